"""Clean text of fetched HTML: identity of the head, then the body without scripts, navigation and hidden parts."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

from evidentia.functions.kernels import udf

# Elements that are no text or are a site's navigation; keys of structured data that name the product.
NO_TEXT, NAVIGATION = frozenset("script style noscript svg template".split()), frozenset("nav header footer".split())
IDENTITY_KEYS, OWNERS = frozenset("name sku mpn productid item".split()), ("brand", "manufacturer", "seller")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAST, MOST_LINES, MOST_CHARS = 100, 32, 500


def normalized(text: str | None) -> str:
    """No zero-width characters, white space collapsed in each line, no empty lines."""
    lines = re.sub("[​‌‍﻿]", "", text or "").splitlines()
    return "\n".join(filter(None, (" ".join(x.split()) for x in lines)))


class Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []
        self.title, self.data, self.body, self.json_ld = [], [], [], []

    def handle_starttag(self, tag, attributes):
        at = dict(attributes)
        hidden = tag in NO_TEXT | NAVIGATION or at.get("role") == "navigation" or "hidden" in at or at.get("aria-hidden") == "true"
        if tag not in VOID:
            self.stack.append((tag, hidden))
        if tag == "script" and (at.get("type") or "").casefold() == "application/ld+json":
            self.json_ld.append("")

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return

    def handle_data(self, text):
        tags = [t for t, _ in self.stack]
        if tags[-1:] == ["script"] and self.json_ld:
            self.json_ld[-1] += text
        if "title" in tags and "svg" not in tags:
            self.title.append(text)
        elif "head" not in tags and not any(h for _, h in self.stack):
            self.body.append(text)


def named(value: object, owner: str = "") -> list[tuple[str, object]]:
    """Identity values of structured data with their labels."""
    if isinstance(value, list):
        return [x for v in value for x in named(v, owner)]
    out = []
    for key, v in value.items() if isinstance(value, dict) else ():
        key = key.casefold()
        if key in IDENTITY_KEYS and isinstance(v, (str, int, float)) and not isinstance(v, bool):
            out.append((f"jsonld.{owner}.{key}" if owner in OWNERS else f"jsonld.{key}", v))
        out += named(v, key)
    return out


def clean(source: str | None) -> dict[str, str]:
    """content and title; no content where it is shorter than LEAST."""
    reader = Reader()
    reader.feed(source or "")
    reader.close()
    title = normalized(" ".join(reader.title))
    facts: list[tuple[str, object]] = [("title", title)] if title else []
    for raw in reader.json_ld:
        try:
            facts += named(json.loads(raw))
        except ValueError:
            continue
    lines = list(dict.fromkeys(f"{label}: {text}" for label, v in facts if (text := normalized(str(v))[:MOST_CHARS])))[:MOST_LINES]
    content = normalized("\n".join([*lines, *(t.strip() for t in reader.body)]))
    return {"content": content if len(content) >= LEAST else "", "title": title}


clean_html = udf(clean, "struct<content:string,title:string>")
