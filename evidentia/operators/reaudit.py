"""Second pass over pages that were fetched already: proofs for open criteria, official ones for proven criteria, and
secondary incompatibilities that a manufacturer's page takes back. Nothing is fetched and no model is asked.

Pages and candidates meet by mission where the page's identity key contains the candidate's, a native test of keys that
are computed once a page and once a candidate; only such pairs are read for windows and excerpts."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import kernels as k
from evidentia.functions import quantity, scan
from evidentia.functions.urls import canonical, canonical_url, is_list_page
from evidentia.operators import evidence
from evidentia.operators.identity import Brands, applicable, official_page, page_names, primary_content
from evidentia.operators.matching import meetings
from evidentia.runtime import cut

# Characters of windows before and behind an identity, of merged windows and of official ones; and how many.
BEFORE, BEHIND, MERGED, OFFICIAL, SECTION = 350, 550, 1_800, 12_000, 1_200
MOST_ALIASES, MOST_MATCHES, MOST_WINDOWS = 16, 24, 12
# Words of labels for usages, headings of nominal currents, and words that don't count in a usage.
USAGE_LABELS = ("usage", "utilisation", "application")
CURRENT_LABELS = ("courant nominal", "rated operational current", "operational current", "rated current")
STOP = frozenset(["a", "au", "aux", "de", "des", "du", "et", "la", "le", "les", "of", "the", "to"])
# What announces another product, and prefixes of standards, which look like codes.
OTHERS, OTHER_THINGS = ("related", "other"), ("product", "model", "reference", "ref", "produit", "modèle", "modele", "référence", "réference", "reférence")
# Units with and without a kind of current, and what else a technical code is made of.
SUPPLIES = frozenset(u + c for u in ("v", "a") for c in ("ac", "dc"))
STANDARDS = frozenset(["iec", "en", "ul", "vde", "gb", "csa", "nf", "iso", "din", "ansi", "nema", "rohs", "reach", "ce"])
ALONE = frozenset(["ac", "dc", "pole", "phase", "stack"])  # those that may be a part of their own
TECHNICAL = STANDARDS | SUPPLIES | {u + c for u in ("v", "a", "ma", "ka") for c in ("", "ac", "dc")} | {"no", "nc", "nf", "hz", "ac", "dc", "ip", "ec", "pole", "phase", "stack"}
FAMILY_WORDS = frozenset(["famille", "family", "serie", "series"])


def asks_family(label: str) -> bool:
    """Does a requirement's id and label ask for a product family?"""
    text = k.quotation(label)
    return bool(FAMILY_WORDS & set(text.split())) or "product range" in text or "gamme produit" in text


def names_family(value: str | None) -> bool:
    """Is a value code-like, and no quantity?"""
    key = "".join(c for c in k.quotation(value) if c.isalnum())
    return len(key) >= 4 and any(c.isalpha() for c in key) and any(c.isdigit() for c in key) and not quantity.is_quantity(value)


def aliases_of(reference: str, found: list | None) -> list[str]:
    """Distinct codes of five characters or more: the reference first, then what official pages call the product."""
    first: dict[str, str] = {}
    for value in [reference, *(found or [])]:
        key = k.plain_key(value)
        if len(key) >= 5 and any(c.isalpha() for c in key) and any(c.isdigit() for c in key):
            first.setdefault(key, value)
    return list(first.values())


def official_aliases(reference: str, url: str, content: str | None, family: str | None) -> list[str]:
    """Other names of a product that its maker's page has literally: a family's value, and the URL's codes with their first parts."""
    if not content or k.find_literal(reference, content) is None:
        return []
    out = [family] if family and names_family(family) and k.find_literal(family, content) else []
    for code, _, _ in scan.codes(unquote(url), "-_"):
        if not code.isalnum() and k.find_literal(code, content):
            out += [code, re.split("[-_]", code)[0]]
    return out


def technical(code: str) -> bool:
    """Does a code have technical words and numbers only, or end with a supply's value, and so names no product?"""
    parts = [re.findall(r"\d+|\D+", p) for p in re.split("[-_]", code.casefold())]
    words = {run for p in parts for run in p if not run.isdigit()}
    last = parts[-1]
    alone = all(len(p) > 1 or p[0].isdigit() or p[0] in ALONE for p in parts if p)  # DIN35 is a standard, DIN-35 may be a code
    return bool(words) and words <= TECHNICAL and alone or len(parts) > 1 and len(last) == 2 and last[0].isdigit() and last[1] in SUPPLIES


def window_end(content: str, start: int, end: int, aliases: list[str], brand: str) -> int:
    """`end`, or where another product begins before it: by announcement, or by the brand anew and an unknown code."""
    words = list(k.WORD.finditer(content, start, end))
    for a, b in zip(words, words[1:]):
        if a[0].casefold() in OTHERS and b[0].casefold() in OTHER_THINGS and not content[a.end() : b.start()].strip():
            end = a.start()
            break
    again = k.find_literal(brand, content, start) if k.literal_pattern(brand) else None
    if again is None or again.end() > end:
        return end
    known = {k.plain_key(x) for x in aliases}
    for code, at, _ in scan.codes(content[again.end() : end], "-_"):
        if len(code) >= 3 and (scan.mixed(code) or code.casefold().startswith(("ref-", "ref_"))) and k.plain_key(code) not in known and not technical(code):
            return again.end() + at
    return end


def identity_windows(content: str, shown: list[str], known: list[str], brand: str) -> list[str]:
    """Texts around the identities of a product, merged while they overlap and stay short."""
    places = ((m.start(), m.end()) for alias in shown[:MOST_ALIASES] for m in k.all_literal(alias, content))
    spans = {(max(0, a - BEFORE), window_end(content, b, min(len(content), b + BEHIND), known or shown, brand)) for (a, b), _ in zip(places, range(MOST_MATCHES))}
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1] and b - merged[-1][0] <= MERGED:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [content[a:b] for a, b in merged[:MOST_WINDOWS]]


def official_windows(content: str, reference: str, known: list[str], brand: str) -> list[str]:
    """Longer texts behind each occurrence of the reference on its maker's page."""
    found = (content[max(0, m.start() - BEFORE) : window_end(content, m.end(), min(len(content), m.end() + OFFICIAL), known, brand)] for m in k.all_literal(reference, content))
    return list(dict.fromkeys(found))[:MOST_WINDOWS]


def windows(content: str, reference: str, brand: str, known: list, official: bool) -> list[str]:
    shown = list(dict.fromkeys([reference, *(a for a in known if len(k.plain_key(a)) >= 8)]))
    found = identity_windows(content, shown, known, brand)
    return list(dict.fromkeys([*found, *(official_windows(content, reference, known, brand) if official else [])]))


def contact_evidence(label: str, requested: str, window: str) -> str:
    """The clause that states the requested number of normally open main contacts; auxiliary contacts never do."""
    value = k.quotation(requested)
    number = re.search(r"\d+", value)
    if "contact" not in k.quotation(label) or "no" not in k.WORD.findall(value) or not number:
        return ""
    joined = re.sub(r":\s*[\r\n]\s*", lambda m: ":" + " " * (len(m[0]) - 1), window)  # a value on the line behind its label
    for m in re.finditer(r"[^.!?;\r\n]+", joined):
        said = k.quotation(m[0])
        words = k.WORD.findall(said)
        main = {"principaux", "principales", "main"} & set(words) and any(w in ("contact", "contacts") for w in words)
        opens = "fermeture" in words or "normally open" in said or "no" in words
        if main and opens and number[0] in words and not any(w.startswith("auxilia") for w in words):
            return window[m.start() : m.end()].strip()
    return ""


def current_evidence(label: str, requested: str, window: str, reference: str) -> str:
    """A nominal current in utilisation category AC-3: from its heading, the nearest to the reference, to the value."""
    value = k.quotation(requested)
    wanted = next(iter(quantity.read(value)[1]), None)
    if not any(x in k.quotation(label) for x in CURRENT_LABELS) or not ac3(value) or wanted is None or wanted.unit not in ("a", "ma", "ka"):
        return ""
    text = window.casefold()
    places = sorted({(at.start(), end) for x in CURRENT_LABELS for at in re.finditer(r"\s+".join(x.split()), text) if (end := heading_end(text, at.end()))})
    headings = [p for j, p in enumerate(places) if j == 0 or p[0] >= places[j - 1][1]]
    if not headings:
        return ""
    apart = lambda m, h: min(abs(m.start() - h[1]), abs(h[0] - m.end()))
    near = {min(range(len(headings)), key=lambda j: apart(m, headings[j])) for m in k.all_literal(reference, window)}
    for j in sorted(near) or range(len(headings)):
        start, end = headings[j]
        stop = min(len(window), end + SECTION, headings[j + 1][0] if j + 1 < len(headings) else len(window))
        if found := k.find_literal(f"{scan.tokens(value[wanted.start :])[0].text} {wanted.unit}", window[end:stop]):
            return window[start : end + found.end()]
    return ""


def ac3(text: str) -> bool:
    words = scan.tokens(text)
    return any(a.text == "ac" and ((b.text == "3" and not scan.word_at(text, b.end)) or b.text == "-" and j + 2 < len(words) and words[j + 2].text == "3") for j, (a, b) in enumerate(zip(words, words[1:])))


def heading_end(text: str, start: int) -> int:
    """Where `AC-3` ends behind a heading's words, on the same line within 120 characters; 0 if it isn't there."""
    line = text[start : start + 130].split("\n")[0]
    m = re.search(r"\bac\s?-?\s?3\b", line)
    return start + m.end() if m and m.start() <= 120 else 0


def usage_evidence(label: str, requested: str, window: str) -> str:
    """The words of one of several usages, in order, each near the one before."""
    if not any(x in k.quotation(label) for x in USAGE_LABELS):
        return ""
    there = [(k.folded_key(m[0]), m.start(), m.end()) for m in k.WORD.finditer(window)]
    for branch in re.split(r"[/;]|\bou\b|\bor\b", requested, flags=re.I):
        stems = [w.rstrip("s") for w in k.WORD.findall(k.quotation(branch)) if len(w) >= 4 and w not in STOP]
        for j, (word, start, end) in enumerate(there):
            if len(stems) < 2 or not word.startswith(stems[0]):
                continue
            for stem in stems[1:]:
                following = next((x for x in there[j + 1 :] if x[0].startswith(stem)), None)
                if following is None or following[1] - end > 100:
                    break
                j, end = there.index(following), following[2]
            else:
                return window[start:end]
    return ""


def requirement_evidence(label: str, requested: str, shown: list, reference: str) -> str:
    """The first window's excerpt that states a requested value: literally, else by one of the readers."""
    for window in shown or []:
        direct = k.find_literal(requested, window)
        found = direct[0] if direct else contact_evidence(label, requested, window) or current_evidence(label, requested, window, reference) or usage_evidence(label, requested, window)
        if found:
            return found
    return ""


def candidate_aliases(criteria: DataFrame, requirements: DataFrame, pages: DataFrame, brands: Brands) -> DataFrame:
    """mission_id, candidate_id, aliases: names that official proofs' pages give to the candidate; pages are canonical."""
    rows = criteria.join(requirements.select("mission_id", "requirement_id", "label"), ["mission_id", "requirement_id"], "left").select("mission_id", "candidate_id", "brand", "reference", "ord", F.when(k.udf(asks_family, "boolean")(F.concat_ws(" ", "requirement_id", "label")), F.col("observed_value")).alias("family"), F.posexplode("proofs").alias("p", "proof"))
    rows = rows.filter((F.col("proof.type") == "web_officiel") & ~is_list_page(F.col("proof.url"))).withColumn("url", canonical_url("proof.url"))
    owned = k.udf(lambda u, b: brands.owns(u, b), "boolean")
    found = rows.filter(owned("proof.url", "brand")).join(pages.select("mission_id", "url", "content"), ["mission_id", "url"]).withColumn("names", k.udf(official_aliases, "array<string>")("reference", "proof.url", "content", "family"))
    said = found.groupBy("mission_id", "candidate_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "p", "names"))), lambda x: x["names"])).alias("said"))
    people = criteria.select("mission_id", "candidate_id", "brand", "reference").distinct()
    return people.join(said, ["mission_id", "candidate_id"], "left").withColumn("aliases", k.udf(aliases_of, "array<string>")("reference", "said")).drop("said")


def identity_pages(people: DataFrame, pages: DataFrame, brands: Brands) -> DataFrame:
    """mission_id, candidate_id, url, page_ord, official, shown: pages that may state a candidate's identity, and the windows of those that do."""
    texts = pages.filter((F.col("content") != "") & ~is_list_page(F.col("url"))).select("mission_id", "url", "content", "page_ord")
    near = meetings(people.withColumn("names", F.array_append("aliases", F.col("reference"))), texts, "candidate_id")
    named = near.join(people, ["mission_id", "candidate_id"]).groupBy("mission_id", "url").agg(F.collect_list(F.struct("candidate_id", "brand", "reference", "aliases")).alias("near"))

    def read(url: str, content: str, near: list) -> list[dict]:
        """What a page says of each candidate that it may state."""
        out = []
        for n in near:
            official = official_page(brands, n["brand"], n["reference"], url, content)
            states = page_names(n["brand"], n["reference"], content, tuple(x for x in n["aliases"] if len(k.plain_key(x)) >= 8))
            out.append({"candidate_id": n["candidate_id"], "official": official, "shown": windows(content, n["reference"], n["brand"], n["aliases"], official) if states else None})
        return out

    said = k.udf(read, "array<struct<candidate_id:string,official:boolean,shown:array<string>>>")("url", "content", "near")
    return texts.join(named, ["mission_id", "url"]).select("mission_id", "url", "page_ord", F.explode(said).alias("s")).select("mission_id", "s.candidate_id", "url", "page_ord", "s.official", "s.shown")


def stands_there(urls: list | None, excerpts: list | None, url: str | None, excerpt: str | None) -> bool:
    return url is not None and any(canonical(u) == url and (e or "").casefold() == (excerpt or "").casefold() for u, e in zip(urls or [], excerpts or []))


def reaudit(criteria: DataFrame, requirements: DataFrame, missions: DataFrame, pages: DataFrame, brands: Brands = Brands()) -> DataFrame:
    """One pass: criteria with `reaudited` (`downgraded`, `proven`, `enriched`, or null). `pages`: mission_id, url, content, page_ord.

    Only candidates that a maker's page confirms are looked at. A secondary incompatibility that a maker's page contradicts
    becomes not proven, and can be proven by the next pass only."""
    ids = ["mission_id", "candidate_id", "requirement_id"]
    typed = cut(evidence.with_proof_types(criteria, pages, brands))
    flat = pages.withColumn("url", canonical_url("url"))
    people = cut(candidate_aliases(typed, requirements, flat, brands))
    found = cut(identity_pages(people, flat, brands).select("mission_id", "candidate_id", "url", "page_ord", "official", "shown"))
    confirmed = found.filter("official").select("mission_id", "candidate_id").distinct()
    wanted = applicable(requirements, missions).filter("notable").select("mission_id", "requirement_id", "label", F.col("requested_value").alias("wanted"))
    backed = F.exists("proofs", lambda p: p["type"] == "web_officiel")
    open_ = typed.join(confirmed, ["mission_id", "candidate_id"], "left_semi").join(wanted, ["mission_id", "requirement_id"])
    any_page, maker_only = F.col("status") == "not_proven", ((F.col("status") == "incompatible") & (F.size("proofs") > 0) | (F.col("status") == "proven")) & ~backed
    open_ = open_.filter(any_page | maker_only).select(*ids, "reference", "label", "wanted", any_page.alias("any_page"))
    rows = open_.join(found.filter(F.size("shown") > 0), ["mission_id", "candidate_id"]).filter(F.col("any_page") | F.col("official"))
    rows = cut(rows.withColumn("excerpt", k.udf(requirement_evidence, "string")("label", "wanted", "shown", "reference")).filter("excerpt != ''").select(*ids, "url", "page_ord", "official", "excerpt"))
    group = Window.partitionBy("mission_id", "candidate_id")
    ranked = rows.withColumn("n", F.count("*").over(Window.partitionBy("mission_id", "candidate_id", "url"))).withColumn("place", F.dense_rank().over(group.orderBy(F.desc("n"), F.desc("official"), "page_ord", "url")))
    person = F.to_json(F.struct("mission_id", "candidate_id"))
    fewest = evidence.minimum_pages(ranked.select(person.alias("key"), F.col("place").alias("page_ord"), "url", F.col("requirement_id").alias("criterion")))
    kept = ranked.withColumn("key", person).join(fewest, ["key", "url"], "left_semi")
    taken = kept.groupBy(*ids).agg(F.min_by(F.struct("url", "excerpt", "official"), "place").alias("t"))
    out = typed.join(taken, ids, "left")
    new = F.struct(F.col("t.url").alias("url"), F.col("t.excerpt").alias("excerpt"), F.when(F.col("t.official"), "web_officiel").otherwise("web_secondaire").alias("type"))
    same = k.udf(stands_there, "boolean")(F.col("proofs.url"), F.col("proofs.excerpt"), "t.url", "t.excerpt")
    none = F.array().cast(f"array<{evidence.PROOF}>")
    change = F.when(F.col("t").isNull(), None).when(F.col("status") == "incompatible", "downgraded").when(F.col("status") == "proven", "enriched").otherwise("proven")
    out = out.withColumn("reaudited", change)
    proofs = F.when(F.col("reaudited").isNull(), F.col("proofs")).when(F.col("reaudited") == "downgraded", none).when(F.col("reaudited") == "proven", F.array(new)).when(same, F.col("proofs")).otherwise(F.array_append("proofs", new))
    seen = F.when(F.col("reaudited") == "downgraded", "").when(F.col("reaudited").isin("proven", "enriched"), F.col("t.excerpt")).otherwise(F.col("observed_value"))
    status = F.when(F.col("reaudited") == "downgraded", "not_proven").when(F.col("reaudited").isNotNull(), "proven").otherwise(F.col("status"))
    fallen = F.when(F.col("reaudited").isNotNull(), F.lit(False)).otherwise(F.col("evidence_rejected")) if "evidence_rejected" in criteria.columns else None
    out = out.withColumn("_p", proofs).withColumn("_o", seen).withColumn("_s", status)
    keep = {"proofs": F.col("_p").alias("proofs"), "observed_value": F.col("_o").alias("observed_value"), "status": F.col("_s").alias("status")} | ({"evidence_rejected": fallen.alias("evidence_rejected")} if fallen is not None else {})
    return out.select(*[keep.get(c, F.col(c)) for c in criteria.columns], "reaudited")


def downgraded(before: DataFrame, after: DataFrame, requirements: DataFrame, missions: DataFrame) -> DataFrame:
    """mission_id, candidate_id, downgraded: labels, in requirement order, of incompatibilities that the second pass took back."""
    ids = ["mission_id", "candidate_id", "requirement_id"]
    wanted = applicable(requirements, missions).filter("notable").select("mission_id", "requirement_id", "ord", "label")
    gone = before.filter("status = 'incompatible'").select(*ids).join(after.filter("status != 'incompatible'").select(*ids), ids).join(wanted, ["mission_id", "requirement_id"])
    return gone.groupBy("mission_id", "candidate_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda x: x["label"])).alias("downgraded"))
