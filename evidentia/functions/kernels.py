"""Scalar text functions that Spark has no expression for, and how they become Arrow-batched columns.

Spark cannot return a Unicode-normalised string, so folds are Python; `udf()` sends them Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Characters that count as an apostrophe or a hyphen in quotations, and the soft hyphen, which counts as nothing.
APOSTROPHES, HYPHENS, SOFT_HYPHEN = "’‘ʼ", "‐‑‒–—―−﹘﹣－", "­"
QUOTATION = str.maketrans(dict.fromkeys(APOSTROPHES, "'") | dict.fromkeys(HYPHENS, "-") | {SOFT_HYPHEN: None})
WORD = re.compile(r"[^\W_]+")


#: The most bytes of an Arrow batch, about: a worker holds a batch and its results as Python values, which take many times that.
BATCH_BYTES = 1 << 20


def udf(kernel: Callable, returns: str) -> Callable:
    """A kernel of one row as a column function with Arrow transfer; results of null arguments are the kernel's business."""

    def column(*columns):
        small_batches()
        return F.udf(kernel, returns, useArrow=True)(*columns)

    return column


def small_batches() -> None:
    """Bounds the session's Arrow batches by bytes, so that workers' memory doesn't grow with the rows of a partition."""
    spark, name = SparkSession.active(), "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def unaccented(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def collapse(text: str | None) -> str:
    """Case folded, white space collapsed."""
    return " ".join((text or "").casefold().split())


def quotation(text: str | None) -> str:
    """The form in which quotations are compared: no accents, plain apostrophes and hyphens, folded, collapsed."""
    return collapse(unaccented(text or "").translate(QUOTATION))


def identity(text: str | None) -> str:
    """The form in which identities are searched: URL-decoded, compatibility-composed, folded."""
    return unicodedata.normalize("NFKC", unquote(text or "")).casefold()


def unicode_form(text: str | None) -> str:
    return unicodedata.normalize("NFKC", text or "")


def identity_key(text: str | None) -> str:
    return "".join(c for c in identity(text) if c.isalnum())


def identity_words(text: str | None) -> list[str]:
    return WORD.findall(identity(text))


def spaced_identity(text: str | None) -> str:
    return " ".join(identity_words(text))


def ascii_words(text: str | None) -> list[str]:
    folded = unicodedata.normalize("NFKD", unquote(text or "")).casefold()
    return re.findall(r"[a-z0-9]+", folded.encode("ascii", "ignore").decode())


def ascii_key(text: str | None) -> str:
    """Letters and digits that remain in ASCII."""
    folded = unicodedata.normalize("NFKD", (text or "").casefold())
    return "".join(c for c in folded.encode("ascii", "ignore").decode() if c.isalnum())


def folded_key(text: str | None) -> str:
    """Letters and digits without accents."""
    return "".join(c for c in unaccented(text or "").casefold() if c.isalnum())


def phrase_key(text: str | None) -> str:
    """Words without accents, joined by one space."""
    return " ".join(WORD.findall(unaccented(text or "").casefold()))


def plain_key(text: str | None) -> str:
    return "".join(c for c in (text or "").casefold() if c.isalnum())


def brand_words(text: str | None) -> list[str]:
    return sorted({w.lower() for w in re.findall(r"[A-Za-z0-9]+", unaccented(text or ""))})


def literal_pattern(value: str | None, fold: Callable[[str], str] = lambda v: unicodedata.normalize("NFKC", v)) -> str:
    """A pattern for a value with free separators between its words and no letter or digit around it; empty without words."""
    words = WORD.findall(fold(value or ""))
    return r"(?<![^\W_])" + r"[\W_]*".join(map(re.escape, words)) + r"(?![^\W_])" if words else ""


def find_literal(value: str | None, source: str, start: int = 0) -> re.Match | None:
    pattern = literal_pattern(value)
    return re.compile(pattern, re.IGNORECASE).search(source, start) if pattern else None


def all_literal(value: str | None, source: str) -> list[re.Match]:
    pattern = literal_pattern(value)
    return list(re.finditer(pattern, source, re.IGNORECASE)) if pattern else []


def identities_in(value: str | None, source: str | None) -> list[str]:
    """Every place where an identity stands in a folded text."""
    pattern = literal_pattern(value, identity)
    return re.findall(pattern, identity(source)) if pattern else []


def identity_present(value: str | None, source: str | None) -> bool:
    return bool(identities_in(value, source))


def valid_ean(value: str | None) -> bool:
    """Check digit of EAN-8, UPC-A, EAN-13 or GTIN-14."""
    digits = (value or "").strip()
    if len(digits) not in (8, 12, 13, 14) or not digits.isdigit():
        return False
    weighted = sum(int(d) * (3 if k % 2 == 0 else 1) for k, d in enumerate(digits[-2::-1]))
    return (weighted + int(digits[-1])) % 10 == 0


def decode_ladder(data: bytes | None) -> str:
    """UTF-8, else Windows-1252, else UTF-8 with replacement characters."""
    for encoding in ("utf-8", "cp1252"):
        try:
            return bytes(data or b"").decode(encoding)
        except UnicodeDecodeError:
            continue
    return bytes(data or b"").decode("utf-8", "replace")


def exact_span(excerpt: str | None, content: str | None) -> str:
    """The place of a quotation in a page, literally: as it is, else with other white space, else the only place that is
    equal without accents. Empty if there is none."""
    if not excerpt or not content:
        return ""
    if excerpt in content:
        return excerpt
    free = re.search(r"\s+".join(map(re.escape, re.split(r"\s+", excerpt))), content)
    if free:
        return free[0]
    wanted, _ = bare(excerpt)
    have, place = bare(content)
    at = have.find(wanted)
    if not wanted or at < 0 or have.find(wanted, at + 1) >= 0:
        return ""
    return content[place[at][0] : place[at + len(wanted) - 1][1]]


def bare(text: str) -> tuple[str, list[tuple[int, int]]]:
    """A text without accents, white space runs as one space, and each character's span in the original."""
    out, place = [], []
    for k, c in enumerate(text):
        if c.isspace():
            if out and out[-1] == " ":
                place[-1] = (place[-1][0], k + 1)
                continue
            out.append(" ")
            place.append((k, k + 1))
            continue
        for base in unicodedata.normalize("NFD", c):
            if not unicodedata.combining(base):
                out.append(base)
                place.append((k, k + 1))
    return "".join(out), place
