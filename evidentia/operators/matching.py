"""Which identities meet, by equi-joins: nested references, and references that pages state.

A reference that lies inside another one is found by its first WINDOW characters, which are a window of the longer one. A
reference that a page states is made of whole words of the page, one behind another; so the page has a word from which on its
letters and digits begin with those of the reference. Both sides get such keys and are joined on them within a mission; what
meets is then checked exactly. No page meets a name that it can't state, and a page is read once for its marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import kernels as k
from evidentia.operators.identity import SHORT_REFERENCE

WINDOW = SHORT_REFERENCE  # a shorter reference is nested in no other
MARK = 6


def short_key(key: Column) -> Column:
    """What a reference key is looked up by where it may be the shorter one."""
    return F.when(F.length(key) >= WINDOW, F.substring(key, 1, WINDOW)).otherwise(key)


def long_keys(key: Column) -> Column:
    """What it offers where it may be the longer one: its windows, or itself."""
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - (WINDOW - 1), F.lit(1))), lambda at: F.substring(key, at, F.lit(WINDOW)))
    return F.array_distinct(windows)


def nested_pairs(left: DataFrame, right: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """Rows of `left` with those of `right` of the same mission, brand_key and `on` whose reference_key is equal or nested.

    `right`'s further columns keep their names, its reference_key becomes other_key. A null or empty key meets only equal ones."""
    same = ["mission_id", "brand_key", *on]
    a = left.withColumn("_ref", F.coalesce("reference_key", F.lit("")))
    b = right.withColumn("other_key", F.coalesce("reference_key", F.lit(""))).drop("reference_key")
    inside = a.withColumn("_key", short_key(F.col("_ref"))).join(b.withColumn("_key", F.explode(long_keys(F.col("other_key")))), [*same, "_key"]).filter(F.contains("other_key", F.col("_ref")) & ((F.col("_ref") == F.col("other_key")) | (F.length("_ref") >= WINDOW)))
    around = a.withColumn("_key", F.explode(long_keys(F.col("_ref")))).join(b.withColumn("_key", short_key(F.col("other_key"))), [*same, "_key"]).filter((F.col("_ref") != F.col("other_key")) & (F.length("other_key") >= WINDOW) & F.contains("_ref", F.col("other_key")))
    return inside.unionByName(around).drop("_key", "_ref")


def starts(words: list[str]) -> set[str]:
    """MARK letters and digits from each word on, and what shorter runs of whole words make."""
    out = set()
    for at in range(len(words)):
        text = ""
        for word in words[at : at + MARK]:
            text += word
            if len(text) >= MARK:
                out.add(text[:MARK])
                break
            out.add(text)
    return out


def page_marks(content: str | None) -> list[str]:
    """The marks of a text as it is and as identities are folded."""
    text = content or ""
    return sorted(starts(k.identity_words(text)) | starts([w.casefold() for w in k.WORD.findall(text)]))


def name_marks(names: list[str | None] | None) -> list[str]:
    """The marks of names; a text that states one of the names has one of its marks."""
    keys = {key for n in names or [] for key in (k.identity_key(n), "".join(k.WORD.findall(k.unicode_form(n))).casefold())}
    return sorted({key[:MARK] for key in keys if key})


def meetings(names: DataFrame, pages: DataFrame, *keep: str) -> DataFrame:
    """mission_id, url, `keep`: pages (mission_id, url, content) that may state one of the `names` (array) of a row of `names`."""
    marks = pages.select("mission_id", "url", F.explode(k.udf(page_marks, "array<string>")("content")).alias("mark"))
    wanted = names.select("mission_id", *keep, F.explode(k.udf(name_marks, "array<string>")("names")).alias("mark")).distinct()
    return marks.join(wanted, ["mission_id", "mark"]).select("mission_id", "url", *keep).distinct()
