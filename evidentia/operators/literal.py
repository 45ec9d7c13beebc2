"""Phrases that stand literally in documents, found by an equi-join.

A phrase's words but its first and last are whole words of any text that holds it. So the hash of its second and third
word is a key that such a document has; the document's text then decides. Phrases of fewer words have one whole word or none:
their key is a run of GRAM characters, which any text that holds them has too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, GRAM = 4, 3
#: The most keys that are broadcast to drop a document's other keys before they are shuffled.
BROADCAST_KEYS = 200_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def grams(text: Column, sizes: list[int]) -> Column:
    """All different runs of characters of the given sizes."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)) for size in sizes]))


def few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def occurrences(phrases: DataFrame, docs: DataFrame) -> DataFrame:
    """phrases (phrase and others) with each of `docs` (text and others) that holds them, without text.

    An empty or null phrase stands in no text. Rows of `docs` are told by their text, so an id may be null or stand twice."""
    texts = docs.filter("text IS NOT NULL").withColumn("_text", F.xxhash64("text"))
    own = phrases.filter("phrase != ''").withColumn("_w", words(F.col("phrase")))
    long = own.filter(F.size("_w") >= LEAST_WORDS).withColumn("_key", F.xxhash64(F.get("_w", F.lit(1)), F.get("_w", F.lit(2)))).drop("_w")
    two = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.xxhash64(F.get("w", i - 1), F.get("w", i)))
    by_words = texts.select("_text", words(F.col("text")).alias("w")).filter(F.size("w") >= 2).select("_text", F.explode(F.array_distinct(two)).alias("_key"))
    # the middle of a phrase is a rarer key than its ends, which are mostly first letters and signs
    size = F.least(F.length("phrase"), F.lit(GRAM))
    short = own.filter(F.size("_w") < LEAST_WORDS).withColumn("_key", F.xxhash64(F.substring("phrase", ((F.length("phrase") - size) / 2).cast("int") + 1, size))).drop("_w")
    sides = [(long, by_words)]
    if sizes := [r[0] for r in short.select(size).distinct().collect()]:  # GRAM different ones at most
        by_grams = texts.select("_text", F.explode(grams(F.col("text"), sorted(sizes))).alias("g")).select("_text", F.xxhash64("g").alias("_key"))
        sides.append((short, by_grams))
    out = None
    for keyed, held in sides:
        met = held.join(few(keyed.select("_key").distinct()), "_key", "left_semi").distinct().join(keyed, "_key").drop("_key")
        found = met.join(texts, "_text").filter(F.contains("text", F.col("phrase"))).drop("text", "_text")
        out = found if out is None else out.unionByName(found)
    return out
