"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Texts are words (runs of letters and digits, lower case). Each fixed mask of MASKS takes some of the words that follow a
position and ignores the others, so a substituted word at an ignored place doesn't change the mask's hash. Positions of
documents and of benchmark items with equal hashes are hits; hits with one difference of positions are one diagonal of
(document, item). Around the hits of a diagonal all words are compared: it is an overlap if WINDOW words of the item have
at most MISSES substitutions, or if at least SHARE of the item's words are equal. The masks find every window of 13 words
with two substitutions and every one of 15 with three; SHORT_MASKS complete items of up to SHORT_ITEM words and
PAIR_MASKS those of two, so no such overlap is lost.

The item side is small; while it has at most BROADCAST_ROWS positions it is broadcast, beyond it the joins are shuffled.
Documents' words are hashed and compared in place and never shuffled on the broadcast path; only documents on a diagonal
are read again for the comparison. A passage that very many documents share makes one row for each of them.

Defined results: null texts have no words; items with fewer than two words match nothing. The result has one row per
(doc_id, item_id): the diagonal with most equal words, the first of ties. Repeated rows give one row, as do rows of one
doc_id and equal text; null doc_ids or item_ids are kept as null. Further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.llm.runtime import cut, free_name, small

#: Fixed masks: 1 compares a word, 0 ignores it. All begin with two words compared, which a cheap join checks first.
MASKS = ("11111", "111011", "110111")
#: Further masks for items of up to SHORT_ITEM words, which have too few places for the others.
SHORT_MASKS, SHORT_ITEM = ("1111", "11011", "111"), 11
#: For items of two words, the fewest that an item has; of up to four words all must be equal.
PAIR_MASKS, LEAST_ITEM = ("11",), 2
WINDOW, MISSES, SHARE = 13, 2, 0.8
SPAN = max(map(len, MASKS))
#: The most words of all items that are broadcast.
BROADCAST_WORDS = 2_000_000


def words(column: str) -> Column:
    """The text's words; the last may be empty where the text ends in other characters."""
    begun = F.regexp_replace(F.lower(F.coalesce(F.col(column), F.lit(""))), r"^[^\p{L}\p{N}]+", "")
    return F.split(begun, r"[^\p{L}\p{N}]+", -1)


def positions(rows: DataFrame, *keep: str) -> DataFrame:
    """`keep`, pos, w0 ... : each position's word hashes, as far as the longest mask reaches (null beyond the end)."""
    hashed = rows.select(*keep, F.transform("words", lambda w: F.when(w != "", F.xxhash64(w))).alias("h"))
    zipped = F.arrays_zip(*[F.slice("h", k + 1, F.size("h")).alias(f"w{k}") if k else F.col("h").alias("w0") for k in range(SPAN)])
    out = hashed.select(*keep, F.posexplode(zipped).alias("pos", "w"))
    return out.select(*keep, "pos", *[F.col("w").getField(f"w{k}").alias(f"w{k}") for k in range(SPAN)]).filter("w1 IS NOT NULL")


def seeds(rows: DataFrame, *keep: str, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """`keep`, pos, seed: a row for each mask that lies within the text there."""

    def one(mask: str) -> Column:
        used = [F.col(f"w{j}") for j, c in enumerate(mask) if c == "1"]
        return F.when(used[-1].isNotNull(), F.xxhash64(F.lit(mask), *used))

    return rows.select(*keep, "pos", F.explode(F.array(*[one(m) for m in masks])).alias("seed")).filter("seed IS NOT NULL")


def diagonals(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, shift (document position less item position) of all hits, distinct."""
    item_at = cut(positions(items.withColumn("n", F.size("words")), "item_id", "n"))
    short, pair = item_at.filter(F.col("n") <= SHORT_ITEM), item_at.filter(F.col("n") == LEAST_ITEM)
    pairs = small(cut(item_at.select(F.xxhash64("w0", "w1").alias("pair")).distinct()))
    item_seeds = small(cut(seeds(item_at, "item_id").union(seeds(short, "item_id", masks=SHORT_MASKS)).union(seeds(pair, "item_id", masks=PAIR_MASKS)).select("item_id", F.col("pos").alias("item_pos"), "seed").distinct()))
    doc_at = positions(docs.select("doc_id", words("text").alias("words")), "doc_id").withColumn("pair", F.xxhash64("w0", "w1"))
    begun = doc_at.join(pairs, "pair", "left_semi")
    masks = MASKS + (() if short.isEmpty() else SHORT_MASKS) + (() if pair.isEmpty() else PAIR_MASKS)
    return seeds(begun, "doc_id", masks=masks).join(item_seeds, "seed").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, doc_start, n_tokens (of the item), n_matched, window_matched of each overlap."""
    items = cut(benchmark.select(F.col("item_id"), F.filter(words("text"), lambda w: w != "").alias("words")).filter(F.size("words") >= LEAST_ITEM).distinct())
    docs = docs.select("doc_id", "text")
    found = cut(diagonals(docs, items))
    suspects = small(cut(found.select("doc_id").distinct()))
    texts = docs.join(suspects, docs["doc_id"].eqNullSafe(suspects["doc_id"]), "left_semi").select("doc_id", words("text").alias("doc_words")).distinct()
    side = found.withColumnRenamed("doc_id", "d").withColumnRenamed("item_id", "i")
    both = texts.join(small(side), F.col("doc_id").eqNullSafe(F.col("d"))).join(small(items, BROADCAST_WORDS, F.size("words")), F.col("item_id").eqNullSafe(F.col("i")))
    shift, n = F.col("shift"), F.size("words")
    doc_part = F.slice("doc_words", F.greatest(shift, F.lit(0)) + 1, n)
    item_part = F.slice("words", F.greatest(-shift, F.lit(0)) + 1, n)
    equal = F.zip_with(doc_part, item_part, lambda a, b: F.when(a == b, 1).otherwise(0))
    both = both.select("doc_id", "item_id", "shift", n.alias("n"), equal.alias("equal"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size("equal") - WINDOW + 1, F.lit(1))), lambda k: total(F.slice("equal", k, WINDOW)))
    scored = both.select("doc_id", "item_id", "shift", "n", total(F.col("equal")).alias("n_matched"), F.array_max(windows).alias("window_matched"))
    kept = scored.filter((F.col("n_matched") >= F.ceil(F.col("n") * SHARE)) | (F.col("n") >= WINDOW) & (F.col("window_matched") >= WINDOW - MISSES))
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("n_matched"), "shift")
    kept = kept.withColumn("rank", F.row_number().over(best)).filter("rank = 1")
    return kept.select("doc_id", "item_id", F.greatest("shift", F.lit(0)).cast("bigint").alias("doc_start"), F.col("n").cast("bigint").alias("n_tokens"), F.col("n_matched").cast("bigint").alias("n_matched"), F.col("window_matched").cast("bigint").alias("window_matched"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, without those whose text has an overlap. Rows are told by their texts' 64-bit hash, so
    a null or repeated doc_id drops no other row."""
    text, own = F.xxhash64(F.coalesce(docs["text"], F.lit(""))), free_name(docs, "text_hash")
    bad = cut(overlaps(docs.select(text.alias("doc_id"), docs["text"]), benchmark).select(F.col("doc_id").alias(own)).distinct())
    return docs.join(small(bad), text == F.col(own), "left_anti")


ORACLE_SQL = r"""
WITH dt AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM documents),
bt AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS t FROM benchmark),
d AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS pos FROM dt),
b AS (SELECT item_id, len(t) AS n, unnest(t) AS w, unnest(range(len(t))) AS pos FROM bt),
p AS (SELECT doc_id, item_id, n, d.pos - b.pos AS shift, b.pos AS pos FROM d JOIN b USING (w)),
c AS (SELECT *, count(*) OVER g AS n_matched, count(*) OVER (g ORDER BY pos RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS ahead
      FROM p WINDOW g AS (PARTITION BY doc_id, item_id, shift) QUALIFY n_matched >= least(11, ceil(n * 0.8))),
s AS (SELECT doc_id, item_id, shift, n, n_matched, max(ahead) AS window_matched FROM c GROUP BY ALL),
k AS (SELECT * FROM s WHERE n >= 2 AND (n_matched >= ceil(n * 0.8) OR n >= 13 AND window_matched >= 11)
      QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_matched DESC, shift) = 1)
SELECT doc_id, item_id, greatest(shift, 0) AS doc_start, CAST(n AS BIGINT) AS n_tokens, n_matched, window_matched FROM k
"""
