"""How the words of a language's sources differ: pairs of sources, and the words that set one source off from its language.

Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased. A language keeps the terms that stand in
LEAST_DOCS of its documents. Where a term occurs `count` times in a group (the rows of one language and source) or in the
whole language, its frequency there is p = 1 + floor(1e9 * (count + 2) / (N + 2 V)): N sums the counts of the V kept terms.
Two frequencies diverge by floor((p - q)^2 / (p + q)); a pair of sources by the sum over all V terms.

The sum isn't taken over V terms for each pair. Each pair starts at V times the divergence of two zero counts. A term of one
source corrects it by what its count changes against a zero on the other side; since that depends on the count alone, a group
gives one correction for each count that occurs in it and each other source. The inverted index (term, its groups) then
corrects pairs of groups that share a term by what both counts change together. Corrections of zero are not emitted.

Documents are never shuffled: a task counts the terms of each group that it reads and hands sums on. Pairs of groups are
rows of the result. Nothing is broadcast but what `small` has counted.

Defined results: null text, lang and source count as ''. A group without a kept term has frequencies like any other; with
V = 0 its pairs have value 0 and there are no terms. A language of one source has no pairs. Ties of value are ranked by
the item's UTF-8 bytes. Repeated rows count as often as they stand; doc_id and further columns are not read. No rows, no
result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.runtime import cut, map_arrow, new_folder, small

LEAST_DOCS, TOP, UNIT = 10, 10, 1_000_000_000
#: Terms that a task holds before it hands their counts on.
HELD = 300_000
#: A-Z to a-z; what no term holds becomes a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def terms(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8 bytes."""
    return text.encode().translate(TERM_BYTES).split()


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs: occurrences and documents of each term, summed over what a task reads between two outputs.

    A group's empty term, which no text holds, says that the group occurs."""
    held: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    size = 0

    def hand_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in held.items():
            rows = list(found.items())
            for k in range(0, len(rows), 50_000):
                part = rows[k : k + 50_000]
                columns = [[lang] * len(part), [source] * len(part), [t.decode() for t, _ in part], [n for _, (n, _) in part], [d for _, (_, d) in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, COUNTS, strict=True)], schema=COUNTS)

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            group = held.setdefault((lang.as_py(), source.as_py()), {b"": [0, 0]})
            before = len(group)
            for term, n in Counter(terms(text.as_py())).items():
                sums = group.setdefault(term, [0, 0])
                sums[0] += n
                sums[1] += 1
            size += len(group) - before
            if size > HELD:
                yield from hand_on()
                held, size = {}, 0
    yield from hand_on()


def frequency(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * kept)), exact: three decimal places at a time, so no product passes 64 bits."""
    below = total + 2 * kept
    out, rest = F.lit(0).cast("bigint"), count + 2
    for _ in range(3):
        out, rest = out * 1000 + divided(rest * 1000, below), (rest * 1000) % below
    return out + 1


def divided(a: Column, b: Column) -> Column:
    """The whole quotient of two integers of 64 bits."""
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return divided((p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: all pairs of sources of a language, and each group's `top` terms."""
    spark = docs.sparkSession
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    rows = map_arrow(rows, term_counts, "lang string, source string, term string, n bigint, docs bigint")
    counts = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # a table, as later plans read single columns of it
    path = new_folder(spark, "terms")
    counts.write.parquet(path)
    counts = spark.read.parquet(path)
    groups = counts.filter("term = ''").select("lang", "source")
    whole = cut(counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs"))
    langs = groups.select("lang").distinct().join(whole.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n_lang").alias("total_lang")), "lang", "left").na.fill(0)
    postings = counts.filter("term <> ''").select("lang", "source", "term", "n").join(small(whole, weight=F.length("term")), ["lang", "term"])
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").na.fill(0).join(langs, "lang")
    zero = F.when(F.col("kept") > 0, frequency(F.lit(0).cast("bigint"), F.col("total"), F.col("kept")))
    groups = cut(groups.withColumn("p0", zero))
    postings = postings.join(small(groups), ["lang", "source"]).withColumn("p", frequency(F.col("n"), F.col("total"), F.col("kept")))
    postings = cut(postings.withColumn("q", frequency(F.col("n_lang"), F.col("total_lang"), F.col("kept"))).select("lang", "source", "term", "n", "p", "q", "p0"))
    return pair_values(groups, postings).unionByName(term_values(postings, top)).select("lang", "source", "part", "item", "value", "rank")


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))))


def term_values(postings: DataFrame, top: int) -> DataFrame:
    rows = postings.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    return ranked(rows).filter(F.col("rank") <= top)


def pair_values(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """Both directions of each pair of sources of a language."""
    side = lambda frame, s, *more: frame.select("lang", *(F.col(c).alias(f"{c}_{s}") for c in ("source", *more)))
    pairs = cut(side(groups, "a", "p0").join(side(groups, "b", "p0", "kept"), "lang").filter("source_a <> source_b"))
    p0_a, p0_b = F.col("p0_a"), F.col("p0_b")
    start = pairs.select("lang", "source_a", "source_b", F.coalesce(F.col("kept_b") * divergence(p0_a, p0_b), F.lit(0)).alias("value"))
    # counts on one side only: as many terms as have the count
    by_count = postings.groupBy("lang", F.col("source").alias("source_a"), "p").agg(F.count("*").alias("terms"))
    one = pairs.join(by_count, ["lang", "source_a"]).select("lang", "source_a", "source_b", (F.col("terms") * (divergence(F.col("p"), p0_b) - divergence(p0_a, p0_b))).alias("value"))
    one = one.groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
    one = one.union(one.select("lang", "source_b", "source_a", "value"))
    # counts on both sides: what they change beyond the two corrections above
    both = side(postings, "a", "term", "p", "p0").withColumnRenamed("term_a", "term").join(side(postings, "b", "term", "p", "p0").withColumnRenamed("term_b", "term"), ["lang", "term"]).filter("source_a < source_b")
    p_a, p_b = F.col("p_a"), F.col("p_b")
    both = both.select("lang", "source_a", "source_b", (divergence(p_a, p_b) - divergence(p_a, p0_b) - divergence(p0_a, p_b) + divergence(p0_a, p0_b)).alias("value")).filter("value <> 0")
    both = both.groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
    both = both.union(both.select("lang", "source_b", "source_a", "value"))
    sums = start.union(one).union(both).groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
    return ranked(sums.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), "value"))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(c) AS n FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, CAST(count(*) AS HUGEINT) AS c FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
t AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
    1 + 1000000000 * (coalesce(c.c, 0) + 2) // (coalesce(t.n, 0) + 2 * l.v) AS p, 1 + 1000000000 * (k.c + 2) // (l.n + 2 * l.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q
),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM z WHERE part = 'pair' OR rank <= 10
"""
