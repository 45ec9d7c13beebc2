"""Near-duplicate documents by SimHash: fingerprints of 64 bits that differ in at most DIFFER bits, found by chains of segments.

A text's words are runs of other characters than space, tab, line feed, vertical tab, form feed and carriage return, A-Z
lower-cased. Shingles are runs of SHINGLE words, repeats included; a shorter text is one shingle. A bit of the fingerprint
is 1 if it is 1 in the XXH64 (seed 42) of more than half of the shingles.

Pigeonring: lay the SEGMENTS segments of two fingerprints on a ring. If they differ in DIFFER bits or fewer, there is a
segment from which on every chain of l consecutive segments differs in at most l * DIFFER / SEGMENTS bits. So after turning
both fingerprints to that segment, the first 3 segments (12 bits) are equal, the first 7 differ in one bit at most, the first
11 in two, the first 15 in three. A level t = 1, 2, 3 makes keys of the first 4 t + 3 segments without t of them that may
differ: 24, 36 and 48 bits that must be equal, for each turn and each choice that the budgets allow. Fingerprints that share
a key are candidates; the chain's budgets prune them before all 64 bits are compared, within the join.

Equal fingerprints are one node, so copies cost nothing. In each bucket of level 1 all nodes meet one leader first, the node
that shares most buckets; near copies of one text so become one component by one comparison a node and bucket. Buckets of up
to SMALL nodes then try all pairs of different components, each pair in the first of the buckets that it shares. Larger ones are dealt to the keys of the next level and treated
alike. A bucket of the last level agrees in 48 bits, so it holds 65,536 nodes at most, and its pairs of different components
are all tried. No pair within DIFFER bits escapes: each level has a key for it. Keys are joined, never collected; a hot bucket
is split by adaptive execution.

Defined results: a null text is empty; a text without a word has the fingerprint zero and is linked like any other. Every row
gives one row, repeated rows and rows of one doc_id too. component_id is the least doc_id of the component; a null doc_id
counts as greater than all others. Further columns are ignored. Texts are read whole, however long. No rows, no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.omh import NO_ID, components, rerooted, row_id
from evidentia.llm.runtime import cut, cut_few, map_arrow, small, text_of
from evidentia.llm.words import LOWER

SHINGLE, SEED, BITS = 4, 42, 64
DIFFER, SEGMENTS = 4, 16
WIDTH = BITS // SEGMENTS
LEVELS, SMALL = (1, 2, 3), 32
LOWERED = LOWER.tobytes()
#: Shingles whose bits are summed at once.
CHUNK = 50_000


def fingerprint(text: str) -> int:
    words = text.encode().translate(LOWERED).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    ones, view, of = np.zeros(BITS, np.int64), memoryview(joined), xxhash.xxh64_intdigest
    for k in range(0, n, CHUNK):
        hashes = np.array([of(view[s:e], SEED) for s, e in zip(starts[k : k + CHUNK], ends[k : k + CHUNK], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """id (doc_id, a null one as the greatest integer), node (the fingerprint as a signed integer) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["id", "node"])

    return map_arrow(docs.select(row_id(docs).alias("id"), text_of().alias("text")), run, "id bigint, node bigint")


def signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def first_segments(n: int) -> int:
    """The mask of the first n segments of a turned fingerprint."""
    return ((1 << n * WIDTH) - 1) << (BITS - n * WIDTH)


def reach(budget: int) -> int:
    """The most segments from the start of a chain that may differ in no more than `budget` bits."""
    return min(SEGMENTS, (budget + 1) * SEGMENTS // DIFFER - 1)


def masks(level: int) -> list[int]:
    """What must be equal in the first reach(level) segments, by the choice of `level` segments that may differ."""
    out = []
    for gone in combinations(range(reach(0), reach(level)), level):
        if all(sum(g < reach(b) for g in gone) <= b for b in range(level)):
            out.append(sum(first_segments(s + 1) ^ first_segments(s) for s in range(reach(level)) if s not in gone))
    return out


def turned(node: str, turn: str) -> Column:
    """The fingerprint, its ring read from segment `turn` on."""
    return F.expr(f"shiftleft({node}, {WIDTH} * {turn}) | shiftrightunsigned({node}, {BITS} - {WIDTH} * {turn})")


def chained(x: Column) -> Column:
    """Do the differing bits x of two turned fingerprints stay within the budget of each chain, and of the whole?"""
    ok = F.lit(True)
    for budget in range(DIFFER + 1):
        ok &= F.bit_count(x.bitwiseAND(F.lit(signed(first_segments(reach(budget)))))) <= budget
    return ok


def keys(rows: DataFrame, level: int) -> DataFrame:
    """`rows` (node, turn and others) with a bucket for each mask of the level."""
    mask = F.explode(F.array(*(F.lit(signed(m)).cast("bigint") for m in masks(level)))).alias("mask")
    return rows.select("*", mask).withColumn("bucket", bucket("turn", F.col("mask"), turned("node", "turn"))).drop("mask")


def bucket(turn: str, mask: Column, x: Column) -> Column:
    return F.xxhash64(turn, mask, x.bitwiseAND(mask))


def shared(rows: DataFrame) -> DataFrame:
    """The rows (bucket, node, turn, root) of buckets with more than one root, and n, the bucket's rows."""
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("bucket", "n")
    return cut_few(rows.join(small(cut_few(sizes)), "bucket"))


def met_first(x: Column, level: int) -> Column:
    """Is this the first turn whose chains the differing bits allow, and the bucket that of the first mask that they leave equal?

    Two nodes share many buckets of a level. A pair told in this one only loses no link: whichever level tells this bucket, both
    nodes are in it with this turn."""
    # as functions of arrays: written out, the condition would be too long to be compiled
    shift = lambda f, n: F.call_function(f, F.col("node_a").bitwiseXOR(F.col("node_b")), n)
    ring = lambda t: shift("shiftleft", F.lit(WIDTH) * t).bitwiseOR(shift("shiftrightunsigned", F.lit(BITS) - F.lit(WIDTH) * t))
    earlier = F.exists(F.sequence(F.lit(0), F.col("turn_a")), lambda t: (t < F.col("turn_a")) & chained(ring(t)))
    first = F.filter(F.array(*(F.lit(signed(m)).cast("bigint") for m in masks(level))), lambda m: x.bitwiseAND(m) == 0)[0]
    return ~earlier & (F.col("bucket_a") == bucket("turn_a", first, turned("node_a", "turn_a")))


def met(a: DataFrame, b: DataFrame, more: Column, level: int | None = None) -> DataFrame:
    """Verified pairs of nodes of different roots. a, b: bucket_x, node_x, turn_x, root_x. With a level, each pair only in the
    first of its buckets."""
    x = turned("node_a", "turn_a").bitwiseXOR(turned("node_b", "turn_b"))
    once = F.lit(True) if level is None else met_first(x, level)
    return a.join(b, (F.col("bucket_a") == F.col("bucket_b")) & (F.col("turn_a") == F.col("turn_b")) & (F.col("root_a") != F.col("root_b")) & more & chained(x) & once)


def pairs(a: DataFrame, b: DataFrame, more: Column, level: int | None = None) -> DataFrame:
    """The roots a, b of the pairs that met()."""
    return met(a, b, more, level).select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct()


def side(rows: DataFrame, s: str) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"{c}_{s}") for c in ("bucket", "node", "turn", "root")))


def led(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Pairs of each node with its bucket's leader."""
    leader = F.max_by(F.struct("node", "turn", "root"), F.struct("weight", -F.col("node").cast("decimal(20,0)"))).alias("l")
    leaders = cut_few(rows.join(small(weights), "node").groupBy("bucket").agg(leader).select("bucket", "l.*"))
    return pairs(side(rows, "a"), small(side(leaders, "b")), F.lit(True))


def linked(nodes: DataFrame) -> DataFrame:
    """node, root of the nodes (distinct, column node) that have a link; the root is the component's least node."""
    labels = None

    def merge(found: DataFrame, rows: DataFrame) -> DataFrame:
        """Takes over the components that new links between roots make; `rows` with their new roots."""
        nonlocal labels
        found = cut_few(found)
        if found.isEmpty():
            return rows
        joined = components(found)
        labels = joined if labels is None else cut_few(rerooted(labels, joined).unionByName(joined).groupBy("node").agg(F.min("root").alias("root")))
        return rerooted(rows, joined)

    turns = F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("turn")
    left, weights = nodes.select("node", F.col("node").alias("root"), turns), None
    for level in LEVELS:
        left = shared(keys(left, level))
        if left.isEmpty():
            break
        weights = weights or cut_few(left.groupBy("node").agg(F.sum("n").alias("weight")))
        last = level == LEVELS[-1]
        # the leader's links leave n as it is: buckets that they make one component are looked for among the larger ones only
        left = cut_few(merge(led(left, weights), left))
        few = left if last else left.filter(F.col("n") <= SMALL)
        left = merge(pairs(side(few, "a"), side(few, "b"), F.col("node_a") < F.col("node_b"), level), left.filter(F.col("n") > SMALL).drop("n"))
        if last or left.isEmpty():
            break
        left = cut_few(left.select("node", "turn", "root").distinct())
    return nodes.select("node", F.col("node").alias("root")).limit(0) if labels is None else labels


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row."""
    rows = cut(fingerprints(docs))
    nodes = cut_few(rows.groupBy("node").agg(F.min("id").alias("first_id")))
    roots = linked(nodes.select("node"))
    found = nodes.join(small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = cut_few(found.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    of = cut_few(found.join(small(least), "root", "left").select("node", F.coalesce("component_id", "first_id").alias("component_id")))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c if c != "id" else "doc_id")
    return rows.join(small(of), "node").select(back("id"), F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), back("component_id"))
