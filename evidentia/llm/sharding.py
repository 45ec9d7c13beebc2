"""Minimax contiguous partition of ordered atomic groups into shards, in DataFrame operations only.

Rows of equal text form an atomic group; groups are ordered by the text's SHA-256 digest. Among all ways to cut the
ordered groups into at most `n_shards` runs, the one whose largest run is smallest is found by binary search over the
capacity: a capacity is feasible if filling shards greedily needs no more than `n_shards`. The cuts are digests, so each
row's shard follows from its own digest, without a join.

The groups may be too many for the driver. So sizes are first summed by ranges of digests (a prefix of hexadecimal
digits). Greedy filling over ranges bounds the best capacity from both sides, and only ranges that can hold a cut for a
capacity between the bounds are summed again by a longer prefix, until those are single groups. The first round brings
the driver 16**DIGITS sums at most. The t-th cut lies in a stretch of at most about 2 * t + 2 ranges, so a further round
brings it about n_shards**2 * 16**MORE_DIGITS sums at most, whatever the number of groups.

Slots number the rows of a shard without gaps. Rows are numbered within (shard, hash of doc_id and text) cells, and a cell
starts where the rows of the cells before it end; so neither a group of copies nor the rows of one doc_id fill a cell.

Defined results: a null text has size 1 and the digest of the empty text, so it shares a group with empty texts. Repeated
rows each get a slot. An empty table gives no rows. Further columns are ignored. Ties of equal sizes need no rule: a
group's order is its digest. Shards may stay empty where there are fewer groups than shards.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.llm.runtime import cut, text_of

#: Hexadecimal digits of the first round's prefix, and digits that each further round adds.
DIGITS, MORE_DIGITS = 3, 2
#: A range is large if it holds more than this part of an even shard.
FINE = 64
#: Rows of a slot cell, about; and the most cells of a shard.
CELL_ROWS, MOST_CELLS = 50_000, 4_096


def greedy(before: list[int], capacity: int, n_shards: int) -> list[int] | None:
    """Indexes where shards end if each takes all that fits, or None if that needs more than `n_shards`; before[k] is the size of the first k pieces."""
    ends, at, n = [], 0, len(before) - 1
    while at < n:
        end = bisect_right(before, before[at] + capacity) - 1
        if end == at or len(ends) == n_shards:
            return None
        ends.append(at := end)
    return ends


def least_capacity(sizes: list[int], n_shards: int) -> int:
    """The smallest feasible capacity, by binary search."""
    before = [0, *accumulate(sizes)]
    low, high = max([1, -(-before[-1] // n_shards), *sizes]), max(1, before[-1])
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy(before, middle, n_shards) is not None else (middle + 1, high)
    return low


def fluid_capacity(before: list[int], whole: list[bool], n_shards: int) -> int:
    """As least_capacity() if a piece that isn't `whole` could be split anywhere: no real partition does better."""
    total = before[-1]

    def feasible(capacity: int) -> bool:
        at = 0
        for _ in range(n_shards):
            if at >= total:
                break
            reach = at + capacity
            piece = bisect_right(before, reach) - 1
            at = before[piece] if piece < len(whole) and whole[piece] else min(reach, total)
        return at >= total

    low, high = max(1, -(-total // n_shards)), max(1, total)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if feasible(middle) else (middle + 1, high)
    return low


def open_pieces(sizes: list[int], whole: list[bool], n_shards: int) -> set[int]:
    """Pieces, not `whole`, that must be known in parts before the best capacity and its cuts are known.

    The best capacity lies between the one for pieces that split anywhere and the one for pieces that never split. A
    greedy cut moves up with the capacity, so each lies between its places for the two; a piece that some cut may lie in
    is open. First, while a piece is large, only such are opened: then the two capacities are close."""
    before = [0, *accumulate(sizes)]
    total = before[-1]
    if large := {k for k, s in enumerate(sizes) if not whole[k] and s * FINE * n_shards > total}:
        return large
    low, high = fluid_capacity(before, whole, n_shards), least_capacity(sizes, n_shards)
    found: set[int] = set()
    least, most = 0, 0
    for _ in range(n_shards):
        if least + low >= total:
            break
        first = bisect_right(before, least + low) - 1
        last = min(bisect_right(before, most + high) - 1, len(sizes) - 1)
        found |= {k for k in range(first, last + 1) if not whole[k]}
        least, most = before[first], before[last] if whole[last] and most + high < total else min(most + high, total)
    return found


def find_cuts(groups: DataFrame, n_shards: int) -> list[str]:
    """The digests from which shards 1, 2, ... take over. `groups` has digest and size, one row or more a group."""
    pieces: list[tuple[str, int, bool]] = []  # prefix, size, is it one group?
    wanted: list[str] | None = None
    while True:
        length = DIGITS if wanted is None else len(wanted[0]) + MORE_DIGITS
        rows = groups if wanted is None else groups.filter(F.substring("digest", 1, len(wanted[0])).isin(wanted))
        sums = rows.groupBy(F.substring("digest", 1, length).alias("prefix")).agg(F.sum("size").alias("size"), (F.min("digest") == F.max("digest")).alias("single")).collect()
        new = [(r["prefix"], r["size"], r["single"] or length >= 64) for r in sums]
        pieces = sorted([p for p in pieces if wanted is None or p[0] not in set(wanted)] + new)
        sizes, whole = [p[1] for p in pieces], [p[2] for p in pieces]
        if not pieces:
            return []
        inside = open_pieces(sizes, whole, n_shards)
        if not inside:
            ends = greedy([0, *accumulate(sizes)], least_capacity(sizes, n_shards), n_shards) or []
            return [pieces[e][0] for e in ends if e < len(pieces)]
        shortest = min(len(pieces[k][0]) for k in inside)
        wanted = [pieces[k][0] for k in inside if len(pieces[k][0]) == shortest]


def shard_of(digest: Column, cuts: list[str]) -> Column:
    """How many cuts a digest has reached: a cut is a digest or a prefix of one, which sorts before all that it begins."""
    return sum((F.when(digest >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def shard_documents(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null: this law has none), digest of every row."""
    rows = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text_of()) + 1).cast("bigint").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"), F.sha2(text_of(), 256).alias("digest")))
    groups = rows.select("digest", "size")
    cuts = find_cuts(groups, n_shards)
    n_cells = max(8, min(MOST_CELLS, rows.count() // (CELL_ROWS * n_shards)))
    placed = rows.withColumn("shard", shard_of(F.col("digest"), cuts)).withColumn("cell", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(n_cells)).cast("int"))
    cells = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))  # n_shards * n_cells rows at most
    order = Window.partitionBy("shard").orderBy("cell")
    first = cells.select("shard", "cell", (F.sum("n").over(order) - F.col("n")).alias("first"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "digest"))
    numbered = placed.withColumn("within", within).join(F.broadcast(first), ["shard", "cell"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("within") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "digest")
