"""Near-duplicate documents by Order MinHash: sketches keep the text order of several minimal, occurrence-labelled k-mers.

Texts are sequences of words (words.py); k-mers are runs of K words, a shorter text is one k-mer. The n-th occurrence of
a k-mer in a text is labelled n, so repeats count. Each of SKETCHES hash functions picks its two least labelled k-mers and
hashes them in text order; two texts share such a value with a probability that follows their edit similarity. Texts
so short that FEW_EDITS words at most may differ also have keys of what is left without them, so all similar pairs of short
texts are candidates. Documents of equal text are one node. Nodes that share a
sketch value are candidates. Each node is first compared with a leader, the node of its buckets that shares most values with
others, then with the leaders of its other buckets; so a group of near copies, all like their leader, costs one comparison a
node. Then all pairs that aren't one component yet are compared in buckets of up to SMALL nodes. Nodes of larger buckets, say
of texts that merely share a passage, are joined exactly (rare_pairs()): of the longer of two similar texts, of n words of which
d may be edited, n - q + 1 - q * d runs of q words at least stand in both, repeats numbered. So in one order of all runs, the rarest
first, the first q * d + 1 of both have one in common, and no pair of such nodes is lost. A pair meets at its first common run,
or a few times: rows carry the runs in front of theirs. How rare a run is is told by SLOTS counters of those
that stand more than once, which only steer the choice.
Kinds without such runs (chroma.py) are sketched again with more minima, and then compared with more and more leaders of each
large bucket until each of its pairs was compared or is in one component.
A bound of the edits by how many words fall in each of BINS tells most unlike pairs apart without their
texts. A pair is a link if a banded alignment of the two word sequences has a similarity 1 - edits / longer length of
SIMILARITY or more. Classes are the connected components of links.

No bucket is gathered or expanded into all pairs while it is large. Hot buckets are joined by key, which adaptive execution
splits.

Defined results: a null text is empty; texts without a word are near copies of none, but equal texts are one class, empty
ones too. Every row gives one row, repeated rows too; class_id is the least doc_id of the class, a null doc_id counts as
greater than all others. Rows of one doc_id, or of none, with different texts are different nodes. A node is a text's 64-bit
hash. Further columns are ignored. Whole texts are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.runtime import broadcast_value, cut, cut_few, free_name, map_arrow, small
from evidentia.llm.words import A, B, blocks, column_bytes, hash_words, mix

K, SKETCHES, LEVELS, SIMILARITY, SMALL = 3, 48, (2,), 0.8, 10
LEAST = LEVELS[0]  # minima of a value
FEW_EDITS = 2  # texts that may differ by so many edits at most have deletion keys
FEW_STEPS = 10  # edits up to which furthest-reaching points are tried before bit vectors
NO_ID = (1 << 63) - 1
BINS = 256  # of a sign
RUNS = (1, 2, 3, 4)  # words of a run
BEFORE, MANY = 10, 8  # runs in front of a run, kept for runs of at least so many texts, and of 4 times the mean
GRAMS, CLASS = (1, 2, 3), 1.12  # words of a labelled run; a class of lengths begins at so many times the one before
SLOTS, MOST = 1 << 24, (1 << 15) - 1  # counters of runs, of two bytes each, and how far they count
FINE = 1 << 31  # places by which runs are told apart before those that stand more than once are counted in SLOTS


def kmers(hashes: np.ndarray, first: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Labelled k-mers of all texts, and where each text's begin; a text of fewer than k words has one, of no word none."""
    n_words = np.diff(first)
    n = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    at = first[:-1][text] + np.arange(begin[-1]) - begin[:-1][text]
    end, h = first[1:][text], np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            inside = at + j < end
            h = mix(h * A + np.where(inside, hashes[np.minimum(at + j, len(hashes) - 1)], np.uint64(j + 1))) if len(at) else h
        order = np.lexsort((h, text))
        ordered = h[order]
        new = np.concatenate([[True], (ordered[1:] != ordered[:-1]) | (text[order][1:] != text[order][:-1])]) if len(at) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        label = np.empty(len(at), np.uint64)
        label[order] = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
        return mix(h + label * B), begin


def sketch(labelled: np.ndarray, begin: np.ndarray, sketches: int = SKETCHES, least: int = LEAST) -> np.ndarray:
    """For each text with k-mers one row of `sketches` values (texts without any are left out), each of `least` minima."""
    full = np.flatnonzero(np.diff(begin))
    starts = begin[full]
    size = begin[full + 1] - starts
    out = np.empty((len(full), sketches), np.uint64)
    if not len(full):
        return out
    place = np.arange(len(labelled)) - np.repeat(starts, size)
    bits = max(1, int(size.max()).bit_length())
    low = np.uint64((1 << bits) - 1)
    place = place.astype(np.uint64)
    for s in range(sketches):
        with np.errstate(over="ignore"):
            h = (mix(labelled ^ (np.uint64(s + 1) * A)) & ~low) | place  # the place breaks ties and comes along
        places = []
        for m in range(least):
            at = starts + (np.minimum.reduceat(h, starts) & low).astype(np.int64)
            at = np.where(size > m, at, places[-1]) if m else at  # a text of fewer k-mers repeats its last minimum
            h[at] = np.iinfo(np.uint64).max
            places.append(at)
        value = np.full(len(full), np.uint64(s))
        for at in np.sort(np.stack(places), axis=0):
            with np.errstate(over="ignore"):
                value = mix(value * A + labelled[at])
        out[:, s] = value
    return out


def deletion_keys(hashes: np.ndarray, first: np.ndarray, least: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Text and key, in order and distinct, of what is left of a short text without any of its words, as many as may differ.

    Two short texts are similar only if they share a key: a substitution takes a word from both, an insertion from one."""
    n_words = np.diff(first)
    texts, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in np.unique(n_words):
        if not n or (most := int((1 - least) * n + 1e-9)) > FEW_EDITS:
            continue
        rows = np.flatnonzero(n_words == n)
        w = hashes[first[rows][:, None] + np.arange(n)]
        for gone in (g for d in range(most + 1) for g in combinations(range(n), d)):
            h = np.full(len(rows), B)
            with np.errstate(over="ignore"):
                for j in np.delete(np.arange(n), gone):
                    h = mix(h * A + w[:, j])
            texts.append(rows)
            keys.append(h)
    return distinct_keys(np.concatenate(texts), np.concatenate(keys))


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """The edit distance of two sequences if it is `most` or less, by an alignment within the band of `most` diagonals."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1]) if n else np.zeros(0, int)
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return (d if (d := max(len(a), len(b))) <= most else None)
    if abs(len(a) - len(b)) > most:
        return None
    alone = max(len(a), len(b)) - np.intersect1d(numbered(a), numbered(b), assume_unique=True).size
    if alone > most:  # words without a partner need an edit each
        return None
    x, y = a.tolist(), b.tolist()
    found = few_edits(x, y, a, b, min(most, FEW_STEPS)) if alone <= FEW_STEPS else None
    return found if found is not None or most <= FEW_STEPS else many_edits(x, y, most)


def few_edits(x: list[int], y: list[int], a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """As edits_within(), by furthest-reaching points: quick for few edits, however long the sequences."""
    goal = len(x) - len(y)
    reach = {0: snake(x, y, a, b, 0, 0)}
    if goal == 0 and reach[0] >= len(a):
        return 0
    for d in range(1, most + 1):
        new = {}
        for k in range(-min(d, most), min(d, most) + 1):
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2) + 1, reach.get(k + 1, -2))
            if i < 0 or abs(k - goal) > most - d:
                continue
            i = min(i, len(a), len(b) + k)
            if i >= 0 and i - k >= 0:
                new[k] = snake(x, y, a, b, i, i - k)
        reach = new
        if reach.get(goal, -1) >= len(a):
            return d
    return None


def many_edits(x: list[int], y: list[int], most: int) -> int | None:
    """As edits_within(), by bit vectors: a column of the band of 2 * most + 1 diagonals is a few operations on long integers.

    Bit j of a column stands for x's word at (column - most + j); `up` and `down` hold where the distance grows or shrinks
    by one from a row to the next. First the distance is followed along the lowest diagonal, then along x's last row."""
    n, m, limit = len(x), len(y), most
    if abs(n - m) > most:
        return None
    most = max(1, min(most, max(n, m)))
    if min(n, m) <= most:  # a band wider than a sequence: as many words in front, equal in both, change no distance
        pad = [-1 - k for k in range(most + 1)]
        x, y, n, m = pad + x, pad + y, n + most + 1, m + most + 1
    width = 2 * most + 1
    full = (1 << width) - 1
    where: dict[int, int] = {}
    for i, w in enumerate(x):
        where[w] = where.get(w, 0) | 1 << i
    up, down, row, low, distance = full ^ ((1 << most) - 1), 0, 1 << (width - 2), 1 << (width - 1), most
    for i in range(m):
        same = where.get(y[i], 0)
        if same:
            same = (same >> (i - most) if i >= most else same << (most - i)) & full
        zero = (((same & up) + up) ^ up) | same | down
        right, left = down | (full & ~(zero | up)), zero & up
        if i < n - most:
            distance += not zero & low
        else:
            distance += (right & row > 0) - (left & row > 0)
            row >>= 1
        if distance - (m - 1 - i) > most and i >= n - most:  # each further column takes one off at most
            return None
        zero = (zero & full) >> 1
        up, down = left | (full & ~(zero | right)), zero & right
    return distance if distance <= limit else None


def numbered(a: np.ndarray) -> np.ndarray:
    """Each word with the number of its occurrence mixed in, so that all are different."""
    order = np.argsort(a, kind="stable")
    ordered = a[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    out = np.empty(len(a), np.uint64)
    with np.errstate(over="ignore"):
        out[order] = mix(ordered + (np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))).astype(np.uint64) * B)
    return out


def snake(x: list[int], y: list[int], a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How far in x equal words go on from (i, j)."""
    stop = min(len(x) - i, len(y) - j)
    k = 0
    while k < stop and k < 8:
        if x[i + k] != y[j + k]:
            return i + k
        k += 1
    step = 64
    while k < stop:
        e = min(k + step, stop)
        differ = np.flatnonzero(a[i + k : i + e] != b[j + k : j + e])
        if len(differ):
            return i + k + int(differ[0])
        k, step = e, step * 4
    return i + k


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    longer = max(len(a), len(b))
    return longer > 0 and edits_within(a, b, int((1 - least) * longer + 1e-9)) is not None


def nodes_of(docs: DataFrame, sketches: int = SKETCHES, least: float = SIMILARITY) -> DataFrame:
    """id, node, sketch of each row: a node is a text; rows of a node's least id have its sketch, others null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, hashes, first in blocks(batch, 2):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), values_of(hashes, first, sketches, LEAST, least)], ["id", "node", "sketch"])

    rows = cut(map_arrow(docs.select(row_id(docs).alias("id"), text_node(docs).alias("node"), "text"), run, "id bigint, node bigint, sketch array<bigint>"))
    first_ids = rows.groupBy("node").agg(F.min("id").alias("first_id"))
    return cut(rows.join(first_ids, "node").select("id", "node", F.when(F.col("id") == F.col("first_id"), F.col("sketch")).alias("sketch")))


def values_of(hashes: np.ndarray, first: np.ndarray, sketches: int, minima: int, least: float) -> pa.ListArray:
    """For each text its sketch values, and behind them a short text's deletion keys; nothing for a text without a word."""
    values = sketch(*kmers(hashes, first), sketches, minima)
    text, keys = deletion_keys(hashes, first, least)
    text = np.concatenate([np.repeat(np.flatnonzero(np.diff(first)), sketches), text])
    values = np.concatenate([values.ravel(), keys])[np.argsort(text, kind="stable")].view(np.int64)
    ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(first) - 1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def text_node(docs: DataFrame) -> Column:
    """The text's 64-bit hash."""
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def row_id(docs: DataFrame) -> Column:
    """doc_id, a null one as the greatest integer."""
    return F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID))


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, payload (its text) for each of `nodes`."""
    rows = docs.select(text_node(docs).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(small(nodes), "node", "left_semi").groupBy("node").agg(F.max("text").alias("payload"))


def alike_texts(least: float) -> Callable[[pa.Array, pa.Array], list[bool]]:
    def alike(a: pa.Array, b: pa.Array) -> list[bool]:
        (x, xs), (y, ys) = (hash_words(*column_bytes(c)) for c in (a, b))
        return [similar(x[xs[k] : xs[k + 1]], y[ys[k] : ys[k + 1]], least) for k in range(len(a))]

    return alike


def signs_of(payloads: DataFrame) -> DataFrame:
    """node, sign of texts: how many words fall in each of BINS, 255 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, hashes, first in blocks(batch, 1):
                text = np.repeat(np.arange(part.num_rows), np.diff(first))
                # the size goes in front, as four bytes
                n = np.bincount(text * BINS + (hashes % np.uint64(BINS)).astype(np.int64), minlength=part.num_rows * BINS)
                rows = np.concatenate([np.diff(first).astype("<u4").view(np.uint8).reshape(-1, 4), np.minimum(n, 255).astype(np.uint8).reshape(-1, BINS)], axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["node", "sign"])

    return map_arrow(payloads.select("node", "payload"), run, "node bigint, sign binary")


def near_signs(least: float) -> Callable[[pa.Array, pa.Array], np.ndarray]:
    """Can texts of these signs be similar? An edit takes at most one word out of a bin and puts at most one into a bin."""

    def near(a: pa.Array, b: pa.Array) -> np.ndarray:
        x, y = (column_bytes(c)[0].reshape(-1, BINS + 4) for c in (a, b))
        n, m = (np.ascontiguousarray(v[:, :4]).view("<u4").ravel().astype(np.int64) for v in (x, y))
        d = x[:, 4:].astype(np.int16) - y[:, 4:]
        edits = np.maximum(np.maximum(d, 0).sum(axis=1, dtype=np.int64), np.maximum(-d, 0).sum(axis=1, dtype=np.int64))
        return np.maximum(edits, np.abs(n - m)) <= ((1 - least) * np.maximum(n, m) + 1e-9).astype(np.int64)

    return near


def told(pairs: DataFrame, payloads: DataFrame, alike: Callable[[pa.Array, pa.Array], list[bool]]) -> DataFrame:
    """Pairs (a, b) with `alike`, told by their payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike(batch.column(2), batch.column(3)), pa.bool_())], ["a", "b", "alike"])

    side = lambda n: payloads.select(F.col("node").alias(n), F.col("payload").alias(f"of_{n}"))
    return map_arrow(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a", "of_b"), run, "a bigint, b bigint, alike boolean")


Alike = Callable[[pa.Array, pa.Array], list[bool]]


@dataclass(frozen=True)
class Kind:
    """How nodes are compared: `payloads` of some nodes, `alike` of two. `may`, if given, makes short signs of payloads and tells
    from two signs whether they can be alike. `rest` makes all pairs (a, b, root_a, root_b, n) of different roots that can be
    alike from rows (node, root, payload), n telling likely ones; else `deeper` makes sketches of payloads by minima a value."""

    sketches: int
    levels: tuple[int, ...]
    payloads: Callable[[DataFrame], DataFrame]
    alike: Alike
    deeper: Callable[[DataFrame, int], DataFrame] | None = None
    may: tuple[Callable[[DataFrame], DataFrame], Callable[[pa.Array, pa.Array], np.ndarray]] | None = None
    rest: Callable[[DataFrame], DataFrame] | None = None


class Links:
    """Verified pairs (a, b), a < b, found so far, and the pairs that were told to be none."""

    def __init__(self, kind: Kind, payloads: DataFrame):
        self.kind, self.payloads = kind, payloads
        self.signs = cut(kind.may[0](payloads)) if kind.may else None
        self.found: DataFrame | None = None
        self.seen: DataFrame | None = None

    def near(self, pairs: DataFrame, buckets: DataFrame) -> DataFrame:
        """The pairs (a, b and others) that share a bucket (`buckets`: node, buckets) and whose signs, if any, are near."""
        looks = buckets if self.signs is None else buckets.join(self.signs, "node")
        looks = cut_few(looks)
        side = lambda n: looks.select(*(F.col(c).alias(n if c == "node" else f"{c}_{n}") for c in looks.columns))
        met = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.arrays_overlap("buckets_a", "buckets_b")).drop("buckets_a", "buckets_b")
        if self.signs is None:
            return cut(met)
        may, columns = self.kind.may[1], pairs.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield batch.filter(pa.array(may(batch.column("sign_a"), batch.column("sign_b")), pa.bool_())).select(columns)

        return cut(map_arrow(met, run, pairs.schema))

    def tell(self, pairs: DataFrame, near: bool = False) -> DataFrame | None:
        """Compares pairs (a, b, and their roots root_a, root_b) that weren't compared yet. Returns node, root for the roots that
        new links join, or nothing if there is no new link; links between nodes of known components make no larger graph.
        Signs of pairs that are known to be `near` aren't compared again."""
        pairs = pairs.groupBy("a", "b").agg(F.min("root_a").alias("root_a"), F.min("root_b").alias("root_b"))
        pairs = cut_few(pairs if self.seen is None else pairs.join(small(self.seen), ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            return None
        bare = pairs.select("a", "b")
        near = cut_few(cut(told(bare, self.signs.withColumnRenamed("sign", "payload"), self.kind.may[1]).filter("alike").select("a", "b"))) if self.kind.may and not near else bare
        new = near if near.isEmpty() else cut_few(cut(told(near, self.payloads, self.kind.alike).filter("alike").select("a", "b")))
        self.found, self.seen = (new, bare) if self.seen is None else (cut_few(self.found.union(new)), cut_few(self.seen.union(bare)))
        if new.isEmpty():
            return None
        return components(cut_few(pairs.join(small(new), ["a", "b"], "left_semi").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()))


def rerooted(rows: DataFrame, joined: DataFrame | None) -> DataFrame:
    """rows (root, ...) with the roots that others were joined to."""
    if joined is None:
        return rows
    return rows.join(small(joined.select(F.col("node").alias("root"), F.col("root").alias("new_root"))), "root", "left").withColumn("root", F.coalesce("new_root", "root")).drop("new_root")


def led(rows: DataFrame, weights: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of each node with its bucket's leaders, one of each of `parts`, where roots differ; and the leaders."""
    part = F.pmod(F.xxhash64("node"), F.lit(parts))
    leaders = rows.join(small(weights), "node").groupBy("bucket", part.alias("part")).agg(F.max_by(F.struct("node", "root", "weight"), F.struct("weight", -F.col("node"))).alias("l"))
    leaders = cut_few(leaders.select("bucket", F.col("l.node").alias("leader"), F.col("l.root").alias("leader_root"), F.col("l.weight").alias("n")))
    pairs = rows.drop("n").join(small(leaders), "bucket").filter("root != leader_root")
    first = F.col("node") < F.col("leader")
    either = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return pairs.select("node", either("node", "leader").alias("a"), either("leader", "node").alias("b"), either("root", "leader_root").alias("root_a"), either("leader_root", "root").alias("root_b"), "n"), leaders


def first_of(pairs: DataFrame, *group: str) -> DataFrame:
    """The pair of each group with the greatest n."""
    ends = ("a", "b", "root_a", "root_b")
    return pairs.groupBy(*group).agg(F.max_by(F.struct(*ends), F.struct("n", "a", "b")).alias("p")).select(*[f"p.{c}" for c in ends])


def links(nodes: DataFrame, kind: Kind) -> DataFrame:
    """Verified pairs (a, b), a < b, whose components join the nodes that share a bucket and are alike.

    `nodes`: node, sketch, one row a node: a value for each of `kind.sketches` and further keys behind them."""
    rows = exploded(nodes, kind).withColumn("root", F.col("node"))
    left = shared(rows)
    if left.isEmpty():
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    payloads = cut(kind.payloads(cut_few(left.select("node").distinct())))
    # the node in the middle of a group shares most values with others
    weights = cut_few(left.groupBy("node").agg(F.sum("n").alias("weight")))
    state = Links(kind, payloads)
    if (joined := state.tell(first_of(led(left, weights, 1)[0], "node"))) is not None:
        left = shared(rerooted(left, joined))
    large = None
    for level, minima in enumerate(kind.levels):
        if level:
            again = kind.deeper(payloads.join(small(left.select("node").distinct()), "node", "left_semi"), minima)
            rows = exploded(again, kind).join(left.select("node", "band", "root").distinct(), ["node", "band"])
            left = shared(rows)
        if left.isEmpty():
            break
        if (joined := state.tell(led(left, weights, 1)[0].drop("node", "n"))) is not None:
            left = shared(rerooted(left, joined))
        few = left.filter(F.col("n") <= SMALL)
        side = lambda x: few.select("bucket", F.col("node").alias(x), F.col("root").alias(f"root_{x}"))  # noqa: E731, B023
        told_few = state.tell(side("a").join(side("b"), "bucket").filter("a < b AND root_a != root_b").select("a", "b", "root_a", "root_b"))
        left = left.filter(F.col("n") > SMALL)
        left = shared(rerooted(left, told_few)) if told_few is not None else cut_few(left)
        # refined buckets only find links early: the large buckets themselves are settled below
        large = left if large is None else rerooted(rerooted(large, joined), told_few)
    if large is not None and not (large := shared(large)).isEmpty():
        settle(large, weights, payloads, state)
    return payloads.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0) if state.found is None else state.found


def settle(left: DataFrame, weights: DataFrame, payloads: DataFrame, state: Links) -> None:
    """Tells all pairs of large buckets that aren't one component and can be alike."""
    if state.kind.rest:
        roots = cut_few(left.select("node", "root").distinct())
        sets = left.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))  # a value a sketch and a few keys
        pairs = state.near(state.kind.rest(payloads.join(small(roots), "node")), sets)
        # one comparison joins a text to a group; what is left after it is told pair by pair
        joined = state.tell(first_of(pairs, "a", "root_b"), near=True)
        state.tell(rerooted_pairs(pairs, joined).filter("root_a != root_b"), near=True)
        return
    parts = SMALL
    while not left.isEmpty():
        pairs, leaders = led(left, weights, parts)
        joined = state.tell(pairs.drop("node", "n"))
        # leaders are settled with all of their bucket
        left = left.join(small(leaders.select("bucket", F.col("leader").alias("node"))), ["bucket", "node"], "left_anti")
        left, parts = shared(rerooted(left, joined)), parts * SMALL


def rerooted_pairs(pairs: DataFrame, joined: DataFrame | None) -> DataFrame:
    for end in ("root_a", "root_b"):
        pairs = rerooted(pairs.withColumnRenamed(end, "root"), joined).withColumnRenamed("root", end)
    return pairs


def runs(hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each of RUNS its words, and of all its runs the text, the place in the text and the hash."""
    n_words = np.diff(first)
    h = np.zeros(len(hashes), np.uint64)
    for q in RUNS:
        with np.errstate(over="ignore"):
            h = mix(h[: max(len(hashes) - q + 1, 0)] * A + hashes[q - 1 :] + np.uint64(q))
        n = np.maximum(n_words - q + 1, 0)
        text = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        yield q, text, place, h[first[:-1][text] + place]


def slots_of(keys: np.ndarray) -> np.ndarray:
    return (keys % np.uint64(SLOTS)).astype(np.int64)


def rarest_runs(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Text and key of d + 1 disjoint runs of each text of which d > 0 words may be edited, in the length that meets fewest texts;
    runs that stand in no other place are left out."""
    n_words = np.diff(first)
    need = ((1 - least) * n_words + 1e-9).astype(np.int64) + 1
    best, texts, keys = np.full(len(n_words), np.iinfo(np.int64).max), [], []
    for q, text, place, key in runs(hashes, first):
        apart = place % q == 0
        text, key = text[apart], key[apart]
        n = counts[slots_of(key)]
        order = np.lexsort((n, text))
        text, key, n = text[order], key[order], n[order]
        have = np.bincount(text, minlength=len(n_words))
        rank = np.arange(len(text)) - (np.cumsum(have) - have)[text]
        chosen = (rank < need[text]) & (have[text] >= need[text]) & (need[text] > 1)
        text, key, n = text[chosen], key[chosen], n[chosen]
        cost = np.bincount(text, np.where(n > 1, n, 0), minlength=len(n_words)).astype(np.int64)
        cost[have < need] = np.iinfo(np.int64).max
        texts.append((q, text[n > 1]))
        keys.append(key[n > 1])
        better = cost < best
        best = np.where(better, cost, best)
        choice = np.where(better, q, choice) if q > RUNS[0] else np.full(len(n_words), q)
    out = [(t[(m := choice[t] == q)], k[m]) for (q, t), k in zip(texts, keys, strict=True)]
    return distinct_keys(np.concatenate([t for t, _ in out]), np.concatenate([k for _, k in out]))


def distinct_keys(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])]) if len(text) else np.zeros(0, bool)
    return text[new], key[new]


def edits_of(n_words: np.ndarray, least: float) -> np.ndarray:
    """How many words of a text may be edited if it is the longer one of two similar texts."""
    return ((1 - least) * n_words + 1e-9).astype(np.int64)


def length_class(n_words: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n_words, 1)) / np.log(CLASS) + 1e-9).astype(np.int64)


def rarest_grams(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray, take: np.ndarray, q: int) -> tuple[np.ndarray, ...]:
    """The `take` rarest labelled runs of q words of each text that stand in other texts as well, in one order for all texts:
    text, run, its count, its rank, and the BEFORE runs in front of it in that order (0: none; left out for runs of few texts)."""
    labelled, begin = kmers(hashes, first, q)
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    n = counts[slots_of(labelled)]
    order = np.lexsort((labelled, n, text))
    text, labelled, n = text[order], labelled[order], n[order]
    rank = np.arange(len(text)) - begin[:-1][text]
    keep = (rank < take[text]) & (n > 1)
    text, labelled, n, rank = text[keep], labelled[keep], n[keep], rank[keep]
    before, many = np.zeros((len(text), BEFORE), np.uint64), max(MANY, 4 * counts.mean())
    for k in range(1, BEFORE + 1):
        before[k:, k - 1] = np.where((text[k:] == text[:-k]) & (n[k:] >= many), labelled[:-k], 0)
    return text, labelled, n, rank, before


def sought_grams(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """Text, key, place and runs before it, by which a text finds all similar ones that aren't longer: of the run length that
    meets fewest texts, the rarest labelled runs, with each class of lengths that such texts may have.

    Of n words with d edits, at least n - q + 1 - q * d labelled runs of q words stay. So of two similar texts' runs in one order,
    the first q * d + 1 of the longer one and as many of the shorter one as held_grams() takes have one in common. Where n of
    a shorter text's words are fewer, less of its runs come in question: the first in common has a place up to this one's."""
    n_words = np.diff(first)
    edits = edits_of(n_words, least)
    best, found = np.full(len(n_words), np.iinfo(np.int64).max), []
    choice = np.zeros(len(n_words), np.int64)
    for q in GRAMS:
        text, key, n, _, before = rarest_grams(hashes, first, counts, q * edits + 1, q)
        cost = np.bincount(text, n, minlength=len(n_words)).astype(np.int64)
        better = (n_words - q + 1 >= q * edits + 1) & (edits > 0) & (cost < best)
        best, choice = np.where(better, cost, best), np.where(better, q, choice)
        found.append((q, text, key, before))
    text, key, before = (np.concatenate(x) for x in zip(*((t[m], k[m], b[m]) for q, t, k, b in found for m in [choice[t] == q]), strict=True))
    low, high = length_class(n_words - edits), length_class(n_words)
    times = (high - low + 1)[text]
    each = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    text, key, before = (np.repeat(x, times, axis=0) for x in (text, key, before))
    return text, classed(key, low[text] + each), (choice * edits - n_words)[text], before


def held_grams(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """Text, key, place (rank less words) and runs before it, by which a text is found: for each run length the rarest labelled runs, with its class."""
    n_words = np.diff(first)
    longer = n_words + np.arange(int(np.ceil(1 / max(1 - least, 0.01))) + 2)[:, None]
    out = []
    for q in GRAMS:
        # further edits of a still longer text are fewer than the words that it has more
        take = (n_words - longer + q * edits_of(longer, least)).max(axis=0) + 1
        text, key, _, rank, before = rarest_grams(hashes, first, counts, take, q)
        out.append((text, key, rank, before))
    text, key, rank, before = (np.concatenate(x) for x in zip(*out, strict=True))
    return text, classed(key, length_class(n_words)[text]), rank - n_words[text], before


def classed(key: np.ndarray, length: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(key + length.astype(np.uint64) * A)


def rare_pairs(least: float) -> Callable[[DataFrame], DataFrame]:
    """Pairs (a, b, root_a, root_b, n) of texts (node, root, payload) with different roots, all similar ones among them.

    The longer text looks others up by its sought_grams(), which stand among the other's held_grams(); n rows tell so."""
    schema = "key bigint, node bigint, root bigint, words bigint, place bigint, before array<bigint>"

    def emit(part: pa.RecordBatch, first: np.ndarray, text: np.ndarray, key: np.ndarray, place: np.ndarray, before: np.ndarray) -> pa.RecordBatch:
        at, there = pa.array(text), before > 0
        ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
        before = pa.ListArray.from_arrays(pa.array(ends), pa.array(before[there].view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0).take(at), part.column(1).take(at), pa.array(np.diff(first).astype(np.int64)[text]), pa.array(place), before], ["key", "node", "root", "words", "place", "before"])

    def pairs(texts: DataFrame) -> DataFrame:
        spark = texts.sparkSession
        texts = texts.select("node", "root", "payload")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, hashes, first in blocks(batch, 2):
                    slot, n = np.unique(np.concatenate([kmers(hashes, first, q)[0] % np.uint64(FINE) for q in GRAMS]).astype(np.int32), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n.astype(np.int32))], ["slot", "n"])

        counted = map_arrow(texts, count, "slot int, n int").groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 1")
        counted = counted.groupBy((F.col("slot") % SLOTS).alias("slot")).agg(F.least(F.sum("n"), F.lit(MOST)).cast("smallint").alias("n"))
        counts = broadcast_value(spark, lambda: filled(counted.toArrow(), np.ones(SLOTS, np.int16)))

        def sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, hashes, first in blocks(batch, 2):
                    yield emit(part, first, *sought_grams(hashes, first, counts.value, least))

        seek = cut(map_arrow(texts, sought, schema))
        slots = seek.select(F.pmod("key", F.lit(SLOTS)).cast("int").alias("slot"))  # the same slot: SLOTS is a power of two
        wanted = broadcast_value(spark, lambda: filled(slots.distinct().select("slot", F.lit(True).alias("n")).toArrow(), np.zeros(SLOTS, bool)))

        def held_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, hashes, first in blocks(batch, 2):
                    rows = held_grams(hashes, first, counts.value, least)
                    some = wanted.value[slots_of(rows[1])]
                    yield emit(part, first, *(x[some] for x in rows))

        held = cut(map_arrow(texts, held_by, schema))
        side = lambda rows, n: rows.select("key", F.col("node").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("root", "words", "place", "before")))
        most = F.floor((1 - least) * F.col("words_x") + 1e-9)
        fits = (F.col("words_y") <= F.col("words_x")) & (F.col("words_x") - F.col("words_y") <= most) & (F.col("place_y") <= F.col("place_x"))
        # two texts that have a run of those before in common met there
        x, y = side(seek, "x"), side(held, "y")
        met = x.join(y, (x["key"] == y["key"]) & (F.col("root_x") != F.col("root_y")) & fits & ~F.arrays_overlap("before_x", "before_y"))
        first = F.col("x") < F.col("y")
        either = lambda u, v: F.when(first, F.col(u)).otherwise(F.col(v))
        ends = [either("x", "y").alias("a"), either("y", "x").alias("b"), either("root_x", "root_y").alias("root_a"), either("root_y", "root_x").alias("root_b")]
        return met.select(*ends).groupBy("a", "b", "root_a", "root_b").agg(F.count("*").alias("n"))

    return pairs


def filled(rows: pa.Table, out: np.ndarray) -> np.ndarray:
    """`out` with n of rows (slot, n) at their slots."""
    for part in rows.to_batches():
        out[part.column("slot").to_numpy()] = part.column("n").to_numpy(zero_copy_only=False)
    return out


def exploded(nodes: DataFrame, kind: Kind) -> DataFrame:
    """node, band, bucket: a row for each value; further keys are one band."""
    rows = nodes.select("node", F.posexplode("sketch").alias("band", "bucket"))  # a value tells its band
    return rows.withColumn("band", F.least("band", F.lit(kind.sketches)))


def shared(rows: DataFrame) -> DataFrame:
    """node, band, root, bucket, n of rows whose bucket holds nodes of more than one root."""
    sizes = cut_few(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("bucket", "n"))
    return cut_few(rows.select("node", "band", "root", "bucket").join(small(sizes), "bucket"))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of an edge: least labels spread along edges, and labels take over their label's label."""
    both = cut_few(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")))
    labels = cut_few(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("near"))
        new = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = new.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = cut_few(new.join(jump, "root").select("node", "old", F.col("further").alias("root")))
        if new.filter("old != root").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def text_kind(docs: DataFrame, least: float, sketches: int) -> Kind:
    return Kind(sketches, LEVELS, lambda nodes: texts_of(docs, nodes), alike_texts(least), may=(signs_of, near_signs(least)), rest=rare_pairs(least))


def classes(docs: DataFrame, least: float = SIMILARITY, sketches: int = SKETCHES) -> DataFrame:
    """doc_id, class_id, class_size, n_links (links of the row's text to different texts) of every row."""
    return classes_of(nodes_of(docs, sketches, least), text_kind(docs, least, sketches)).withColumnRenamed("id", "doc_id")


def placed(rows: DataFrame, kind: Kind) -> DataFrame:
    """The rows (id, node, sketch and others) without sketch, with root (of the class) and n_links."""
    nodes = cut_few(rows.filter(F.size("sketch") > 0).dropDuplicates(["node"]).select("node", "sketch"))
    edges = cut_few(links(nodes, kind))
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    roots = cut_few(components(edges).join(degree, "node"))
    return rows.drop("sketch").join(small(roots), "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("n_links", F.coalesce("n_links", F.lit(0)))


def classes_of(rows: DataFrame, kind: Kind, *keep: str) -> DataFrame:
    """id, `keep`, class_id, class_size, n_links of every row of `rows` (id, node, sketch), as nodes_of() gives them."""
    found = placed(rows, kind)
    several = cut_few(found.groupBy("root").agg(F.count("*").alias("class_size"), F.min("id").alias("class_id")).filter("class_size > 1"))
    out = found.join(small(several), "root", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(back("id").alias("id"), *keep, back("class_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), "n_links")


def one_of_each(docs: DataFrame, least: float = SIMILARITY, sketches: int = SKETCHES) -> DataFrame:
    """The rows of `docs`, all columns, with one row of each class: one with the class's least doc_id (null ones last)."""
    found = cut(placed(nodes_of(docs, sketches, least), text_kind(docs, least, sketches)).select("id", "node", "root"))
    several = found.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct("id", "node")).alias("first")).filter("n > 1")
    several = cut_few(several.select("root", F.col("first.id").alias("first_id"), F.col("first.node").alias("first_node")))
    # rows are told by id and text: an id, or none, may stand at several texts
    row, text = free_name(docs, "row_id"), free_name(docs, "row_text")
    gone = cut_few(found.join(small(several), "root").filter("id != first_id OR node != first_node").select(F.col("id").alias(row), F.col("node").alias(text)).distinct())
    kept = docs.withColumns({row: row_id(docs), text: text_node(docs)}).join(small(gone), [row, text], "left_anti")
    again = found.groupBy("id", "node").agg(F.count("*").alias("n")).filter("n > 1")
    return (kept if again.isEmpty() else kept.dropDuplicates([row, text])).select(*docs.columns)
