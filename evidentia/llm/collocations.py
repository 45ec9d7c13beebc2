"""Phrases of two to four words that occur together: counted by position bitmaps, scored by their cut of least cohesion.

Texts, A-Z lower-cased, are split at ``.,;:!?`` and line ends into pieces and those at blanks into words. A task lays the
pieces that it reads of a language one behind another in a shard of about SHARD positions, with an empty position between
pieces. In a shard each word has a bitmap of its positions, of which only blocks of BLOCK positions with a bit set are kept.
A phrase's bitmap holds the positions of its last word. Shifted by one and ANDed with the bitmaps that have a bit in the same
block, it becomes the bitmaps of all phrases that are one word longer; popcounts are their numbers in the shard, and sums of
these over shards their numbers in the language. Phrases are extended depth first, a run of first words at a time.

A phrase that occurs LEAST times has only words and inner phrases that do, too. So shards keep bitmaps of the words that are
frequent in their language, extend them to pairs, and in a second pass extend only pairs that may be frequent: a Bloom filter
of bounded size holds all frequent pairs. What it lets through besides can't make a phrase that occurs LEAST times, so its sum
drops it. A shard gets the frequent words that occur in it by a join on the shard; nothing grows with the corpus in a task or on
the driver, and the bitmaps are built once, in a table of the shared folder. Words are numbered, so a pair is one integer.

Defined results: a null text is empty and a null lang `und`. A language without a candidate gives no row. Repeated rows count
as often as they stand. doc_id and further columns are not read. A text of any length is read whole: it is laid out in several
shards, cut between pieces. No rows, no result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.runtime import broadcast_value, cut, map_arrow, new_folder, remove_folder, small
from evidentia.llm.words import A, mix

LEAST, LONGEST, TOP, SCALE = 30, 4, 2000, 2_000_000
#: A candidate inside a longer phrase that occurs INSIDE percent as often is dropped.
INSIDE = 80
SHARD, BLOCK = 1_000_000, 8
#: Flags of a filter of frequent words that tasks have; only what passes it is joined with them.
FILTER = 1_048_573
#: Bits of the Bloom filter of frequent pairs for each pair, at least and at most in all, and how many of them a pair sets.
PAIR_BITS, FEWEST_BITS, MOST_BITS, HASHES = 16, 1 << 16, 1 << 28, 4
#: Bytes of a text that are split into words at once, and pairs of blocks that are ANDed at once.
SLICE, AT_ONCE = 4 << 20, 1_000_000
END = b"."
#: A-Z to a-z, all that ends a piece to END, tab to space.
BYTES = bytes(END[0] if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))

SHARDS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("per_block", pa.binary()), ("word", pa.binary()), ("bits", pa.binary())])
SHARDS_SQL = "shard bigint, lang string, words array<string>, counts array<bigint>, per_block binary, word binary, bits binary"


def slices(data: bytes, most: int) -> Iterator[bytes]:
    """`data` in parts of about `most` bytes, cut where a piece ends."""
    start = 0
    while len(data) - start > most:
        end = data.rfind(END, start + 1, start + most)
        end = data.find(END, start + most) if end < 0 else end
        if end < 0:
            break
        yield data[start:end]
        start = end
    yield data[start:]


class Layout:
    """Positions of one language: each word's number in a shard, 0 where a piece ends."""

    def __init__(self) -> None:
        self.number: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.number[END]
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, part: bytes) -> None:
        words = part.replace(END, b" . ").split()  # no other white space is left
        words.append(END)
        self.parts.append(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)))
        self.size += len(words)

    def row(self, shard: int, lang: str) -> pa.RecordBatch | None:
        at = np.concatenate(self.parts)
        place = np.flatnonzero(at)
        if not len(place):
            return None
        number = at[place] - 1
        block, word, bits = blocks(place, number)
        names = list(self.number)[1:]
        columns = [[shard], [lang], [[w.decode() for w in names]], [np.bincount(number, minlength=len(names))], [per_block(block)], [word.astype(np.uint32).tobytes()], [bits.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SHARDS, strict=True)], schema=SHARDS)


class PairFilter:
    """Which pairs may be frequent: a Bloom filter in words of 64 bits, a power of two of them."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def bits_for(pairs: int) -> int:
        return min(max(1 << (PAIR_BITS * pairs).bit_length(), FEWEST_BITS), MOST_BITS)

    @staticmethod
    def places(pair: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        h = mix(pair.astype(np.uint64))
        step = mix(h ^ A) | np.uint64(1)
        for k in range(HASHES):
            with np.errstate(over="ignore"):
                yield ((h + np.uint64(k) * step) & np.uint64(bits - 1)).astype(np.int64)

    def passes(self, pair: np.ndarray) -> np.ndarray:
        out = np.ones(len(pair), bool)
        for at in self.places(pair, 64 * len(self.words)):
            out &= (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return out


def filter_of_pairs(frequent: DataFrame) -> Broadcast:
    """The PairFilter of all rows' pairs (materialised); tasks make its bits, the driver puts at most MOST_BITS of them together."""
    bits = PairFilter.bits_for(frequent.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in PairFilter.places(batch.column(0).to_numpy(), bits):
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["at", "bit"])

    def made() -> PairFilter:
        rows = map_arrow(frequent.select("pair"), run, "at bigint, bit bigint").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
        return PairFilter(words)

    return broadcast_value(frequent.sparkSession, made)


def blocks(place: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block, word, bits of all bitmaps, ordered by block and word."""
    key = np.sort((place // BLOCK << 35) | (number << 3) | place % BLOCK)
    first = np.flatnonzero(np.concatenate([[True], key[1:] >> 3 != key[:-1] >> 3]))
    bits = np.bitwise_or.reduceat((1 << (key & 7)).astype(np.uint8), first)
    return key[first] >> 35, (key[first] >> 3) & 0xFFFFFFFF, bits


def per_block(block: np.ndarray) -> bytes:
    """How many words have bits in each block, from block 0 on."""
    return np.bincount(block).astype(np.uint8).tobytes()


def layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of what a task reads; whenever it holds SHARD positions, those of the language with most become one."""
    held: dict[str, Layout] = {}
    shards = count((TaskContext.get().partitionId() if TaskContext.get() else 0) << 32)

    def hand_on(lang: str) -> Iterator[pa.RecordBatch]:
        if (row := held.pop(lang).row(next(shards), lang)) is not None:
            yield row

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang = lang.as_py()
            for part in slices(text.as_py().encode().translate(BYTES), SLICE):
                held.setdefault(lang, Layout()).add(part)
                while sum(x.size for x in held.values()) >= SHARD:
                    yield from hand_on(max(held, key=lambda x: held[x].size))
    for lang in list(held):
        yield from hand_on(lang)


class Shard:
    """The bitmaps of a shard's frequent words: entry k holds bits[k] of word[k] in block[k]; ids[w] is a word's number."""

    def __init__(self, ids: np.ndarray, per_block: np.ndarray, word: np.ndarray, bits: np.ndarray):
        self.ids, self.word, self.bits = ids.astype(np.int64), word.astype(np.int64), bits
        self.start = np.concatenate([[0], np.cumsum(per_block, dtype=np.int64), [len(word)]])
        self.block = np.repeat(np.arange(len(per_block)), per_block)

    @classmethod
    def of(cls, row: dict) -> Shard:
        return cls(*(np.frombuffer(row[c], t) for c, t in (("ids", np.int32), ("per_block", np.uint8), ("word", np.uint32), ("bits", np.uint8))))

    def runs(self) -> Iterator[np.ndarray]:
        """Entries by word, about as many at once as their extensions may take."""
        order = np.argsort(self.word, kind="stable")
        begins = np.flatnonzero(np.concatenate([[True], np.diff(self.word[order]) > 0])) if len(order) else []
        run, limit = 0, AT_ONCE // BLOCK
        for begin, end in zip(begins, [*begins[1:], len(order)], strict=True):
            if end - run > limit and begin > run:
                yield order[run:begin]
                run = begin
        yield order[run:]

    def extended(self, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shift and AND: for each word that follows a bit, the entry that it follows, the word's entry, and the bits."""
        moved, over = (bits << 1).astype(np.uint8), np.flatnonzero(bits >> (BLOCK - 1))
        entry = np.concatenate([np.flatnonzero(moved), over])
        moved = np.concatenate([moved[moved > 0], np.ones(len(over), np.uint8)])
        to = np.concatenate([block[entry[: len(moved) - len(over)]], block[over] + 1])
        n = self.start[to + 1] - self.start[to]
        parts, done = [], 0
        bounds = np.cumsum(n)
        while done < len(n):
            upto = max(done + 1, int(np.searchsorted(bounds, (bounds[done - 1] if done else 0) + AT_ONCE, side="right")))
            some = n[done:upto]
            source = np.repeat(np.arange(done, upto), some)
            other = np.arange(len(source)) - np.repeat(np.cumsum(some) - some, some) + self.start[to[source]]
            both = moved[source] & self.bits[other]
            hit = np.flatnonzero(both)
            parts.append((entry[source[hit]], other[hit], both[hit]))
            done = upto
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of words, each as one integer, and their numbers."""
        found = []
        for run in self.runs():
            entry, other, bits = self.extended(self.block[run], self.bits[run])
            first, second = self.word[run[entry]], self.word[other]
            if not len(first):
                continue
            # both words' places in the shard and the popcount in one integer, which sorts faster than an order of keys
            key = np.sort((first << 34) | (second << 5) | np.bitwise_count(bits))
            first = np.flatnonzero(np.concatenate([[True], key[1:] >> 5 != key[:-1] >> 5]))
            found.append((self.pair(key[first] >> 34, (key[first] >> 5) & 0x1FFFFFFF), np.add.reduceat(key & 31, first)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.ids[a] << 32) | self.ids[b]

    def longer(self, frequent: np.ndarray | PairFilter) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Phrases of three and more words whose pairs all are `frequent` (or in a filter): first pair, what follows, number."""
        known = frequent.passes if isinstance(frequent, PairFilter) else lambda x: np.isin(x, frequent)
        for run in self.runs():
            entry, other, bits = self.extended(self.block[run], self.bits[run])
            head = self.pair(self.word[run[entry]], self.word[other])
            keep = known(head)
            head, other, bits, tail = head[keep], other[keep], bits[keep], np.zeros(keep.sum(), np.int64)
            phrase = np.unique(head, return_inverse=True)[1]
            for size in range(3, LONGEST + 1):
                entry, last, bits = self.extended(self.block[other], bits)
                keep = known(self.pair(self.word[other[entry]], self.word[last]))
                entry, last, bits = entry[keep], last[keep], bits[keep]
                head, tail = head[entry], tail[entry] | self.ids[self.word[last]] << 32 * (LONGEST - size)
                other = last
                if not len(head):
                    break
                # what a phrase was extended from is a number, so one integer tells phrases apart
                key = (phrase[entry] << 29) | last
                order = np.argsort(key)
                new = np.concatenate([[True], np.diff(key[order]) != 0])
                yield head[order][new], tail[order][new], np.add.reduceat(np.bitwise_count(bits[order]).astype(np.int64), np.flatnonzero(new))
                phrase = np.empty(len(key), np.int64)
                phrase[order] = np.cumsum(new) - 1


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards with the bitmaps of the words in `known` only, in the order of the words' numbers."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("known"))
        for n, row in enumerate(batch.drop_columns(["known"]).to_pylist()):
            at, ids = (lists[n].values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "id"))
            order = np.argsort(ids)
            rank = np.full(row["n_words"], -1, np.int64)
            rank[at[order]] = np.arange(len(order))
            per, word, bits = (np.frombuffer(row[c], t) for c, t in (("per_block", np.uint8), ("word", np.uint32), ("bits", np.uint8)))
            block, word = np.repeat(np.arange(len(per)), per), rank[word]
            keep = word >= 0
            columns = [pa.array([row["shard"]]), *(pa.array([x], pa.binary()) for x in (ids[order].astype(np.int32).tobytes(), np.bincount(block[keep], minlength=len(per)).astype(np.uint8).tobytes(), word[keep].astype(np.uint32).tobytes(), bits[keep].tobytes()))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "ids", "per_block", "word", "bits"])


def shard_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pair, n of each shard."""
    for batch in batches:
        for row in batch.to_pylist():
            pair, n = Shard.of(row).pairs()
            for k in range(0, len(pair), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pair[k : k + 100_000]), pa.array(n[k : k + 100_000])], ["pair", "n"])


def shard_words(passes: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """shard, lang, i, word of the words that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = words.values
                keep = np.flatnonzero(passes.value[[zlib.crc32(w.encode()) % FILTER for w in words.to_pylist()]])
                for k in range(0, len(keep), 50_000):
                    part = keep[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard)), pa.array([lang] * len(part)), pa.array(part.astype(np.int32)), words.take(pa.array(part))], ["shard", "lang", "i", "word"])

    return run


def filter_of(frequent: DataFrame, value: Column) -> Broadcast:
    """Which remainders the frequent rows' values have: FILTER flags, however many rows there are."""
    rest = [r[0] for r in frequent.select((value % FILTER).cast("int")).distinct().collect()]
    flags = np.zeros(FILTER, bool)
    flags[rest] = True
    return frequent.sparkSession.sparkContext.broadcast(flags)


def shard_phrases(frequent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """head, tail, n of each shard's phrases of pairs that may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for head, tail, n in Shard.of(row).longer(frequent.value):
                    yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(tail), pa.array(n)], ["head", "tail", "n"])

    return run


def with_ids(words: DataFrame) -> DataFrame:
    """`words` (materialised) with id: 1, 2, ... without a gap."""
    rows = words.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    before, starts = 1, []
    for part, n in sorted(map(tuple, rows.groupBy("part").count().collect())):  # a row a partition
        starts.append((part, before))
        before += n
    if before > 1 << 31:
        raise ValueError("more than 2^31 frequent words")
    starts = words.sparkSession.createDataFrame(starts or [(0, 0)], "part int, start bigint")
    return rows.join(F.broadcast(starts), "part").withColumn("id", F.col("start") + F.col("at")).drop("part", "at", "start")


def ids_of(head: Column, tail: Column) -> Column:
    low = F.lit(0xFFFFFFFF)
    parts = F.array(F.shiftrightunsigned(head, 32), head.bitwiseAND(low), F.shiftrightunsigned(tail, 32), tail.bitwiseAND(low))
    return F.filter(parts, lambda x: x > 0)


def counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, f, id) and phrases (ids, f) that occur `least` times; and n, all words of each lang."""
    spark = docs.sparkSession
    folder, packed_folder = new_folder(spark, "layouts"), new_folder(spark, "bitmaps")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    map_arrow(rows, layouts, SHARDS_SQL).write.option("compression", "zstd").parquet(folder)
    shards = spark.read.schema(SHARDS_SQL).parquet(folder)
    per_lang = cut(shards.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")))
    words = shards.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    frequent = cut(with_ids(cut(words.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least))))
    here = map_arrow(shards.select("shard", "lang", "words"), shard_words(filter_of(frequent, F.crc32(F.col("word").cast("binary")))), "shard bigint, lang string, i int, word string")
    known = here.join(small(frequent.select("lang", "word", "id"), weight=F.length("word")), ["lang", "word"]).groupBy("shard").agg(F.collect_list(F.struct("i", "id")).alias("known"))
    packed = shards.select("shard", F.size("words").alias("n_words"), "per_block", "word", "bits").join(known, "shard")
    schema = "shard bigint, ids binary, per_block binary, word binary, bits binary"
    map_arrow(packed.select("shard", "n_words", "per_block", "word", "bits", "known"), numbered, schema).write.option("compression", "zstd").parquet(packed_folder)
    remove_folder(spark, folder)
    packed = spark.read.schema(schema).parquet(packed_folder)
    pairs = map_arrow(packed, shard_pairs, "pair bigint, n bigint")
    frequent_pairs = cut(pairs.groupBy("pair").agg(F.sum("n").alias("f")).filter(F.col("f") >= least))
    longer = map_arrow(packed, shard_phrases(filter_of_pairs(frequent_pairs)), "head bigint, tail bigint, n bigint")
    longer = longer.groupBy("head", "tail").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    phrases = cut(frequent_pairs.select(ids_of(F.col("pair"), F.lit(0).cast("bigint")).alias("ids"), "f").unionByName(longer.select(ids_of(F.col("head"), F.col("tail")).alias("ids"), "f")))
    remove_folder(spark, packed_folder)
    return frequent, phrases, per_lang


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first `top` phrases."""
    words, found, per_lang = counts(docs, least)
    every = cut(found.unionByName(words.select(F.array("id").alias("ids"), "f")))
    of = lambda s: every.select(F.col("ids").alias(s), F.col("f").alias(s[0]))
    size = F.size("ids")
    cuts = found.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("ids", F.lit(1), F.col("k")), "right": F.slice("ids", F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(of("left"), "left").join(of("right"), "right")
    score = F.expr(f"CAST(CAST({SCALE} AS DECIMAL(8, 0)) * CAST(a AS DECIMAL(20, 0)) DIV (l + r) AS BIGINT)")
    scored = cuts.withColumn("score", score).groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("ids", "a", "c.score", "c.l", "c.r")
    inner = F.expr("flatten(transform(sequence(2, size(ids) - 1), n -> transform(sequence(1, size(ids) - n + 1), s -> slice(ids, s, n))))")
    inner = found.filter(size > 2).select(F.explode(inner).alias("ids"), "f").groupBy("ids").agg(F.max("f").alias("longer"))
    kept = cut(scored.join(inner, "ids", "left").filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * INSIDE)).drop("longer"))
    spelled = kept.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", "word"), "id").groupBy("ids").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    rows = kept.join(spelled.select("ids", "lang", F.array_join("w.word", " ").alias("phrase")), "ids")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    rows = rows.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= top)
    return rows.join(small(per_lang), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
s AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM s),
g AS (SELECT lang, k, ws[i:i + k - 1] AS p FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) x(k))),
m AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, k, p, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, p, a, unnest(range(1, k)) AS j FROM f WHERE k > 1),
x AS (SELECT c.lang, c.k, c.p, c.a, j, l.a AS l, r.a AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (l.a + r.a) AS BIGINT) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:j] JOIN f r ON r.lang = c.lang AND r.p = c.p[j + 1:c.k]),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
i AS (SELECT lang, p[s:s + z - 1] AS p, max(a) AS longer FROM (SELECT lang, p, a, z, unnest(range(1, k - z + 2)) AS s FROM f, (VALUES (2), (3)) v(z) WHERE z < k) GROUP BY ALL),
o AS (SELECT y.lang, array_to_string(y.p, ' ') AS phrase, y.a, l, r, m.n, score FROM y JOIN m ON m.lang = y.lang LEFT JOIN i ON i.lang = y.lang AND i.p = y.p WHERE longer IS NULL OR 100 * longer < 80 * y.a),
q AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM q WHERE rank <= 2000
"""
