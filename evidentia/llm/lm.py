"""An interpolated modified Kneser-Ney bigram model, counted in Spark and read by workers from memory-mapped arrays.

Counting: a narrow pass finds words that precede a large share of all tokens. A second pass turns each block of text into
distinct (previous word, word) pairs with counts, cut into shards by the previous word's hash; a frequent previous word's
pairs are dealt by the next word as well, so no shard grows with one word. A shard's blobs are merged into sorted arrays.
Each shard then sends its words' continuation counts to shards by word, which gives unigram arrays. Only sums of a few
numbers, and the totals of frequent previous words, come to the driver.

Files of a model: per shard sorted 64-bit keys of pairs with their discounted probability; sorted keys of previous words
with their back-off weight; and by word shard sorted keys with count and continuation probability. A worker maps them
into memory and looks up a block's tokens in sorted order.

Tokens: words of words.py, then one end token per text. The first word's previous word is a mark that isn't a token.
p(w|v) = max(c(v,w) - D[c], 0) / c(v) + g(v) p(w), g(v) = sum of D[k] n_k(v) / c(v), and
p(w) = max(N(w) - E[N], 0) / N + (sum of E[k] n_k) / N / (V + 1), with N(w) the different words before w. A word never seen
has N(w) = 0; after a word never seen before another, p(w) holds. Discounts come from counts of counts (Chen and Goodman).

Defined results: null texts are empty, which is one end token; each row gives one row, repeated rows too; an empty
training set gives base and model a uniform word over V + 1 = 1. Further columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.runtime import cut, economical, fold, new_folder, remove_folder
from evidentia.llm.words import A, blocks, mix

#: Tokens of a shard, about; tokens whose pairs are counted at once; a frequent word's share of a shard.
SHARD_TOKENS, BLOCK_TOKENS, FREQUENT = 1_000_000, 3_000_000, 0.25
BEGIN, END = np.uint64(0x1234567 << 8), np.uint64(0x7654321 << 8)
TOP = np.uint64(0xFFFFFFFFFFFFFF00)  # a word's key: the upper 56 bits of its hash


def put(uri: str, arrays: dict[str, np.ndarray]) -> None:
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    for name, a in arrays.items():
        mine = f"{path}/{name}.{uuid.uuid4().hex}"  # attempts of one task don't share a file
        with system.open_output_stream(mine) as f:
            f.write(np.ascontiguousarray(a).data)
        system.move(mine, f"{path}/{name}")  # a repeated task writes the same bytes


@lru_cache(maxsize=100_000)
def mapped(uri: str, kind: str) -> np.ndarray:
    """A file of the model as a memory-mapped array; from a remote store it is fetched once per worker, into a file without
    a name, which goes with the worker. A file that should be there and isn't is an error."""
    system, path = fs.FileSystem.from_uri(uri)
    if system.get_file_info(path).type != fs.FileType.File:
        raise FileNotFoundError(f"the model lacks {uri}; is its folder shared by all executors?")
    if not isinstance(system, fs.LocalFileSystem):
        with system.open_input_stream(path) as source, tempfile.TemporaryFile() as f:
            while chunk := source.read(1 << 24):
                f.write(chunk)
            f.flush()
            return np.memmap(f, kind, "r") if f.tell() else np.zeros(0, kind)
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)


@dataclass(frozen=True)
class Model:
    """What a worker needs: where the files are, how keys are dealt, discounts, and totals."""

    folder: str
    shards: int
    with_pairs: frozenset[int]  # shards that have files of pairs, and of words; others are empty
    with_words: frozenset[int]
    frequent: tuple[int, ...]  # sorted keys of words dealt by the next word too, and their back-off weights
    frequent_gaps: tuple[float, ...]
    tokens: int
    words: int
    pairs: int
    different: int  # distinct pairs by their next word: the continuation counts' sum
    discounts: tuple[float, float, float]  # of continuation counts
    gap: float  # continuation probability of a word never seen


def pairs_of(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Previous and next keys of all tokens, ends included, and where each text's tokens begin."""
    n_texts = len(first) - 1
    begin = first[:-1] + np.arange(n_texts)
    total = len(hashes) + n_texts
    word, before = np.empty(total, np.uint64), np.empty(total, np.uint64)
    ends = np.append(begin[1:], total) - 1
    is_end = np.zeros(total, bool)
    is_end[ends] = True
    word[~is_end], word[is_end] = hashes & TOP, END
    before[1:], before[begin] = word[:-1], BEGIN
    return before, word, np.append(begin, total)


def shard_of(before: np.ndarray, word: np.ndarray, shards: int, frequent: np.ndarray) -> np.ndarray:
    by = mix(before)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, before), len(frequent) - 1)
        by = np.where(frequent[at] == before, by ^ mix(word ^ A), by)
    return (by % np.uint64(shards)).astype(np.int64)


def pair_keys(before: np.ndarray, word: np.ndarray, shard: np.ndarray, shards: int) -> np.ndarray:
    """A pair's key: its shard above, a hash below, so that keys of all shards in order are one sorted array."""
    bits = max(1, (shards - 1).bit_length())
    with np.errstate(over="ignore"):
        h = mix(mix(before) * A + word)
    return (shard.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits))


def runs(a: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)


def packed(before: np.ndarray, word: np.ndarray, count: np.ndarray) -> bytes:
    """Pairs in order of (before, word): their number, previous words with run lengths, and word keys with counts in the low byte."""
    over = count > 255
    if over.any():  # a larger count is repeated in parts of 255
        parts = -(-count // 255)
        index = np.repeat(np.arange(len(count)), parts)
        place = np.arange(len(index)) - np.repeat(np.cumsum(parts) - parts, parts)
        before, word, count = before[index], word[index], np.minimum(count[index] - place * 255, 255)
    at = runs(before)
    sizes = np.diff(np.append(at, len(before)))
    return np.array([len(at), len(before)], "<u8").tobytes() + before[at].tobytes() + sizes.astype("<u4").tobytes() + (word | count.astype(np.uint64)).tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    k, n = (int(x) for x in np.frombuffer(blob, "<u8", 2))
    before = np.repeat(np.frombuffer(blob, "<u8", k, 16), np.frombuffer(blob, "<u4", k, 16 + 8 * k))
    both = np.frombuffer(blob, "<u8", n, 16 + 12 * k)
    return before, both & TOP, (both & np.uint64(255)).astype(np.int64)


def merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order of (before, word) with summed counts."""
    parts = [unpacked(b) for b in blobs]
    before, word, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((word, before))
    before, word, count = before[order], word[order], count[order]
    at = runs_of_pairs(before, word)
    return before[at], word[at], np.add.reduceat(count, at) if len(at) else count


def runs_of_pairs(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], (before[1:] != before[:-1]) | (word[1:] != word[:-1])])) if len(before) else np.zeros(0, np.int64)


def discounts(n: list[int]) -> list[float]:
    """Discounts of counts 1, 2, and 3 or more, from the numbers of things counted 1, 2, 3 and 4 times; kept within the count."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    raw = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else 0.5 * (k + 1) for k in range(3)]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]


def count_model(docs: DataFrame, trains: Column, *, shards: int | None = None) -> Model:
    """Counts the rows of `docs` that `trains` and writes the model below the shared folder."""
    spark = docs.sparkSession
    texts = docs.filter(trains).select("text")
    frequent, tokens = frequent_words(texts, shards)
    n_shards = shards or max(4, tokens // SHARD_TOKENS)
    folder, often = new_folder(spark, "ngrams"), np.array(sorted(frequent), np.uint64)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            before, word = (np.concatenate(x) for x in zip(*kept, strict=True))
            shard = shard_of(before, word, n_shards, often)
            key = np.argsort(pair_keys(before, word, shard, n_shards), kind="stable")
            before, word, shard = before[key], word[key], shard[key]
            at = runs_of_pairs(before, word)
            count = np.diff(np.append(at, len(before)))
            before, word, shard = before[at], word[at], shard[at]
            edges = np.searchsorted(shard, np.arange(n_shards + 1))
            out = []
            for s in np.flatnonzero(np.diff(edges)):
                part = slice(edges[s], edges[s + 1])
                order = np.lexsort((word[part], before[part]))
                out.append((int(s), packed(before[part][order], word[part][order], count[part][order])))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["shard", "blob"])

        for batch in batches:
            for _, hashes, first in blocks(batch, 0):
                before, word, _ = pairs_of(hashes, first)
                kept.append((before, word))
                size += len(word)
                if size >= BLOCK_TOKENS:
                    yield flush()
                    kept, size = [], 0
        if kept:
            yield flush()

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        before, word, count = merged(list(rows["blob"]))
        put(f"{folder}/raw/{key[0]}", {"blob": np.frombuffer(packed(before, word, count), np.uint8)})
        at = runs(before)
        of = np.array([np.sum(count == k) for k in range(1, 5)], np.int64)
        hot = np.flatnonzero(np.isin(before[at], often)) if len(often) else np.zeros(0, np.int64)
        total, kinds = context_sums(before, count, at)
        hot_rows = np.column_stack([before[at][hot].view(np.int64), total[hot], kinds[hot]]) if len(hot) else np.zeros((0, 5), np.int64)
        return pd.DataFrame({"shard": [key[0]], "pairs": [len(word)], "tokens": [int(count.sum())], "of": [of.tolist()], "hot": [hot_rows.ravel().tolist()]})

    economical(spark)
    blobs = texts.mapInArrow(chunks, "shard int, blob binary").repartition(n_shards, "shard")  # a task a shard, about
    sums = cut(blobs.groupBy("shard").applyInPandas(merge, "shard int, pairs bigint, tokens bigint, of array<bigint>, hot array<bigint>"))
    found = sums.select(F.sum("pairs").alias("pairs"), F.sum("tokens").alias("tokens"), *[F.sum(F.col("of")[k]).alias(f"n{k}") for k in range(4)]).first()
    # a frequent previous word's totals lie in many shards: at most 4 / FREQUENT * shards words, each summed by Spark
    hot = sums.select(F.explode(F.expr("transform(sequence(0, cast(size(hot) / 5 as int) - 1), i -> slice(hot, i * 5 + 1, 5))")).alias("r")).filter("size(r) = 5") if len(often) else None
    totals = {r[0]: [int(x) for x in r[1:]] for r in hot.groupBy(F.col("r")[0]).agg(*[F.sum(F.col("r")[k]) for k in range(1, 5)]).collect()} if hot is not None else {}
    d = discounts([found[f"n{k}"] or 0 for k in range(4)])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(f"{folder}/raw/{s}/blob")
                with system.open_input_stream(path) as f:
                    before, word, count = merged([f.read()])
                at = runs(before)
                total, kinds = context_sums(before, count, at)
                heads = before[at]
                for k in np.flatnonzero(np.isin(heads, often)) if len(often) else ():
                    total[k], kinds[k] = (t := totals[int(heads[k].view(np.int64))])[0], t[1:]
                spread = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(before))))
                p = (count - np.array([0.0, *d])[np.minimum(count, 3)]) / total[spread]
                keys = pair_keys(before, word, np.full(len(word), s), n_shards)
                order = np.argsort(keys)
                put(f"{folder}/pairs/{s}", {"key": keys[order], "p": p[order].astype(np.float32), "head": heads, "gap": (kinds @ np.array(d) / total).astype(np.float32)})
                order = np.argsort(word, kind="stable")
                word, count = word[order], count[order]
                at = runs(word)
                different, times, word = np.diff(np.append(at, len(word))), np.add.reduceat(count, at), word[at]
                to = (mix(word) % np.uint64(n_shards)).astype(np.int64)
                for t in np.unique(to):
                    m = to == t
                    yield pa.RecordBatch.from_arrays([pa.array([int(t)], pa.int32()), pa.array([word[m].tobytes()], pa.binary()), pa.array([np.column_stack([different[m], times[m]]).astype("<i8").tobytes()], pa.binary())], ["shard", "words", "numbers"])

    def unigrams(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        word = np.concatenate([np.frombuffer(b, "<u8") for b in rows["words"]])
        numbers = np.concatenate([np.frombuffer(b, "<i8").reshape(-1, 2) for b in rows["numbers"]])
        order = np.argsort(word, kind="stable")
        at = runs(word[order])
        numbers = np.add.reduceat(numbers[order], at, axis=0)
        put(f"{folder}/words/{key[0]}", {"key": word[order][at], "different": numbers[:, 0], "count": numbers[:, 1]})
        return pd.DataFrame({"shard": [key[0]], "words": [len(at)], "different": [int(numbers[:, 0].sum())], "of": [[int(np.sum(numbers[:, 0] == k)) for k in range(1, 5)] + [len(at)]]})

    words = sums.select("shard").repartition(max(1, min(n_shards, 2 * spark.sparkContext.defaultParallelism)), "shard").mapInArrow(finish, "shard int, words binary, numbers binary").groupBy("shard").applyInPandas(unigrams, "shard int, words bigint, different bigint, of array<bigint>")
    words = cut(words)
    w = words.select(F.sum("words").alias("words"), F.sum("different").alias("different"), *[F.sum(F.col("of")[k]).alias(f"n{k}") for k in range(4)]).first()
    n = [w[f"n{k}"] or 0 for k in range(4)]
    e = discounts(n)
    v, different = w["words"] or 0, w["different"] or 0
    gap = (e[0] * n[0] + e[1] * n[1] + e[2] * (v - n[0] - n[1])) / different / (v + 1) if different else 1.0
    remove_folder(spark, f"{folder}/raw")
    mine = [totals.get(int(x)) for x in often.view(np.int64)]
    gaps = tuple(sum(a * b for a, b in zip(d, t[1:], strict=True)) / t[0] if t else 0.0 for t in mine)
    ids = lambda df: frozenset(r["shard"] for r in df.select("shard").collect())
    return Model(folder, n_shards, ids(sums), ids(words), tuple(int(x) for x in often), gaps, found["tokens"] or 0, v, found["pairs"] or 0, different, tuple(e), float(gap))


def context_sums(before: np.ndarray, count: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per previous word: its tokens, and how many words follow it once, twice, and more often."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros((0, 3), np.int64)
    return np.add.reduceat(count, at), np.column_stack([np.add.reduceat((count == 1).astype(np.int64), at), np.add.reduceat((count == 2).astype(np.int64), at), np.add.reduceat((count > 2).astype(np.int64), at)])


def frequent_words(texts: DataFrame, shards: int | None) -> tuple[list[int], int]:
    """Keys of words whose share of all tokens is a large part of a shard, and the number of tokens.

    Each block reports words that make up a thousandth of its tokens or more, so at most a thousand; a word frequent in
    the whole is so in some block. What is missed or held too much only shifts load between shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, hashes, first in blocks(batch, 0):
                before, _, _ = pairs_of(hashes, first)
                if len(before):
                    key, n = np.unique(before, return_counts=True)
                    m = n * 1000 >= len(before)
                    yield pa.RecordBatch.from_arrays([pa.array(np.append(key[m].view(np.int64), 0)), pa.array(np.append(n[m], len(before)).astype(np.int64)), pa.array([*[False] * int(m.sum()), True])], ["key", "n", "total"])

    sums = texts.mapInArrow(run, "key bigint, n bigint, total boolean").groupBy("key", "total").agg(F.sum("n").alias("n"))
    sums = cut(sums)
    tokens = sums.filter("total").agg(F.sum("n")).first()[0] or 0
    n_shards = shards or max(4, tokens // SHARD_TOKENS)
    rows = sums.filter(~F.col("total") & (F.col("n") >= FREQUENT * tokens / n_shards)).select("key").collect()  # n_shards / FREQUENT rows at most
    return [int(np.int64(r["key"]).view(np.uint64)) for r in rows], tokens


class Scorer:
    def __init__(self, model: Model):
        self.m, self.e = model, np.array([0.0, *model.discounts])
        self.often = np.array(sorted(model.frequent), np.uint64)

    def look_up(self, keys: np.ndarray, shard: np.ndarray, part: str, name: str, columns: tuple[tuple[str, str], ...]) -> list[np.ndarray]:
        """For each key the values of its shard's arrays, 0 where it is missing. Keys are searched in sorted order."""
        order = np.argsort(keys) if name == "key" and part == "pairs" else np.lexsort((keys, shard))  # pairs' keys begin with the shard
        shard, wanted = shard[order], keys[order]
        edges = np.searchsorted(shard, np.arange(self.m.shards + 1))
        out = [np.zeros(len(keys)) for _ in columns]
        for s in np.flatnonzero(np.diff(edges)):
            if int(s) not in (self.m.with_pairs if part == "pairs" else self.m.with_words):
                continue
            part_of = slice(edges[s], edges[s + 1])
            have = mapped(f"{self.m.folder}/{part}/{s}/{name}", "<u8")
            at = np.minimum(np.searchsorted(have, wanted[part_of]), len(have) - 1)
            hit = have[at] == wanted[part_of]
            for o, (column, kind) in zip(out, columns, strict=True):
                o[order[part_of]] = np.where(hit, mapped(f"{self.m.folder}/{part}/{s}/{column}", kind)[at], 0)
        return out

    def score(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score, model score."""
        m = self.m
        before, word, begin = pairs_of(hashes, first)
        shard = shard_of(before, word, m.shards, self.often)
        distinct, back = np.unique(word, return_inverse=True)
        counts = self.look_up(distinct, (mix(distinct) % np.uint64(m.shards)).astype(np.int64), "words", "key", (("count", "<i8"), ("different", "<i8")))
        c, different = counts[0][back], counts[1]
        p = np.full(len(distinct), m.gap) + (np.maximum(different - self.e[np.minimum(different, 3).astype(int)], 0) / m.different if m.different else 0)
        p1 = p[back]
        order = np.lexsort((before, shard))
        at = runs_of_pairs(before[order], shard[order].astype(np.uint64))
        hb, hs = before[order][at], shard[order][at]
        gap = self.look_up(hb, hs, "pairs", "head", (("gap", "<f4"),))[0]
        if len(self.often):  # a shard may lack a frequent word that others hold
            at_often = np.minimum(np.searchsorted(self.often, hb), len(self.often) - 1)
            gap = np.where(self.often[at_often] == hb, np.array(m.frequent_gaps)[at_often], gap)
        which = np.empty(len(before), np.int64)
        which[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(before))))
        g = gap[which]
        hit = self.look_up(pair_keys(before, word, shard, m.shards), shard, "pairs", "key", (("p", "<f4"),))[0]
        prob = np.where(g > 0, hit + g * p1, p1)
        logs = (np.log10((c + 1) / (m.tokens + m.words + 1)), np.log10(prob))
        at = begin[:-1]
        return np.diff(begin), np.add.reduceat((c > 0).astype(np.int64), at), *(np.add.reduceat(x, at) for x in logs)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part, hashes, first in blocks(batch, 2, 16_000_000):
                n, known, base, score = scorer.score(hashes, first)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(base), pa.array(score), pa.array(10 ** (-score / n))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), (fold("doc_id", 7) == 2).alias("held_out"), docs["text"])
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")
