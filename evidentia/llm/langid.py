"""Language identification by cross-parsing: a text is cut into the longest phrases that a language's sample holds.

Per language, a suffix automaton of a labelled sample accepts exactly the sample's substrings. A text is parsed greedily:
a phrase ends where the automaton has no transition for the next letter, and after PIECE codes, so that the pieces of all
texts of a batch advance together through dense transition tables. Few phrases mean that the text shares long substrings
with the sample, so phrases times log2(sample size), over the text's length, estimates its cross entropy. The language
with the least wins.

The sample is bounded by rows: at most SAMPLE_DOCS labelled documents a language, always as whole texts, those of up to
PLAIN characters before longer ones, in the order of a hash; a further row is taken only while a language's sample has at
most SAMPLE_CHARS characters with it. The automata are built once, on the driver.

Defined results: null texts and texts without a letter get ``und`` and score 0. Without any training row every text gets
``und``. Ties go to the language that sorts first. Each row gives one row, repeated rows too; lang, source and doc_id
never enter a prediction. Further columns are ignored. Whole texts are read, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.llm.runtime import broadcast_value, fold, map_arrow

#: The training sample's bounds, which hold on any corpus: rows per language, characters up to which rows are alike in
#: rank, and characters per language and of all languages beyond which no further row is taken.
SAMPLE_DOCS, PLAIN, SAMPLE_CHARS, ALL_CHARS = 100, 2_000, 20_000, 1_000_000
#: Codes after which a phrase ends anyway.
PIECE = 1_024
UNKNOWN = "und"


def sample(docs: DataFrame, trains: Column) -> dict[str, str]:
    """The whole texts of a bounded number of labelled rows for each language, joined by blanks."""
    rows = docs.filter(trains & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64(F.col("doc_id").cast("string")).alias("at"), F.xxhash64("text").alias("h"), F.length("text").alias("size"))
    order = Window.partitionBy("lang").orderBy(F.greatest("size", F.lit(PLAIN)), "at", "h")
    # tasks keep SAMPLE_DOCS rows a language before anything is shuffled
    first = rows.select("lang", "size", "at", "h").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLE_DOCS).collect()
    chosen: dict[str, dict[int, int]] = {}  # by language, sizes by text hash
    keys, most = [], min(SAMPLE_CHARS, ALL_CHARS // max(1, len({r["lang"] for r in first})))
    for r in sorted(first, key=lambda r: (r["lang"], r["rank"])):
        taken = chosen.setdefault(r["lang"], {})
        if r["h"] not in taken and (not taken or sum(taken.values()) + r["size"] <= most):
            taken[r["h"]] = r["size"]
            keys.append((r["lang"], r["at"], r["h"], r["rank"]))
    if not keys:
        return {}
    wanted = F.broadcast(docs.sparkSession.createDataFrame(keys, "lang string, at bigint, h bigint, rank int"))
    texts = rows.join(wanted, ["lang", "at", "h"]).groupBy("lang", "rank").agg(F.max("text").alias("text")).collect()  # a row for each key
    out: dict[str, list[str]] = {}
    for r in sorted(texts, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return {lang: " ".join(found) for lang, found in out.items()}


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """By code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """The suffix automaton's transitions by state; state 0 is the start, every state accepts."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new, p = len(step), last
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class CrossParser:
    """All languages' automata in one table: entry [state, code] is four times the next state, plus the phrases that end."""

    def __init__(self, texts: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in texts]
        points = [code_points(t) for _, t in texts]
        known = np.unique(np.concatenate([p[letters()[p]] for p in points] or [np.zeros(0, np.uint32)]))
        self.code = np.where(letters(), len(known) + 1, 0).astype(np.uint8 if len(known) < 250 else np.int32)
        self.code[known] = np.arange(1, len(known) + 1)
        self.width, parts, base, self.roots, bits = len(known) + 2, [], 0, [], []
        for p in points:
            codes = self.squeeze(p)
            step = automaton(codes.tolist())
            table = np.full((len(step), self.width), -1, np.int32)
            for state, row in enumerate(step):
                table[state, list(row)] = list(row.values())
            again, lacks = np.maximum(table[0], 0), table[0] < 0  # a letter that the sample lacks is a phrase of its own
            ended = 1 + (lacks & (np.arange(len(step)) > 0)[:, None]).astype(np.int32)
            table = np.where(table < 0, 4 * (base + again) + ended, 4 * (base + table)).astype(np.int32)
            self.roots.append(base)
            parts.append(table)
            base += len(step)
            bits.append(np.log2(len(codes) + 1))
        self.table = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int32)
        self.bits = np.array(bits)

    def squeeze(self, points: np.ndarray) -> np.ndarray:
        """Codes, each run of other characters than letters as one 0, with a 0 at both ends."""
        codes = np.concatenate([[0], self.code[points], [0]])
        return codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the estimated bits a letter, and per text whether it has letters."""
        codes = [self.squeeze(code_points(t)) for t in texts]
        total = np.array([len(c) for c in codes])
        flat = np.concatenate(codes).astype(np.int64)
        n_pieces = -(-total // PIECE)
        of = np.repeat(np.arange(len(texts)), n_pieces)
        place = (np.arange(len(of)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)) * PIECE
        begin, size = (np.cumsum(total) - total)[of] + place, np.minimum(PIECE, total[of] - place)
        order = np.argsort(-size, kind="stable")
        at, ordered = begin[order], size[order]
        active = np.searchsorted(-ordered, -np.arange(ordered[0]), side="left")  # pieces longer than each step
        state = np.tile(np.array(self.roots, np.int64), (len(of), 1))
        phrases = np.zeros((len(of), len(self.langs)), np.int64)
        table, width = self.table, self.width
        for t, k in enumerate(active.tolist()):
            moved = table[state[:k] * width + flat[at[:k] + t][:, None]]
            phrases[:k] += moved & 3
            state[:k] = moved >> 2
        back = np.empty_like(phrases)
        back[order] = phrases + 1
        summed = np.add.reduceat(back, np.cumsum(n_pieces) - n_pieces, axis=0)
        return summed * self.bits / total[:, None], total > 1

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score: the share of the second-best entropy in the sum of the best two, from 0.5 to 1."""
        if not self.langs or not texts:
            return [(UNKNOWN, 0.0)] * len(texts)
        bits, known = self.entropy(texts)
        best = bits.argmin(axis=1)
        first = bits[np.arange(len(texts)), best]
        second = np.partition(bits, 1, axis=1)[:, 1] if len(self.langs) > 1 else np.full(len(texts), np.inf)
        with np.errstate(invalid="ignore"):
            score = np.where(np.isinf(second), 1.0, second / (first + second))
        return [(self.langs[b], float(s)) if ok else (UNKNOWN, 0.0) for b, s, ok in zip(best, score, known, strict=True)]


def predict_whole(parsed: CrossParser, texts: list[str], chunk: int = 2_000_000) -> list[tuple[str, float]]:
    """As predict(), at most about `chunk` characters at once."""
    out, part, size = [], [], 0
    for t in texts:
        if part and size + len(t) > chunk:
            out += parsed.predict(part)
            part, size = [], 0
        part.append(t)
        size += len(t)
    return out + (parsed.predict(part) if part else [])


def identify(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """doc_id, held_out, lang_pred, score; `texts` is a sample() per language. One narrow pass."""
    model = broadcast_value(docs.sparkSession, lambda: CrossParser(tuple(texts.items())))  # bounded as the sample is

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predict_whole(model.value, [t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), (fold("doc_id", 4) == 2).alias("held_out"), docs["text"])
    return map_arrow(rows, run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def accept(docs: DataFrame, texts: dict[str, str], least: float = 0.0) -> DataFrame:
    """The rows of `docs`, all columns, whose language is known with a score of `least` or more."""
    model, at = broadcast_value(docs.sparkSession, lambda: CrossParser(tuple(texts.items()))), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = predict_whole(model.value, [t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
