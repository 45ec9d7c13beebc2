"""Text quality by compression: a text of a kind shrinks most with a dictionary built from texts of that kind.

One zstandard dictionary is built from good and one from bad labelled text. A text's feature is the difference of its two
compressed sizes over its own size; a logistic curve, fitted on labelled rows that no dictionary has seen, makes it a
score.

Defined results: null counts as empty; empty texts get the curve's value at 0, a score from 0 to 1 like any other. Each
row gives one row, repeated rows too. Rows of labels with a null or different quality for one doc_id teach nothing; with
one class or none, the score is the smoothed share of good labels. Further columns are ignored. Whole texts are scored,
and learned from: the sample is bounded by rows, SAMPLE_DOCS a class in the order of a hash, of which those are left out
that would bring a class beyond SAMPLE_CHARS.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.llm.runtime import fold, map_arrow

#: The training sample's bounds a class: labelled documents, and characters beyond which a further document is left out.
SAMPLE_DOCS, SAMPLE_CHARS = 1_200, 8_000_000
DICTIONARY_BYTES, LEVEL = 100_000, 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_AUTO if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=kind), compression_params=params)


def build_dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or where texts are too few for training their own tail."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY_BYTES:] or b" " * 8


def features(texts: list[str | None], good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    """1, and how much larger the text gets with the bad dictionary than with the good one, over its own size."""
    out = np.zeros((len(texts), 2))
    out[:, 0] = 1
    for k, t in enumerate(texts):
        if raw := (t or "").encode("utf-8", "surrogatepass"):
            out[k, 1] = (len(bad.compress(raw)) - len(good.compress(raw))) / len(raw)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method for a lightly shrunk logistic regression with weighted rows."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Scorer:
    def __init__(self, model: Model):
        self.good, self.bad, self.weights = compressor(model.good), compressor(model.bad), np.array(model.weights)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(texts, self.good, self.bad) @ self.weights, -30, 30)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from rows of `labels` whose fold (crc32 of the id modulo 3) is not 1; their texts' bounded sample reaches the driver."""
    marks = labels.filter((fold("doc_id", 3) != 1) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).filter("q = q2").select("doc_id", "q")
    counts = {r["q"]: r["n"] for r in marks.groupBy("q").agg(F.count("*").alias("n")).collect()}
    order = Window.partitionBy("q").orderBy(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)), "doc_id")
    # about twice as many rows as are ranked, so that no class is sorted as a whole
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = [min(1.0, 2 * SAMPLE_DOCS / max(1, counts.get(q, 0))) for q in (0, 1)]
    marks = marks.filter(place <= F.when(F.col("q") == 1, share[1]).otherwise(share[0]))
    chosen = marks.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLE_DOCS)  # 2 * SAMPLE_DOCS rows
    # one text of a doc_id that stands at several
    found = docs.filter(F.length("text") > 0).select("doc_id", F.length("text").alias("size"), F.xxhash64("text").alias("h")).join(F.broadcast(chosen), "doc_id").groupBy("q", "rank", "doc_id").agg(F.min(F.struct("h", "size")).alias("m")).select("q", "rank", "doc_id", "m.h", "m.size").collect()
    total, keys = {0: 0, 1: 0}, []
    for r in sorted(found, key=lambda r: (r["q"], r["rank"])):
        if total[r["q"]] + r["size"] <= SAMPLE_CHARS:
            total[r["q"]] += r["size"]
            keys.append((r["doc_id"], r["h"], r["q"]))
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    flat = Model(b" " * 8, b" " * 8, (float(np.log(prior / (1 - prior))), 0.0))
    if not keys:
        return flat
    wanted = docs.sparkSession.createDataFrame(keys, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h bigint, q int")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(wanted), ["doc_id", "h"]).groupBy("doc_id", "q").agg(F.max("text").alias("text")).collect()
    rows = sorted({(r["q"], r["text"]) for r in texts}, key=lambda x: (hash_text(x[1]), x[1]))
    dictionary, curve = [x for k, x in enumerate(rows) if k % 2], rows[::2]
    by = {q: [t.encode("utf-8", "surrogatepass") for k, t in dictionary if k == q] for q in (0, 1)}
    y = np.array([q for q, _ in curve], float)
    if not by[0] or not by[1] or len(set(y)) < 2:
        return flat
    good, bad = build_dictionary(by[1]), build_dictionary(by[0])
    x = features([t for _, t in curve], compressor(good), compressor(bad))
    weight = np.where(y == 1, counts[1] / sum(y == 1), counts[0] / sum(y == 0))  # back to the labels' shares
    w = fit_logistic(x, y, weight / weight.mean())
    return Model(good, bad, tuple(map(float, w)))


def hash_text(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            s = scorer.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), (fold("doc_id", 3) == 1).alias("held_out"), docs["text"])
    return map_arrow(rows, run, "doc_id bigint, held_out boolean, score double, predicted int")


def accept(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, that score `least` or more."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scorer.score(batch.column(at).to_pylist()) >= least))

    return map_arrow(docs, run, docs.schema)
