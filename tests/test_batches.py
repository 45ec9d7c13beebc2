"""Python sees bounded batches, and characters of phrases are found without Python."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from evidentia.functions import kernels as k
from evidentia.operators import literal


def test_batches_of_kernels_are_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str(64 << 20))
    k.udf(lambda x: x, "string")("t")

    @F.arrow_udf("int")
    def rows(x: pa.Array) -> pa.Array:
        return pa.array([len(x)] * len(x), pa.int32())

    texts = spark.range(0, 4_000, 1, 1).select(F.repeat(F.lit("x"), 2_000).alias("t"))
    assert texts.select(F.max(rows("t"))).first()[0] * 2_000 < 2 * k.BATCH_BYTES


def test_short_phrases_are_found_without_python(spark):
    phrases = ["é", "a.b", "x\ny", "😀a", "no", "b😀", "zz"]
    texts = ["é", "ca.bd", "x\ny", "o😀a", "n o", "ab😀", "", None]
    p = spark.createDataFrame([(x,) for x in phrases], "phrase string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = literal.occurrences(p, d)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["phrase"], r["doc_id"]) for r in found.select("phrase", "doc_id").distinct().collect())
    assert got == sorted((x, i) for i, t in enumerate(texts) for x in phrases if x in (t or ""))
