"""Materialised steps: each is computed once, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in spark.checkpoint.dir (a temporary folder where that is unset, in local mode only); later steps read it.

    A checkpoint hands the size that its plan was guessed to have on to the plans that read it. From wave to wave the guesses
    multiply until their digits alone hold the optimizer up for minutes, so the rows are taken without a guess; adaptive
    execution sees their true sizes."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="evidentia-"))
    done = df.checkpoint()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)
