"""What the operators of this folder share: the shared folder, checkpoints, column selection, guarded broadcasts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most rows of a few fixed-width columns that are broadcast; beyond it a join is shuffled.
BROADCAST_ROWS = 500_000


#: The most bytes of an Arrow batch between the JVM and Python, about; long texts would else make batches of any size.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one, in local mode only."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="evidentia-"))
    return sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().get()


def economical(spark: SparkSession) -> None:
    """Session settings that bound memory and disk: small Arrow batches, and shuffle files that go when their query ends."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def map_arrow(df: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """df.mapInArrow() in batches of bounded bytes, by workers that give memory back at the end of a partition."""
    economical(df.sparkSession)
    return df.mapInArrow(lean(run), schema)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder's URI below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialised once in the shared folder; later reads survive lost executors.

    A checkpoint hands the size that its plan was guessed to have on to the plans that read it. In iterations of joins the
    guesses multiply until their digits alone slow the optimizer down, so the rows are taken without a guess."""
    spark = df.sparkSession
    shared_folder(spark)
    economical(spark)
    done = df.checkpoint()
    rows = done._jdf.queryExecution().toRdd()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, done._jdf.schema(), False), spark)


def cut_few(df: DataFrame) -> DataFrame:
    """cut() for rows that are few for their partitions: four tasks a core at most, so not a file for each empty one."""
    return cut(df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows (counted here), else as it is. Give it materialised rows.

    `weight` counts the values of a row that holds arrays; then their sum is bounded."""
    if weight is None:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    return F.broadcast(df) if (df.agg(F.sum(weight + 1)).first()[0] or 0) <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores in front as make it none of the frame's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_of(column: str = "text") -> Column:
    """The text, a null one empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A partition function after which its worker gives freed memory back, since workers serve many stages."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Returns freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries lack it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def broadcast_value(spark: SparkSession, make: Callable[[], object]):
    """A value of bounded size that is made once, on the driver, which keeps nothing of it but the broadcast file."""
    out = spark.sparkContext.broadcast(make())
    give_back()
    return out
