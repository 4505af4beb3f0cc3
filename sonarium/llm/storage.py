"""Where operators keep what must outlive an executor: the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths written inside scratch() blocks that are open here, innermost last; each thread and each context has blocks of its own.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open scratch blocks", default=())
#: Bytes of an Arrow batch that goes to Python, in place of Spark's default.
BATCH_KEY, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the batches that go to Python more tightly, unless the session has a bound of its own."""
    if spark.conf.get(BATCH_KEY) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names; a temporary one is set only where none is named and Spark runs in this process, as in tests."""
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="sonarium-")
        spark.conf.set("spark.checkpoint.dir", where)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(where)
    return where


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written to the shared folder and read from there. Inside scratch() they go with the block."""
    if _open.get():
        return written(df, "cut")
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a Parquet table of its own in the shared folder, and the table's path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def written(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """The rows as a Parquet table in the shared folder, for plans that read few of their columns, more than once.

    It goes at the end of the innermost scratch() block, or with outlive at the end of the one around it. Where
    there is none, what reads the table decides: it stays."""
    table, path = stored(df, name)
    around = _open.get()[: -1 if outlive else None]
    if around:
        around[-1].append(path)
    return table


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that written() and checkpointed() make inside go at the end; what leaves this block must not read them."""
    mine: list[str] = []
    token = _open.set((*_open.get(), mine))
    try:
        yield
    finally:
        _open.reset(token)
        for path in mine:
            delete(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
