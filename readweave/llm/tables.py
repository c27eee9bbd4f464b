"""Tables in the folder that all executors share, and other Spark plumbing of the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, a temporary folder of this machine in local mode, as in tests,
    and an error otherwise: executors of a cluster don't share such a folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "/tmp/readweave-shared"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_written: list[str] = []

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Removes an execution's shuffle files when it has ended
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bound_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Arrow batches of at most `most` bytes (or one row) in this session, unless it sets a size of its own: a batch stands
    several times in the memory of an executor and its worker."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(most))


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Executions within leave no shuffle files: their results are in written tables, which nothing computes again."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; `clear` deletes what is there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written() -> int:
    """How many paths the operators have asked for so far in this process: a mark for `clear`."""
    return len(_written)


def clear(spark: SparkSession, *keep: DataFrame, since: int = 0) -> None:
    """Delete what the operators wrote in this process since a mark, but the tables to keep: other results that are still
    lazy can't be read after."""
    kept = [f for df in keep for f in df.inputFiles()]
    for path in _written[since:]:
        if not any(f"/{path.rpartition('/')[2]}/" in f for f in kept):
            _delete(spark, path)
            _written.remove(path)


def stash(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, and outlives executors."""
    spark = df.sparkSession
    bound_batches(spark)
    path = new_path(spark, name)
    with cleaned(spark):
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*parts) if parts else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstash(*tables: DataFrame) -> None:
    """Delete stashed tables that no plan reads any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets(spark: SparkSession, each: int = 4) -> int:
    """Several hash buckets for every shuffle partition, so that partitions get even shares."""
    return each * int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
