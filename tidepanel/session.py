"""Session settings, the shared folder, and tables written once."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidepanel", master: str | None = None, shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and a UTC clock.

    On a cluster leave `master` and `shuffle_partitions` unset: the submit settings decide and AQE coalesces.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.ui.enabled", "false"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, else the checkpoint folder already set.

    A temporary folder is made only on a local master; on a cluster executors would each write to their own disk.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager)


_COLLECTING: list[list[str]] = []


@contextmanager
def collecting(paths: list[str]):
    """Adds the folders that `materialise` writes meanwhile to `paths`, for `drop_tables` once nothing reads them."""
    _COLLECTING.append(paths)
    try:
        yield
    finally:
        _COLLECTING.pop()


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders written by `materialise` and empties the list."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes `df` as Parquet to the shared folder, now, and returns the table read back: several branches then read
    it with column pruning, and a lost executor rereads files instead of recomputing."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    for kept in _COLLECTING:
        kept.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
