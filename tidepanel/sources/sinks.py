"""Sinks and stores: bar tables, per-variant results, replace-one-variant writes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the folder that driver and executors share."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by year, clustered so that a year is a handful of sorted files rather than one per task."""
    (bars.withColumn("year", F.year("date")).repartition("year", F.pmod(F.hash("symbol"), F.lit(16)))
     .sortWithinPartitions("year", "symbol", "date").write.mode(mode).partitionBy("year").parquet(path))


def replace_variants(df: DataFrame, path: str, key: str = "variant") -> None:
    """Overwrite only the partitions (models, variants) present in `df`; the others stay."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path))


def load_variant(spark: SparkSession, path: str, value: str, key: str = "variant") -> DataFrame:
    """One partition of a store; an unknown name is an error."""
    df = spark.read.parquet(path).where(F.col(key) == value)
    if df.isEmpty():
        raise ValueError(f"nothing stored for {key}={value!r}")
    return df


def with_ensemble(pred: DataFrame, models=("forest", "boosting", "mlp")) -> DataFrame:
    """Adds the plain mean of the listed model columns."""
    total = F.lit(0.0)
    for m in models:
        total = total + F.col(m)
    return pred.withColumn("ensemble", total / len(models))
