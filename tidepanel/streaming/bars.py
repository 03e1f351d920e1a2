"""Structured Streaming versions of bar building, volatility and the stateful signal.

Events carry (event_id, ts, user_id, event_type, value). Every stream has a batch twin that must give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.statescan import _AFTER, compose, scan_states
from ..operators.factors import FactorConfig, _next

EVENT_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
                             T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
                             T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def event_order(ts: Column, event_id: Column) -> Column:
    """Time, then the whole event id, as one DECIMAL(38): exact, and of fixed width, so hash aggregation can keep it."""
    whole = event_id.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    return (F.unix_micros(ts).cast("decimal(17,0)") * F.lit(str(10 ** 20)).cast("decimal(21,0)") + whole).cast("decimal(38,0)")


def event_bars(events: DataFrame, every: str = "1 day", key: str = "event_type", late: str | None = "1 hour") -> DataFrame:
    """Tumbling bars. On a stream in append mode only windows behind the watermark come out: the forming bar is withheld."""
    if late is not None:
        events = events.withWatermark("ts", late)
    order = event_order(F.col("ts"), F.col("event_id"))
    b = events.groupBy(F.window("ts", every).alias("w"), F.col(key).alias("symbol")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", order).alias("close"), F.count("*").alias("events"))
    return b.select(F.to_date("w.start").alias("date"), "symbol", "open", "high", "low", "close", "events")


def finished(bars: DataFrame, last_event: DataFrame, late_seconds: int, every_seconds: int = 86400) -> DataFrame:
    """The batch twin's filter: windows that end at or before the watermark."""
    mark = last_event.select(F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))) - late_seconds).scalar()
    return bars.where(F.unix_timestamp(F.col("date").cast("timestamp")) + every_seconds <= mark)


def sliding_volatility(events: DataFrame, width: str = "20 days", slide: str = "1 day", key: str = "event_type", late: str | None = "1 hour") -> DataFrame:
    if late is not None:
        events = events.withWatermark("ts", late)
    g = events.groupBy(F.window("ts", width, slide).alias("w"), F.col(key).alias("symbol")).agg(
        F.stddev_samp("value").alias("vol"), F.count("*").alias("events"))
    return g.select(F.to_date("w.end").alias("date"), "symbol", "vol", "events")


def with_dimension(stream: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Stream-static join. The dimension is re-read per batch; Spark broadcasts it when it is small."""
    return stream.join(dim, on, "left")


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "append", progress: list | None = None) -> DataFrame:
    """Drive a stream over everything available now and return what it wrote, as parquet in the shared folder. The run's
    progress, one entry a batch, is added to `progress`."""
    out, state = f"{checkpoint}/{name}/data", f"{checkpoint}/{name}/state"
    if progress is not None:                    # Spark keeps the newest 100 entries unless told otherwise
        df.sparkSession.conf.set("spark.sql.streaming.numRecentProgressUpdates", str(10 ** 6))
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode(mode)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if progress is not None:
        progress += q.recentProgress
    return df.sparkSession.read.schema(df.schema).parquet(out)


def run_counts(spark: SparkSession, name: str, checkpoint: str, progress: list, emitted: DataFrame, count: str = "events") -> DataFrame:
    """One row for a finished run of an aggregation by `run_to_table`: input rows, rows dropped behind the watermark in this
    run, and groups dropped. `progress` is the query's progress, `count` the column of `emitted` that counts input rows.

    Spark counts what it drops after its partial sums, that is groups; rows follow from what is neither in a written bar
    nor in the state, which is read from the checkpoint. Earlier runs' rows are read back from the counts written before."""
    out = f"{checkpoint}/{name}/runs"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    before = spark.read.parquet(out) if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder) else None
    run, came, gone = before.agg(F.count("*"), F.sum("input_rows"), F.sum("dropped_rows")).first() if before is not None else (0, 0, 0)
    rows = sum(p["numInputRows"] for p in progress)
    groups = sum(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])
    state = spark.read.format("statestore").load(f"{checkpoint}/{name}/state")
    held = state.agg(F.coalesce(F.sum("value.count"), F.lit(0))).first()[0]
    written = emitted.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    row = spark.createDataFrame([(run + 1, rows, came + rows - gone - written - held, groups)], "run long, input_rows long, dropped_rows long, dropped_groups long")
    row.coalesce(1).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def stored_keys(spark: SparkSession, path: str, key: str, buckets: list[int]) -> DataFrame | None:
    """(key, epoch) of these buckets of a key store; other buckets are neither listed nor read. None where there are none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    there = [p for p in (f"{path}/bucket={b}" for b in buckets) if folder(p).getFileSystem(conf).exists(folder(p))]
    return spark.read.option("basePath", path).parquet(*there).select(key, "epoch") if there else None


def idempotent_sink(path: str, key: str, buckets: int = 64):
    """foreachBatch writer: a key already in the store is not written again, so replays and duplicates leave one row.

    Keys are dealt into buckets by hash, which are folders: a batch is compared with the buckets of its own keys only. Each
    batch writes its own partition of a bucket and replaces it on a replay, so a lost executor or a restart cannot double it."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        try:
            touched = sorted(r[0] for r in new.select("bucket").distinct().collect())      # at most `buckets` numbers
            seen = stored_keys(spark, path, key, touched)
            rows = new if seen is None else new.join(seen.where(F.col("epoch") != epoch).select(key), key, "left_anti")
            (rows.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("bucket", "epoch").parquet(path))
        finally:
            new.unpersist()
    return write


# ------------------------------------------------------------------ stateful signal

SIGNAL_OUT = "symbol string, slice long, place long, t long, event_id long, s double, code int"
SIGNAL_STATE = "code int, n long, held binary"
_ROW = np.dtype([("t", "<i8"), ("id", "<i8"), ("s", "<f8")])
_SAME = 5       # the map that leaves every state as it is


def _codes(s: np.ndarray, cfg: FactorConfig) -> np.ndarray:
    """Each score's map of the states before it to those after it (see `statescan`); an unknown score closes."""
    opened = np.where(s < -cfg.s_open, 1, np.where(s > cfg.s_open, -1, 0))
    short, long_ = np.where(s < cfg.s_close_short, 0, -1), np.where(s > -cfg.s_close_long, 0, 1)
    return np.where(np.isnan(s), 13, 9 * (short + 1) + 3 * (opened + 1) + long_ + 1).astype(np.uint8)


def hysteresis_stream(scores: DataFrame, cfg: FactorConfig, late: str = "0 seconds", slice_seconds: int = 3600) -> DataFrame:
    """Rows of (symbol, ts, event_id, s) scores arriving in any order within the watermark, each with the map `code` from the
    state at the start of its slice of time to the state after it; `slice_states` gives the states.

    Rows wait in the state of their key and slice until the watermark passes them, then their maps compose in order of time
    and event id. A group holds the rows of one slice, never a key's history, so a hot key is spread over many tasks; a slice
    that lies behind the watermark leaves the state. The last rows of a finished stream come when the watermark passes them."""
    width = slice_seconds * 1000

    def fold(key, frames: Iterator[pd.DataFrame], st) -> Iterator[pd.DataFrame]:
        code, n, held = st.get if st.exists else (_SAME, 0, b"")
        parts = [np.frombuffer(bytes(held), _ROW)]
        for f in frames:
            new = np.empty(len(f), _ROW)
            new["t"], new["id"], new["s"] = f["us"], f["event_id"], f["s"].astype("float64")
            parts.append(new)
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows["id"], rows["t"]))]
        mark = st.getCurrentWatermarkMs()
        due, rest = np.split(rows, [np.searchsorted(rows["t"], mark * 1000, "right")])
        out = _AFTER[compose(_codes(due["s"], cfg)), code]
        end = (int(key[1]) + 1) * width
        if mark >= end and not len(rest):
            st.remove()
        else:
            st.update((int(out[-1]) if len(out) else code, n + len(out), rest.tobytes()))
            # a timeout fires once the watermark is beyond it: just before the next row is due, or the slice ends
            st.setTimeoutTimestamp(max(-(-int(rest["t"][0]) // 1000) - 1 if len(rest) else end - 1, mark))
        if len(out):
            yield pd.DataFrame({"symbol": key[0], "slice": key[1], "place": np.arange(n, n + len(out)), "t": due["t"], "event_id": due["id"],
                                "s": due["s"], "code": out.astype(np.int32)})

    us = F.unix_micros("ts")
    s = scores.withWatermark("ts", late).withColumn("us", us).withColumn("slice", F.floor(us / F.lit(width * 1000)).cast("long"))
    return s.groupBy("symbol", "slice").applyInPandasWithState(fold, SIGNAL_OUT, SIGNAL_STATE, "append", "EventTimeTimeout")


def slice_states(coded: DataFrame) -> DataFrame:
    """(symbol, t, event_id, s, state) of what `hysteresis_stream` wrote: the maps of whole slices, one row each, give every
    slice the state it starts from."""
    place = lambda code, state: F.when(state == -1, F.floor(code / 9)).when(state == 0, F.floor(code / 3) % 3).otherwise(code % 3) - 1
    slices = coded.groupBy("symbol", "slice").agg(F.max_by("code", "place").alias("code"))
    ends = scan_states(slices, ("symbol",), ("slice",), lambda before: place(F.col("code"), before))
    before = F.lag("state", 1, 0).over(Window.partitionBy("symbol").orderBy("slice"))       # one row per slice
    starts = ends.select(F.col("symbol").alias("_symbol"), F.col("slice").alias("_slice"), before.alias("_start"))
    got = coded.join(starts, F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.col("slice") == F.col("_slice")))
    return got.select("symbol", "t", "event_id", "s", place(F.col("code"), F.col("_start")).cast("int").alias("state"))


def hysteresis_batch(scores: DataFrame, cfg: FactorConfig) -> DataFrame:
    """The same states in batch, in order of time and event id, in parallel inside a key (see `statescan`)."""
    rows = scores.select("symbol", F.unix_micros("ts").alias("t"), "event_id", "s")
    rule = lambda before: _next(before, F.when(~F.isnan("s"), F.col("s")), F.lit(True), cfg)
    return scan_states(rows, ("symbol",), ("t", "event_id"), rule).select("symbol", "t", "event_id", "s", "state")
