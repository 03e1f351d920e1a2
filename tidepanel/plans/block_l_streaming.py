"""Streams over the events table, each driven to its end and compared with its batch twin."""

from pyspark.sql import functions as F

from ..operators.factors import FactorConfig
from ..sources.sinks import shared_folder
from ..streaming import bars as S
from .block_e_evaluate import rnd
from .registry import query

ORD = "{'ts': ts, 'id': event_id}"
FIN = "(SELECT epoch(max(ts)) - 3600 FROM events)"
L1 = f"""SELECT CAST(ts AS DATE) AS date, event_type AS symbol, arg_min(value, {ORD}) AS open, max(value) AS high, min(value) AS low, arg_max(value, {ORD}) AS close,
 count(*) AS events FROM events GROUP BY 1, 2 HAVING epoch(CAST(CAST(ts AS DATE) AS TIMESTAMP)) + 86400 <= {FIN}"""


def stream(t):
    """The events file as a stream (the glob lets a single file be a streaming source)."""
    return S.read_events(t.spark, f"{t.dir}/event[s].parquet")


def batch(t):
    return t.events().withColumn("ts", F.col("ts").cast("timestamp"))


@query("l1_stream_bars", L1)
def l1(t):
    """Daily bars from the stream: the unfinished last day never comes out."""
    return S.run_to_table(S.event_bars(stream(t)), "bars", shared_folder(t.spark, "stream"))


@query("l1_batch_twin", L1)
def l1b(t):
    return S.finished(S.event_bars(batch(t), late=None), batch(t), 3600)


def late_runs(t):
    """Bars and counts of one stream in two runs: all days but the first, then the first day."""
    folder = shared_folder(t.spark, "late")
    first = t.events().select(F.min(F.to_date("ts"))).scalar()
    e = t.events()
    for part, rows in ((1, F.to_date("ts") != first), (2, F.to_date("ts") == first)):
        e.where(rows).write.parquet(f"{folder}/in/part={part}")
        progress = []
        out = S.run_to_table(S.event_bars(S.read_events(t.spark, f"{folder}/in/part=*")), "bars", folder, progress=progress)
        counts = S.run_counts(t.spark, "bars", folder, progress, out)
    return out, counts


@query("l2_dropped_rows", """SELECT CASE WHEN CAST(ts AS DATE) = (SELECT min(CAST(ts AS DATE)) FROM events) THEN 2 ELSE 1 END AS run, count(*) AS input_rows,
 count(*) FILTER (WHERE CAST(ts AS DATE) = (SELECT min(CAST(ts AS DATE)) FROM events)) AS dropped_rows FROM events GROUP BY 1""")
def l2d(t):
    """Rows in and rows dropped behind the watermark, by run of the stream."""
    return late_runs(t)[1].select(F.col("run").cast("int").alias("run"), "input_rows", "dropped_rows")


@query("l2_late_rows", f"""SELECT symbol, min(date) AS first_bar, count(*) AS bars, CAST(sum(events) AS BIGINT) AS events FROM ({L1}) WHERE date <> (SELECT min(CAST(ts AS DATE)) FROM events) GROUP BY symbol""")
def l2(t):
    """Rows of the first day sent after the rest: dropped behind the watermark, so the bars equal those without them."""
    out, _ = late_runs(t)
    return out.groupBy("symbol").agg(F.min("date").alias("first_bar"), F.count("*").alias("bars"), F.sum("events").alias("events"))


def scores(df):
    return df.select(F.col("event_type").alias("symbol"), "ts", "event_id", ((F.col("value") - 50) / 25).alias("s"))


CFG = FactorConfig()
L3 = """WITH RECURSIVE e AS (SELECT event_type AS symbol, epoch_us(ts) AS t, event_id, (value - 50) / 25 AS s, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
st AS (SELECT symbol, 0::BIGINT AS i, 0 AS state FROM (SELECT DISTINCT symbol FROM e) UNION ALL SELECT e.symbol, e.i, CASE WHEN state = 0 THEN CASE WHEN s < -1.25 THEN 1 WHEN s > 1.25 THEN -1 ELSE 0 END
 WHEN state = 1 AND s > -0.5 THEN 0 WHEN state = -1 AND s < 0.75 THEN 0 ELSE state END FROM st JOIN e ON e.symbol = st.symbol AND e.i = st.i + 1)
SELECT e.symbol, e.t, e.event_id, round(e.s, 6) AS s, CAST(state AS INTEGER) AS state FROM st JOIN e ON e.symbol = st.symbol AND e.i = st.i"""


@query("l3_stateful_signal", L3 + " WHERE e.t <= ((SELECT epoch_us(max(ts)) // 1000 FROM events) - 60000) * 1000")
def l3(t):
    """Hysteresis states per event type from the stream, in time order."""
    out = S.run_to_table(S.hysteresis_stream(scores(stream(t)), CFG, "60 seconds"), "signal", shared_folder(t.spark, "signal"))
    return S.slice_states(out).select("symbol", "t", "event_id", *rnd("s"), "state")


@query("l3_batch_twin", L3)
def l3b(t):
    return S.hysteresis_batch(scores(batch(t)), CFG).select("symbol", "t", "event_id", *rnd("s"), "state")


@query("l4_stream_static_join", f"""WITH b AS ({L1}), d AS (SELECT event_type AS symbol, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type) SELECT date, b.symbol, close, mean_value FROM b LEFT JOIN d USING (symbol)""")
def l4(t):
    """Stream bars with a static per-type dimension."""
    dim = t.events().groupBy(F.col("event_type").alias("symbol")).agg(F.round(F.avg("value"), 6).alias("mean_value"))
    s = S.with_dimension(S.event_bars(stream(t)), dim, "symbol").select("date", "symbol", "close", "mean_value")
    return S.run_to_table(s, "joined", shared_folder(t.spark, "join"))


@query("l5_idempotent_sink", "SELECT event_id % 1000 AS order_key, count(DISTINCT event_id % 1000) AS stored FROM events GROUP BY 1")
def l5(t):
    """Order keys sent many times over are stored once."""
    folder = shared_folder(t.spark, "orders")
    s = stream(t).select((F.col("event_id") % 1000).alias("order_key"), "ts").withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["order_key"])
    q = (s.writeStream.foreachBatch(S.idempotent_sink(f"{folder}/out", "order_key")).option("checkpointLocation", f"{folder}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").groupBy("order_key").agg(F.count("*").alias("stored"))


L6 = f"""SELECT * FROM (SELECT CAST(CAST(ts AS DATE) + CAST(k + 1 AS INTEGER) AS DATE) AS date, event_type AS symbol, round(stddev_samp(value), 6) AS vol, count(*) AS events
FROM (SELECT *, unnest(range(20)) AS k FROM events) GROUP BY 1, 2) WHERE epoch(CAST(date AS TIMESTAMP)) <= {FIN}"""


@query("l6_sliding_volatility", L6)
def l6(t):
    """Twenty-day volatility every day, from the stream."""
    out = S.run_to_table(S.sliding_volatility(stream(t)), "vol", shared_folder(t.spark, "vol"))
    return out.select("date", "symbol", *rnd("vol"), "events")
