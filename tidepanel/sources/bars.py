"""Bar sources: file scans, bars from raw trades, calendars, dense grids, resampling and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import clean, col, ratio, shift

BAR_COLUMNS = ("date", "symbol", "open", "high", "low", "close", "adj_close", "volume")
PRICES = ("open", "high", "low", "close", "adj_close")
BAR_SCHEMA = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("symbol", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in BAR_COLUMNS[2:]])


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet", columns=BAR_COLUMNS) -> DataFrame:
    """Scan a bar table. CSV is read with a fixed schema and fails on a malformed row; gzipped CSV cannot be split,
    so convert it once with `sinks.write_bars` before large jobs."""
    if fmt == "csv":
        header = spark.read.option("header", True).csv(path).columns
        missing = sorted(set(columns) - set(header))
        if missing:
            raise ValueError(f"{path} is missing columns {missing}")
        fields = {f.name: f for f in BAR_SCHEMA}
        schema = T.StructType([fields.get(h, T.StructField(h, T.StringType())) for h in header])
        df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)
    else:
        df = spark.read.format(fmt).load(path)
        missing = sorted(set(columns) - set(df.columns))
        if missing:
            raise ValueError(f"{path} is missing columns {missing}")
    return df.select(*[F.col(c).cast(BAR_SCHEMA[c].dataType) for c in columns])


#: What `trade_order` keeps apart: order numbers, lines of an order, part numbers below these.
ORDERS, LINES, PARTS = 10 ** 16, 10 ** 5, 10 ** 13


def trade_order(place: Column, order_id: Column, line: Column, part: Column) -> Column:
    """Place in the period (0 to 30), order, line and part as one DECIMAL(38): exact and of fixed width, so hash
    aggregation can keep it. Numbers beyond the bounds are an error, never a wrong order."""
    fits = order_id.between(0, ORDERS - 1) & line.between(0, LINES - 1) & part.between(0, PARTS - 1)
    high = (place.cast("bigint") * ORDERS + order_id).cast("decimal(18,0)")
    low = (line.cast("bigint") * PARTS + part).cast("decimal(18,0)")
    key = (high * F.lit(str(10 ** 18)).cast("decimal(19,0)") + low).cast("decimal(38,0)")
    return F.when(fits, key).otherwise(F.raise_error(F.lit("an order, line or part number is negative or too large")).cast("decimal(38,0)"))


def ohlc(trades: DataFrame, keys: list[str], price, order, volume, notional_cents=None) -> DataFrame:
    """Bars from trades: first/highest/lowest/last price by `order`, volume-weighted price and volume.

    Every aggregate combines map-side, so a key holding a third of all trades still ships one row per task. `order`
    is one number of fixed width, which keeps the plan on hash aggregation.
    """
    px, o, v = col(price), col(order), col(volume)
    cents = F.round(px * v * 100).cast("bigint") if notional_cents is None else col(notional_cents)
    return (trades.groupBy(*keys)
            .agg(F.min_by(px, o).alias("open"), F.max(px).alias("high"), F.min(px).alias("low"),
                 F.max_by(px, o).alias("close"), F.sum(cents).alias("cents"), F.sum(v).alias("volume"))
            .withColumn("adj_close", (F.col("cents").cast("double") / 100.0) / F.col("volume")))


def calendar(dates: DataFrame, column: str = "date") -> DataFrame:
    """(date, t): trading-day ordinals from 0. The one-task window sees distinct dates only."""
    d = dates.select(F.col(column).alias("date")).distinct()
    return d.withColumn("t", F.row_number().over(Window.orderBy("date")) - 1)


def number_days(bars: DataFrame, cal: DataFrame) -> DataFrame:
    """Adds the ordinal `t`. A calendar has one row per trading day, so it is always small enough to broadcast."""
    return bars.join(F.broadcast(cal), "date")


def densify(panel: DataFrame, cal: DataFrame) -> DataFrame:
    """Every symbol on every calendar day, NULL where it has no bar. No cross join: each symbol spells out its days."""
    last = cal.select(F.max("t")).scalar()
    days = panel.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(0), last)).alias("t"))
    return (days.join(F.broadcast(cal), "t")
            .join(panel.drop("date"), ["symbol", "t"], "left"))


def to_wide(panel: DataFrame, value: str, symbols: list[str]) -> DataFrame:
    """Dates down, one column per listed symbol. The list comes from a dimension, so no job runs over the bars to find
    it; a symbol that is not listed stops the job rather than being left out."""
    known = F.when(F.col("symbol").isin(symbols), F.col("symbol")).otherwise(F.raise_error(F.concat(F.lit("symbol not in the list: "), F.col("symbol"))))
    panel = panel.withColumn("symbol", known)
    return panel.groupBy("date").pivot("symbol", symbols).agg(F.first(value))


def to_long(wide: DataFrame, value: str, symbols: list[str] | None = None) -> DataFrame:
    names = symbols or [c for c in wide.columns if c != "date"]
    return wide.unpivot(["date"], names, "symbol", value)


def vendor_long(raw: DataFrame, symbol: Column) -> DataFrame:
    """Vendor column names to ours: lower case, underscores, rows without a close dropped, symbol added."""
    tidy = raw.withColumnsRenamed({c: c.strip().lower().replace(" ", "_") for c in raw.columns})
    return tidy.withColumn("symbol", symbol).dropna(subset=["close"])


def with_ratios(bars: DataFrame, adjusted: bool = False) -> DataFrame:
    """open/close, high/close and low/close of the same day; a close of zero or less gives NULL."""
    c = F.when(F.col("close") > 0, F.col("close"))
    return bars.select("*", *[clean(F.try_divide(F.col(n), c)).alias(f"{n}_r") for n in ("open", "high", "low")])


def last_ingested(bars: DataFrame, order: str, values=BAR_COLUMNS[2:]) -> DataFrame:
    """One row per (date, symbol): the last one received wins, column by column."""
    return bars.groupBy("date", "symbol").agg(*[
        F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values])


def resample(panel: DataFrame, cal: DataFrame, every: int) -> DataFrame:
    """Bars of `every` days counted back from the last day; an incomplete first block is dropped.

    `panel` carries t, adj_close, open_r, high_r, low_r, volume. A symbol needs no bar on every day of a block.
    """
    n = cal.select(F.max("t") + 1).scalar()
    block = F.floor((n - 1 - F.col("t")) / every).cast("int")
    full = F.col("block") < F.floor(n / every).cast("int")
    ends = cal.select("date", block.alias("block")).groupBy("block").agg(F.max("date").alias("date"))
    b = panel.withColumn("block", block).where(full)
    lvl = lambda r: F.col(r) * F.col("adj_close")
    known = lambda c: F.when(c.isNotNull(), F.col("t"))
    out = b.groupBy("symbol", "block").agg(
        F.max_by("adj_close", known(F.col("adj_close"))).alias("adj_close"),
        F.min_by(lvl("open_r"), known(lvl("open_r"))).alias("o"), F.max(lvl("high_r")).alias("h"),
        F.min(lvl("low_r")).alias("l"), F.sum("volume").alias("volume"))
    return (out.join(F.broadcast(ends), "block")
            .select("date", "symbol", "adj_close", ratio("o", "adj_close").alias("open_r"),
                    ratio("h", "adj_close").alias("high_r"), ratio("l", "adj_close").alias("low_r"), "volume"))


def splice_repair(panel: DataFrame, repairs: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """At each listed (symbol, day) compare the adjusted move with the raw move; where they differ by `tolerance` or
    more, rescale every earlier adjusted price by the factor.

    `repairs` (symbol, day) is a hand-kept list. A later repair sees earlier prices already moved, which cancels in its
    own ratio, so the factors multiply.
    """
    w = Window.partitionBy("symbol").orderBy("t")
    moves = panel.select("symbol", "date", "adj_close",
                         ratio(ratio("adj_close", F.lag("adj_close").over(w)),
                               ratio("close", F.lag("close").over(w))).alias("factor"))
    hits = (moves.join(F.broadcast(repairs), (moves.symbol == repairs.symbol) & (moves.date == repairs.day), "left_semi")
            .where(F.abs(F.col("factor") - 1) >= tolerance)
            .groupBy("symbol").agg(F.collect_list(F.struct("date", "factor")).alias("hits")))
    scale = F.aggregate(F.filter(F.coalesce("hits", F.array()), lambda h: h["date"] > F.col("date")), F.lit(1.0),
                        lambda acc, h: acc * h["factor"])
    return (panel.join(hits, "symbol", "left")
            .withColumn("adj_close", F.col("adj_close") * scale).drop("hits"))


def recent_days(panel: DataFrame, cal: DataFrame, n: int) -> DataFrame:
    """Rows of the last n trading days."""
    keep = cal.orderBy(F.desc("date")).limit(n)
    return panel.join(F.broadcast(keep.select("date")), "date", "left_semi")


def lookback_start(cal: DataFrame, start, rows: int) -> Column:
    """First calendar date needed so that features with a `rows`-day lookback are complete on `start`."""
    at = cal.where(F.col("date") <= F.lit(start)).select(F.max("t").alias("t")).scalar()
    return cal.where(F.col("t") >= F.greatest(at - (rows - 1), F.lit(0))).select(F.min("date").alias("d")).scalar()
