"""Relations derived from the star-schema test tables: what the registered queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import change, shift
from ..session import cut_lineage
from . import bars as B


class Tables:
    """Lazy views of one data folder. Brands are the instruments; a trade is a line item at its unit price."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, str(sf_dir).rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self._kept: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # ------------------------------------------------------------------ bars

    def trades(self, freq: str = "week", start=None, end=None) -> DataFrame:
        """Dated, priced line items with a total order inside any (date, symbol)."""
        li = self.table("lineitem")
        if start is not None:
            li = li.where(F.col("l_shipdate") >= F.lit(start).cast("timestamp_ntz"))
        if end is not None:
            li = li.where(F.col("l_shipdate") < F.lit(end).cast("timestamp_ntz"))
        day = F.to_date("l_shipdate")
        date = {"week": F.date_sub(day, F.weekday(day)), "day": day, "month": F.trunc(day, "month")}[freq]
        order = B.trade_order(F.datediff(day, date), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"))
        return li.select(date.alias("date"), "l_partkey", "l_suppkey", order.alias("ord"),
                         (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"),
                         F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("c"),
                         F.col("l_quantity").alias("q"))

    def brand_trades(self, freq: str = "week", start=None, end=None) -> DataFrame:
        part = self.table("part").select("p_partkey", F.col("p_brand").alias("symbol"))
        return self.trades(freq, start, end).join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")

    def bars(self, freq: str = "week", start=None, end=None, cents: bool = False) -> DataFrame:
        """Bars per (date, brand); `start`/`end` reach the file scan."""
        out = B.ohlc(self.brand_trades(freq, start, end), ["date", "symbol"], "px", "ord", "q", "c")
        return out.select(*B.BAR_COLUMNS, *(["cents"] if cents else []))

    def calendar(self, freq: str = "week") -> DataFrame:
        """Ordinals of the trading dates, from a one-column scan."""
        if freq == "week" and self._kept is not None:
            return self._kept.select("date", "t").distinct()
        day = F.to_date("l_shipdate")
        date = F.date_sub(day, F.weekday(day)) if freq == "week" else day
        return B.calendar(self.table("lineitem").select(date.alias("date")))

    def keep_panel(self) -> Tables:
        """Write the weekly panel once to the checkpoint folder. For queries that read it several times: the trades
        are then scanned once, and the panel is far smaller than they are."""
        if self._kept is None:
            self._kept = cut_lineage(self.panel())
        return self

    def panel(self, freq: str = "week", start=None, end=None) -> DataFrame:
        if freq == "week" and start is None and end is None and self._kept is not None:
            return self._kept
        return B.number_days(self.bars(freq, start, end), self.calendar(freq))

    def dense(self, freq: str = "week") -> DataFrame:
        return B.densify(self.panel(freq), self.calendar(freq))

    # ------------------------------------------------------------------ a universe that grows with the data

    def supplier_panel(self) -> DataFrame:
        """Monthly bars per supplier: as many instruments as the scale factor brings, numbered by month."""
        out = B.ohlc(self.trades("month"), ["date", "l_suppkey"], "px", "ord", "q", "c")
        t = (F.year("date") - 1995) * 12 + F.month("date") - 1
        return out.select("date", F.format_string("S%012d", "l_suppkey").alias("symbol"), "adj_close", "volume",
                          t.cast("int").alias("t"))

    def supplier_scores(self) -> DataFrame:
        """One-month reversal score and next-month return per supplier and month."""
        p = self.supplier_panel()
        r = p.select("date", "symbol", (-change("adj_close", 1)).alias("score"),
                     (shift("adj_close", -1) / F.col("adj_close") - 1).alias("fwd"))
        return r.where(F.col("score").isNotNull() & F.col("fwd").isNotNull())

    # ------------------------------------------------------------------ dimensions and funds

    def sectors(self) -> DataFrame:
        n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 5
        d = self.table("part").select(F.col("p_brand").alias("symbol"), n.alias("sector")).distinct()
        return d.withColumn("fund", F.concat(F.lit("F"), F.col("sector").cast("string")))

    def fund_bars(self, freq: str = "week") -> DataFrame:
        """Volume-weighted price per sector fund, and MKT over all brands."""
        b = self.bars(freq, cents=True).join(self.sectors(), "symbol")
        legs = b.select("date", F.explode(F.array("fund", F.lit("MKT"))).alias("symbol"), "cents", "volume")
        g = legs.groupBy("date", "symbol").agg(F.sum("cents").alias("c"), F.sum("volume").alias("volume"))
        return g.select("date", "symbol", ((F.col("c").cast("double") / 100.0) / F.col("volume")).alias("adj_close"),
                        "volume")

    # ------------------------------------------------------------------ scores

    def returns(self, freq: str = "week") -> DataFrame:
        """Panel with ret (into t) and fwd (out of t)."""
        return self.panel(freq).select("date", "symbol", "t", "adj_close", "close", "volume",
                                       change("adj_close", 1).alias("ret"),
                                       (shift("adj_close", -1) / F.col("adj_close") - 1).alias("fwd"))

    def score_columns(self, freq: str = "week") -> DataFrame:
        """Model-free scores side by side: 5-period reversal and the price-trend signals."""
        p = self.panel(freq)
        x = F.col("adj_close")
        return p.select("date", "symbol", "t",
                        (shift(x, -1) / x - 1).alias("fwd"),
                        (-change(x, 5)).alias("rev5"),
                        (shift(x, 4) / shift(x, 52) - 1).alias("mom"),
                        (-change(x, 4)).alias("str"), (-change(x, 1)).alias("wstr"))

    def scores(self, models=("rev5", "mom", "str", "wstr")) -> DataFrame:
        """Long (model, date, symbol, t, score, fwd), unknown scores dropped."""
        s = self.score_columns()
        stack = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in models]))
        return (s.select("date", "symbol", "t", "fwd", stack.alias("s"))
                .select(F.col("s.model").alias("model"), "date", "symbol", "t", F.col("s.score").alias("score"), "fwd")
                .where(F.col("score").isNotNull()))

    # ------------------------------------------------------------------ events

    def events(self) -> DataFrame:
        return self.table("events")
