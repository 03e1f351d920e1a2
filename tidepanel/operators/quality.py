"""Universe selection, data checks and summary rows over bar tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bars import PRICES


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def liquid_universe(bars: DataFrame, keep: int, coverage: float = 0.99) -> DataFrame:
    """Symbols present on at least `coverage` of all dates, then the `keep` largest by median close x volume."""
    days = bars.select(F.count_distinct("date")).scalar()
    per = bars.groupBy("symbol").agg(F.count_distinct("date").alias("days"),
                                     F.median(F.col("close") * F.col("volume")).alias("dollar"))
    return (per.where(F.col("days") / days >= coverage)
            .orderBy(F.desc("dollar"), "symbol").limit(keep))


def data_checks(bars: DataFrame) -> DataFrame:
    """One row: rows, symbols, date bounds, non-positive prices, duplicate keys, all counted in one pass per key."""
    bad = F.lit(False)
    for c in PRICES:
        bad = bad | F.coalesce(~(F.col(c) > 0), F.lit(True))
    per_key = bars.groupBy("date", "symbol").agg(F.count("*").alias("n"), count_if(bad).alias("bad"))
    return per_key.agg(F.sum("n").alias("rows"), F.count_distinct("symbol").alias("symbols"),
                       F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                       F.sum("bad").alias("bad_prices"), count_if(F.col("n") > 1).alias("duplicate_keys"))


def bar_sanity(bars: DataFrame) -> DataFrame:
    """Counts of impossible and flat bars, and the symbol with the most flat bars (NULL when no bar is flat)."""
    hi, lo, o, c = (F.col(x) for x in ("high", "low", "open", "close"))
    per = bars.groupBy("symbol").agg(
        F.count("*").alias("bars"), count_if(hi < F.greatest(o, c)).alias("high_below"),
        count_if(lo > F.least(o, c)).alias("low_above"), count_if((hi == lo) & (o == c)).alias("flat"),
        count_if(c.isNotNull() & (o.isNull() | hi.isNull() | lo.isNull())).alias("close_only"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return per.agg(total("bars"), total("high_below"), total("low_above"), total("flat"), total("close_only"),
                   F.max_by("symbol", F.when(F.col("flat") > 0, F.struct("flat", "symbol"))).alias("flattest"))


def summary(bars: DataFrame) -> DataFrame:
    return bars.agg(F.count("*").alias("rows"), F.count_distinct("symbol").alias("symbols"),
                    F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                    F.count_distinct("date").alias("days"))


def last_prices(bars: DataFrame) -> DataFrame:
    """Last known price per symbol."""
    return bars.where(F.col("adj_close").isNotNull()).groupBy("symbol").agg(
        F.max_by("adj_close", "date").alias("price"), F.max("date").alias("price_date"))


def coverage_gate(bars: DataFrame, universe: DataFrame, minimum: float = 0.9) -> DataFrame:
    """Share of the universe with a price on the last day, and whether a plan may run."""
    last = bars.select(F.max("date")).scalar()
    have = bars.where((F.col("date") == last) & F.col("adj_close").isNotNull()).select("symbol").distinct()
    seen = universe.join(have.withColumn("hit", F.lit(1)), "symbol", "left")
    out = seen.agg(F.count("*").alias("universe"), F.count("hit").alias("covered"))
    share = F.col("covered") / F.col("universe")
    return out.select("universe", "covered", share.alias("share"), (share >= minimum).cast("int").alias("passes"))


def unfinished_cut(clock: DataFrame, rule: str) -> Column:
    """First date that is NOT complete, from a one-row clock (now TIMESTAMP_NTZ in exchange time, is_open INT or NULL).

    open_now: today while the market is open. before_close: today until 16:00. clock_or_today: anything after today,
    and today as well when the market is open or the clock is unknown.
    """
    now, is_open = F.col("now"), F.col("is_open")
    today = F.to_date(now)
    nxt = F.date_add(today, 1)
    cut = {"open_now": F.when(is_open == 1, today).otherwise(F.lit("9999-12-31").cast("date")),
           "before_close": F.when(F.hour(now) < 16, today).otherwise(nxt),
           "clock_or_today": F.when(F.coalesce(is_open, F.lit(1)) == 1, today).otherwise(nxt)}[rule]
    return clock.select(cut).scalar()


def completed_days(bars: DataFrame, clock: DataFrame, rule: str) -> DataFrame:
    return bars.where(F.col("date") < unfinished_cut(clock, rule))


# The key shapes a secret scan looks for.
SECRET_PATTERNS = (
    r"""APCA_API_KEY_ID\s*=\s*['"]?[A-Z0-9]{16,}""",
    r"""APCA_API_SECRET_KEY\s*=\s*['"]?[A-Za-z0-9/+]{30,}""",
    r"""\b(?:PK|AK)[A-Z0-9]{16,}\b""",
    r"""(?i)(secret|api_key|apikey|token)\s*=\s*['"][A-Za-z0-9/+_\-]{20,}['"]""",
)


def scan_secrets(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key-shaped strings per document, cut to ten characters, with their number."""
    def hits(i: int, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)),
                           lambda m: F.struct(F.lit(i).cast("bigint").alias("pattern"),
                                              F.concat(F.substring(m, 1, 10), F.lit("...")).alias("hit")))

    found = F.concat(*[hits(i, p) for i, p in enumerate(SECRET_PATTERNS, 1)])
    return (texts.select(key, F.explode(found).alias("f")).groupBy(key, "f.pattern", "f.hit")
            .agg(F.count("*").alias("hits")))
