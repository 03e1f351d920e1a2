"""Time splits, samples and cross-validation roles on the trading-day ordinal."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crosssection import wide_rank


def _share(frac: float) -> str:
    """Hex threshold below which a uniform md5 falls with probability `frac`."""
    return format(min(int(frac * 16 ** 8), 16 ** 8 - 1), "08x")


def key_hash(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.col(p).cast("string") for p in parts]))


def embargo_start(cal: DataFrame, train_end, h: int) -> dt.date:
    """Earliest test start for a training set ending on `train_end`."""
    b = cal.agg(F.min("date").alias("a"), F.max("date").alias("z"), F.max("t").alias("last"),
                F.max(F.when(F.col("date") <= F.lit(train_end), F.col("t"))).alias("pos")).first()
    if b["pos"] is None:
        raise ValueError(f"train_end ({train_end}) is before the first date in the data ({b['a']}).")
    if b["pos"] >= b["last"]:
        raise ValueError(f"train_end ({train_end}) leaves no dates for testing: the data ends {b['z']}.")
    return cal.where(F.col("t") == min(b["pos"] + int(h), b["last"])).first()["date"]


def time_split(ds: DataFrame, cal: DataFrame, train_end: str, test_start: str, h: int) -> DataFrame:
    """Rows tagged train or test; the embargo gap belongs to neither. Bad ranges are errors in plain words.

    The checks read one row of the calendar, never the data set.
    """
    e, s = F.to_date(F.lit(train_end)), F.to_date(F.lit(test_start))
    if str(test_start) <= str(train_end):
        raise ValueError(f"test_start ({test_start}) must come after train_end ({train_end}).")
    b = cal.agg(F.max(F.when(F.col("date") <= e, F.col("t"))).alias("pos"), F.max("t").alias("last"),
                F.max("date").alias("z")).first()
    if b["pos"] is None:
        raise ValueError(f"no data on or before train_end ({train_end}), so the training set would be empty.")
    if b["pos"] + h > b["last"]:
        raise ValueError(f"train_end ({train_end}) leaves no room for a test set after a {h}-day embargo.")
    first = cal.where(F.col("t") == b["pos"] + h).first()["date"]
    if str(test_start) < str(first):
        raise ValueError(f"test_start ({test_start}) is too close to train_end ({train_end}): the test must start on or "
                         f"after {first}, when the last training target is known.")
    if str(test_start) > str(b["z"]):
        raise ValueError(f"no data on or after test_start ({test_start}), so the test set would be empty.")
    return ds.withColumn("split", F.when(F.col("date") <= e, "train").when(F.col("date") >= s, "test")).where(
        F.col("split").isNotNull())


def random_split(ds: DataFrame, test_size: float = 0.25, seed: int = 0) -> DataFrame:
    """The wrong split, for comparison: each row by a hash of its key, so reruns and repartitions agree."""
    h = F.substring(key_hash("symbol", "date", F.lit(str(seed))), 1, 8)
    return ds.withColumn("split", F.when(h < _share(test_size), "test").otherwise("train"))


def split_report(split: DataFrame) -> DataFrame:
    """First and last date, days and rows per side, and the calendar gap before the test side."""
    g = split.groupBy("split").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                                   F.count_distinct("date").alias("trading_days"), F.count("*").alias("rows"))
    train_end = F.max(F.when(F.col("split") == "train", F.col("last_date"))).over(Window.partitionBy(F.lit(1)))
    return g.withColumn("gap_days", F.when(F.col("split") == "test", F.datediff("first_date", train_end)))


def stratified_sample(ds: DataFrame, frac: float, seed: int = 0) -> DataFrame:
    """round(frac * n) rows of every date, the choice fixed by a hash of the symbol."""
    w = Window.partitionBy("date")
    r = F.row_number().over(w.orderBy(key_hash("symbol", F.lit(str(seed))), "symbol"))
    return (ds.withColumn("_r", r).withColumn("_n", F.count("*").over(w))
            .where(F.col("_r") <= F.round(F.col("_n") * frac)).drop("_r", "_n"))


def study_periods(dates: DataFrame, train: int = 750, trade: int = 250, last_partial: bool = True) -> DataFrame:
    """(period, train_start, train_end, trade_start, trade_end) from the distinct dates that have features."""
    d = dates.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    p = (d.where(F.col("i") >= train).withColumn("period", F.floor((F.col("i") - train) / trade).cast("int") + 1)
         .groupBy("period").agg(F.min("i").alias("a"), F.min("date").alias("trade_start"),
                                F.max("date").alias("trade_end"), F.count("*").alias("n")))
    if not last_partial:
        p = p.where(F.col("n") == trade)
    at = lambda name: d.select(F.col("i").alias(f"_{name}"), F.col("date").alias(name))
    return (p.join(at("train_start"), F.col("_train_start") == F.col("a") - train)
            .join(at("train_end"), F.col("_train_end") == F.col("a") - 1)
            .select("period", "train_start", "train_end", "trade_start", "trade_end"))


def tag_periods(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """Each row with every period it trains or trades in. Periods number one per trading block: broadcast range join."""
    d = F.col("date")
    inside = d.between(F.col("train_start"), F.col("trade_end"))
    return (rows.join(F.broadcast(periods), inside)
            .withColumn("role", F.when(d <= F.col("train_end"), "train").otherwise("trade"))
            .drop("train_start", "train_end", "trade_start", "trade_end"))


def purged_folds(cal: DataFrame, k: int, h: int = 1, embargo: int = 0) -> DataFrame:
    """(fold, date, role): consecutive date blocks tested in turn; dates whose labels overlap the block are purged."""
    d = cal.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)
    d = d.withColumn("block", F.ntile(k).over(Window.orderBy("date")))
    blocks = d.groupBy(F.col("block").alias("fold")).agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    folds = F.explode(F.sequence(F.lit(1), F.lit(k))).alias("fold")
    i = F.col("i")
    return (d.select("date", "i", folds).join(F.broadcast(blocks), "fold")
            .withColumn("role", F.when(i.between(F.col("lo"), F.col("hi")), "test")
                        .when(i.between(F.col("lo") - h, F.col("hi") + max(h, embargo)), "purged").otherwise("train"))
            .select("fold", "date", "role"))


def shuffled_folds(ds: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Equal-size folds of shuffled rows (the leaky kind). The shuffle is a distributed rank of a key hash."""
    h = key_hash("symbol", "date", F.lit(str(seed)))
    x = F.conv(F.substring(h, 1, 13), 16, 10).cast("double")
    r = wide_rank(ds.withColumn("_h", x), [], "_h", ["symbol", "date"])
    return r.withColumn("fold", F.pmod(F.col("place"), F.lit(k)).cast("int")).drop("_h", "place", "rank", "size")


def every_kth(rows: DataFrame, k: int, start: int = 0, offset: int = 0) -> DataFrame:
    """Rows on every k-th trading day from `start` + `offset`."""
    i = F.col("t") - start - offset
    return rows.where((i >= 0) & (F.pmod(i, F.lit(k)) == 0))
