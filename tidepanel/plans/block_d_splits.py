"""Splits, samples and fold roles."""

from pyspark.sql import functions as F

from ..functions.frames import change
from ..operators import splits as S
from .block_c_labels import dataset
from .registry import query
from .sqltext import sql

TRAIN_END, TEST_START = "1998-12-28", "1999-02-15"


@query("d1_time_split", sql(f"""SELECT date, symbol, CASE WHEN date <= DATE '{TRAIN_END}' THEN 'train' ELSE 'test' END AS split, target FROM dataset
WHERE date <= DATE '{TRAIN_END}' OR date >= DATE '{TEST_START}'""", "dataset"))
def d1(t):
    return S.time_split(dataset(t), t.calendar(), TRAIN_END, TEST_START, 4).select("date", "symbol", "split", "target")


@query("d2_embargo_start", sql(f"""SELECT date AS earliest_test_start FROM cal WHERE t = least((SELECT max(t) FROM cal WHERE date <= DATE '{TRAIN_END}') + 4,
 (SELECT max(t) FROM cal))""", "cal"))
def d2(t):
    cal = t.calendar()
    at = cal.where(F.col("date") <= F.lit(TRAIN_END).cast("date")).select(F.max("t")).scalar()
    last = cal.select(F.max("t")).scalar()
    return cal.where(F.col("t") == F.least(at + 4, last)).select(F.col("date").alias("earliest_test_start"))


@query("d3_random_split", sql("""SELECT date, symbol, CASE WHEN left(md5(symbol || '|' || CAST(date AS VARCHAR) || '|0'), 8) < '40000000' THEN 'test' ELSE 'train' END AS split
FROM dataset""", "dataset"))
def d3(t):
    return S.random_split(dataset(t), 0.25, 0).select("date", "symbol", "split")


@query("d4_split_report", sql(f"""WITH s AS (SELECT *, CASE WHEN date <= DATE '{TRAIN_END}' THEN 'train' ELSE 'test' END AS split FROM dataset
 WHERE date <= DATE '{TRAIN_END}' OR date >= DATE '{TEST_START}')
SELECT split, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS trading_days, count(*) AS rows,
 CAST(CASE WHEN split = 'test' THEN date_diff('day', (SELECT max(date) FROM s WHERE split = 'train'), min(date)) END AS INTEGER) AS gap_days
FROM s GROUP BY split""", "dataset"))
def d4(t):
    return S.split_report(S.time_split(dataset(t), t.calendar(), TRAIN_END, TEST_START, 4))


@query("d5_stratified_sample", sql("""SELECT date, symbol FROM (SELECT date, symbol, row_number() OVER (PARTITION BY date ORDER BY md5(symbol || '|7'), symbol) AS r,
 count(*) OVER (PARTITION BY date) AS n FROM dataset) WHERE r <= round(n * 0.25)""", "dataset"))
def d5(t):
    return S.stratified_sample(dataset(t), 0.25, 7).select("date", "symbol")


PERIODS = """d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM dataset)),
p AS (SELECT CAST((i - 150) // 50 + 1 AS INTEGER) AS period, min(i) AS a, min(date) AS trade_start, max(date) AS trade_end FROM d WHERE i >= 150 GROUP BY 1),
periods AS (SELECT period, (SELECT date FROM d WHERE i = a - 150) AS train_start, (SELECT date FROM d WHERE i = a - 1) AS train_end, trade_start, trade_end FROM p)"""


@query("d6_study_periods", sql(f"WITH {PERIODS} SELECT * FROM periods", "dataset"))
def d6(t):
    return S.study_periods(dataset(t), 150, 50)


@query("d7_tag_periods", sql(f"""WITH {PERIODS} SELECT period, date, symbol, CASE WHEN date <= train_end THEN 'train' ELSE 'trade' END AS role
FROM dataset JOIN periods ON date BETWEEN train_start AND trade_end""", "dataset"))
def d7(t):
    ds = dataset(t)
    return S.tag_periods(ds.select("date", "symbol"), S.study_periods(ds, 150, 50)).select("period", "date", "symbol", "role")


@query("d8_purged_folds", sql("""WITH b AS (SELECT date, t, ntile(5) OVER (ORDER BY date) AS fold FROM cal),
f AS (SELECT fold, min(t) AS lo, max(t) AS hi FROM b GROUP BY fold)
SELECT CAST(f.fold AS INTEGER) AS fold, date, CASE WHEN t BETWEEN lo AND hi THEN 'test' WHEN t BETWEEN lo - 4 AND hi + 6 THEN 'purged' ELSE 'train' END AS role
FROM b CROSS JOIN f""", "cal"))
def d8(t):
    return S.purged_folds(t.calendar(), 5, 4, 6)


@query("d9_shuffled_folds", sql("""SELECT date, symbol, CAST(row_number() OVER (ORDER BY CAST('0x' || left(md5(symbol || '|' || CAST(date AS VARCHAR) || '|3'), 13) AS BIGINT), symbol, date) % 5 AS INTEGER) AS fold
FROM dataset""", "dataset"))
def d9(t):
    return S.shuffled_folds(dataset(t).select("date", "symbol"), 5, 3)


@query("d12_every_kth_date", sql("SELECT date, symbol, adj_close FROM panel WHERE t >= 12 AND (t - 12) % 5 = 0", "panel"))
def d12(t):
    return S.every_kth(t.panel(), 5, 10, 2).select("date", "symbol", "adj_close")
