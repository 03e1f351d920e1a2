"""Sources, sinks, reshaping and quality."""

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources import bars as B
from ..sources import sinks
from .registry import query
from .sqltext import sql

COLS = "date, symbol, open, high, low, close, adj_close, volume"
WEEK0, WEEK1 = "1997-01-06", "1999-01-04"
BRANDS = [f"Brand#{i}" for i in range(1, 26)]          # the columns that the SQL spells out


def listed(t) -> list[str]:
    """The symbols of the dimension: a pivot's columns must be known before it runs."""
    return [r["symbol"] for r in t.sectors().select("symbol").distinct().orderBy("symbol").collect()]


@query("a1_scan_bars", sql(f"SELECT {COLS} FROM bars WHERE date >= DATE '{WEEK0}' AND date < DATE '{WEEK1}'", "bars"))
def a1(t):
    """Bars of a date range; the range reaches the file scan."""
    return t.bars(start=WEEK0, end=WEEK1)


@query("a2_pruned_adj_close", sql("SELECT date, symbol, adj_close FROM bars", "bars"))
def a2(t):
    return t.bars().select("date", "symbol", "adj_close")


@query("a2_pruned_volume", sql("SELECT date, symbol, volume FROM bars", "bars"))
def a2v(t):
    return t.bars().select("date", "symbol", "volume")


@query("a3_sector_dimension", sql("SELECT * FROM sectors", "sectors"))
def a3(t):
    return t.sectors()


@query("a4_market_left_join", sql("""SELECT b.date, b.symbol, b.adj_close, b.volume, o.open_r, o.high_r, o.low_r
FROM bars b LEFT JOIN (SELECT date, symbol, open / close AS open_r, high / close AS high_r, low / close AS low_r
  FROM bars WHERE high > low AND volume > 400) o ON b.date = o.date AND b.symbol = o.symbol""", "bars"))
def a4(t):
    """Closes with the day's ratios where they are known."""
    b = t.bars()
    ohl = (B.with_ratios(b).where((F.col("high") > F.col("low")) & (F.col("volume") > 400))
           .select("date", "symbol", "open_r", "high_r", "low_r"))
    return b.select("date", "symbol", "adj_close", "volume").join(ohl, ["date", "symbol"], "left")


@query("a5_predictions_ensemble", sql("""SELECT date, symbol, rev5, str, wstr, round((rev5 + str + wstr) / 3, 6) AS ensemble
FROM score_cols WHERE rev5 IS NOT NULL AND str IS NOT NULL AND wstr IS NOT NULL""", "score_cols"))
def a5(t):
    s = t.score_columns().dropna(subset=["rev5", "str", "wstr"]).select("date", "symbol", "rev5", "str", "wstr")
    return (sinks.with_ensemble(s, ("rev5", "str", "wstr"))
            .withColumn("ensemble", F.round("ensemble", 6)))


@query("a6_replace_one_model", sql("""SELECT model, count(*) AS rows, round(sum(CASE WHEN model = 'str' THEN -score ELSE score END), 6)
  AS total FROM scores GROUP BY model""", "scores"))
def a6(t):
    """Write all models, replace one, read the store back."""
    path = sinks.shared_folder(t.spark, "predictions")
    s = t.scores().select("model", "date", "symbol", "score")
    sinks.replace_variants(s, path, "model")
    sinks.replace_variants(s.where("model = 'str'").withColumn("score", -F.col("score")), path, "model")
    return (t.spark.read.parquet(path).groupBy("model")
            .agg(F.count("*").alias("rows"), F.round(F.sum("score"), 6).alias("total")))


@query("a7_vendor_long", sql("""SELECT date, symbol, open, high, low, close, adj_close, volume FROM bars_d
WHERE close IS NOT NULL""", "bars_d"))
def a7(t):
    """A vendor's frames of all symbols (its own column names, nulls where a symbol did not trade) to our long form, in one job."""
    raw = (t.dense("day")
           .select("date", F.col("symbol").alias("Ticker"), F.col("open").alias("Open"), F.col("high").alias("High"), F.col("low").alias("Low"),
                   F.col("close").alias("Close"), F.col("adj_close").alias("Adj Close"), F.col("volume").alias("Volume")))
    return B.vendor_long(raw, F.col("Ticker")).select(*B.BAR_COLUMNS)


@query("a8_densify", sql(f"SELECT t, {COLS} FROM grid_d", "grid_d"))
def a8(t):
    """Every brand on every trading day, NULL where it did not trade."""
    return t.dense("day").select("t", *B.BAR_COLUMNS)


@query("a9_last_bar_wins", sql("""SELECT date, symbol, open / close AS open_r, high / close AS high_r, low / close AS low_r, adj_close, volume
FROM (SELECT CAST(date_trunc('week', date) AS DATE) AS date, symbol, arg_max(open, date) AS open, arg_max(high, date) AS high,
 arg_max(low, date) AS low, arg_max(close, date) AS close, arg_max(adj_close, date) AS adj_close, arg_max(volume, date) AS volume
 FROM bars_d GROUP BY ALL)""", "bars_d"))
def a9(t):
    """Several bars received for one key: the last one wins, then the ratios."""
    d = t.bars("day").withColumn("got", F.unix_date("date")).withColumn("date", F.date_sub("date", F.weekday("date")))
    return B.with_ratios(B.last_ingested(d, "got")).select("date", "symbol", "open_r", "high_r", "low_r", "adj_close",
                                                           "volume")


@query("a10_ohl_ratios", sql("""SELECT date, symbol, open / close AS open_r, high / close AS high_r, low / close AS low_r
FROM bars WHERE (date, symbol) IN (SELECT (date, symbol) FROM bars WHERE volume >= 200)""", "bars"))
def a10(t):
    """Ratios for known keys only."""
    b = t.bars()
    keys = b.where("volume >= 200").select("date", "symbol")
    return (B.with_ratios(b).select("date", "symbol", "open_r", "high_r", "low_r")
            .join(keys, ["date", "symbol"], "left_semi"))


@query("a11_union_bars", sql("""SELECT date, symbol, open, high, low, close, adj_close, volume FROM bars
UNION ALL SELECT date, symbol, NULL, NULL, NULL, NULL, adj_close, volume FROM fund_bars""", "bars", "fund_bars"))
def a11(t):
    return t.bars().unionByName(t.fund_bars(), allowMissingColumns=True)


@query("a12_pivot", sql("SELECT date, " + ", ".join(
    f"max(CASE WHEN symbol = '{b}' THEN adj_close END) AS \"{b}\"" for b in BRANDS) + " FROM bars GROUP BY date", "bars"))
def a12(t):
    return B.to_wide(t.bars(), "adj_close", listed(t))


@query("a12_unpivot", sql("SELECT date, symbol, x AS adj_close FROM grid", "grid"))
def a12u(t):
    names = listed(t)
    return B.to_long(B.to_wide(t.bars(), "adj_close", names), "adj_close", names)


@query("a13_resample_4", sql("""SELECT e.date, g.symbol, g.c AS adj_close, round(g.o / g.c, 6) AS open_r, round(g.h / g.c, 6) AS high_r,
  round(g.l / g.c, 6) AS low_r, g.v AS volume FROM (
 SELECT symbol, block, arg_max(adj_close, t) AS c, arg_min(open / close * adj_close, t) AS o, max(high / close * adj_close) AS h,
  min(low / close * adj_close) AS l, sum(volume) AS v
 FROM (SELECT *, ((SELECT max(t) FROM cal) - t) // 4 AS block FROM panel) GROUP BY symbol, block) g
JOIN (SELECT ((SELECT max(t) FROM cal) - t) // 4 AS block, max(date) AS date, count(*) AS n FROM cal GROUP BY 1) e
 ON e.block = g.block AND e.n = 4""", "panel"))
def a13(t):
    out = B.resample(B.with_ratios(t.panel()), t.calendar(), 4)
    return out.select("date", "symbol", "adj_close", *[F.round(c, 6).alias(c) for c in ("open_r", "high_r", "low_r")],
                      "volume")


@query("a14_bars_weekly", sql(f"SELECT {COLS} FROM bars", "bars"))
def a14(t):
    """Weekly bars from line items: map-side aggregation, one shuffle."""
    return t.bars()


@query("a14_bars_daily", sql(f"SELECT {COLS} FROM bars_d", "bars_d"))
def a14d(t):
    return t.bars("day")


@query("a14_supplier_bars", sql("""SELECT date, symbol, x AS adj_close, volume, CAST(t AS INTEGER) AS t FROM sgrid
WHERE x IS NOT NULL""", "sgrid"))
def a14s(t):
    """Monthly bars of a universe that grows with the data."""
    return t.supplier_panel()


REPAIRS = [("Brand#1", "1996-05-06"), ("Brand#1", "1998-06-01"), ("Brand#2", "1999-09-27")]


@query("a15_splice_repair", sql("""WITH m AS (SELECT *, (adj_close / lag(adj_close) OVER w) / (close / lag(close) OVER w) AS f
 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
hits AS (SELECT symbol, date, f FROM m WHERE (symbol, date) IN (VALUES ('Brand#1', DATE '1996-05-06'),
 ('Brand#1', DATE '1998-06-01'), ('Brand#2', DATE '1999-09-27')) AND abs(f - 1) >= 0.05)
SELECT b.date, b.symbol, b.adj_close * coalesce(product(h.f), 1) AS adj_close
FROM bars b LEFT JOIN hits h ON h.symbol = b.symbol AND b.date < h.date GROUP BY b.date, b.symbol, b.adj_close""", "bars"))
def a15(t):
    repairs = t.spark.createDataFrame(REPAIRS, "symbol string, day string").withColumn("day", F.to_date("day"))
    return (B.splice_repair(t.panel(), repairs)
            .select("date", "symbol", "adj_close"))


@query("a16_liquid_universe", sql("""WITH u AS (SELECT symbol, count(DISTINCT date) AS days, median(close * volume) AS dollar FROM bars
  GROUP BY symbol HAVING count(DISTINCT date) >= 0.99 * (SELECT count(DISTINCT date) FROM bars))
SELECT symbol, days, round(dollar, 4) AS dollar FROM u ORDER BY u.dollar DESC, symbol LIMIT 15""", "bars"))
def a16(t):
    u = Q.liquid_universe(t.bars(), 15)
    return u.select("symbol", "days", F.round("dollar", 4).alias("dollar"))


@query("a16_universe_rows", sql("""WITH u AS (SELECT symbol FROM bars GROUP BY symbol HAVING count(DISTINCT date) >= 0.99 * (SELECT count(DISTINCT date) FROM bars)
 ORDER BY median(close * volume) DESC, symbol LIMIT 15)
SELECT date, symbol, adj_close FROM bars WHERE symbol IN (SELECT symbol FROM u)""", "bars"))
def a16r(t):
    b = t.bars()
    return b.join(Q.liquid_universe(b, 15), "symbol", "left_semi").select("date", "symbol", "adj_close")


FUND_OF = {"ECONOMY": "F0", "SMALL": "F1", "LARGE": "F2", "PROMO": "F3"}


@query("a17_fund_lookup", "SELECT p_partkey, p_type, CASE p_type " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in FUND_OF.items()) + " ELSE '' END AS fund FROM part")
def a17(t):
    """Vendor group name to fund code; unknown names give an empty code."""
    m = F.create_map(*[F.lit(x) for kv in FUND_OF.items() for x in kv])
    return t.table("part").select("p_partkey", "p_type", F.coalesce(F.try_element_at(m, "p_type"), F.lit("")).alias("fund"))


@query("a18_data_checks", sql("""WITH twice AS (SELECT * FROM bars_d UNION ALL SELECT * REPLACE (-low AS low) FROM bars_d WHERE day(date) = 13)
SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, min(date) AS first_date, max(date) AS last_date,
 CAST(count(*) FILTER (WHERE NOT (open > 0 AND high > 0 AND low > 0 AND close > 0 AND adj_close > 0)) AS BIGINT) AS bad_prices,
 (SELECT count(*) FROM (SELECT date, symbol FROM twice GROUP BY ALL HAVING count(*) > 1)) AS duplicate_keys FROM twice""", "bars_d"))
def a18(t):
    """The daily bars with those of every 13th sent again, their lows turned negative: both faults must be counted."""
    bars = t.bars("day")
    again = bars.where(F.dayofmonth("date") == 13).withColumn("low", -F.col("low"))
    return Q.data_checks(bars.unionByName(again))


@query("a19_bar_sanity", sql("""SELECT count(*) AS bars, count(*) FILTER (WHERE high < greatest(open, close)) AS high_below,
 count(*) FILTER (WHERE low > least(open, close)) AS low_above, count(*) FILTER (WHERE high = low AND open = close) AS flat,
 count(*) FILTER (WHERE close IS NOT NULL AND (open IS NULL OR high IS NULL OR low IS NULL)) AS close_only,
 (SELECT symbol FROM bars_d WHERE high = low AND open = close GROUP BY symbol ORDER BY count(*) DESC, symbol DESC LIMIT 1) AS flattest
FROM bars_d""", "bars_d"))
def a19(t):
    return Q.bar_sanity(t.bars("day"))


@query("a20_listed_per_date", sql("SELECT date, count(adj_close) AS listed FROM bars_d GROUP BY date", "bars_d"))
def a20(t):
    return t.bars("day").groupBy("date").agg(F.count("adj_close").alias("listed"))


@query("a21_summary", sql("""WITH twice AS (SELECT * FROM bars_d UNION ALL SELECT * REPLACE (-low AS low) FROM bars_d WHERE day(date) = 13)
SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, min(date) AS first_date, max(date) AS last_date,
 count(DISTINCT date) AS days FROM bars_d""", "bars_d"))
def a21(t):
    return Q.summary(t.bars("day"))


@query("a21_first_date", sql("SELECT symbol, min(date) AS first_date FROM bars_d WHERE adj_close IS NOT NULL GROUP BY symbol", "bars_d"))
def a21f(t):
    return t.bars("day").groupBy("symbol").agg(F.min(F.when(F.col("adj_close").isNotNull(), F.col("date"))).alias("first_date"))


@query("a22_recent_days", sql("SELECT date, symbol, adj_close FROM bars WHERE date IN (SELECT date FROM cal ORDER BY date DESC LIMIT 30)", "cal"))
def a22(t):
    return B.recent_days(t.bars(), t.calendar(), 30).select("date", "symbol", "adj_close")


@query("a23_universe_last_date", sql("SELECT DISTINCT symbol FROM bars WHERE date = (SELECT max(date) FROM bars)", "bars"))
def a23(t):
    last = t.calendar().select(F.max("date")).scalar()
    return t.bars().where(F.col("date") == last).select("symbol").distinct()


@query("a24_last_price", sql("SELECT symbol, arg_max(adj_close, date) AS price, max(date) AS price_date FROM bars_d GROUP BY symbol", "bars_d"))
def a24(t):
    return Q.last_prices(t.bars("day"))


@query("a25_exchange_date", """SELECT CAST(ts - INTERVAL 5 HOUR AS DATE) AS date, event_type, count(*) AS n FROM events GROUP BY ALL""")
def a25(t):
    """UTC vendor timestamps to exchange calendar dates (the oracle's fixed shift holds in January)."""
    local = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")
    return t.events().groupBy(F.to_date(local).alias("date"), "event_type").agg(F.count("*").alias("n"))


@query("a26_ticker_mapping", """SELECT DISTINCT replace(p_brand, '#', '-') AS ours, upper(replace(replace(p_brand, '#', '-'), '-', '.')) AS theirs,
 upper(replace(p_brand, '#', '-')) AS back FROM part""")
def a26(t):
    ours = F.replace("p_brand", F.lit("#"), F.lit("-"))
    theirs = F.upper(F.replace(ours, F.lit("-"), F.lit(".")))
    return t.table("part").select(ours.alias("ours"), theirs.alias("theirs"),
                                  F.upper(F.replace(theirs, F.lit("."), F.lit("-"))).alias("back")).distinct()


@query("a27_completed_days", """WITH d AS (SELECT CAST(ts AS DATE) AS date, event_type AS symbol, count(*) AS n FROM events GROUP BY ALL),
clock AS (SELECT max(ts) AS now, CAST(max(ts) AS DATE) AS today FROM events)
SELECT 'open_now' AS rule, d.* FROM d, clock WHERE date < today
UNION ALL SELECT 'before_close', d.* FROM d, clock WHERE date < CASE WHEN hour(now) < 16 THEN today ELSE today + 1 END
UNION ALL SELECT 'clock_or_today', d.* FROM d, clock WHERE date < today""")
def a27(t):
    """The three rules for the day still forming; the clock is the newest event with the market open."""
    e = t.events()
    d = e.groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"))
    clock = e.agg(F.max("ts").alias("now")).withColumn("is_open", F.lit(1))
    out = None
    for rule in ("open_now", "before_close", "clock_or_today"):
        part = Q.completed_days(d, clock, rule).select(F.lit(rule).alias("rule"), "date", "symbol", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("a28_coverage_gate", sql("""SELECT count(*) AS universe, count(b.symbol) AS covered, count(b.symbol) / count(*) AS share,
 CAST(count(b.symbol) / count(*) >= 0.9 AS INTEGER) AS passes FROM (SELECT DISTINCT p_brand AS symbol FROM part) u
LEFT JOIN (SELECT DISTINCT symbol FROM bars_d WHERE date = (SELECT max(date) FROM bars_d)) b USING (symbol)""", "bars_d"))
def a28(t):
    return Q.coverage_gate(t.bars("day"), t.sectors().select("symbol"))


_SCAN = " UNION ALL ".join(
    "SELECT doc_id, CAST({} AS BIGINT) AS pattern, unnest(regexp_extract_all(text, '{}')) AS m FROM documents".format(
        i + 1, p.replace("'", "''")) for i, p in enumerate(Q.SECRET_PATTERNS))


@query("a29_secret_scan", f"""SELECT doc_id, pattern, left(m, 10) || '...' AS hit, count(*) AS hits FROM ({_SCAN}) GROUP BY ALL""")
def a29(t):
    """Key-shaped strings over whole texts."""
    return Q.scan_secrets(t.table("documents").select("doc_id", "text"))
