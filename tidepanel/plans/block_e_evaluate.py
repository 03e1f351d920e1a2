"""Forecast evaluation on model-free scores (the Spark ML part is in block_ml)."""

from pyspark.sql import functions as F

from ..operators import evaluate as E
from .block_b_features import NAMES
from .block_c_labels import dataset
from .block_d_splits import TRAIN_END
from .registry import query
from .sqltext import cte, sql

rnd = lambda *names: [F.round(n, 6).alias(n) for n in names]
R = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
MODELS = ("rev5", "mom", "str", "wstr")


def avg_rank_sql(x: str, part: str) -> str:
    p = f"PARTITION BY {part}" if part else ""
    q = f"PARTITION BY {part + ', ' if part else ''}{x}"
    return f"(rank() OVER ({p} ORDER BY {x}) + (count(*) OVER ({q}) - 1) / 2.0)"


def qcut_sql(r: str, n: str, k: int) -> str:
    return f"CAST(greatest(1, (({r} - 1) * {k} + {n} - 2) // nullif({n} - 1, 0)) AS BIGINT)"


cte("known", "SELECT * FROM scores WHERE fwd IS NOT NULL", "scores")


def known(t):
    return t.scores().where("fwd IS NOT NULL")


@query("e1_baselines", sql(f"""SELECT date, symbol, target, CAST(0 AS DOUBLE) AS zero, round((SELECT avg(target) FROM dataset WHERE date <= DATE '{TRAIN_END}'), 6) AS train_mean
FROM dataset""", "dataset"))
def e1(t):
    ds = dataset(t)
    return E.baselines(ds, F.col("date") <= F.lit(TRAIN_END).cast("date")).withColumn("train_mean", F.round("train_mean", 6))


@query("e6_auc_accuracy", sql(f"""WITH r AS (SELECT model, score, CAST(fwd > 0 AS INTEGER) AS up, {avg_rank_sql('score', 'model')} AS rk FROM known)
SELECT model, round((sum(rk) FILTER (WHERE up = 1) - count(*) FILTER (WHERE up = 1) * (count(*) FILTER (WHERE up = 1) + 1) / 2.0)
 / (count(*) FILTER (WHERE up = 1) * count(*) FILTER (WHERE up = 0)), 6) AS auc,
 round(avg(CAST(CAST(score > 0 AS INTEGER) = up AS INTEGER)), 6) AS accuracy, count(*) AS rows FROM r GROUP BY model""", "known"))
def e6(t):
    """AUC per model from distributed pooled ranks."""
    s = known(t).withColumn("up", (F.col("fwd") > 0).cast("int"))
    return E.auc_accuracy(s, "model", "score", "up", 0.0).select("model", *rnd("auc", "accuracy"), "rows")


@query("e9_score_table", sql(f"""WITH r AS (SELECT *, {avg_rank_sql('score', 'model')} AS rp, {avg_rank_sql('fwd', 'model')} AS ry FROM known)
SELECT model, round(avg((fwd - score) * (fwd - score)), 6) AS mse, round(1 - avg((fwd - score) * (fwd - score)) / avg(fwd * fwd), 6) AS r2_vs_zero,
 round(corr(rp, ry), 6) AS ic, round(avg(CASE WHEN fwd <> 0 THEN CAST(sign(score) = sign(fwd) AS INTEGER) END), 6) AS hit_rate, count(*) AS rows
FROM r GROUP BY model""", "known"))
def e9(t):
    return E.score_table(known(t), "model", "score", "fwd").select("model", *rnd("mse", "r2_vs_zero", "ic", "hit_rate"), "rows")


DEC = sql(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score, date, symbol) AS r, count(*) OVER (PARTITION BY model) AS n FROM known),
d AS (SELECT model, {qcut_sql('r', 'n', 10)} AS decile, avg(score) AS mean_forecast, avg(fwd) AS mean_target, stddev_samp(fwd) / sqrt(count(*)) AS target_se, count(*) AS rows
 FROM r GROUP BY ALL) """, "known")


@query("e10_decile_table", DEC + f"SELECT model, decile, {R('mean_forecast', 'mean_target', 'target_se')}, rows FROM d")
def e10(t):
    return E.decile_table(known(t), "model", "score", "fwd").select("model", "decile", *rnd("mean_forecast", "mean_target", "target_se"), "rows")


#: From whole sums of doubled ranks, so that no correlation is exactly 0.
_DOT = lambda a, b: f"CAST(sum(CAST(round(2 * {a}) AS HUGEINT) * CAST(round(2 * {b}) AS HUGEINT)) - CAST(count(*) AS HUGEINT) * (count(*) + 1) * (count(*) + 1) AS DOUBLE)"
RANK_CORR = f"{_DOT('rs', 'rf')} / nullif(sqrt({_DOT('rs', 'rs')}) * sqrt({_DOT('rf', 'rf')}), 0)"
IC = f"""ranks AS (SELECT model, date, symbol, score, fwd, {avg_rank_sql('score', 'model, date')} AS rs, {avg_rank_sql('fwd', 'model, date')} AS rf FROM known),
ics AS (SELECT model, date, {RANK_CORR} AS ic, count(*) AS n FROM ranks GROUP BY model, date HAVING count(*) >= 5)"""


@query("e11_ic_by_date", sql(f"WITH {IC} SELECT model, date, round(ic, 6) AS ic, n FROM ics", "known"))
def e11(t):
    return E.ic_by_group(known(t), ["model", "date"], "score", "fwd", 5).select("model", "date", *rnd("ic"), "n")


@query("e11_period_corr", sql("SELECT model, date, round(corr(score, fwd), 6) AS ic, count(*) AS n FROM known GROUP BY model, date HAVING count(*) >= 10", "known"))
def e11p(t):
    """Pearson version with at least ten names."""
    return E.ic_by_group(known(t), ["model", "date"], "score", "fwd", 10, rank=False).select("model", "date", *rnd("ic"), "n")


@query("e11_ic_by_date_wide", sql(f"""SELECT date, round(corr(rs, rf), 6) AS ic, count(*) AS n FROM (SELECT date, {avg_rank_sql('score', 'date')} AS rs,
 {avg_rank_sql('fwd', 'date')} AS rf FROM sscores) GROUP BY date HAVING count(*) >= 5""", "sscores"))
def e11w(t):
    """Rank correlation per month over the growing universe: no month in one task."""
    return E.ic_by_group(t.supplier_scores(), ["date"], "score", "fwd", 5, wide=True).select("date", *rnd("ic"), "n")


@query("e12_ic_summary", sql(f"""WITH {IC} SELECT model, {R('mean_ic', 'std_ic', 't_stat', 'positive')}, days FROM (SELECT model, avg(ic) AS mean_ic,
 stddev_samp(ic) AS std_ic, avg(ic) / stddev_samp(ic) * sqrt(count(ic)) AS t_stat, avg(CAST(ic > 0 AS INTEGER)) AS positive, count(ic) AS days FROM ics GROUP BY model)""", "known"))
def e12(t):
    s = E.ic_summary(E.ic_by_group(known(t), ["model", "date"], "score", "fwd", 5), "model")
    return s.select("model", *rnd("mean_ic", "std_ic", "t_stat", "positive"), "days")


_UNP = " UNION ALL ".join(f"SELECT '{n}' AS feature, date, symbol, {n} AS value, target FROM dataset" for n in NAMES)


@query("e12_feature_ic", sql(f"""WITH u AS ({_UNP}), r AS (SELECT feature, date, {avg_rank_sql('value', 'feature, date')} AS a, {avg_rank_sql('target', 'feature, date')} AS b FROM u),
i AS (SELECT feature, date, corr(a, b) AS ic FROM r GROUP BY ALL HAVING count(*) >= 5)
SELECT feature, round(avg(ic), 6) AS mean_ic, round(avg(ic) / stddev_samp(ic) * sqrt(count(ic)), 6) AS t_stat, count(ic) AS days FROM i GROUP BY feature""", "dataset"))
def e12f(t):
    u = E.unpivot_features(dataset(t), NAMES, ["date", "symbol", "target"])
    s = E.ic_summary(E.ic_by_group(u, ["feature", "date"], "value", "target", 5), "feature")
    return s.select("feature", *rnd("mean_ic", "t_stat"), "days")


@query("e13_decile_returns", sql("""WITH r AS (SELECT *, fwd - avg(fwd) OVER (PARTITION BY model, date) AS rel, row_number() OVER (PARTITION BY model, date ORDER BY score, symbol) AS r,
 count(*) OVER (PARTITION BY model, date) AS n FROM known)
SELECT model, CAST((r * 10 + n - 1) // n AS BIGINT) AS decile, round(avg(rel), 6) AS mean_return, count(*) AS rows FROM r WHERE n >= 10 GROUP BY ALL""", "known"))
def e13(t):
    return (E.decile_returns(known(t), ["model", "date"], "score", "fwd", out=["model"])
            .select("model", "decile", *rnd("mean_return"), "rows"))


@query("e13_decile_returns_wide", sql("""WITH r AS (SELECT *, fwd - avg(fwd) OVER (PARTITION BY date) AS rel, row_number() OVER (PARTITION BY date ORDER BY score, symbol) AS r,
 count(*) OVER (PARTITION BY date) AS n FROM sscores)
SELECT CAST((r * 10 + n - 1) // n AS BIGINT) AS decile, round(avg(rel), 6) AS mean_return, count(*) AS rows FROM r WHERE n >= 10 GROUP BY ALL""", "sscores"))
def e13w(t):
    """Per-month deciles over the growing universe."""
    return E.decile_returns(t.supplier_scores(), ["date"], "score", "fwd", wide=True).select("decile", *rnd("mean_return"), "rows")


@query("e14_decile_spread", DEC + "SELECT model, round(max(mean_target) FILTER (WHERE decile = 10) - max(mean_target) FILTER (WHERE decile = 1), 6) AS spread FROM d GROUP BY model")
def e14(t):
    return E.decile_spread(E.decile_table(known(t), "model", "score", "fwd"), "model").select("model", *rnd("spread"))


@query("e15_accuracy_median", sql("""SELECT model, date, round(avg(CAST((score > m) = (fwd > 0) AS INTEGER)), 6) AS accuracy, count(*) AS n
FROM (SELECT *, median(score) OVER (PARTITION BY model, date) AS m FROM known) GROUP BY model, date""", "known"))
def e15(t):
    return E.period_accuracy(known(t), ["model", "date"], "score", "fwd", None).select("model", "date", *rnd("accuracy"), "n")


@query("e15_accuracy_threshold", sql("SELECT model, date, round(avg(CAST((score > 0.0) = (fwd > 0) AS INTEGER)), 6) AS accuracy, count(*) AS n FROM known GROUP BY model, date", "known"))
def e15t(t):
    return E.period_accuracy(known(t), ["model", "date"], "score", "fwd", 0.0).select("model", "date", *rnd("accuracy"), "n")


_ALL = MODELS
_AGR = ", ".join(f"{avg_rank_sql(m, 'date')} AS {m}" for m in _ALL)
_PAIRS = [(a, b) for i, a in enumerate(_ALL) for b in _ALL[i:]]


@query("e20_agreement", sql(f"WITH r AS (SELECT date, {_AGR} FROM score_cols WHERE " + " AND ".join(f"{m} IS NOT NULL" for m in MODELS) + ")\n"
       + " UNION ALL ".join(f"SELECT '{a}' AS model_a, '{b}' AS model_b, round(avg(c), 6) AS agreement, count(c) AS days FROM (SELECT corr({a}, {b}) AS c FROM r GROUP BY date)" for a, b in _PAIRS), "score_cols"))
def e20(t):
    s = t.score_columns().select("date", "symbol", *_ALL)
    return E.agreement(s, _ALL).select("model_a", "model_b", *rnd("agreement"), "days")


@query("e20_spread", sql("SELECT model, round(avg(sd), 6) AS spread FROM (SELECT model, date, stddev_samp(score) AS sd FROM known GROUP BY ALL) GROUP BY model", "known"))
def e20s(t):
    return (known(t).groupBy("model", "date").agg(F.stddev_samp("score").alias("sd"))
            .groupBy("model").agg(F.round(F.avg("sd"), 6).alias("spread")))


@query("e21_compare_runs", sql(f"""WITH j AS (SELECT a.v AS va, b.v AS vb FROM (SELECT date, symbol, score AS v FROM scores WHERE model = 'str') a
 FULL OUTER JOIN (SELECT date, symbol, score AS v FROM scores WHERE model = 'rev5') b ON a.date = b.date AND a.symbol = b.symbol),
k AS (SELECT {avg_rank_sql('va', '')} AS ra, {avg_rank_sql('vb', '')} AS rb FROM j WHERE va IS NOT NULL AND vb IS NOT NULL)
SELECT round(max(abs(va - vb)), 6) AS max_gap, count(*) FILTER (WHERE va IS NULL OR vb IS NULL) AS unmatched,
 (SELECT round(corr(ra, rb), 6) FROM k) AS rank_corr, (SELECT count(*) FROM k) AS matched FROM j""", "scores"))
def e21(t):
    """Two versions of a score series: gap, unmatched rows, pooled rank correlation."""
    a, b = t.scores(("str",)), t.scores(("rev5",))
    return E.compare_runs(a, b, ["date", "symbol"], "score").select(*rnd("max_gap"), "unmatched", *rnd("rank_corr"), "matched")


_SIG = ("mom", "str", "wstr")


@query("e22_signal_correlation", sql(" UNION ALL ".join(f"""SELECT '{s}' AS signal, round(avg(c), 6) AS mean_corr, count(c) AS dates FROM (SELECT corr(a, b) AS c FROM (SELECT date,
 {avg_rank_sql('rev5', 'date')} AS a, {avg_rank_sql(s, 'date')} AS b FROM score_cols WHERE rev5 IS NOT NULL AND {s} IS NOT NULL) GROUP BY date HAVING count(*) >= 10)""" for s in _SIG), "score_cols"))
def e22(t):
    """Average rank correlation of a score with each known signal."""
    s = t.score_columns().select("date", "symbol", "rev5", *_SIG)
    u = s.unpivot(["date", "symbol", "rev5"], list(_SIG), "signal", "value")
    i = E.ic_by_group(u, ["signal", "date"], "rev5", "value", 10)
    return i.groupBy("signal").agg(F.round(F.avg("ic"), 6).alias("mean_corr"), F.count("ic").alias("dates"))
