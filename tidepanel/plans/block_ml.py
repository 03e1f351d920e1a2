"""Spark ML queries at the operators' own model sizes (preset "quick", as the parameter tables of `operators/ml.py` say)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.crosssection import place, qcut_group, size
from ..operators import backtest as G
from ..operators import charts as C
from ..operators import evaluate as E
from ..operators import labels as L
from ..operators import ml as M
from ..operators import splits as S
from ..operators import window_models as W
from ..session import cut_lineage
from ..sources import bars as B
from ..sources.sinks import shared_folder
from .block_b_features import NAMES, WLAGS
from .block_c_labels import dataset
from .block_d_splits import PERIODS, TEST_START, TRAIN_END
from .block_e_evaluate import avg_rank_sql, rnd
from .block_h_factors import meta_rows, trades_of
from .block_i_charts import D, market
from .registry import ORACLES, query
from .sqltext import sql

RN = [f"R{m}" for m in WLAGS]
PANEL_TRAIN_END, PANEL_TEST_START = "2000-10-02", "2000-11-06"        # the panel starts when its longest lag is known


def split(t):
    return S.time_split(dataset(t), t.calendar(), TRAIN_END, TEST_START, 4)


def fitted_scores(t, fits):
    """Forecasts of several regressions on the test side, long by model."""
    s = cut_lineage(split(t.keep_panel()))
    train, test = s.where("split = 'train'"), s.where("split = 'test'")
    out = None
    for name, fit in fits.items():
        p = M.predict(fit(train), test, "p", ("date", "symbol", "target"), regression=True).withColumn("model", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out


def ridge_sql(rows: str, names, label: str, alpha: float = 1.0) -> str:
    """CTEs: ridge fits by the normal equations of `rows` (key, names, label), solved by elimination: `coefs` (key, c, b0)."""
    k = len(names)
    sums = ", ".join(f"avg({c})" for c in (*names, label))
    return f"""mean AS (SELECT key, count(*) AS n, [{sums}] AS mu FROM {rows} GROUP BY key),
dev AS (SELECT r.key, [{", ".join(f"{c} - mu[{i}]" for i, c in enumerate((*names, label), 1))}] AS d FROM {rows} r JOIN mean USING (key)),
prod AS (SELECT key, i, j, sum(d[i] * d[j]) AS v FROM dev, (SELECT unnest(range(1, {k + 2})) AS i), (SELECT unnest(range(1, {k + 2})) AS j) GROUP BY ALL),
sd AS (SELECT key, list(sqrt(v / n) ORDER BY i) AS s FROM prod JOIN mean USING (key) WHERE i = j GROUP BY key),
line AS (SELECT key, i, list(CASE WHEN j > {k} THEN v / s[i] ELSE v / (s[i] * s[j]) + CASE WHEN i = j THEN {alpha}::DOUBLE ELSE 0 END END ORDER BY j) AS a
 FROM prod JOIN sd USING (key) WHERE i <= {k} GROUP BY key, i),
gauss AS (SELECT key, 0 AS p, list(a ORDER BY i) AS m FROM line GROUP BY key UNION ALL
 SELECT key, p + 1, [[CASE WHEN i = p + 1 THEN m[p + 1][j] / m[p + 1][p + 1] ELSE m[i][j] - m[i][p + 1] * m[p + 1][j] / m[p + 1][p + 1] END
  for j in range(1, {k + 2})] for i in range(1, {k + 1})] FROM gauss WHERE p < {k}),
coefs AS (SELECT key, [m[i][{k + 1}] / s[i] for i in range(1, {k + 1})] AS c, mu[{k + 1}] - list_sum([m[i][{k + 1}] / s[i] * mu[i] for i in range(1, {k + 1})]) AS b0
 FROM gauss JOIN sd USING (key) JOIN mean USING (key) WHERE p = {k})"""


def fit_sql(names) -> str:
    return "b0 + " + " + ".join(f"c[{i}] * {n}" for i, n in enumerate(names, 1))


def recursive(query_: str) -> str:
    return "WITH RECURSIVE " + query_.lstrip().removeprefix("WITH ")


@query("e2_linear_scores", recursive(sql(f"""WITH tr AS (SELECT 1 AS key, * FROM dataset WHERE date <= DATE '{TRAIN_END}'),
{ridge_sql('tr', NAMES, 'target')},
sc AS (SELECT date, symbol, target AS y, {fit_sql(NAMES)} AS p FROM dataset, coefs WHERE date >= DATE '{TEST_START}'),
rk AS (SELECT *, {avg_rank_sql('p', '')} AS rp, {avg_rank_sql('y', '')} AS ry FROM sc)
SELECT 'linear' AS model, round(avg((y - p) * (y - p)), 6) AS mse, round(1 - avg((y - p) * (y - p)) / avg(y * y), 6) AS r2_vs_zero, round(corr(rp, ry), 6) AS ic,
 round(avg(CASE WHEN y <> 0 THEN CAST(sign(p) = sign(y) AS INTEGER) END), 6) AS hit_rate, count(*) AS rows FROM rk""", "dataset")))
def e2(t):
    """Ridge regression on the training side, from sums by date, scored on the test side."""
    s = cut_lineage(split(t.keep_panel()))
    sides = s.groupBy("split").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).withColumn("key", F.lit(1))
    fits = W.ridge_windows(s, sides.where("split = 'train'"), NAMES, "target")
    p = W.apply_windows(s.where("split = 'test'"), fits, sides.where("split = 'test'"), NAMES, "p", ("date", "symbol", "target"))
    p = cut_lineage(p.withColumn("model", F.lit("linear")))
    return E.score_table(p, "model", "p", "target").select("model", *rnd("mse", "r2_vs_zero", "ic", "hit_rate"), "rows")


@query("e5_ridge_walk_forward", recursive(sql(f"""WITH {PERIODS},
tr AS (SELECT period AS key, dataset.* FROM dataset JOIN periods ON date BETWEEN train_start AND train_end),
{ridge_sql('tr', NAMES, 'target')}
SELECT period, date, symbol, round({fit_sql(NAMES)}, 6) AS forecast FROM dataset JOIN periods ON date BETWEEN trade_start AND trade_end JOIN coefs ON key = period""", "dataset")))
def e5_ridge(t):
    """Ridge forecasts of every study period, all periods fitted from one pass of sums by date."""
    ds = cut_lineage(dataset(t.keep_panel()))
    p = cut_lineage(S.study_periods(ds, 150, 50).withColumnRenamed("period", "key"))
    fits = W.ridge_windows(ds, p.select("key", F.col("train_start").alias("lo"), F.col("train_end").alias("hi")), NAMES, "target")
    out = W.apply_windows(ds, fits, p.select("key", F.col("trade_start").alias("lo"), F.col("trade_end").alias("hi")), NAMES, "forecast", ("date", "symbol"))
    return out.select(F.col("key").alias("period"), "date", "symbol", *rnd("forecast"))


@query("e3_forest_scores")
def e3(t):
    p = fitted_scores(t, {"forest": lambda d: M.fit_forest(d, NAMES, trees=200, depth=6, leaf=50)})
    return E.score_table(p, "model", "p", "target").select("model", *rnd("mse", "r2_vs_zero", "ic", "hit_rate"), "rows")


@query("e4_classifiers")
def e4(t):
    """The four classifiers on one split: AUC and accuracy on the test weeks."""
    panel = cut_lineage(L.make_panel(t.keep_panel().panel(), WLAGS))
    d = F.col("date")
    train = panel.where((d <= F.lit(PANEL_TRAIN_END).cast("date")) & F.col("y").isNotNull())
    test = panel.where((d >= F.lit(PANEL_TEST_START).cast("date")) & F.col("y").isNotNull())
    n = train.count()
    fits = M.together([lambda m=m: M.classifier(m, RN, n).fit(train) for m in M.MODEL_NAMES])
    out = None
    for name, m in zip(M.MODEL_NAMES, fits):
        p = M.predict(m, test, "p", ("date", "symbol", "y")).withColumn("model", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return E.auc_accuracy(out, "model", "p", "y", 0.5).select("model", *rnd("auc", "accuracy"), "rows")


def predictions(t):
    """Walk-forward predictions of the weekly panel, whose first 240 weeks go to the longest lag: 60 weeks of training, 20 of
    trading."""
    panel = L.make_panel(t.keep_panel().panel(), WLAGS)
    return M.walk_forward(panel, S.study_periods(panel, 60, 20), RN, M.MODEL_NAMES)


@query("e5_walk_forward")
def e5(t):
    return predictions(t).select("date", "symbol", "period", *M.MODEL_NAMES, "ensemble")


@query("e7_latest_scores")
def e7(t):
    """Model of the last 150 labelled weeks, scoring the newest week."""
    panel = cut_lineage(L.make_panel(t.keep_panel().panel(), WLAGS))
    m = M.train_latest(panel, t.calendar(), RN, 150, "forest")
    last = panel.select(F.max("date")).scalar()
    return M.predict(m, panel.where(F.col("date") == last), "score", ("date", "symbol"))


@query("e8_saved_strategy", f"SELECT 0.0::DOUBLE AS max_gap, count(*) AS rows, {len(RN)} AS features FROM ({ORACLES['c6_make_panel']})")
def e8(t):
    """Save a strategy, load it back, score with both: the largest gap is zero."""
    panel = cut_lineage(L.make_panel(t.keep_panel().panel(), WLAGS))
    m = M.train_latest(panel, t.calendar(), RN, 100, "logit")
    path = shared_folder(t.spark, "strategy")
    M.save_strategy(t.spark, m, path, {"features": RN, "lookback": max(WLAGS) + 1, "model": "logit", "universe": sorted(r[0] for r in t.sectors().select("symbol").collect())})
    again, manifest = M.load_strategy(t.spark, path, RN)
    a = M.predict(m, panel, "a", ("date", "symbol"))
    b = M.predict(again, panel, "b", ("date", "symbol"))
    return a.join(b, ["date", "symbol"]).agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("max_gap"), F.count("*").alias("rows")).withColumn(
        "features", F.lit(len(manifest["features"])))


@query("e16_permutation_importance")
def e16(t):
    s = cut_lineage(split(t.keep_panel()))
    m = M.fit_forest(s.where("split = 'train'"), NAMES, trees=200)
    return M.permutation_importance(m, s.where("split = 'test'"), NAMES, "target", 3)


@query("e17_impurity_importance")
def e17(t):
    """Impurity importance next to permutation importance."""
    s = cut_lineage(split(t.keep_panel()))
    m = M.fit_forest(s.where("split = 'train'"), NAMES, trees=200)
    p = M.permutation_importance(m, s.where("split = 'test'"), NAMES, "target", 2)
    return M.impurity_importance(t.spark, m, NAMES).join(p, "feature")


@query("e18_noise_experiment")
def e18(t):
    """Real features against real plus thirty noise columns."""
    s = M.noise_columns(split(t.keep_panel()), 30)
    noisy = NAMES + [f"noise_{i}" for i in range(30)]
    return M.train_test_r2({"real": lambda d: M.fit_forest(d, NAMES, trees=200), "real+noise": lambda d: M.fit_forest(d, noisy, trees=200)}, s)


@query("e19_depth_sweep")
def e19(t):
    """One tree per depth: the training fit keeps rising, the test fit does not."""
    return M.train_test_r2({f"depth_{k:02d}": M.tree(NAMES, k) for k in range(1, 21)}, split(t.keep_panel()))


@query("e23_seed_average")
def e23(t):
    """Mean of three forests that differ by seed."""
    panel = cut_lineage(L.make_panel(t.keep_panel().panel(), WLAGS))
    train = panel.where((F.col("date") <= F.lit(PANEL_TRAIN_END).cast("date")) & F.col("y").isNotNull())
    n = train.count()
    ms = M.together([lambda s=s: M.classifier("forest", RN, n, seed=s).fit(train) for s in (0, 1, 2)])
    return M.seed_average(ms, panel.where(F.col("date") >= F.lit(PANEL_TEST_START).cast("date")), ("date", "symbol"))


@query("d10_cv_scores")
def d10(t):
    """Purged folds: AUC per fold."""
    panel = L.make_panel(t.keep_panel().panel(), WLAGS).where("y IS NOT NULL")
    folds = S.purged_folds(panel.select("date").distinct(), 4, 1, 2)
    return M.cv_scores(panel, cut_lineage(folds), RN, 4, "logit")


META = ["abs_s", "tau", "sigma_eq", "r2", "alpha", "side", "market_vol"]


def meta_scored(t):
    tr, _ = trades_of(t)
    return M.expanding_years(meta_rows(t, tr).dropna(subset=META), META)


@query("d11_expanding_years")
def d11(t):
    """A meta-model of trade outcomes retrained before every year."""
    return meta_scored(t).select("year", "symbol", "entry", "p", "win")


@query("j15_kept_half")
def j15(t):
    """Trades the meta-model keeps against those it drops, and its AUC, per year."""
    m = cut_lineage(meta_scored(t)).withColumn("cut", F.median("p").over(Window.partitionBy("year")))
    keep = F.col("p") >= F.col("cut")
    halves = m.groupBy("year").agg(F.avg(F.when(keep, F.col("pnl"))).alias("kept"), F.avg(F.when(~keep, F.col("pnl"))).alias("dropped"))
    auc = E.auc_accuracy(m.withColumnRenamed("entry", "date"), "year", "p", "win", 0.5)
    return halves.join(auc.select("year", "auc", "rows"), "year")


def chart_models(t, seeds=(0, 1, 2, 3, 4)):
    train = market(t, t.panel().where(F.col("date") <= F.lit(TRAIN_END).cast("date")))
    im = C.image_vectors(C.make_images(train, D, 5), D)
    return M.chart_classifier(im.select("date", "symbol", F.col("label").cast("double").alias("label"), "features"), seeds)


@query("i6_chart_classifier")
def i6(t):
    """Chart models trained on the early years, seeds averaged, scored on later charts."""
    t.keep_panel()
    ms = chart_models(t)
    im = C.make_images(market(t), D, 5, every=5).where(F.col("date") > F.lit(TRAIN_END).cast("date"))
    v = C.image_vectors(im, D).select("date", "symbol", "label", "features")
    p = M.seed_average(ms, v, ("date", "symbol", "label")).withColumn("model", F.lit("charts"))
    return E.auc_accuracy(p, "model", "prob_up", "label", 0.5)


@query("i8_latest_chart_ranking")
def i8(t):
    """P(up) and decile of every chart of the newest week, highest first."""
    t.keep_panel()
    ms = chart_models(t)
    last = t.calendar().agg(F.max("t").alias("t")).first()["t"]
    im = C.make_images(market(t), D, 5, start_t=last, need_label=False)
    p = M.seed_average(ms, C.image_vectors(im, D).select("date", "symbol", "features"), ("date", "symbol"))
    by = ["date"]
    return p.select("date", "symbol", "prob_up", qcut_group(place([F.col("prob_up"), F.col("symbol")], by), size("*", by), 10).alias("decile")).orderBy(F.desc("prob_up"), "symbol")


@query("i9_time_scale_transfer")
def i9(t):
    """Models of weekly charts scoring charts of four-week bars, then the decile book on those bars."""
    t.keep_panel()
    ms = chart_models(t)
    coarse = cut_lineage(B.resample(market(t), t.calendar(), 4))
    cal = B.calendar(coarse)
    p = B.number_days(coarse, cal)
    im = C.image_vectors(C.make_images(p, D, 1, need_label=False), D).select("t", "symbol", "features")
    s = cut_lineage(M.seed_average(ms, im, ("t", "symbol"), "score").withColumn("variant", F.lit("transfer")))
    return G.decile_backtest(s, p, cal, 1, 9, 5)["periods"].select("date", *rnd("long", "short", "spread", "turnover", "net"), "n")
