"""Forecast models on Spark ML: fits, walk-forward runs, importances, stores.

Fits are Spark jobs over the training rows; several are submitted at once from a few driver threads so that small
periods share the cluster. Nothing is collected but fitted models and one row per period.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from math import gcd

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crosssection import wide_rank
from ..session import cut_lineage
from . import evaluate as E
from .splits import key_hash
from .window_models import date_ranges, linear_score, logit_column, logit_windows

#: Model names and, in `classifier`, the published sizes of both presets.
MODEL_NAMES = ("logit", "forest", "boosting", "mlp")
ENSEMBLE = ("forest", "boosting", "mlp")
UNLIMITED = 30          # Spark ML's deepest tree


def _whole(name: str, v) -> int:
    if isinstance(v, bool) or float(v) != int(float(v)) or int(float(v)) < 1:
        raise ValueError(f"{name} must be a whole number of at least 1, not {v!r}")
    return int(float(v))


def assembler(names: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(names), outputCol=out)


def fit_linear(train: DataFrame, names: Sequence[str], label: str = "target", alpha: float = 1.0) -> PipelineModel:
    """Scaled ridge regression; alpha is the penalty against the SUM of squared errors."""
    n = train.count()
    return Pipeline(stages=[
        assembler(names, "raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        LinearRegression(labelCol=label, regParam=alpha / n, elasticNetParam=0.0, standardization=False)]).fit(train)


def fit_forest(train: DataFrame, names: Sequence[str], label: str = "target", trees: int = 200, depth: int | None = 6,
               seed: int = 0, leaf: int = 50) -> PipelineModel:
    """Averaged shallow trees on bootstrap samples, every feature tried at every split."""
    rf = RandomForestRegressor(labelCol=label, numTrees=_whole("trees", trees), seed=seed, featureSubsetStrategy="all",
                               maxDepth=UNLIMITED if depth is None else _whole("depth", depth),
                               minInstancesPerNode=_whole("leaf", leaf))
    return Pipeline(stages=[assembler(names), rf]).fit(train)


def classifier(name: str, names: Sequence[str], n_rows: int, preset: str = "quick", seed: int = 0, label: str = "y") -> Pipeline:
    """A fresh classifier by name. preset "paper" uses the larger sizes."""
    if preset not in ("quick", "paper"):
        raise ValueError("preset must be 'quick' or 'paper'")
    paper = preset == "paper"
    k = len(names)
    subset = str(min(5, k))
    scaled = [assembler(names, "raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)]
    if name == "logit":
        return Pipeline(stages=scaled + [LogisticRegression(labelCol=label, regParam=1.0 / max(n_rows, 1), maxIter=500, standardization=False)])
    if name == "forest":
        return Pipeline(stages=[assembler(names), RandomForestClassifier(
            labelCol=label, numTrees=1000 if paper else 150, maxDepth=20 if paper else 10, featureSubsetStrategy=subset,
            minInstancesPerNode=1 if paper else 100, subsamplingRate=1.0 if paper else 0.3, seed=seed)])
    if name == "boosting":
        return Pipeline(stages=[assembler(names), GBTClassifier(labelCol=label, maxIter=100, maxDepth=3, stepSize=0.1,
                                                                featureSubsetStrategy="0.5", seed=seed)])
    if name == "mlp":
        return Pipeline(stages=scaled + [MultilayerPerceptronClassifier(labelCol=label, layers=[k, 31, 10, 5, 2], seed=seed,
                                                                        maxIter=400 if paper else 60)])
    raise ValueError(f"unknown model {name!r}; use {', '.join(MODEL_NAMES)}")


def prob_up() -> Column:
    return vector_to_array("probability")[1]


def predict(model: PipelineModel, df: DataFrame, out: str, keep: Sequence[str], regression: bool = False) -> DataFrame:
    return model.transform(df).select(*keep, (F.col("prediction") if regression else prob_up()).alias(out))


def together(jobs: Sequence[Callable], threads: int = 4) -> list:
    """Run a few Spark actions at once; results in order."""
    with ThreadPoolExecutor(max_workers=threads) as pool:
        return list(pool.map(lambda j: j(), jobs))


def walk_forward(panel: DataFrame, periods: DataFrame, names: Sequence[str], models: Sequence[str] = ("logit", "forest", "boosting"),
                 preset: str = "quick", seed: int = 0, threads: int = 4) -> DataFrame:
    """Out-of-sample P(beats the median) for every traded day, one model per period and name; `ensemble` is the mean of
    the three machine-learning models when all ran. The panel is written once and every period reads its own dates."""
    panel = cut_lineage(panel)
    rows = periods.orderBy("period").collect()          # one short row per study period
    d = F.col("date")

    logits = {}
    if "logit" in models:       # all periods at once
        spans = periods.select(F.col("period").alias("key"), F.col("train_start").alias("lo"), F.col("train_end").alias("hi"))
        logits = {f["key"]: f for f in logit_windows(panel, spans, names, "y")}

    def fit(p):
        """The other models of one period on the same training rows."""
        train = panel.where(d.between(F.lit(p["train_start"]), F.lit(p["train_end"])) & F.col("y").isNotNull())
        return {m: classifier(m, names, 0, preset, seed).fit(train) for m in models if m != "logit"}

    def trade(p, fitted):
        """The period's models applied one after another to its trading rows: no joins between their forecasts."""
        out = panel.where(d.between(F.lit(p["trade_start"]), F.lit(p["trade_end"])))
        for name in models:
            out = (out.withColumn(name, logit_column(names, logits[p["period"]])) if name == "logit"
                   else fitted[name].transform(out).select(*[c for c in out.columns], prob_up().alias(name)))
        return out.select("date", "symbol", *models, F.lit(p["period"]).alias("period"))

    fits = together([lambda p=p: fit(p) for p in rows], threads)
    out = reduce(DataFrame.unionByName, [trade(p, f) for p, f in zip(rows, fits)])
    if all(m in models for m in ENSEMBLE):
        out = out.withColumn("ensemble", (F.col("forest") + F.col("boosting") + F.col("mlp")) / 3)
    return out


def train_latest(panel: DataFrame, cal: DataFrame, names: Sequence[str], days: int, model: str = "forest",
                 seed: int = 0) -> PipelineModel:
    """Fit on the most recent `days` labelled dates."""
    labelled = panel.where(F.col("y").isNotNull())
    keep = labelled.select("date").distinct().orderBy(F.desc("date")).limit(days)
    train = cut_lineage(labelled.join(F.broadcast(keep), "date", "left_semi"))
    return classifier(model, names, train.count(), seed=seed).fit(train)


def seed_average(models: Sequence[PipelineModel], df: DataFrame, keep: Sequence[str], out: str = "prob_up") -> DataFrame:
    """Mean probability over models that differ by seed, in one pass over the rows."""
    for i, m in enumerate(models):
        cols = [c for c in df.columns]
        df = m.transform(df).select(*cols, prob_up().alias(f"_p{i}"))
    total = reduce(lambda a, b: a + b, [F.col(f"_p{i}") for i in range(len(models))])
    return df.select(*keep, (total / len(models)).alias(out))


def cv_scores(rows: DataFrame, folds: DataFrame, names: Sequence[str], k: int, model: str = "logit") -> DataFrame:
    """AUC and accuracy of a fresh model per fold; roles come from a (fold, date, role) table."""
    rows = cut_lineage(rows)
    if model == "logit":        # all folds at once
        days = rows.select("date").distinct()
        fits = logit_windows(rows, date_ranges(folds.where("role = 'train'"), "fold", days), names, "y")
        test = rows.join(F.broadcast(folds.where("role = 'test'").select("fold", "date")), "date")
        models = rows.sparkSession.createDataFrame([(f["key"], f["intercept"], f["coef"]) for f in fits], "fold int, intercept double, coef array<double>")
        p = 1 / (1 + F.exp(-linear_score(names, F.col("intercept"), F.col("coef"))))
        return E.auc_accuracy(test.join(F.broadcast(models), "fold").select("fold", "date", "symbol", "y", p.alias("p")), "fold", "p", "y", 0.5)

    def one(f):
        r = rows.join(F.broadcast(folds.where(F.col("fold") == f)), "date")
        train = r.where("role = 'train'")
        m = classifier(model, names, train.count()).fit(train)
        return predict(m, r.where("role = 'test'"), "p", ("fold", "date", "symbol", "y"))

    parts = together([lambda f=f: one(f) for f in range(1, k + 1)])
    return E.auc_accuracy(reduce(DataFrame.unionByName, parts), "fold", "p", "y", 0.5)


def permutation_importance(model: PipelineModel, rows: DataFrame, names: Sequence[str], y: str, repeats: int = 3, regression: bool = True) -> DataFrame:
    """Rise in mean squared error when one feature's values change places between rows.

    Rows get a shuffled place from a distributed rank of a key hash; repeat r reads the value of place a*place + b mod n
    with a coprime to n, which is a permutation. One equi-join per job, no ordering in one task."""
    h = F.conv(F.substring(key_hash("symbol", "date"), 1, 13), 16, 10).cast("double")
    r = wide_rank(rows.withColumn("_h", h), [], "_h", ["symbol", "date"]).withColumn("place", (F.col("place") - 1).cast("bigint"))
    x = F.array(*[F.col(c).cast("double") for c in names])
    base = cut_lineage(r.select("place", "size", "symbol", "date", F.col(y).cast("double").alias("_y"), x.alias("_x")))
    n = base.agg(F.max("size").alias("n")).first()["n"]
    steps = []
    a = int(n * 0.618) or 1
    while len(steps) < repeats:
        if gcd(a, n) == 1:
            steps.append((len(steps), a, (a * 7919) % n))
        a += 1
    moves = F.explode(F.array(*[F.struct(F.lit(i).alias("r"), F.lit(p).cast("bigint").alias("a"), F.lit(q).cast("bigint").alias("b")) for i, p, q in steps]))
    shuffled = base.withColumn("m", moves).withColumn("src", (F.col("place") * F.col("m.a") + F.col("m.b")) % F.col("size"))
    other = base.select(F.col("place").alias("src"), F.col("_x").alias("_o"))
    s = shuffled.join(other, "src").select("_y", "_x", "_o", F.col("m.r").alias("r"), F.explode(F.sequence(F.lit(-1), F.lit(len(names) - 1))).alias("f"))
    s = s.withColumn("_v", F.transform("_x", lambda v, i: F.when(i == F.col("f"), F.col("_o")[i]).otherwise(v)))
    cols = [F.col("_v")[i].alias(c) for i, c in enumerate(names)]
    scored = model.transform(s.select("_y", "r", "f", *cols))
    p = F.col("prediction") if regression else prob_up()
    loss = scored.groupBy("r", "f").agg(F.avg((F.col("_y") - p) * (F.col("_y") - p)).alias("mse"))
    whole = loss.where("f = -1").select("r", F.col("mse").alias("base"))
    name = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("f") + 1)
    return (loss.where("f >= 0").join(F.broadcast(whole), "r").groupBy(name.alias("feature"))
            .agg(F.avg(F.col("mse") - F.col("base")).alias("mse_increase"), F.stddev_pop(F.col("mse") - F.col("base")).alias("mse_increase_std")))


def impurity_importance(spark: SparkSession, model: PipelineModel, names: Sequence[str]) -> DataFrame:
    v = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(c, float(i)) for c, i in zip(names, v)], "feature string, importance double")


def noise_columns(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n standard normal columns fixed by the row's key, so reruns and repartitions agree."""
    def u(i, j):
        h = F.pmod(F.xxhash64("symbol", "date", F.lit(seed * 1000 + i * 2 + j)), F.lit(1 << 52))
        return (h + F.lit(0.5)) / float(1 << 52)
    return df.select("*", *[(F.sqrt(-2 * F.ln(u(i, 0))) * F.cos(u(i, 1) * 6.283185307179586)).alias(f"noise_{i}") for i in range(n)])


def r2_zero(scored: DataFrame, by: Sequence[str], pred: str = "prediction", y: str = "target") -> DataFrame:
    e = F.col(y) - F.col(pred)
    return scored.groupBy(*by).agg((1 - F.avg(e * e) / F.nullif(F.avg(F.col(y) * F.col(y)), F.lit(0.0))).alias("r2"), F.count("*").alias("rows"))


def train_test_r2(fits: dict[str, Callable[[DataFrame], PipelineModel]], split: DataFrame) -> DataFrame:
    """r2 against zero on both sides of a split for several fits, submitted together."""
    split = cut_lineage(split)
    train = split.where("split = 'train'")

    def one(name, fit):
        return fit(train).transform(split).select(F.lit(name).alias("model"), "split", "target", "prediction")

    parts = together([lambda n=n, f=f: one(n, f) for n, f in fits.items()])
    return r2_zero(reduce(DataFrame.unionByName, parts), ["model", "split"])


def tree(names: Sequence[str], depth: int):
    return lambda train: Pipeline(stages=[assembler(names), DecisionTreeRegressor(labelCol="target", maxDepth=depth, minInstancesPerNode=1)]).fit(train)


def save_strategy(spark: SparkSession, model: PipelineModel, path: str, manifest: dict) -> None:
    """The fitted model next to a one-row manifest: features, config, universe, lookback."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_strategy(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> tuple[PipelineModel, dict]:
    """Model and manifest; a feature list that differs from the saved one is an error."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if names is not None and list(names) != list(manifest["features"]):
        raise ValueError(f"the strategy was trained on {manifest['features']}, not on {list(names)}")
    return PipelineModel.load(f"{path}/model"), manifest


def expanding_years(trades: DataFrame, names: Sequence[str], label: str = "win", rounds: int = 100) -> DataFrame:
    """For each year with a trade opened in it: train on trades closed before, score the year's trades. Years before which
    no trade of each outcome was closed cannot be scored and are left out."""
    trades = cut_lineage(trades)
    opened = trades.groupBy(F.year("entry").alias("year")).count()
    closed = trades.groupBy(label).agg(F.min("exit").alias("first"))
    ready = closed.agg(F.max("first").alias("d"), F.count("*").alias("k")).first()
    years = [r["year"] for r in opened.orderBy("year").collect() if ready["k"] == 2 and f"{r['year']}-01-01" > str(ready["d"])]
    if not years:
        raise ValueError("no year follows closed trades of both outcomes")

    def one(year):
        train = trades.where(F.col("exit") < F.lit(f"{year}-01-01").cast("date"))
        test = trades.where(F.year("entry") == year)
        gb = GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=3, stepSize=0.05, seed=0)
        m = Pipeline(stages=[assembler(names), gb]).fit(train)
        return predict(m, test, "p", ("symbol", "entry", "pnl", label)).withColumn("year", F.lit(year))

    return reduce(DataFrame.unionByName, together([lambda y=y: one(y) for y in years]))


def chart_classifier(images: DataFrame, seeds: Sequence[int], max_iter: int = 50) -> list[PipelineModel]:
    """Logistic models on standardised pixels, one per seed, each on its own 70% of the charts (chosen by key hash).
    images: date, symbol, label, features (vector)."""
    images = cut_lineage(images)

    def one(seed):
        u = F.pmod(F.xxhash64("symbol", "date", F.lit(seed)), F.lit(10))
        return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
                                LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=max_iter, regParam=0.01)]).fit(images.where(u < 7))

    return together([lambda s=s: one(s) for s in seeds])
