"""Linear models of many date windows at once, from sums.

Ridge: each date gives one set of sums of products (constant, features, label). Running sums over the dates make every
window's sums the difference of two of them, so walk-forward periods, folds and expanding windows share one pass over
the rows, whatever their number. Logit: a fixed number of reweighted rounds, each one pass in which a row adds to every
window it lies in. The number of Spark jobs does not depend on the number of windows.

`windows` has a column `key` and inclusive date bounds `lo` and `hi`; a key may have several rows that do not overlap
(a fold trains before and after its test block). A label that is null leaves its row out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_SUMS = "at int, pos int, v double"


def _labelled(panel: DataFrame, names: Sequence[str], label: str, date: str) -> DataFrame:
    """(day, constant, features, label) of the rows whose features and label are known."""
    z = panel.select(F.unix_date(date).alias("day"), F.array(F.lit(1.0), *[F.col(c).cast("double") for c in names], F.col(label).cast("double")).alias("z"))
    return z.where(F.forall("z", lambda v: v.isNotNull() & ~F.isnan(v)))


def _rows(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    return b.column(0).to_numpy(zero_copy_only=False), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _emit(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], ["at", "pos", "v"])


def date_moments(panel: DataFrame, names: Sequence[str], label: str, date: str = "date") -> DataFrame:
    """(at, pos, v): for each day number, the upper half of the sums of products of constant, features and label."""
    width = len(names) + 2
    half = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            day, z = _rows(b, width)
            order = np.argsort(day, kind="stable")
            days, start = np.unique(day[order], return_index=True)
            z = z[order]
            yield from _emit({int(d): (z[a:e].T @ z[a:e])[half] for d, a, e in zip(days, start, [*start[1:], len(z)])})

    return _labelled(panel, names, label, date).mapInArrow(run, _SUMS).groupBy("at", "pos").agg(F.sum("v").alias("v"))


def window_moments(moments: DataFrame, windows: DataFrame) -> DataFrame:
    """(key, pos, v): the sums of each window as differences of running sums over the dates."""
    moments = cut_lineage(moments)
    days = moments.where("pos = 0").select("at", F.row_number().over(Window.orderBy("at")).alias("i"))
    run = Window.partitionBy("pos").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    running = moments.join(F.broadcast(days), "at").select("i", "pos", F.sum("v").over(run).alias("v"))
    inside = F.col("at").between(F.unix_date("lo"), F.unix_date("hi"))
    ends = days.join(F.broadcast(windows.select("key", "lo", "hi")), inside).groupBy("key", "lo", "hi").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    legs = ends.select("key", F.explode(F.array(F.struct(F.col("b").alias("i"), F.lit(1.0).alias("sign")), F.struct((F.col("a") - 1).alias("i"), F.lit(-1.0).alias("sign")))).alias("e"))
    legs = legs.select("key", "e.i", "e.sign")
    return legs.join(running, "i").groupBy("key", "pos").agg(F.sum(F.col("sign") * F.col("v")).alias("v"))


def _scales(m: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, means, spreads, centred products) of features and label; a spread of 0 counts as 1."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    c = m[1:, 1:] - n * np.outer(mean, mean)
    var = np.maximum(np.diag(c), 0) / n
    spread = np.where(var > 1e-12 * np.maximum(mean * mean, 1e-300), np.sqrt(var), 0.0)
    return n, mean, np.where(spread > 0, spread, 1.0), c


def _square(v: np.ndarray, width: int) -> np.ndarray:
    m = np.zeros((width, width))
    m[np.triu_indices(width)] = v
    return np.triu(m, 1).T + m


def ridge_windows(panel: DataFrame, windows: DataFrame, names: Sequence[str], label: str, alpha: float = 1.0, date: str = "date") -> DataFrame:
    """(key, n, intercept, coef): ridge regression on each window's standardised features, in the features' own units.

    `alpha` is the penalty against the sum of squared errors; the intercept is free. A feature without spread gets no
    weight; windows without rows are left out. Sums are differences in double precision: features should be of one size
    over the history, as ranks and returns are."""
    k = len(names)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _square(pdf.sort_values("pos")["v"].to_numpy(), k + 2)
        n, mean, spread, c = _scales(m)
        s = spread[:k]
        beta = np.linalg.solve(c[:k, :k] / np.outer(s, s) + alpha * np.eye(k), c[:k, k] / s) / s
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "n": [int(round(n))], "intercept": [mean[k] - beta @ mean[:k]], "coef": [beta.tolist()]})

    sums = window_moments(date_moments(panel, names, label, date), windows)
    kind = windows.schema["key"].dataType.simpleString()
    return sums.groupBy("key").applyInPandas(solve, f"key {kind}, n long, intercept double, coef array<double>")


def logit_windows(panel: DataFrame, windows: DataFrame, names: Sequence[str], label: str, penalty: float = 1.0, rounds: int = 8, date: str = "date") -> list[dict]:
    """One record (key, n, intercept, coef) for each window: logistic regression on standardised features, `penalty` / 2
    times the squared weights against the sum of the losses, by `rounds` Newton steps. Windows without rows are left out.

    Only sums of the features' number squared reach the driver, one set a window and round."""
    k, width = len(names), len(names) + 1
    half = np.triu_indices(width)
    rows = cut_lineage(_labelled(panel, names, label, date))
    spans: dict = {}
    for r in windows.select("key", F.unix_date("lo").alias("lo"), F.unix_date("hi").alias("hi")).collect():
        spans.setdefault(r["key"], []).append((r["lo"], r["hi"]))
    sums: dict = {}
    for r in window_moments(date_moments(panel, names, label, date), windows).collect():
        sums.setdefault(r["key"], {})[r["pos"]] = r["v"]
    fits = {}
    for key, v in sums.items():
        n, mean, spread, _ = _scales(_square(np.array([v[i] for i in range(len(v))]), k + 2))
        if round(n) > 0:
            fits[key] = {"n": int(round(n)), "mean": mean[:k], "spread": spread[:k], "b": np.zeros(width)}
    keys = sorted(fits, key=str)
    send = rows.sparkSession.sparkContext.broadcast
    for _ in range(rounds if keys else 0):
        shared = send([(spans[key], fits[key]["mean"], fits[key]["spread"], fits[key]["b"]) for key in keys])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            out: dict[int, np.ndarray] = {}
            for b in batches:
                day, z = _rows(b, k + 2)
                for i, (bounds, mean, spread, weights) in enumerate(shared.value):
                    own = reduce(np.logical_or, [(day >= lo) & (day <= hi) for lo, hi in bounds])
                    if own.any():
                        x = np.column_stack([np.ones(own.sum()), (z[own, 1:k + 1] - mean) / spread])
                        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                        part = np.append(x.T @ (z[own, k + 1] - p), ((x * (p * (1 - p))[:, None]).T @ x)[half])
                        out[i] = out[i] + part if i in out else part
            yield from _emit(out)

        got: dict[int, dict[int, float]] = {}
        for r in rows.mapInArrow(run, _SUMS).groupBy("at", "pos").agg(F.sum("v").alias("v")).collect():
            got.setdefault(r["at"], {})[r["pos"]] = r["v"]
        shared.unpersist()
        free = np.append(0.0, np.full(k, penalty))
        for i, v in got.items():
            fit, v = fits[keys[i]], np.array([v[j] for j in range(len(v))])
            step = np.linalg.solve(_square(v[width:], width) + np.diag(free + 1e-9), v[:width] - free * fit["b"])
            fit["b"] = fit["b"] + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
    out = []
    for key in keys:
        f = fits[key]
        coef = f["b"][1:] / f["spread"]
        out.append({"key": key, "n": f["n"], "intercept": float(f["b"][0] - coef @ f["mean"]), "coef": coef.tolist()})
    return out


def linear_score(names: Sequence[str], intercept: Column, coef: Column) -> Column:
    return reduce(lambda a, b: a + b, [coef[i] * F.col(c) for i, c in enumerate(names)], intercept)


def logit_column(names: Sequence[str], fit: dict) -> Column:
    """P(1) of one fitted window as an expression."""
    return 1 / (1 + F.exp(-linear_score(names, F.lit(fit["intercept"]), [F.lit(c) for c in fit["coef"]])))


def apply_windows(rows: DataFrame, fits: DataFrame, spans: DataFrame, names: Sequence[str], out: str, keep: Sequence[str], date: str = "date") -> DataFrame:
    """Forecasts of every row with the model of each `spans` window (key, lo, hi) it lies in. `fits` has one short row a
    window; both are bounded by the calendar and broadcast."""
    models = fits.join(spans.select("key", "lo", "hi"), "key")
    j = rows.join(F.broadcast(models), F.col(date).between(F.col("lo"), F.col("hi")))
    return j.select(*keep, "key", linear_score(names, F.col("intercept"), F.col("coef")).alias(out))


def date_ranges(days: DataFrame, key: str, cal: DataFrame) -> DataFrame:
    """(key, lo, hi): stretches of consecutive dates of `cal` in `days` (key, date), both bounded by the calendar."""
    order = cal.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date")))
    d = days.select(F.col(key).alias("key"), "date").distinct().join(F.broadcast(order), "date")
    d = d.withColumn("_g", F.col("_i") - F.row_number().over(Window.partitionBy("key").orderBy("date")))
    return d.groupBy("key", "_g").agg(F.min("date").alias("lo"), F.max("date").alias("hi")).drop("_g")
