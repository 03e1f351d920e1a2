"""Eigenportfolios, multi-factor residual fits and the factor hedge, for any number of stocks.

With W days per window, the stock-by-stock correlation matrix has at most W non-zero eigenvalues, and they are those of
the W x W matrix of day-by-day products. So stocks are summed into W x W blocks (in parts, then combined), one
small decomposition per as-of day follows, and every stock's loadings and fit come from its own W returns. No pair of
stocks is ever formed and no task sees a whole universe.

Windows are not written out. A stock's returns are kept in blocks of W days, each with the block before it, so a return is
stored twice whatever W; the kernels slide over the days of a block and send out one day at a time.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .factors import FactorConfig

EIGEN_SCHEMA = ("t int, n_stocks long, n_factors int, eigenvalues array<double>, mix array<double>, design array<double>, "
                "solver array<double>")
FIT_SCHEMA = ("symbol string, t int, n_factors int, alpha double, r2 double, kappa double, m double, sigma_eq double, "
              "x_last double, b double, beta array<double>, q array<double>, sigma double")


def day_blocks(returns: DataFrame, cfg: FactorConfig) -> DataFrame:
    """(symbol, block, days, r): the known returns of each block of corr_window days and of the block before it."""
    W = cfg.corr_window
    own = F.floor(F.col("t") / F.lit(W)).cast("int")
    twice = returns.where("ret IS NOT NULL").select("symbol", "t", "ret", F.explode(F.array(own, own + 1)).alias("block"))
    g = twice.groupBy("symbol", "block").agg(F.collect_list(F.struct("t", "ret")).alias("_v"), F.max("t").alias("_last"))
    return g.where(F.col("_last") >= F.col("block") * W).select("symbol", "block", F.col("_v.t").alias("days"), F.col("_v.ret").alias("r"))


def _standardise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sd = r.std(axis=1, ddof=1, keepdims=True)
    return (r - r.mean(axis=1, keepdims=True)) / sd, sd


class _Days:
    """The stocks of one part of a block as a matrix of two blocks of days, NaN where a return is unknown."""

    def __init__(self, stocks: pd.DataFrame, W: int):
        self.W, self.symbols, self.first = W, stocks["symbol"].to_numpy(), (int(stocks["block"].iloc[0]) - 1) * W
        rows = np.repeat(np.arange(len(stocks)), [len(d) for d in stocks["days"]])
        self.r = np.full((len(stocks), 2 * W), np.nan)
        self.r[rows, np.concatenate(stocks["days"].to_numpy()) - self.first] = np.concatenate(stocks["r"].to_numpy())
        self.gaps = np.pad(np.isnan(self.r).cumsum(axis=1), ((0, 0), (1, 0)))

    def window(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the stocks that have a whole, moving window ending on day t, and those windows."""
        end = t - self.first + 1
        at = np.flatnonzero(self.gaps[:, end] == self.gaps[:, end - self.W])
        r = self.r[at, end - self.W:end]
        moves = np.ptp(r, axis=1) > 0 if len(r) else np.zeros(0, bool)
        return at[moves], r[moves]


def _blocks(cfg: FactorConfig, stride: int, offset: int):
    w, W = cfg.window, cfg.corr_window

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        days = _Days(pd.concat(batches, ignore_index=True), W)
        for t in range(days.first + W, days.first + 2 * W):
            at, r = days.window(t)
            if (t - offset) % stride or not len(at):
                continue
            z, sd = _standardise(r)
            gram, cross = z.T @ z, (r[:, -w:] / sd).T @ z
            yield pd.DataFrame({"t": [t], "n": [len(r)], "total": [z.sum(axis=0).tolist()], "gram": [gram.ravel().tolist()],
                                "cross": [cross.ravel().tolist()]})
    return part


def _decompose(cfg: FactorConfig):
    W, w = cfg.corr_window, cfg.window

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        if n < cfg.min_names:
            return pd.DataFrame(columns=["t", "n_stocks", "n_factors", "eigenvalues", "mix", "design", "solver"])
        add = lambda c: np.vstack(pdf[c].to_numpy()).sum(axis=0)
        gram, cross, total = add("gram").reshape(W, W), add("cross").reshape(w, W), add("total")
        lam, axes = np.linalg.eigh(gram / (W - 1))
        by_size = np.argsort(-lam, kind="stable")
        lam, axes = lam[by_size], axes[:, by_size]
        # as many factors as asked for, or until their share of the trace (one per stock) reaches the wanted one
        m = int(cfg.n_factors) if cfg.n_factors is not None else 1 + int((lam.cumsum() < cfg.var_explained * n).sum())
        mix = axes[:, :m] / np.sqrt((W - 1) * lam[:m])
        mix[:, total @ mix < 0] *= -1.0                     # the loadings of a factor add up to no less than zero
        design = np.column_stack([np.ones(w), cross @ mix])
        keep = min(n, W)
        return pd.DataFrame({"t": [pdf["t"].iloc[0]], "n_stocks": [n], "n_factors": [m],
                             "eigenvalues": [np.maximum(lam[:keep], 0.0).tolist()], "mix": [mix.ravel().tolist()],
                             "design": [design.ravel().tolist()], "solver": [np.linalg.pinv(design).ravel().tolist()]})
    return combine


def _salted(blocks: DataFrame, rows: int) -> DataFrame:
    """Blocks with a part number, so many parts a block that none holds much more than `rows` stocks."""
    most = blocks.groupBy("block").count().agg(F.max("count")).first()[0] or 1
    return blocks.withColumn("_salt", F.pmod(F.xxhash64("symbol"), F.lit(-(-most // rows))))


def eigen_days(blocks: DataFrame, cfg: FactorConfig, stride: int = 1, offset: int = 0, rows: int = 2000) -> DataFrame:
    """One row per as-of day t = offset (mod stride): eigenvalues (largest first, zero ones left out), the mixing of days
    into factors, the factor returns of the regression window as a design matrix, and its pseudo-inverse. `blocks`
    (`day_blocks`) is read twice, so it should be a written table."""
    parts = _salted(blocks, rows).groupBy("block", "_salt").applyInPandas(
        _blocks(cfg, stride, offset), "t int, n long, total array<double>, gram array<double>, cross array<double>")
    return parts.groupBy("t").applyInPandas(_decompose(cfg), EIGEN_SCHEMA)


def _ar1(path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope, intercept and error variance of each row's regression on its own last value, from five sums."""
    x, y = path[:, :-1], path[:, 1:]
    n, sx, sy = x.shape[1], x.sum(axis=1), y.sum(axis=1)
    dot = lambda u, v: np.einsum("ij,ij->i", u, v)
    cxx, cxy, cyy = dot(x, x) - sx * sx / n, dot(x, y) - sx * sy / n, dot(y, y) - sy * sy / n
    slope = cxy / cxx
    return slope, (sy - slope * sx) / n, (cyy - slope * cxy) / (n - 1)


def _fit_part(cfg: FactorConfig):
    W, w, year = cfg.corr_window, cfg.window, cfg.per_year

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches, ignore_index=True)
        stocks, asof = rows[rows["symbol"].notna()], rows[rows["symbol"].isna()]
        if stocks.empty or asof.empty:
            return
        days = _Days(stocks, W)
        for d in asof.itertuples():
            at, r = days.window(int(d.t))
            if not len(at):
                continue
            k = int(d.n_factors)
            design, solver = np.asarray(d.design).reshape(w, k + 1), np.asarray(d.solver).reshape(k + 1, w)
            z, sd = _standardise(r)
            last = r[:, -w:]
            coef = last @ solver.T
            errors = last - coef @ design.T
            path = errors.cumsum(axis=1)
            with np.errstate(all="ignore"):
                slope, level, noise = _ar1(path)
                out = pd.DataFrame({
                    "symbol": days.symbols[at], "t": np.int32(d.t), "n_factors": np.int32(k), "alpha": coef[:, 0],
                    "r2": 1 - (errors ** 2).sum(axis=1) / last.var(axis=1) / w, "kappa": -np.log(slope) * year, "m": level / (1 - slope),
                    "sigma_eq": np.sqrt(noise / (1 - slope ** 2)), "x_last": path[:, -1], "b": slope, "beta": list(coef[:, 1:]),
                    "q": list((z @ np.asarray(d.mix).reshape(W, k)) / sd), "sigma": sd[:, 0]})
            reverts = (slope > 0) & (slope < 1) & (noise > 0)
            for c in ("kappa", "m", "sigma_eq"):
                out[c] = pd.array(out[c].where(reverts), dtype="Float64")
            yield out
    return fit


def eigen_fit(blocks: DataFrame, days: DataFrame, cfg: FactorConfig, rows: int = 2000) -> DataFrame:
    """Every stock's loadings, factor regression and AR(1) fit on the as-of days in `days`, each from its own window. A
    block's day matrices travel once to each part of its stocks, as rows without a symbol; results leave day by day."""
    stocks = _salted(blocks, rows)
    day = days.select(F.floor(F.col("t") / F.lit(cfg.corr_window)).cast("int").alias("block"), "t", "n_factors", "mix", "design", "solver")
    asof = stocks.select("block", "_salt").distinct().join(day, "block")
    both = stocks.unionByName(asof, allowMissingColumns=True)
    return both.groupBy("block", "_salt").applyInPandas(_fit_part(cfg), FIT_SCHEMA)


def eigenportfolios(fit: DataFrame, days: DataFrame) -> DataFrame:
    """Long form: (t, factor, symbol, q, eigenvalue); factors count from 1."""
    q = fit.select("t", "symbol", F.posexplode("q").alias("_f", "q"))
    lam = days.select("t", F.posexplode("eigenvalues").alias("_f", "eigenvalue"))
    return q.join(lam, ["t", "_f"]).select("t", (F.col("_f") + 1).alias("factor"), "symbol", "q", "eigenvalue")


def factor_book(states: DataFrame, fit: DataFrame, cfg: FactorConfig) -> DataFrame:
    """(t, symbol, weight): positions minus their factor exposure, w = pos - Q (beta' pos), by two sums over rows."""
    pos = states.where(F.col("state") != 0).select("symbol", "t", (F.col("state") * F.lit(cfg.position)).alias("pos"))
    load = (pos.join(fit.select("symbol", "t", "beta"), ["symbol", "t"])
            .select("t", "pos", F.posexplode("beta").alias("_f", "b"))
            .groupBy("t", "_f").agg(F.sum(F.col("pos") * F.col("b")).alias("g")))
    hedge = (fit.select("symbol", "t", F.posexplode("q").alias("_f", "q")).join(load, ["t", "_f"])
             .groupBy("t", "symbol").agg((-F.sum(F.col("q") * F.col("g"))).alias("w")))
    both = hedge.unionByName(pos.select("t", "symbol", F.col("pos").alias("w")))
    return both.groupBy("t", "symbol").agg(F.sum("w").alias("weight"))


def factor_hedged_returns(fit: DataFrame, returns: DataFrame) -> DataFrame:
    """(symbol, t, hedged): next day's return minus beta times the factors' next-day returns."""
    nxt = returns.select("symbol", (F.col("t") - 1).alias("t"), F.col("ret").alias("rs"))
    j = fit.select("symbol", "t", "beta", "q").join(nxt, ["symbol", "t"], "left").withColumn("rs", F.coalesce("rs", F.lit(0.0)))
    f = (j.select("t", "rs", F.posexplode("q").alias("_f", "qv")).groupBy("t", "_f").agg(F.sum(F.col("rs") * F.col("qv")).alias("fr")))
    per = (j.select("symbol", "t", F.posexplode("beta").alias("_f", "bv")).join(f, ["t", "_f"])
           .groupBy("symbol", "t").agg(F.sum(F.col("bv") * F.col("fr")).alias("h")))
    return j.select("symbol", "t", "rs").join(per, ["symbol", "t"]).select("symbol", "t", (F.col("rs") - F.col("h")).alias("hedged"))


def noise_edge(n_stocks: Column, n_days: int) -> Column:
    """Largest eigenvalue pure noise would show: (1 + sqrt(N / T))^2."""
    return F.pow(1 + F.sqrt(n_stocks / F.lit(float(n_days))), 2)
