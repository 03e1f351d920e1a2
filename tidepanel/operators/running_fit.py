"""The one-factor regression and the mean-reversion fit of every window, from running sums.

A residual path is linear in alpha and beta, so its sums and squares follow from sums over the cumulated returns of the
stock and the factor; no window is gathered. Days are cut into blocks as long as a window. A window is then the end of one
block and the beginning of the next (or one whole block): sums that run forward from the cut and sums that run back from it
are added. Each row thus costs the same whatever the window, and only the window's own rows enter its sums: a jump
before the window leaves no rounding error behind, as differences of sums over the whole history would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import ratio, shift

#: products summed along a window: a, b are the cumulated stock and factor returns measured from the cut, j the day's place.
_PATH = {"a": ("a",), "b": ("b",), "aa": ("a", "a"), "bb": ("b", "b"), "ab": ("a", "b"), "ja": ("j", "a"), "jb": ("j", "b")}
_PLAIN = {"y": ("y",), "x": ("x",), "yy": ("y", "y"), "xx": ("x", "x"), "xy": ("x", "y")}


def _product(names: tuple[str, ...], of: dict[str, Column]) -> Column:
    out = of[names[0]]
    for n in names[1:]:
        out = out * of[n]
    return out


def running_sums(df: DataFrame, factors: dict[str, str], window: int, y: str = "ret", key=("symbol",)) -> DataFrame:
    """Adds a struct for each entry (its name -> the factor's column): n (days of the window on which both returns are
    known) and the window's sums; the sums mean something only where n = window. `df` has one row per key and day t."""
    forward = Window.partitionBy(*key, "_block").orderBy("t")
    back = Window.partitionBy(*key, "_block").orderBy(F.col("t").desc())
    upto, since, after = (forward.rowsBetween(Window.unboundedPreceding, 0), back.rowsBetween(Window.unboundedPreceding, 0),
                          back.rowsBetween(Window.unboundedPreceding, -1))
    z = lambda col: F.coalesce(col, F.lit(0.0))
    c = lambda tag, name: f"_{tag}_{name}"
    known = {tag: F.col(y).isNotNull() & F.col(x).isNotNull() for tag, x in factors.items()}
    every = lambda make: {k: v for tag in factors for k, v in make(tag).items()}
    df = df.withColumns({"_block": F.floor(F.col("t") / F.lit(window)), **every(lambda tag: {
        c(tag, "y"): F.when(known[tag], F.col(y)), c(tag, "x"): F.when(known[tag], F.col(factors[tag]))})})
    df = df.withColumns(every(lambda tag: {c(tag, "a"): z(F.sum(c(tag, "y")).over(upto)), c(tag, "b"): z(F.sum(c(tag, "x")).over(upto)),
                                           c(tag, "n"): F.count(c(tag, "y")).over(upto)}))
    df = df.withColumns(every(lambda tag: {c(tag, "ra"): -z(F.sum(c(tag, "y")).over(after)), c(tag, "rb"): -z(F.sum(c(tag, "x")).over(after)),
                                           c(tag, "rn"): -F.count(c(tag, "y")).over(after)}))

    def sums(tag: str, a: str, b: str, j: str, frame) -> list[Column]:
        of = {k: F.col(c(tag, v)) for k, v in (("y", "y"), ("x", "x"), ("j", j))}
        of |= {k: F.when(known[tag], F.col(c(tag, v))) for k, v in (("a", a), ("b", b))}
        return [z(F.sum(_product(names, of)).over(frame)).alias(k) for k, names in (_PATH | _PLAIN).items()]
    df = df.withColumns(every(lambda tag: {c(tag, "down"): F.struct(
        F.count(c(tag, "y")).over(since).alias("n"), *sums(tag, "ra", "rb", "rn", since), F.col(c(tag, "y")).alias("y1"), F.col(c(tag, "x")).alias("x1"))}))
    df = df.withColumns(every(lambda tag: {c(tag, "first"): shift(c(tag, "down"), window - 1, key)}))
    df = df.withColumns(every(lambda tag: {c(tag, "up"): F.struct(F.col(c(tag, "n")).alias("n"), *sums(tag, "a", "b", "n", upto))}))
    # the first day lies in the block before, but for windows that are one whole block
    split = F.pmod(F.col("t"), F.lit(window)) != window - 1

    def whole(tag: str) -> Column:
        up, first = F.col(c(tag, "up")), F.col(c(tag, "first"))
        part = lambda k, none: F.coalesce(F.when(split, first[k]), F.lit(none))
        return F.struct((up["n"] + part("n", 0)).alias("n"), part("n", 0).alias("m"), part("y", 0.0).alias("ty"), part("x", 0.0).alias("tx"),
                        F.col(c(tag, "a")).alias("aw"), F.col(c(tag, "b")).alias("bw"), first["y1"].alias("y1"), first["x1"].alias("x1"),
                        *[(up[k] + part(k, 0.0)).alias(k) for k in _PATH | _PLAIN])
    own = [c(tag, k) for tag in factors for k in ("y", "x", "a", "b", "n", "ra", "rb", "rn", "down", "first", "up")]
    return df.withColumns({tag: whole(tag) for tag in factors}).drop(*own, "_block")


def _derive(value: Column, known: list[str], **make) -> tuple[Column, list[str]]:
    """The struct `value` with further fields, each a function of the fields it has. The struct is bound to a lambda
    variable, so long arithmetic neither repeats its parts nor outgrows one generated method."""
    body = lambda v: F.struct(*[v[k].alias(k) for k in known], *[f(lambda k: v[k]).alias(name) for name, f in make.items()])
    return F.element_at(F.transform(F.array(value), body), 1), known + list(make)


FIT = ("beta", "alpha", "r2", "kappa", "m", "sigma_eq", "x_last", "b", "path_mean", "path_square")


def fit_from_sums(df: DataFrame, sums: str, window: int, per_year: int) -> DataFrame:
    """The rows whose window is complete and whose factor moves in it, with FIT in place of `sums`: beta, alpha, r2 of the
    regression; b, kappa, m, sigma_eq of its residual path's step on its own last value (the last three NULL unless
    0 < b < 1 and the noise has variance), the path's last value, mean and mean square."""
    w, n, c = float(window), float(window - 1), F.col(sums)
    sj, sjj = w * (w + 1) / 2, w * (w + 1) * (2 * w + 1) / 6
    # a factor that stands still leaves only rounding in its spread
    df = df.where((c["n"] == window) & (c["xx"] - c["x"] * c["x"] / w > F.lit(1e-13) * c["xx"]))
    names = ["m", "ty", "tx", "aw", "bw", "y1", "x1", *(_PATH | _PLAIN)]
    v = F.struct(*[c[k].cast("double").alias(k) for k in names])
    spread = lambda uv, u, v_: lambda g: g(uv) - g(u) * g(v_) / w
    v, names = _derive(v, names, cxx=spread("xx", "x", "x"), cxy=spread("xy", "x", "y"), cyy=spread("yy", "y", "y"))
    v, names = _derive(v, names, beta=lambda g: g("cxy") / g("cxx"))
    # the path's sums measured from the window's first day: a + ty, b + tx, j + m
    at0 = lambda uv, u, v_, du, dv: lambda g: g(uv) + g(du) * g(v_) + g(dv) * g(u) + w * g(du) * g(dv)
    with_j = lambda ju, u, du: lambda g: g(ju) + g("m") * g(u) + g(du) * sj
    v, names = _derive(
        v, names, alpha=lambda g: (g("y") - g("beta") * g("x")) / w, sse=lambda g: F.greatest(g("cyy") - g("beta") * g("cxy"), F.lit(0.0)),
        r2=lambda g: F.when(g("cyy") == 0, 1.0).otherwise(g("cxy") * g("cxy") / (g("cxx") * g("cyy"))),
        pa=lambda g: g("a") + w * g("ty"), pb=lambda g: g("b") + w * g("tx"), paa=at0("aa", "a", "a", "ty", "ty"), pbb=at0("bb", "b", "b", "tx", "tx"),
        pab=at0("ab", "a", "b", "ty", "tx"), pja=with_j("ja", "a", "ty"), pjb=with_j("jb", "b", "tx"))
    v, names = _derive(
        v, names, px=lambda g: g("pa") - g("alpha") * sj - g("beta") * g("pb"),
        pxx=lambda g: (g("paa") + g("alpha") * g("alpha") * sjj + g("beta") * g("beta") * g("pbb") - 2 * g("alpha") * g("pja")
                      - 2 * g("beta") * g("pab") + 2 * g("alpha") * g("beta") * g("pjb")),
        x_last=lambda g: (g("aw") + g("ty")) - g("alpha") * w - g("beta") * (g("bw") + g("tx")),
        first=lambda g: g("y1") - g("alpha") - g("beta") * g("x1"))
    # path before against path after a step: the products follow from the squares, as each step is a residual
    v, names = _derive(v, names, sx=lambda g: g("px") - g("x_last"), sy=lambda g: g("px") - g("first"),
                       qx=lambda g: g("pxx") - g("x_last") * g("x_last"), qy=lambda g: g("pxx") - g("first") * g("first"))
    v, names = _derive(v, names, dxx=lambda g: g("qx") - g("sx") * g("sx") / n, dyy=lambda g: g("qy") - g("sy") * g("sy") / n,
                       dxy=lambda g: g("qx") + (g("x_last") * g("x_last") - g("sse")) / 2 - g("sx") * g("sy") / n)
    v, names = _derive(v, names, slope=lambda g: ratio(g("dxy"), g("dxx")))
    v, names = _derive(v, names, noise=lambda g: (g("dyy") - g("slope") * g("dxy")) / (n - 1), level=lambda g: (g("sy") - g("slope") * g("sx")) / n)
    ok = lambda g, x: F.when((g("slope") > 0) & (g("slope") < 1) & (g("noise") > 0), x)
    v = F.transform(F.array(v), lambda r: F.struct(
        *[r[k].alias(k) for k in ("beta", "alpha", "r2", "x_last")], r["slope"].alias("b"), (r["px"] / w).alias("path_mean"), (r["pxx"] / w).alias("path_square"),
        ok(lambda k: r[k], -F.ln(r["slope"]) * per_year).alias("kappa"), ok(lambda k: r[k], r["level"] / (1 - r["slope"])).alias("m"),
        ok(lambda k: r[k], F.sqrt(r["noise"] / (1 - r["slope"] * r["slope"]))).alias("sigma_eq")))
    return df.withColumn("_fit", F.element_at(v, 1)).select(*[x for x in df.columns if x != sums], *[F.col("_fit")[k].alias(k) for k in FIT])


def running_fit(j: DataFrame, window: int, per_year: int) -> DataFrame:
    """The fits of all complete windows of stock returns on their hedge: FIT beside the columns of `j`, which has symbol, t,
    ret, f, m (here renamed market_ret), hedge and fund (see `factors.hedge_funds`). A day's window uses one factor
    throughout, the sector's or the fallback's."""
    # one exchange serves all the sums and the look at the window's first day
    df = running_sums(j.repartition("symbol"), {"_sums_f": "f", "_sums_m": "m"}, window)
    df = df.withColumn("_sums", F.when(F.col("hedge") == F.col("fund"), F.col("_sums_f")).otherwise(F.col("_sums_m"))).drop("_sums_f", "_sums_m")
    return fit_from_sums(df.withColumnRenamed("m", "market_ret"), "_sums", window, per_year)
