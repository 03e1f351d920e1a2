"""Whitening of embeddings.

Two passes over the vectors give exact whole-number sums: first their number and the sum of each dimension, then, with
every entry centred on the rounded mean, the products of all pairs of dimensions. The covariance follows from these
integers without rounding before its last division. Its size is that of the dimensions alone, so one small matrix
reaches the driver: it is reduced to three diagonals by Householder reflections, the leading eigenvalues come from
bisection on Sturm counts, their vectors from inverse iteration, made orthogonal again inside clusters of close values.
The projection is broadcast; a third pass measures the covariance of what came out.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import without

SCALE, SHIFT = 64, 1_000_000
#: |64 c| at most this: beyond it a row counts as non-finite, since its squares leave every exact type.
LARGEST = 2.0 ** 40


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of a symmetric matrix; reflector k acts on the dimensions after k."""
    a = np.array(a, np.float64)
    d = len(a)
    reflectors = []
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0 or not np.any(x[1:]):
            reflectors.append(np.zeros_like(x))
            continue
        x[0] += np.copysign(norm, x[0])
        u = x / np.linalg.norm(x)
        rest = a[k + 1:, k + 1:]
        p = rest @ u
        q = p - (u @ p) * u
        rest -= 2 * (np.outer(u, q) + np.outer(q, u))
        a[k + 1:, k] -= 2 * u * (u @ a[k + 1:, k])
        a[k, k + 1:] = a[k + 1:, k]
        reflectors.append(u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflectors


def _below(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each value of `at`: negative pivots of the shifted matrix."""
    tiny = np.finfo(np.float64).tiny ** 0.5
    q = diag[0] - at
    count = (q < 0).astype(int)
    for i in range(1, len(diag)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = diag[i] - at - off[i - 1] ** 2 / q
        count += q < 0
    return count


def leading_values(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection of all of them at once."""
    d = len(diag)
    reach = np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))
    low, high = (diag - reach).min(), (diag + reach).max()
    want = np.arange(d - 1, d - 1 - k, -1)      # the value with this many below it
    lo, hi = np.full(k, low), np.full(k, np.nextafter(high, np.inf))
    for _ in range(2200):
        mid = lo + (hi - lo) / 2
        if np.all((mid <= lo) | (mid >= hi)):
            break
        right = _below(diag, off, mid) > want
        hi, lo = np.where(right, mid, hi), np.where(right, lo, mid)
    return lo + (hi - lo) / 2


def _solve(diag: np.ndarray, off: np.ndarray, shift: float, rhs: np.ndarray, floor: float) -> np.ndarray:
    """(T - shift) x = rhs by elimination with row exchanges, pivots of at least `floor`."""
    d = len(diag)
    a, b, c = diag - shift, np.append(off, 0.0), np.zeros(d)        # this row's entry, the next one's, the one after
    y = rhs.copy()
    for i in range(d - 1):
        low = off[i]
        if abs(low) > abs(a[i]):        # exchange rows i and i + 1
            row = a[i], b[i]
            a[i], b[i], c[i] = low, a[i + 1], b[i + 1]
            m = row[0] / a[i]
            a[i + 1], b[i + 1] = row[1] - m * b[i], -m * c[i]
            y[i], y[i + 1] = y[i + 1], y[i] - m * y[i + 1]
        else:
            if abs(a[i]) < floor:
                a[i] = floor
            m = low / a[i]
            a[i + 1] -= m * b[i]
            y[i + 1] -= m * y[i]
    x = np.zeros(d)
    for i in range(d - 1, -1, -1):
        pivot = a[i] if abs(a[i]) >= floor else np.copysign(floor, a[i])
        x[i] = (y[i] - (b[i] * x[i + 1] if i + 1 < d else 0) - (c[i] * x[i + 2] if i + 2 < d else 0)) / pivot
    return x


def leading_vectors(diag: np.ndarray, off: np.ndarray, values: np.ndarray, near: float = 1e-3) -> np.ndarray:
    """Columns: unit eigenvectors of the three diagonals for falling `values`. Values closer than `near` times the
    matrix's size form a cluster, inside which each vector is made orthogonal to those before it in every round."""
    d = len(diag)
    size = max(np.abs(diag).max(initial=0), np.abs(off).max(initial=0), np.finfo(np.float64).tiny)
    floor = np.finfo(np.float64).eps * size
    rnd = np.random.default_rng(12345)
    out = np.zeros((d, len(values)))
    first, used = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > near * size:
            first = j
        shift = min(value, used - 4 * floor) if j > first else value      # equal values get different shifts
        used = shift
        x = rnd.standard_normal(d)
        for _ in range(6):
            x = _solve(diag, off, shift, x / np.linalg.norm(x), floor)
            x /= np.linalg.norm(x)
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
            x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def components(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the k leading components, falling."""
    size = float(np.abs(cov).max(initial=0))
    if size == 0:
        return np.zeros(k), np.eye(len(cov))[:, :k]
    unit = 2.0 ** np.frexp(size)[1]         # a power of two, so that scaling is exact
    diag, off, reflectors = tridiagonal(cov / unit)
    values = leading_values(diag, off, k)
    vectors = leading_vectors(diag, off, values)
    for r in range(len(reflectors) - 1, -1, -1):
        u = reflectors[r]
        vectors[r + 1:] -= 2 * np.outer(u, u @ vectors[r + 1:])
    return values * unit, vectors


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sum of each dimension."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), len(b.column(0)[0]))
                n, total = n + len(x), x.sum(0) if total is None else total + x.sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total)), pa.int32()), pa.array([n, *total.tolist()], pa.int64())], ["i", "v"])
    got = {r["i"]: int(r["v"]) for r in vectors.mapInArrow(part, "i int, v long").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    return got.pop(-1, 0), [got[i] for i in sorted(got)]


def _products(vectors: DataFrame, centre: np.ndarray) -> list[list[int]]:
    """Exact sums of products of all pairs of dimensions (upper half), entries less `centre`."""
    d = len(centre)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, i = [[0] * (d - k) for k in range(d)], np.arange(d)
        some = False
        held, size = np.zeros((d, d)), 0.0
        def put():
            for k in range(d):
                total[k] = [a + int(b) for a, b in zip(total[k], held[k, k:].tolist())]
        for b in batches:
            if not b.num_rows:
                continue
            x, some = _matrix(b.column(0), d) - centre, True
            top = float(np.abs(x).max(initial=0))
            if len(x) * top * top >= 2.0 ** 53:         # too large for whole numbers in doubles: Python's integers
                for r in x.tolist():
                    for k in range(d):
                        total[k] = [a + r[k] * c for a, c in zip(total[k], r[k:])]
                continue
            if size + len(x) * top * top >= 2.0 ** 53:
                put()
                held, size = np.zeros((d, d)), 0.0
            f = x.astype(np.float64)
            held, size = held + f.T @ f, size + len(x) * top * top
        if some:
            put()
            for k in range(d):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d - k, k), pa.int32()), pa.array(i[k:], pa.int32()),
                                                  pa.array([str(v) for v in total[k]], pa.string())], ["i", "j", "v"])
    rows = vectors.mapInArrow(part, "i int, j int, v string").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out = [[0] * d for _ in range(d)]
    for r in rows.collect():
        out[r["i"]][r["j"]] = out[r["j"]][r["i"]] = int(r["v"])
    return out


def _merge(a, b):
    """Two (n, mean, centred products) of disjoint rows as one."""
    if a is None:
        return b
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def _identity_error(out: DataFrame, k: int, parts: int = 64) -> float:
    """Largest entry of the covariance of `out.w` less the identity; means are taken out before products are."""
    pack = lambda m: [m[0], m[1].tobytes(), m[2].tobytes()]
    back = lambda n, mean, prod: (n, np.frombuffer(mean), np.frombuffer(prod).reshape(k, k))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None
        for b in batches:
            if b.num_rows:
                w = _matrix(b.column(0), k)
                mean = w.mean(0)
                m = _merge(m, (len(w), mean, (w - mean).T @ (w - mean)))
        if m:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in pack(m)], ["n", "mean", "prod"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        m = None
        for n, mean, prod in zip(pdf["n"], pdf["mean"], pdf["prod"]):
            m = _merge(m, back(n, mean, prod))
        return pd.DataFrame([pack(m)], columns=["n", "mean", "prod"])

    schema = "n long, mean binary, prod binary"
    rows = out.select("w").mapInArrow(part, schema).withColumn("p", F.pmod(F.spark_partition_id(), F.lit(parts)))
    m = None
    for r in rows.groupBy("p").applyInPandas(lambda pdf: join(pdf), schema).collect():      # at most `parts` small matrices
        m = _merge(m, back(r["n"], r["mean"], r["prod"]))
    return float(np.abs(m[2] / m[0] - np.eye(k)).max())


def whiten(vectors: DataFrame, vector: str = "embedding", carry: list[str] | None = None, most: int = 32, flat: float = 1e-12) -> DataFrame:
    """Per usable row: the columns in `carry` (all when None), `n`, `deviation` (sum over dimensions of (n x - S)^2, exact),
    `whitened` and `explained` (arrays over the components, at most `most`) and `identity_error`.

    Rows whose vector is null or has a null, non-finite or huge entry (|64 c| beyond 2^40) are dropped, and so are empty
    vectors and vectors of another length than the commonest (ties: the longest). x = floor(64 c) + 1000000. Components
    whose eigenvalue is not above `flat` times the trace have no spread to whiten and are left out, so there are at most
    as many as the rank; equal rows stay equal, repeated and null ids are kept as they are. When no component is left (no
    row, one row, all equal) the arrays are empty and `identity_error` is 0. Columns of the output's names are replaced.
    A deviation beyond 64 bits is an error, not a wrong number.
    """
    v = F.col(f"`{vector}`")
    names = [c for c in (vectors.columns if carry is None else carry) if c.lower() not in {"n", "deviation", "whitened", "explained", "identity_error"}]
    rows = vectors.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row") if names else F.lit(None).cast("string").alias("_row"), v.cast("array<double>").alias("_v"))
    usable = F.col("_v").isNotNull() & F.forall("_v", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c * SCALE) <= LARGEST), F.lit(False))) & (F.size("_v") > 0)
    rows = rows.where(usable).withColumn("x", F.transform("_v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)).drop("_v")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("m"), F.desc("d")).limit(1).collect()
    if not lengths:
        return _finish(rows.limit(0), names, 0, [], np.zeros((0, 0)), [], 0.0)[0]
    rows = rows.where(F.size("x") == lengths[0]["d"])
    n, s = _sums(rows.select("x"))
    d = len(s)
    centre = np.array([(2 * t + n) // (2 * n) for t in s], np.int64)
    prod = _products(rows.select("x"), centre)
    left = [t - n * int(c) for t, c in zip(s, centre)]       # sums after centring on whole numbers
    cov = np.array([[float(Fraction(n * prod[i][j] - left[i] * left[j], n * n)) for j in range(d)] for i in range(d)])
    trace = float(np.trace(cov))
    values, axes = components(cov, min(most, d))
    kept = int(np.sum(values > flat * trace)) if trace > 0 else 0
    values, axes = values[:kept], axes[:, :kept]
    out, again = _finish(rows, names, n, s, axes / np.sqrt(values), [float(e / trace) for e in values], None)
    if kept:
        again = materialise(again, "whitened")
    return _shown(again, names, n, [float(e / trace) for e in values], _identity_error(again, kept) if kept else 0.0)


def _finish(rows: DataFrame, names: list[str], n: int, s: list[int], axes: np.ndarray, explained: list[float], error: float | None):
    """Rows with `deviation` and `w`, and the same as shown."""
    d, k = axes.shape
    shared = rows.sparkSession.sparkContext.broadcast((s, axes))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s_, axes_ = shared.value
        whole = np.array(s_, dtype=object)
        base = [t // n for t in s_]
        part = np.array([(t - n * b) / n for t, b in zip(s_, base)])
        base = np.array(base, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(b.schema.get_field_index("x")), d)
            top = max(abs(int(x.min())), abs(int(x.max()))) * n
            far = x - base
            if 2 * top < 2 ** 62 and d * float(np.abs(far).max() + 1) ** 2 * float(n) ** 2 < 2.0 ** 62:
                y = n * x - np.array(s_, np.int64)
                dev = (y * y).sum(1)
            else:
                y = n * x.astype(object) - whole
                dev = (y * y).sum(1).tolist()
            w = (far - part) @ axes_
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("_row")), pa.array(dev, pa.int64()), flat], ["_row", "deviation", "w"])

    schema = T.StructType([rows.schema["_row"], T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    got = rows.select("_row", "x").mapInArrow(project, schema)
    return (_shown(got, names, n, explained, error) if error is not None else None), got


def _shown(got: DataFrame, names: list[str], n: int, explained: list[float], error: float) -> DataFrame:
    keep = [F.col("_row")[c].alias(c) for c in names]
    return got.select(*keep, F.lit(n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"),
                      F.array(*[F.lit(e) for e in explained]).cast("array<double>").alias("explained"), F.lit(float(error)).alias("identity_error"))


def by_component(whitened: DataFrame) -> DataFrame:
    """One row for each row and component of `whiten`: `component` (from 1), `whitened`, `explained`."""
    keep = [f"`{c}`" for c in whitened.columns if c not in ("whitened", "explained")]
    pairs = F.arrays_zip("whitened", "explained")
    flat = whitened.select(*keep, F.posexplode(pairs).alias("_at", "_pair"))
    return flat.select(*keep, (F.col("_at") + 1).alias("component"), F.col("_pair.whitened").alias("whitened"), F.col("_pair.explained").alias("explained"))
