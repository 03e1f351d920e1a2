"""Language-model scoring with a hashed maximum-entropy model.

P(token | history) = P(class | history) x P(token | class, history). The `classes` - 1 frequent classes hold `width` words
each, by rank; the last class holds all other words, among which a word has its share of the training counts. The class
softmax adds the weight rows of three hashed features (last token; last two; the one before the last, a skip feature);
the softmax inside a class adds one of (class, last token). Both start from the counts alone and are trained by rounds of
gradient updates: each round takes another part of the training documents, every task sums its gradient in numpy, the
sums are added in two stages, and the step is divided by the expected counts. All weights have a fixed size.

Word counts are a table, joined where a word is outside the dictionary of the most frequent ones.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import map_text, without
from .language import fold

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RARE = T.ArrayType(T.StructType([T.StructField("w", T.StringType()), T.StructField("n", T.LongType())]))
FIELDS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("_known", T.LongType()), T.StructField("_base", T.DoubleType()),
                       T.StructField("_score", T.DoubleType()), T.StructField("_rare", _RARE)])
_STEP = 1 << 15                                   # tokens handled at once
_CHUNK = 256                                      # weight rows in one row of a gradient table


@dataclass
class Shape:
    """Sizes of the model: fixed, whatever the corpus."""
    classes: int = 32
    width: int = 33
    class_bits: int = 14
    word_bits: int = 13
    dictionary: int = 65_536
    rounds: int = 2
    rate: float = 0.6
    prior: float = 4.0
    longest: float = 2.0                          # bound of one update of one weight


@dataclass
class Model:
    shape: Shape
    words: list[bytes]                            # by rank
    counts: np.ndarray
    total: int
    distinct: int
    class_bias: np.ndarray = field(default=None)
    word_bias: np.ndarray = field(default=None)
    class_w: np.ndarray = field(default=None)
    word_w: np.ndarray = field(default=None)

    def __post_init__(self):
        s, top = self.shape, (self.shape.classes - 1) * self.shape.width
        c = np.zeros(top)
        c[:min(top, len(self.counts))] = self.counts[:top]
        self.top_known = min(top, len(self.counts))
        self.rest_total, self.rest_distinct = self.total - c.sum(), self.distinct - self.top_known
        self.rest_den = self.rest_total + 0.5 * (self.rest_distinct + 1)
        grid = c.reshape(s.classes - 1, s.width)
        if self.class_bias is None:
            self.class_bias = np.log(np.append(grid.sum(1), self.rest_total) + 0.5).astype(np.float32)
            # places of a class without a word get no probability
            self.word_bias = np.where(np.arange(top).reshape(grid.shape) < self.top_known, np.log(grid + 0.5), -1e9).astype(np.float32)
            self.class_w = np.zeros((1 << s.class_bits, s.classes), np.float32)
            self.word_w = np.zeros((1 << s.word_bits, s.width), np.float32)


def tokens_of(text: bytes | None) -> list[bytes]:
    """Lower-case words, then the end, which is the empty word."""
    words = (text or b"").translate(_LOWER).split()
    words.append(b"")
    return words


def count_words(docs: DataFrame, text: str = "text", most_held: int = 500_000) -> DataFrame:
    """(w, c) over all tokens; a task flushes its counts whenever it holds `most_held` words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["w", "c"])
            held.clear()
            return out

        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                held.update(tokens_of(t))
                if len(held) >= most_held:
                    yield flush()
        yield flush()

    return docs.select(text).mapInArrow(count, "w string, c long").groupBy("w").agg(F.sum("c").alias("c"))


class Reader:
    """Turns texts into arrays: rank of each token (-1 outside the dictionary), feature rows, and document bounds."""

    def __init__(self, model: Model):
        self.model = model
        self.rank = {w: i for i, w in enumerate(model.words)}
        self.code = np.array([zlib.crc32(w) for w in model.words] or [0], np.uint32)

    def read(self, texts: list[bytes | None]):
        m, s = self.model, self.model.shape
        docs = [tokens_of(t) for t in texts]
        size = np.array([len(d) for d in docs], np.int64)
        flat = [w for d in docs for w in d]
        get = self.rank.get
        rank = np.fromiter((get(w, -1) for w in flat), np.int64, len(flat))
        code = self.code[rank]
        rare = np.flatnonzero(rank < 0)
        code[rare] = [zlib.crc32(flat[i]) for i in rare.tolist()]
        first = np.cumsum(size) - size
        start = np.repeat(first, size)
        at = np.arange(len(flat)) - start
        one = np.where(at > 0, np.roll(code, 1), np.uint32(7))
        two = np.where(at > 1, np.roll(code, 2), np.uint32(11))
        top = (s.classes - 1) * s.width
        cls = np.where((rank >= 0) & (rank < top), rank // s.width, s.classes - 1)
        f = [_row(one, 1, s.class_bits), _row(one * np.uint32(0x85EBCA6B) ^ two, 2, s.class_bits), _row(two, 3, s.class_bits)]
        g = _row(one + cls.astype(np.uint32) * np.uint32(0x9E3779B1), 4, s.word_bits)
        return docs, size, first, rank, cls, f, g


def _row(x: np.ndarray, kind: int, bits: int) -> np.ndarray:
    h = (x ^ np.uint32(kind * 0x01000193)) * np.uint32(0xCC9E2D51)
    h ^= h >> np.uint32(15)
    h = h * np.uint32(0x1B873593)
    return (h >> np.uint32(32 - bits)).astype(np.uint16)


def _softmax(x: np.ndarray) -> np.ndarray:
    """In place; returns the log of the sums."""
    top = x.max(1, keepdims=True)
    x -= top
    np.exp(x, out=x)
    total = x.sum(1, keepdims=True)
    x /= total
    return np.log(total[:, 0]) + top[:, 0]


def _steps(n: int) -> Iterator[slice]:
    for a in range(0, n, _STEP):
        yield slice(a, min(n, a + _STEP))


def _probabilities(m: Model, sl: slice, rank, cls, f, g):
    """(class logits, class probabilities, which tokens are in frequent classes, their word logits and probabilities)."""
    c = m.class_bias + m.class_w[f[0][sl]] + m.class_w[f[1][sl]] + m.class_w[f[2][sl]]
    own = np.take_along_axis(c, cls[sl][:, None], 1)[:, 0]
    log_class = own - _softmax(c)
    inner = np.flatnonzero(cls[sl] < m.shape.classes - 1)
    k, r = cls[sl][inner], rank[sl][inner]
    w = m.word_bias[k] + m.word_w[g[sl][inner]]
    own = np.take_along_axis(w, (r % m.shape.width)[:, None], 1)[:, 0]
    log_word = own - _softmax(w)
    return log_class, c, inner, log_word, w


def _scatter(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    if len(rows):
        order = np.argsort(rows, kind="stable")
        r = rows[order]
        heads = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        into[r[heads]] += np.add.reduceat(values[order], heads, axis=0)


def _gradient(docs: DataFrame, model: Model, text: str) -> tuple[np.ndarray, ...]:
    """Summed over all documents: for both weight tables the observed less the expected counts, and the row counts."""
    spark, s = docs.sparkSession, model.shape
    shared = spark.sparkContext.broadcast(model)
    wide = max(s.classes, s.width) + 1
    n_rows = (1 << s.class_bits) + (1 << s.word_bits)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        m = shared.value
        reader = Reader(m)
        g = np.zeros((n_rows, wide), np.float32)              # the last column counts the rows' uses
        cg, wg = g[:1 << s.class_bits], g[1 << s.class_bits:]
        for b in batches:
            texts = b.column(0).cast(pa.binary()).to_pylist()
            for a in range(0, len(texts), 256):
                _, _, _, rank, cls, f, w = reader.read(texts[a:a + 256])
                for sl in _steps(len(rank)):
                    _, p, inner, _, q = _probabilities(m, sl, rank, cls, f, w)
                    d = np.zeros((len(p), wide), np.float32)
                    d[:, :s.classes] = -p
                    d[np.arange(len(p)), cls[sl]] += 1
                    d[:, -1] = 1
                    for x in f:
                        _scatter(cg, x[sl], d)
                    d = np.zeros((len(q), wide), np.float32)
                    d[:, :s.width] = -q
                    d[np.arange(len(q)), rank[sl][inner] % s.width] += 1
                    d[:, -1] = 1
                    _scatter(wg, w[sl][inner], d)
        part = TaskContext.get().partitionId()
        used = [k for k in range(n_rows // _CHUNK) if g[k * _CHUNK:(k + 1) * _CHUNK, -1].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([part] * len(used), pa.int32()),
                                          pa.array([g[k * _CHUNK:(k + 1) * _CHUNK].tobytes() for k in used], pa.binary())], ["chunk", "part", "g"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")                         # the same order of additions in every run
        total = np.zeros(_CHUNK * wide, np.float32)
        for x in pdf["g"]:
            total += np.frombuffer(x, np.float32)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "part": pdf["part"].iloc[:1], "g": [total.tobytes()]})

    schema = "chunk int, part int, g binary"
    parts = docs.select(text).mapInArrow(task, schema)
    # in two stages, so that no group holds more than a few hundred partial sums
    sums = parts.groupBy("chunk", F.floor(F.col("part") / 256)).applyInPandas(add, schema).groupBy("chunk").applyInPandas(add, schema)
    g = np.zeros((n_rows, wide), np.float32)
    for r in sums.collect():                                  # the size of the model, whatever the corpus
        g[r["chunk"] * _CHUNK:(r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["g"], np.float32).reshape(_CHUNK, wide)
    cg, wg = g[:1 << s.class_bits], g[1 << s.class_bits:]
    return cg[:, :s.classes], cg[:, -1:], wg[:, :s.width], wg[:, -1:]


def fit(docs: DataFrame, shape: Shape | None = None, text: str = "text", doc_id: str = "doc_id") -> tuple[Model, DataFrame]:
    """(model, table of word counts) from all rows of `docs`."""
    s = shape or Shape()
    vocabulary = materialise(count_words(docs, text), "maxent-words")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = vocabulary.orderBy(F.desc("c"), "w").limit(s.dictionary).collect()
    model = Model(s, [r["w"].encode() for r in top], np.array([r["c"] for r in top], np.int64), total, distinct)
    if not total:
        return model, vocabulary
    part = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(s.rounds))
    prior = np.exp(model.class_bias - model.class_bias.max())
    prior /= prior.sum()
    for r in range(s.rounds):
        cg, cn, wg, wn = _gradient(docs.where(part == r), model, text)
        # a step in units of the expected counts, held back where a row was seldom used
        model.class_w += np.clip(s.rate * cg / (cn * prior + s.prior), -s.longest, s.longest) / (3 if r else 2)
        model.word_w += np.clip(s.rate * wg / (wn / s.width + s.prior), -s.longest, s.longest)
    return model, vocabulary


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Per row: the columns in `carry` (all when None), `n_tokens`, `n_known`, `train_tokens`, `base_score` (log10 of the
    unigram probability with half a count added) and `score` (log10 of the model's probability of the whole text).

    A null text is empty: one end token. Repeated rows are scored alike; with nothing to learn from, both scores follow
    from counts of zero. Columns of the output's names are replaced. Words outside the dictionary are joined with the
    table of counts by a shuffle; none of them is frequent, so no key is hot.
    """
    docs = without(docs, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    names = docs.columns if carry is None else carry
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base_den = np.log10(model.total + 0.5 * (model.distinct + 1))
    rest_den = np.log10(model.rest_den)

    def work():
        m = shared.value
        reader = Reader(m)
        logs = np.append(np.log10(m.counts + 0.5), 0.0)       # the last for words outside the dictionary

        def judge(texts):
            out = {k: [] for k in ("n_tokens", "_known", "_base", "_score")}
            words, ns, bounds = [], [], [0]
            for a in range(0, len(texts), 256):
                docs_, size, first, rank, cls, f, g = reader.read(texts[a:a + 256])
                lp = np.empty(len(rank))
                for sl in _steps(len(rank)):
                    log_class, _, inner, log_word, _ = _probabilities(m, sl, rank, cls, f, g)
                    log_class = log_class.astype(np.float64)
                    log_class[inner] += log_word
                    lp[sl] = log_class
                base = logs[rank]
                # in the last class a dictionary word has its share of the counts now, the others after the join
                own = np.where(cls == m.shape.classes - 1, base - rest_den, 0.0)      # a word outside has log 0 here, see `_logs`
                out["n_tokens"] += size.tolist()
                out["_known"] += np.add.reduceat((rank >= 0).astype(np.int64), first).tolist()
                out["_base"] += np.add.reduceat(base - base_den, first).tolist()
                out["_score"] += np.add.reduceat(lp / np.log(10) + own, first).tolist()
                for d, at in zip(docs_, first.tolist()):
                    c = Counter(d[i] for i in np.flatnonzero(rank[at:at + len(d)] < 0).tolist())
                    words += c.keys()
                    ns += c.values()
                    bounds.append(len(words))
            pairs = pa.StructArray.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(ns, pa.int64())], ["w", "n"])
            out["_rare"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs)
            return out

        return judge

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(text).alias("_text"))
    rows = map_text(rows, FIELDS, work, "_text", keep_text=False).withColumn("_rid", F.monotonically_increasing_id())
    rows = materialise(rows, "maxent-rows")
    pairs = rows.select("_rid", F.explode("_rare").alias("r")).select("_rid", "r.w", "r.n")
    met = pairs.join(vocabulary, "w", "left").groupBy("_rid").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("_logs"), F.sum(F.when(F.col("c") > 0, F.col("n"))).alias("_met"))
    out = rows.drop("_rare").join(met, "_rid", "left")
    logs = F.coalesce("_logs", F.lit(0.0))
    return out.select("_row.*", "n_tokens", (F.col("_known") + F.coalesce("_met", F.lit(0))).alias("n_known"), F.lit(int(model.total)).cast("long").alias("train_tokens"),
                      (F.col("_base") + logs).alias("base_score"), (F.col("_score") + logs).alias("score"))


def fit_and_score(docs: DataFrame, shape: Shape | None = None, carry: list[str] | None = None) -> DataFrame:
    """Learns from the rows outside fold 1 of 5, scores all rows; adds `held_out`."""
    held = fold(F.col("doc_id"), 5) == 1
    model, vocabulary = fit(docs.where(~held), shape)
    docs = without(docs, "held_out").withColumn("held_out", held)
    return score(docs, model, vocabulary, carry=None if carry is None else [*carry, "held_out"])
