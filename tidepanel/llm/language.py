"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training is one pass: each task counts (language, n-gram bucket) for its documents in numpy and emits its sparse
counts; Spark sums them. The matrix of log probabilities, `buckets` x languages and so bounded, is broadcast; scoring
adds, in numpy, the matrix rows of a text's n-grams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import beside_text, has_letter, map_text, with_text, without

FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_OTHER = re.compile(r"[\W\d_]+")
_MAX = 1 << 20                                    # characters handled at once
_SALT = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def _grams(text: str, orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of a lower-cased text in which every run of non-letters is one blank."""
    keep = " " + _OTHER.sub(" ", text.lower()).strip() + " "
    code = np.frombuffer(keep.encode("utf-32-le"), "<u4").astype(np.uint32)
    for n in orders:
        if len(code) >= n:
            h = np.full(len(code) - n + 1, n, np.uint32)
            for i in range(n):
                h = (h ^ code[i:len(code) - n + 1 + i]) * np.uint32(_SALT[i % 4])
                h ^= h >> np.uint32(15)
            yield (h >> np.uint32(32 - bits)).astype(np.int64)



def pieces(text: str) -> Iterator[str]:
    for i in range(0, len(text), _MAX):
        yield text[i:i + _MAX]


def train_languages(docs: DataFrame, orders: tuple[int, ...] = (1, 2, 3), bits: int = 15, smooth: float = 0.5, text: str = "text", lang: str = "lang",
                    max_cells: int = 1 << 25) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log prior, log matrix) from all rows that have a text and a language.

    The matrix has 2^bits rows; more than `max_cells` cells (languages x buckets) is an error, so its size is bounded."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    schema = "lang string, bucket int, n long"
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs_of[name] = docs_of.get(name, 0) + 1
                if name not in sums:
                    sums[name] = np.zeros(size, np.int64)
                for piece in pieces(t):
                    for h in _grams(piece, orders, bits):
                        if len(h) > size // 8:
                            sums[name] += np.bincount(h, minlength=size)
                        else:
                            np.add.at(sums[name], h, 1)
        for name, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()),
                                              pa.array(np.append(c[at], docs_of[name]), pa.int64())], ["lang", "bucket", "n"])

    counts = rows.mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    names = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if len(names) * size > max_cells:
        raise ValueError(f"{len(names)} languages x {size} buckets exceed {max_cells} cells; take fewer bits")
    at = {n: i for i, n in enumerate(names)}
    m, prior = np.full((size, len(names)), smooth), np.full(len(names), 1.0)
    for name, bucket, n in counts.toPandas().itertuples(index=False):
        if bucket < 0:
            prior[at[name]] += n
        else:
            m[bucket, at[name]] += n
    return names, np.log(prior / prior.sum()), np.log(m / m.sum(0)).astype(np.float32)


def predict_languages(docs: DataFrame, model, orders: tuple[int, ...] = (1, 2, 3), text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds `lang_pred` and `score`, the posterior probability of that language.

    A null text, or one without a letter, is `und` with score 0; so is every text when nothing could be learned. Texts are
    read whole. Only the text is looked at; columns of the output's names are replaced."""
    names, prior, matrix = model
    bits = int(matrix.shape[0]).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast((names, prior, matrix))

    def work():
        names, prior, matrix = shared.value

        def judge(texts):
            best, score = [], []
            for raw in texts:
                t = raw.decode() if raw else ""
                if not names or not has_letter(t):
                    best.append("und")
                    score.append(0.0)
                    continue
                s = prior.copy()
                for piece in pieces(t):
                    for h in _grams(piece, orders, bits):
                        s += matrix[h].sum(0, dtype=np.float64)
                e = np.exp(s - s.max())
                k = int(e.argmax())
                best.append(names[k])
                score.append(float(e[k] / e.sum()))
            return {"lang_pred": best, "score": score}

        return judge

    return map_text(docs, FIELDS, work, text, keep_text)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, mod `parts`; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def identify(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Learns on the rows outside fold 1 of 3 and predicts all rows; adds `held_out`, `lang_pred` and `score`."""
    held = fold(F.col("doc_id"), 3) == 1
    model = train_languages(docs.where(~held))
    return predict_languages(without(docs, "held_out").withColumn("held_out", held), model, keep_text=keep_text)


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is known with at least this probability, with their own columns."""
    tagged = docs.select(beside_text(docs), "doc_id", "text", "lang")
    return identify(tagged).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*with_text(docs.columns))
