"""Phrase collocations by Toivonen's sampling.

A sample of the documents proposes phrases: at each length those that reach a lowered count among phrases whose two
one-word-shorter parts were proposed. A full pass then counts every phrase whose two shorter parts are proposed: the
proposed ones and their negative border, the phrases just outside. A border phrase that turns out frequent is a failure
of the sample: it is added to the proposals, which moves the border, and another full pass counts what is new. That pass
follows the border as it moves: longer phrases around what it counts anew are counted too, so it leaves nothing open.

Until then phrases are hashes, whose counts are never below the true ones, and proposals travel as bitmaps of bounded
size, whose chance hits only make a pass count more. A last pass counts the phrases found frequent as strings, exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import small_side, sql_lower

#: Kinds of bytes, A-Z in lower case: 0 of a word, 1 between words, 2 between pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of text that are counted at once.
PIECE = 4 << 20
_COUNTS = "lang string, k int, phrase string, n long"


def _mix(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase lengthened by a word."""
    x = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (word + np.uint64(0x7F4A7C15))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _word_hashes(lang: bytes, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang) & 0xFFFFFFFF
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in words), np.uint64, len(words))


def _found(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both of a hash's places are set."""
    mask = np.uint64(len(bits) * 8 - 1)
    a, b = h & mask, (h >> np.uint64(31)) & mask
    one = lambda p: (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
    return (one(a) & one(b)).astype(bool)


def _segment(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(word numbers, distinct words, number of the piece) of texts, in order; no piece crosses a text's end."""
    buf = b"\n".join(texts).translate(_LOWER)
    kind = _KIND[np.frombuffer(buf, np.uint8)]
    inside = kind == 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.binary()), np.zeros(0, np.int64)
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    packed = np.frombuffer(buf, np.uint8)[inside].tobytes()
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed)]).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary, piece


def _walk(lang: bytes, texts: list[bytes], most: int, goes: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple]:
    """(k, ids, words, places, hashes, fresh, hashes of `words`) for lengths from 1 on: the places where a phrase of k words starts, inside a
    piece, whose two shorter parts `goes` lets pass. `goes(k, hashes, fresh)` says which phrases of k words may grow, and
    leaves in `fresh` which count anew; a phrase is fresh if one of its parts is."""
    ids, words, piece = _segment(texts)
    if not len(ids):
        return
    n, wh = len(ids), _word_hashes(lang, words.to_pylist())
    here, hashes, fresh = np.arange(n), wh[ids], np.zeros(n, bool)
    for k in range(1, most + 1):
        yield k, ids, words, here, hashes, fresh, wh
        if k == most:
            return
        grow, known = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        grow[here], old = goes(k, hashes, fresh)
        known[here] = old
        ok = grow[here] & grow[here + 1] & (here + k < n)
        ok[ok] = piece[here[ok] + k] == piece[here[ok]]
        here, hashes = here[ok], hashes[ok]
        if not len(here):
            return
        fresh = ~(known[here] & known[here + 1])
        hashes = _mix(hashes, wh[ids[here + k]])


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[bytes]]]:
    """Texts of one language each, some PIECE bytes at once."""
    for b in batches:
        by_lang: dict[bytes, list[int]] = {}
        for i, lang in enumerate(b.column(0).cast(pa.binary()).to_pylist()):
            by_lang.setdefault(lang, []).append(i)
        texts = b.column(1)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for lang, rows in by_lang.items():
            part, size = [], 0
            for at, i in enumerate(rows):
                part.append(i)
                size += sizes[i]
                if size >= PIECE or at == len(rows) - 1:
                    yield lang, [t for t in texts.take(pa.array(part)).cast(pa.binary()).to_pylist() if t]
                    part, size = [], 0


def _hashed(docs: DataFrame, most: int, levels: tuple[int, ...], shared: Broadcast) -> DataFrame:
    """(k, h, n): counts by hash over all rows of `docs` (lang, text) of the phrases of `levels` words that may grow out of
    the proposals `new`; with earlier proposals `old`, of those only that did not grow out of these."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, old = shared.value

        def goes(k, h, fresh):
            if k not in new:
                return np.zeros(len(h), bool), np.zeros(len(h), bool)
            return (_found(new[k], h) | fresh, _found(old[k], h) & ~fresh) if old else (_found(new[k], h), np.zeros(len(h), bool))
        for lang, texts in _by_lang(batches):
            for k, ids, words, _, h, fresh, wh in _walk(lang, texts, most, goes):
                if k in levels:
                    h, n = (wh, np.bincount(ids, minlength=len(words))) if k == 1 else np.unique(h[fresh] if old else h, return_counts=True)
                    for i in range(0, len(h), 1 << 17):
                        part = h[i:i + (1 << 17)].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k), pa.int32()), pa.array(part), pa.array(n[i:i + (1 << 17)])], ["k", "h", "n"])
    return docs.select("lang", "text").mapInArrow(run, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n"))


def _exact(docs: DataFrame, most: int, shared: Broadcast) -> DataFrame:
    """(lang, k, phrase, n) of the phrases whose hashes, and those of all their parts, are in the bitmaps; k = 0: all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value

        def goes(k, h, fresh):
            return (_found(bits[k], h) if k in bits else np.zeros(len(h), bool)), fresh
        for lang, texts in _by_lang(batches):
            for k, ids, words, here, h, _, wh in _walk(lang, texts, most, goes):
                if k == 1:
                    yield _rows(lang, 0, pa.array([b""], pa.large_binary()), np.array([len(ids)]))
                    some = np.flatnonzero(_found(bits[1], wh))
                    if len(some):
                        yield _rows(lang, 1, words.take(pa.array(some)), np.bincount(ids, minlength=len(words))[some])
                    continue
                here = here[_found(bits[k], h)] if k in bits else here[:0]
                if not len(here):
                    continue
                cols = [ids[here + j] for j in range(k)]
                key = cols[0]
                for j, c in enumerate(cols[1:], 2):
                    if len(words) ** j >= 1 << 62:      # renumber what would not fit
                        key = np.unique(key, return_inverse=True)[1]
                    key = key * len(words) + c
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                names = [words.take(pa.array(c[first])) for c in cols]
                yield _rows(lang, k, pc.binary_join_element_wise(*names, pa.scalar(b" ", pa.large_binary())), n)
    return docs.select("lang", "text").mapInArrow(run, _COUNTS).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


def _rows(lang: bytes, k: int, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    m = len(phrases)
    return pa.RecordBatch.from_arrays([pa.array([lang.decode()] * m, pa.string()), pa.array(np.full(m, k), pa.int32()), phrases.cast(pa.binary()).cast(pa.string()),
                                       pa.array(n.astype(np.int64))], ["lang", "k", "phrase", "n"])


def _bitmap(hashes: DataFrame, bits: np.ndarray, block: int = 1 << 12) -> np.ndarray:
    """`bits` with the places of the column `h` set; at most its size reaches the driver."""
    mask, size = np.uint64(len(bits) * 8 - 1), len(bits)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.uint8)
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64)
            for p in (h & mask, (h >> np.uint64(31)) & mask):
                np.bitwise_or.at(own, p >> np.uint64(3), (np.uint8(1) << (p & np.uint64(7)).astype(np.uint8)))
        used = np.flatnonzero(own.reshape(-1, min(block, size)).any(1))
        for i in range(0, len(used), 256):
            some = used[i:i + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([own.reshape(-1, min(block, size))[j].tobytes() for j in some], pa.binary())], ["at", "bits"])

    def join(key, rows):
        total = np.zeros(min(block, size), np.uint8)
        for x in rows.column("bits"):
            total = total | np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})

    out = bits.copy().reshape(-1, min(block, size))
    rows = hashes.select("h").mapInArrow(places, "at int, bits binary").groupBy("at").applyInArrow(join, "at int, bits binary")
    for r in rows.toLocalIterator():
        out[r["at"]] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.reshape(-1)


def _fresh_bitmap(hashes: DataFrame, most_bytes: int) -> np.ndarray:
    """A bitmap of 16 bits a hash, within `most_bytes`."""
    size = min(most_bytes, max(1 << 12, 2 * hashes.count()))
    return _bitmap(hashes, np.zeros(1 << ((size - 1).bit_length() if size < most_bytes else size.bit_length() - 1), np.uint8))


def _missed(counts: DataFrame, shared: Broadcast) -> DataFrame:
    """Rows (k, h) that the bitmaps of their lengths do not find."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value[0]
        for b in batches:
            h, k = b.column(1).to_numpy().view(np.uint64), b.column(0).to_numpy()
            out = np.zeros(len(h), bool)
            for one in np.unique(k).tolist():
                out[k == one] = ~_found(bits[one], h[k == one])
            yield b.filter(pa.array(out))
    return counts.select("k", "h").mapInArrow(run, "k int, h long")


def count_frequent(docs: DataFrame, longest: int, least: int, share: float, seed: int, bitmap_bytes: int) -> DataFrame:
    """(lang, k, phrase, n): every phrase of 1 to `longest` words with n >= `least`, and k = 0 with the number of words."""
    send = docs.sparkSession.sparkContext.broadcast
    low = max(2, int(0.8 * share * least))      # a phrase seen once proposes nothing
    some = docs.sample(share, seed)
    bits: dict[int, np.ndarray] = {}
    for k in range(1, longest):         # the sample proposes, length by length
        shared = send((bits, {}))
        seen = materialise(_hashed(some, k, (k,), shared).where(F.col("n") >= low), "phrases-proposed")
        shared.unpersist()
        bits = bits | {k: _fresh_bitmap(seen, bitmap_bytes)}
    shared = send((bits, {}))
    done = materialise(_hashed(docs, longest, tuple(range(1, longest + 1)), shared).where(F.col("n") >= least), "phrases-bordered")
    failed = materialise(_missed(done.where(F.col("k") < longest), shared), "phrases-failed")
    shared.unpersist()
    lengths = [r["k"] for r in failed.select("k").distinct().collect()]
    if lengths:
        wider = bits | {k: _bitmap(failed.where(F.col("k") == k), bits[k]) for k in lengths}
        shared = send((wider, bits))
        more = materialise(_hashed(docs, longest, tuple(range(2, longest + 1)), shared).where(F.col("n") >= least), "phrases-bordered")
        shared.unpersist()
        done = done.unionByName(more)
    shared = send({k: _fresh_bitmap(done.where(F.col("k") == k), bitmap_bytes) for k in range(1, longest + 1)})
    counts = materialise(_exact(docs, longest, shared).where((F.col("n") >= least) | (F.col("k") == 0)), "phrases-counted")
    shared.unpersist()
    return counts


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str, most_rows: int) -> DataFrame:
    return left.join(small_side(right, most_rows, "phrase"), on, how)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, top: int | None = 2000, covered: int = 50,
                 share: float = 0.25, seed: int = 7, bitmap_bytes: int = 16 << 20, broadcast_rows: int = 500_000) -> DataFrame:
    """Per language: `lang`, `rank`, `phrase`, `a` (its occurrences), `l`, `r` (those of its two parts at the cut that
    scores least), `n` (all words) and `score` = floor(1000000 a a / (l r)).

    Texts are lower-cased (A-Z) and split at . , ; : ! ? and line ends; occurrences overlap and stay inside pieces.
    Candidates have 2 to `longest` words and at least `least` occurrences; those inside a longer frequent phrase with at
    least `covered` percent of their occurrences are dropped; the first `top` of each language are kept (None: all). Null texts are
    empty, a null language is `und`, repeated rows count each time, other columns are ignored; an empty table, or one
    without frequent phrases, gives no rows. All counts cover all rows: `share` only sets which phrases are proposed.
    `bitmap_bytes` bounds what is broadcast for each length; when the proposals outgrow it, more phrases are counted than needed and
    results stay the same. Frequent phrases are broadcast up to `broadcast_rows` rows (and 32 MiB), counted first.
    """
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text"))
    counts = count_frequent(rows, longest, least, share, seed, bitmap_bytes)
    total = counts.where("k = 0").select("lang", F.col("n").alias("words"))
    frequent = counts.where("k > 0")
    part = frequent.select("lang", "phrase", F.col("n").alias("f"))
    words = F.split("phrase", " ")
    cut = frequent.where("k > 1").withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select(
        "lang", F.col("phrase").alias("whole"), F.col("n").alias("a"), "at", F.array_join(F.slice(words, F.lit(1), F.col("at")), " ").alias("first"),
        F.array_join(F.slice(words, F.col("at") + 1, F.col("k") - F.col("at")), " ").alias("rest"))
    cut = _joined(cut.withColumnRenamed("first", "phrase"), part.withColumnRenamed("f", "l"), ["lang", "phrase"], "inner", broadcast_rows).drop("phrase")
    cut = _joined(cut.withColumnRenamed("rest", "phrase"), part.withColumnRenamed("f", "r"), ["lang", "phrase"], "inner", broadcast_rows).drop("phrase")
    score = F.expr("cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    best = cut.withColumn("score", score).groupBy("lang", F.col("whole").alias("phrase")).agg(F.first("a").alias("a"), F.min(F.struct("score", "at", "l", "r")).alias("b"))
    inner = frequent.where("k > 2").select("lang", F.col("n").alias("inside"), F.explode(_inner(words, F.col("k"))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("inside").alias("inside"))
    kept = _joined(best, inner, ["lang", "phrase"], "left", broadcast_rows).where(
        F.col("inside").isNull() | (F.lit(100) * F.col("inside") < F.lit(covered) * F.col("a")))
    kept = kept.select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:         # first within slices of each language, then over what is left of them
        kept = materialise(kept, "phrases-scored").withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order))).where(F.col("rank") <= top).drop("slice")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked.where(F.col("rank") <= top) if top is not None else ranked
    return ranked.join(F.broadcast(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


def _inner(words: Column, k: Column) -> Column:
    """All phrases of two and more words inside a longer one."""
    sizes = F.sequence(F.lit(2), k - 1)
    return F.flatten(F.transform(sizes, lambda m: F.transform(F.sequence(F.lit(1), k - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))


def collocations_sql(longest: int = 3, least: int = 10, top: int = 2000) -> str:
    """DuckDB: the same phrases by counting all of them."""
    return rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({sql_lower("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
 k AS (SELECT unnest(range(1, {longest + 1})) AS k),
 o AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, k WHERE len(w) >= k),
 f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS n FROM o GROUP BY 1, 2, 3),
 t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
 c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= {least}),
 x AS (SELECT lang, k, phrase, n AS a, w, unnest(range(1, k)) AS cut FROM c),
 s AS (SELECT x.lang, x.phrase, a, cut, f1.n AS l, f2.n AS r, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(f1.n AS HUGEINT) * f2.n) AS BIGINT) AS score
       FROM x JOIN f f1 ON f1.lang = x.lang AND f1.phrase = array_to_string(w[1:cut], ' ')
              JOIN f f2 ON f2.lang = x.lang AND f2.phrase = array_to_string(w[cut + 1:], ' ')),
 b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nr FROM s),
 y AS (SELECT lang, n, w, k, unnest(range(2, k)) AS m FROM c WHERE k > 2),
 z AS (SELECT lang, n, w, m, unnest(range(1, k - m + 2)) AS i FROM y),
 u AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(n) AS inside FROM z GROUP BY 1, 2),
 v AS (SELECT b.lang, b.phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
       FROM b LEFT JOIN u ON u.lang = b.lang AND u.phrase = b.phrase WHERE nr = 1 AND (inside IS NULL OR 100 * inside < 50 * a))
SELECT v.lang, rank, v.phrase, a, l, r, n, score FROM v JOIN t USING (lang) WHERE rank <= {top}"""
