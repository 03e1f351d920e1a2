"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts and items are reduced to lower-case words with one blank around each, as UTF-8 bytes. A pattern is a window of
consecutive item words with its outer blanks, so a byte match is a match of whole words. Patterns are grouped by
length; each group has a shift table over hashed blocks of bytes: a block that ends no pattern's head lets the search
jump ahead. Where the shift is zero, the bucket of the block's hash names the patterns, and bytes are compared.
The search runs over many places of a batch at once, in numpy.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import beside_text, map_text, with_text, without

#: Bytes that are words: digits, letters and everything outside ASCII; capitals fold, all else is a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LANE = 4096
FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType()))])


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class _Group:
    """Patterns of lengths within a factor of two: shift table, buckets by block hash, and the patterns."""

    def __init__(self, patterns: list[bytes]):
        self.m = m = min(map(len, patterns))
        self.block = b = 8 if m >= 16 else 4 if m >= 8 else 2
        self.drop = np.uint64(8 * (8 - b))
        heads = sorted({p[:m] for p in patterns})
        ends = np.frombuffer(b"".join(heads), np.uint8).reshape(len(heads), m)
        self.bits = max(10, min(24, int(len(heads) * 4).bit_length() + 3))
        self.shift = np.full(1 << self.bits, m - b + 1, np.int32)
        for q in range(b, m + 1):
            v = np.zeros(len(heads), np.uint64)
            for i in range(b):
                v |= ends[:, q - b + i].astype(np.uint64) << np.uint64(8 * i)
            h = self._hash(v)
            self.shift[h] = np.minimum(self.shift[h], m - q)
        buckets: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            buckets[p[m - b:m]].append(p)
        self.buckets = dict(buckets)

    def _hash(self, v: np.ndarray) -> np.ndarray:
        return ((v * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, buf: bytes) -> list[tuple[int, bytes]]:
        """(start, pattern) of every occurrence in `buf`, which begins with eight padding bytes."""
        n = len(buf)
        if n < self.m:
            return []
        loads = np.ndarray((n - 7,), "<u8", buf, strides=(1,))
        at = np.arange(max(8, self.m), n + 1, _LANE, dtype=np.int64)      # ends of the first block of each lane
        stop = np.minimum(at + _LANE, n + 1)
        found = []
        while len(at):
            jump = self.shift[self._hash(loads[at - 8] >> self.drop)]
            hit = jump == 0
            if hit.any():
                for e in at[hit].tolist():
                    s = e - self.m
                    for p in self.buckets.get(buf[e - self.block:e], ()):
                        if buf.startswith(p, s):
                            found.append((s, p))
                jump = np.maximum(jump, 1)
            at = at + jump
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        return found


class Patterns:
    """The windows of a block of items, as search groups."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        owners: dict[bytes, set[str]] = defaultdict(set)
        for name, text in items:
            ws = words_of(text)
            for i in range(max(1, len(ws) - window + 1) if ws else 0):
                owners[b" " + b" ".join(ws[i:i + window]) + b" "].add(name)
        self.owners = owners
        by_size: dict[int, list[bytes]] = defaultdict(list)
        for p in owners:
            by_size[len(p).bit_length()].append(p)
        self.groups = [_Group(ps) for _, ps in sorted(by_size.items())]

    def scan(self, texts: list[bytes | None]) -> dict[str, list]:
        normal = [b" ".join(words_of(t)) for t in texts]
        n_words = [t.count(b" ") + 1 if t else 0 for t in normal]
        buf = b"\0" * 8 + b"".join(b" " + t + b" \0" for t in normal)
        first = np.cumsum([8] + [len(t) + 3 for t in normal])
        hits: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for g in self.groups:
            for s, p in g.search(buf):
                hits[int(np.searchsorted(first, s, "right")) - 1].append((s, p))
        ranges: list[list] = [[] for _ in texts]
        items: list[list] = [[] for _ in texts]
        for d, found in hits.items():
            blanks = np.flatnonzero(np.frombuffer(buf, np.uint8, len(normal[d]) + 1, int(first[d])) == 32)
            merged: list[list[int]] = []
            for s, p in sorted(found):
                a = int(np.searchsorted(blanks, s - int(first[d])))
                b = a + p.count(b" ") - 1
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            ranges[d] = [{"start": a, "end": b} for a, b in merged]
            items[d] = sorted(set().union(*(self.owners[p] for _, p in found)))
        return {"n_words": n_words, "hits": ranges, "items": items}


def find_benchmark_words(docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", keep_text: bool = True,
                         item_id: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """Adds to every row of `docs`: `n_words`, `hits` (word ranges, end exclusive, that lie in occurrences of item
    windows), `n_hit` (words in them) and `items` (ids of the items that occur, as sorted strings).

    A window is `window` consecutive words; an item of fewer words is one window, an item without words none. A null
    text has no words, a null item id counts as ''. Repeated rows are judged alike, one output row each; item rows of
    one id count as one item; an empty benchmark finds nothing. Columns of the output's names are replaced.

    Items go to the tasks in blocks of about `block_bytes` of text, measured first, so what is broadcast is bounded;
    with one block the job is a single pass without a shuffle, with more each block is one more pass.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("_item"), F.col(item_text).alias("_text")).where("_text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks))
    out = without(docs, "hits", "items", "n_words", "n_hit")
    for k in range(blocks):
        own = spark.sparkContext.broadcast([(r[0], r[1].encode()) for r in items.where(block == k).collect()])

        def work(own=own):
            return Patterns(own.value, window).scan

        last = k == blocks - 1
        if k:
            out = out.withColumnsRenamed({"hits": "_hits", "items": "_items"})
        out = map_text(out, FIELDS, work, text, keep_text or not last)
        if k:
            out = (out.withColumn("hits", _merge(F.concat("_hits", "hits")))
                   .withColumn("items", F.array_sort(F.array_union("_items", "items"))).drop("_hits", "_items"))
        if not last:
            out = materialise(out, "decontaminate")
    return out.withColumn("n_hit", F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]))


def _merge(ranges):
    """Overlapping word ranges joined."""
    kind = "array<struct<start:bigint,end:bigint>>"
    return F.aggregate(F.array_sort(ranges), F.array().cast(kind), lambda acc, r: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= r["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], r["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(r))))


def contaminated(one_in: int = 20):
    """True where item windows cover at least one word in `one_in`."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, one_in: int = 20) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    names = docs.columns
    # the found columns get names of their own here: the documents' columns stay whatever they are called
    kept = find_benchmark_words(docs.select(beside_text(docs), "text"), benchmark, window).where(~contaminated(one_in))
    return kept.select(*with_text(names))
