"""Sharding by a k-d tree over document metadata.

A node with several shards to fill is split along its widest dimension (its range over the root's) at the weighted
median: the place where the bytes of its first half of shards end. All nodes of a level are split at once. The median
is found by radix selection over an ordered key of four numbers (dimension, checksum of the text, document id, a hash):
one count of bytes by node and slice picks the slice, until few rows are left in it; those are put in order. Equal texts
have equal coordinates and stay together, but for the group that lies at a cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import small_side, without

OUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
_SLICES = 1024


def _number(x: Column, bits: int) -> Column:
    """The first bytes of a string as a whole number in the order of code points; null last."""
    n = bits // 8
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(x.cast("binary"), 1, n)), 2 * n, "0"), 16, 10).cast("long"), F.lit((1 << bits) - 1))


def _cut_nodes(rows: DataFrame, nodes: list[dict], few: int) -> dict[int, list[int]]:
    """For each node of one level, the key (dimension, crc, id, hash) below which its first shards' bytes lie.

    The driver holds a few numbers for each node, of which there are fewer than shards."""
    keys = ("_k", "_crc", "_idn", "_h")
    pick = rows.where(F.col("_node").isin([n["node"] for n in nodes])).withColumn(
        "_k", F.coalesce(*[F.when(F.col("_node") == n["node"], F.col(f"_d{n['dim']}")) for n in nodes]))
    state = {n["node"]: {"low": [None] * 4, "high": [None] * 4, "part": 0, "before": 0, "want": n["want"], "rows": None} for n in nodes}
    live = set(state)
    while live:
        todo = [n for n in nodes if n["node"] in live]
        where = F.lit(False)
        for n in todo:
            s = state[n["node"]]
            c = F.col("_node") == n["node"]
            for i in range(s["part"] + 1):
                if s["low"][i] is not None:
                    c = c & F.col(keys[i]).between(s["low"][i], s["high"][i])
            where = where | c
        part = F.coalesce(*[F.when(F.col("_node") == n["node"], F.col(keys[state[n["node"]]["part"]])) for n in todo])
        cand = pick.where(where).withColumn("_v", part)
        unknown = [n["node"] for n in todo if state[n["node"]]["low"][state[n["node"]]["part"]] is None]
        if unknown:
            for r in cand.where(F.col("_node").isin(unknown)).groupBy("_node").agg(F.min("_v"), F.max("_v")).collect():
                state[r[0]]["low"][state[r[0]]["part"]], state[r[0]]["high"][state[r[0]]["part"]] = r[1], r[2]
        low = F.coalesce(*[F.when(F.col("_node") == n["node"], F.lit(state[n["node"]]["low"][state[n["node"]]["part"]])) for n in todo])
        step = {n["node"]: (state[n["node"]]["high"][state[n["node"]]["part"]] - state[n["node"]]["low"][state[n["node"]]["part"]]) // _SLICES + 1 for n in todo}
        width = F.coalesce(*[F.when(F.col("_node") == n["node"], F.lit(step[n["node"]])) for n in todo])
        bins: dict[int, list] = {n["node"]: [] for n in todo}
        off = F.col("_v") - low
        counted = cand.withColumn("_bin", F.round((off - F.pmod(off, width)) / width).cast("long")).groupBy("_node", "_bin")
        for r in counted.agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).collect():
            bins[r["_node"]].append((r["_bin"], r["w"], r["n"]))
        for n in todo:
            s, p = state[n["node"]], state[n["node"]]["part"]
            for b, w, c in sorted(bins[n["node"]]):
                if s["before"] + w >= s["want"]:
                    break
                s["before"] += w
            lo = s["low"][p] + b * step[n["node"]]
            s["low"][p], s["high"][p], s["rows"] = lo, min(s["high"][p], lo + step[n["node"]] - 1), c
            if s["low"][p] == s["high"][p]:
                s["part"] += 1
            if c <= few or s["part"] == 4:
                live.discard(n["node"])
    where = F.lit(False)
    for n in nodes:
        s = state[n["node"]]
        c = F.col("_node") == n["node"]
        for i in range(4):
            if s["low"][i] is not None:
                c = c & F.col(keys[i]).between(s["low"][i], s["high"][i])
        where = where | c
    before = F.coalesce(*[F.when(F.col("_node") == n["node"], F.lit(state[n["node"]]["before"])) for n in nodes])
    want = F.coalesce(*[F.when(F.col("_node") == n["node"], F.lit(state[n["node"]]["want"])) for n in nodes])
    along = Window.partitionBy("_node").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    last = (pick.where(where).withColumn("_upto", before + F.sum("size").over(along))
            .where(F.col("_upto") - F.col("size") / 2 <= want).groupBy("_node").agg(F.max(F.struct(*keys)).alias("k")))
    got = {r["_node"]: list(r["k"]) for r in last.collect()}
    # where not even the first of the last rows belongs below the cut, the cut lies just before the rows in order
    return {n["node"]: got.get(n["node"]) or [state[n["node"]]["low"][i] if state[n["node"]]["low"][i] is not None else -(1 << 63) for i in range(3)] + [-(1 << 63)] for n in nodes}


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, text: str = "text", doc_id: str = "doc_id",
              carry: list[str] | None = None, few: int = 50_000) -> DataFrame:
    """Per row: the columns in `carry` (all when None), `size` (UTF-8 bytes of the text, null none, plus 1),
    `text_crc32` (of the text's bytes, null as none), `law` = 'bytes', `shard`, `slot` (0.. without gaps in a shard) and
    `grown_shard` (null: under this law a further shard moves rows between the others).

    Give the number of shards, or `target_bytes` for a leaf; the tree then has total / target leaves. The dimensions are
    the logarithm of the size, the language and the share of characters outside ASCII, all functions of text and
    metadata, so copies meet in one shard where a cut does not part them. Null metadata sorts last, repeated rows are
    placed one by one, an empty table gives an empty result; columns of the output's names are replaced.
    """
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either the number of shards or the bytes of a shard")
    docs = without(docs, *OUT)
    names = docs.columns if carry is None else carry
    octets = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), (octets + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        _number(F.col("lang"), 32).alias("_d0"), F.floor(F.log2(octets + 1) * 1024).alias("_d1"),
        F.floor(F.coalesce((octets - F.length(text)) / F.nullif(octets, F.lit(0)), F.lit(0.0)) * 4096).cast("long").alias("_d2"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 62))).alias("_idn"), F.monotonically_increasing_id().alias("_h"))
    rows = materialise(rows.withColumn("_crc", F.col("text_crc32")), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if shards is None:
        shards = max(1, -(-total // target_bytes))
    dims = 3
    root: list[int] | None = None
    tree = {0: shards}                                   # first shard of each open node -> its number of shards
    # what is written is read by key columns only; a level adds an expression, so rows are not written again
    at = rows.withColumn("_node", F.lit(0))
    while total and max(tree.values()) > 1:
        spans = at.groupBy("_node").agg(F.sum("size").alias("w"), *[F.max(f"_d{i}") - F.min(f"_d{i}") for i in range(dims)]).collect()
        if root is None:
            root = [max(1, x) for x in spans[0][2:]]
        todo = [{"node": r["_node"], "want": r["w"] * (tree[r["_node"]] // 2) / tree[r["_node"]],
                 "dim": max(range(dims), key=lambda i: r[2 + i] / root[i])} for r in spans if tree[r["_node"]] > 1]
        if not todo:
            break
        cuts = _cut_nodes(at, todo, few)
        right = F.lit(0)
        for n in todo:
            c = cuts[n["node"]]
            k = F.struct(F.col(f"_d{n['dim']}").alias("a"), F.col("_crc").alias("b"), F.col("_idn").alias("c"), F.col("_h").alias("d"))
            cut = F.struct(*[F.lit(x).cast("long").alias(a) for x, a in zip(c, "abcd")])
            right = F.when((F.col("_node") == n["node"]) & (k > cut), F.lit(tree[n["node"]] // 2)).otherwise(right)
        tree = {k: v for n, m in tree.items() for k, v in ([(n, m)] if m == 1 else [(n, m // 2), (n + m // 2, m - m // 2)])}
        at = at.withColumn("_node", (F.col("_node") + right).cast("int"))
    rows = at.withColumnRenamed("_node", "_shard")
    return number_slots(rows.select("_row", "size", "text_crc32", "_shard", "_crc", "_idn", "_h"), ["_crc", "_idn", "_h"]).select(
        "_row.*", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("_shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def number_slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds `slot`: 0, 1, .. within each `_shard`, without a window over a shard. Rows are ranged by (shard, order) and
    written with their place in the partition; the counts of earlier partitions give the offsets."""
    cols = ["_shard", *order]
    ranged = rows.repartitionByRange(*cols).sortWithinPartitions(*cols)
    ranged = materialise(ranged.withColumn("_part", F.spark_partition_id()).withColumn(
        "_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "shard-slots")
    parts = ranged.groupBy("_shard", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    parts = small_side(materialise(parts, "shard-parts"), 1_000_000)
    return ranged.join(parts, ["_shard", "_part"]).withColumn("slot", F.col("_at") + F.col("_offset")).drop("_part", "_at", "_offset")
