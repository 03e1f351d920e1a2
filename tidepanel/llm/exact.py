"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by successive digits of their normalised bytes: first (length, first bytes), then longer and longer
runs of following bytes, until a group has one row or its texts have ended. Rows of an ended group are equal byte for
byte; no digest takes part. A split is one count by (group, digit) with map-side sums, so a group of any number of
copies costs each task one row. Texts are kept only for rows that are still in a group of two or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import BLANKS, small_side, without

OUT = ("keep_id", "group_size", "kept", "text_sha256")


def normalise(text: Column) -> Column:
    """Every run of ASCII white space is one blank; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", first_bytes: int = 32, growth: int = 8,
                 most_bytes: int = 1 << 18, broadcast_rows: int = 500_000, carry: list[str] | None = None) -> DataFrame:
    """Per row: the columns in `carry` (all when None), `keep_id` (the smallest doc_id among equal texts), `group_size`,
    `kept` (one row of the group: the one of the smallest doc_id, the first read of repeated ones) and `text_sha256`.

    Null texts equal empty ones. A null doc_id comes after all others, so it stays only where all are null. Columns of
    the output's names are replaced. An empty table gives an empty result.

    Digits take `first_bytes`, then `growth` times as many each round up to `most_bytes`: the rounds follow the logarithm
    of the longest text that has a twin so far. Tables of groups are broadcast up to `broadcast_rows` rows and
    32 MB of digits, counted first; beyond that they meet the rows in a shuffled join.
    """
    docs = without(docs, *OUT)
    names = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(doc_id).alias("_id"), normalise(F.col(text)).alias("_text"))
    rows = rows.withColumn("_bytes", F.col("_text").cast("binary"))
    digit = [F.length("_bytes").alias("_len"), F.substring("_bytes", 1, first_bytes).alias("_digit")]
    twins = materialise(rows.select(*digit).groupBy("_len", "_digit").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
                        .withColumn("_group", F.monotonically_increasing_id()), "exact-first")
    rows = rows.select("*", *digit).join(small_side(twins.drop("_n"), broadcast_rows), ["_len", "_digit"], "left")
    rows = materialise(rows.select("_row", "_id", F.sha2("_bytes", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("_rid"), "_group",
                                   F.when(F.col("_group").isNotNull(), F.col("_bytes")).alias("_bytes")), "exact-rows")
    live = rows.where("_group IS NOT NULL").select("_rid", "_id", "_group", "_bytes")
    done = []
    at, width = first_bytes, first_bytes * growth
    while True:
        # what a text has left of the current digit; a short one has ended
        cut = live.withColumn("_digit", F.substring("_bytes", F.lit(at + 1), F.lit(width)))
        groups = materialise(cut.groupBy("_group", "_digit").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
                             .withColumn("_next", F.monotonically_increasing_id()), "exact-groups")
        side = small_side(groups.drop("_n"), broadcast_rows, "_digit")
        split = materialise(cut.join(side, ["_group", "_digit"]).select(
            "_rid", "_id", F.col("_next").alias("_group"), (F.length("_bytes") <= at + width).alias("_ended"),
            F.when(F.length("_bytes") > at + width, F.col("_bytes")).alias("_bytes")), "exact-split")
        done.append(split.where("_ended").select("_rid", "_id", F.lit(at).alias("_round"), "_group"))
        live = split.where("NOT _ended").select("_rid", "_id", "_group", "_bytes")
        if live.isEmpty():
            break
        at += width
        width = min(width * growth, most_bytes)
    ended = done[0]
    for d in done[1:]:
        ended = ended.unionByName(d)
    keep = ended.groupBy("_round", "_group").agg(F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_rid"))).alias("_keep"),
                                                 F.count(F.lit(1)).alias("_size"))
    keep = materialise(keep.select("_round", "_group", F.col("_keep._id").alias("_keep_id"), F.col("_keep._rid").alias("_keep_rid"), "_size"), "exact-keep")
    of = ended.select("_rid", "_round", "_group").join(small_side(keep, broadcast_rows), ["_round", "_group"]).drop("_round", "_group")
    of = small_side(materialise(of, "exact-members"), broadcast_rows)
    out = rows.select("_row", "_id", "_rid", "text_sha256").join(of, "_rid", "left")
    return out.select("_row.*", F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep_id")).alias("keep_id"),
                      F.coalesce("_size", F.lit(1).cast("long")).alias("group_size"),
                      F.coalesce(F.col("_rid") == F.col("_keep_rid"), F.lit(True)).alias("kept"), "text_sha256")
