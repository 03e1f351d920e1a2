"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. The whole part of target / source size is allocated to every document for
certain; the rest is the source's inclusion rate r. A document's inclusion odds are r / (1 - r) times its own weight
(by default words / (words + 200): short pieces are drawn less often). The sample takes documents by ascending
q = (u / (1 - u)) / inclusion odds, u a hash of the row, until the words that the certain copies leave of the target
are reached: its size in words is fixed, within half the document at the cut. Repeated rows share q; of those at the cut
as many are taken as the target allows.

The cut is found without sorting a source: rows are counted by source and slice of q / (1 + q), a window over slices
finds the slice that holds the cut, and only that slice's rows are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import WORDS, small_side, without

OUT = ("size", "source_size", "target", "taken", "copies")
_TWO52 = float(1 << 52)


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1), the same in every run, from the first 13 hex digits of an MD5."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / _TWO52


def source_targets(sizes: DataFrame, weights=(1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size) -> with `target`: shares by weight of the total, none above `most` times the source's size,
    the excess shared again by weight. One row per source; sources take the weights in order of code points, null last.

    The capped sources are the first ones by size over weight, so one running sum over the sources finds the level.
    """
    by_name, by_cap, all_rows = (Window.orderBy(F.col("source").isNull(), "source"),
                                 Window.orderBy("_ratio", F.col("source").isNull(), "source"), Window.partitionBy())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("_w", w).withColumn("_ratio", F.col("source_size") / F.col("_w"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("_left", F.sum("source_size").over(all_rows) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
         .withColumn("_wleft", F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    # the quotient rises while sources are capped and falls after the last capped one: its maximum is the level
    s = s.withColumn("_level", F.max(F.col("_left") / F.col("_wleft")).over(all_rows))
    cap = F.lit(most) * F.col("source_size")
    return s.withColumn("target", F.least(cap, F.col("_level") * F.col("_w"))).select(
        "source", "source_size", "target")


def length_weight(size: Column) -> Column:
    return size / (size + F.lit(200.0))


def _last_rows(drawn: DataFrame, cuts: DataFrame) -> DataFrame:
    """(source, _upto): where only `_fit` rows of the tie at a cut are taken, the number of the last of them.

    Row numbers hold the task that wrote a row, so the tie is counted by task and only one task's share is put in order."""
    tied = drawn.join(cuts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_q") == F.col("_cut")) & (F.col("size") == F.col("_cut_size")))
    tied = tied.select("source", "_rid", F.shiftrightunsigned("_rid", 33).alias("_task"), "_fit")
    along = Window.partitionBy("source").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shares = (tied.groupBy("source", "_task").agg(F.count(F.lit(1)).alias("_held"), F.first("_fit").alias("_fit"))
              .withColumn("_need", F.col("_fit") - F.coalesce(F.sum("_held").over(along), F.lit(0))))
    shares = shares.where("_need > 0 AND _need <= _held").select(F.col("source").alias("_s"), F.col("_task").alias("_t"), "_need")
    at = tied.join(shares, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_task") == F.col("_t")))
    place = F.row_number().over(Window.partitionBy("source").orderBy("_rid"))
    return at.withColumn("_place", place).where("_place = _need").select("source", F.col("_rid").alias("_upto"))


def plan_mix(docs: DataFrame, weights=(1, 2, 3), most: float = 3.0, weight=length_weight, text: str = "text", slice_rows: int = 50_000,
             max_sources: int = 100_000, carry: list[str] | None = None) -> DataFrame:
    """Per row of `docs`: the columns in `carry` (all when None), `size` (words of the text, null 0), `source_size`,
    `target` (of its source), `copies` (whole times the row is taken) and `taken` (copies x size).

    Rows of no words are never taken beyond the certain copies. Rows equal in doc_id and text are interchangeable: any of
    them make up the share that the target allows. An empty table gives an empty plan. Columns of the
    output's names are replaced. What is written once is the carried columns and two numbers.

    The slices follow the row count (`slice_rows` rows each on average), so the rows put in order at a cut stay few.
    The table of sources is broadcast up to `max_sources` rows, beyond that joined by a shuffle.
    """
    docs = without(docs, *OUT, "_u", "_row", "_rid")
    names = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("source"),
                       F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS)).cast("long").alias("size"),
                       unit_hash(F.col("doc_id"), F.md5(F.coalesce(F.col(text), F.lit("")))).alias("_u"),
                       F.monotonically_increasing_id().alias("_rid"))
    rows = materialise(rows, "mix-rows")
    sizes = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n")), "mix-sizes")
    n = sizes.agg(F.sum("_n")).first()[0] or 0
    slices = max(16, -(-n // slice_rows))
    plan = source_targets(sizes.select("source", "source_size"), weights, most)
    plan = materialise(plan.withColumn("_e", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
                       .withColumn("_whole", F.floor("_e")).withColumn("_p", F.col("_e") - F.col("_whole"))
                       .withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size")), "mix-plan")
    plan = small_side(plan, max_sources).withColumnRenamed("source", "_source")
    on = F.col("source").eqNullSafe(F.col("_source"))
    rows = rows.join(plan, on).drop("_source").withColumn(
        "_q", F.when((F.col("_p") > 0) & (F.col("size") > 0),
                     (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")) * weight(F.col("size")))))
    slice_ = F.floor(F.col("_q") / (1 + F.col("_q")) * slices)
    drawn = rows.where("_q IS NOT NULL").withColumn("_slice", slice_)
    along = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    hist = (drawn.groupBy("source", "_slice").agg(F.sum("size").alias("_words"), F.first("_rest").alias("_rest"))
            .withColumn("_before", F.coalesce(F.sum("_words").over(along), F.lit(0))))
    at = (hist.where((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("_words") >= F.col("_rest")))
          .select(F.col("source").alias("_source"), F.col("_slice").alias("_at"), "_before"))
    at = small_side(materialise(at, "mix-slices"), max_sources)
    inside = drawn.join(at, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slice") == F.col("_at")))
    # rows of one doc_id and text share q: they are counted together, so a hot group is one row here
    ties = inside.groupBy("source", "_q", "size").agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in ("_before", "_rest", "_at")])
    order = Window.partitionBy("source").orderBy("_q", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_before") + F.coalesce(F.sum(F.col("_n") * F.col("size")).over(order), F.lit(0))
    # the row at the cut is taken when that ends nearer to the target than leaving it
    fit = F.least(F.floor((F.col("_rest") - ahead) / F.col("size") + 0.5), F.col("_n"))
    # where not even the slice's first row fits, the slices before it are all that is taken
    cuts = (ties.withColumn("_fit", fit).groupBy("source")
            .agg(F.max(F.when(F.col("_fit") > 0, F.struct("_q", "size", "_fit", "_n"))).alias("_c"), F.min("_at").alias("_last")))
    cuts = materialise(cuts.select(F.col("source").alias("_source"), F.col("_c._q").alias("_cut"), F.col("_c.size").alias("_cut_size"),
                                   F.col("_c._fit").alias("_fit"), F.col("_c._n").alias("_n"), "_last"), "mix-cuts")
    last = _last_rows(drawn, small_side(cuts.where("_fit < _n"), max_sources))
    cuts = cuts.join(last, cuts["_source"].eqNullSafe(last["source"]), "left").drop("source")
    cuts = small_side(materialise(cuts, "mix-last"), max_sources).drop("_fit", "_n")
    rows = rows.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left")
    here = F.struct("_q", "size")
    cut = F.struct(F.col("_cut").alias("_q"), F.col("_cut_size").alias("size"))
    drawn_too = (slice_ < F.col("_last")) | ((slice_ == F.col("_last")) & (
        (here < cut) | ((here == cut) & (F.col("_upto").isNull() | (F.col("_rid") <= F.col("_upto"))))))
    copies = F.col("_whole") + F.coalesce(drawn_too, F.lit(False)).cast("long")
    return rows.select("_row.*", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, weights=(1, 2, 3), most: float = 3.0) -> DataFrame:
    """The mixed table: each row of `docs` as many times as it is taken, with its own columns."""
    names = docs.columns
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_whole_row"), "doc_id", "source", "text")
    plan = plan_mix(tagged, weights, most, carry=["_whole_row"])
    return plan.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_whole_row.*")
