"""Running states along a key, in parallel inside the key.

A row of a three-state rule is a map from the state before it to the state after it, and such maps compose. Rows are dealt
by ranges of (key, order), so a hot key is spread over as many tasks as its rows need; each task composes the maps of its
own rows, a short list of one row a task gives each task the state it starts from, and every row looks its state up in
its map. Work is linear in the rows (times the log of a batch), and no task or array holds a key's history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise

STATES = (-1, 0, 1)


def _digits(code: np.ndarray) -> np.ndarray:
    """Places (0, 1, 2) that the map `code` sends the states -1, 0, 1 to."""
    return np.stack([code // 9, code // 3 % 3, code % 3], -1)


_ALL = _digits(np.arange(27))
#: _AFTER[g, f]: first f, then g. _FROM_ZERO[f]: f after a return to state 0.
_AFTER = (_ALL[:, _ALL] @ np.array([9, 3, 1])).astype(np.uint8)
_FROM_ZERO = (_ALL[:, 1] * 13).astype(np.uint8)


def compose(codes: np.ndarray) -> np.ndarray:
    """Each place's map composed with all before it."""
    out, d = codes.copy(), 1
    while d < len(out):
        out[d:] = _AFTER[out[d:], out[:-d]]
        d *= 2
    return out


def scan_states(rows: DataFrame, key: Sequence[str], order: Sequence[str], rule: Callable[[Column], Column], step: str | None = None) -> DataFrame:
    """`rows` with an int column `state`, which starts at 0 for each key and follows `rule` (state before -> state after,
    both of -1, 0, 1, from the row's own columns) in the order of `order`, which must tell a key's rows apart.

    With `step`, a whole number that counts rows, a gap in it brings the state back to 0 before the row. Null keys are a
    key; an empty table stays empty."""
    names = [c for c in rows.columns if c != "state"]
    moved = sum(((rule(F.lit(s)).cast("int") + 1) * w for s, w in zip(STATES, (9, 3, 1))), F.lit(0)).cast("tinyint")
    dealt = rows.select(*names, moved.alias("_m")).repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    dealt = dealt.withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*dealt.schema.fields, T.StructField("_seq", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, last, seq = None, None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            fresh = np.zeros(n, bool)
            for k in key:
                ids = pc.dictionary_encode(b.column(k), null_encoding="encode").indices.to_numpy()
                fresh[1:] |= ids[1:] != ids[:-1]
            if step:
                at = b.column(step).to_numpy(zero_copy_only=False)
                fresh[1:] |= at[1:] != at[:-1] + 1
            ends = [([b.column(k)[i].as_py() for k in key], b.column(step)[i].as_py() if step else None) for i in (0, n - 1)]
            if last is not None:
                fresh[0] = last[0] != ends[0][0] or (step is not None and ends[0][1] != last[1] + 1)
            codes = b.column("_m").to_numpy().astype(np.uint8)
            codes[fresh] = _FROM_ZERO[codes[fresh]]
            out = compose(codes)
            if carry is not None:
                out = _AFTER[out, carry]
            carry, last = out[-1], ends[1]
            cols = [pa.array(out.astype(np.int8)) if f.name == "_m" else b.column(f.name) for f in b.schema]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(seq, seq + n))], [*b.schema.names, "_seq"])
            seq += n

    got = materialise(dealt.mapInArrow(run, schema), "states")
    place = F.struct(*[F.col(c) for c in key], F.col(step).alias("_step") if step else F.lit(0).alias("_step"))
    parts = got.groupBy("_part").agg(F.min_by(place, "_seq").alias("first"), F.max_by(place, "_seq").alias("last"), F.max_by("_m", "_seq").alias("m"))
    starts, state, before = [], 0, None
    for p in sorted(parts.collect(), key=lambda r: r["_part"]):      # one short row a task
        goes_on = before is not None and list(before)[:-1] == list(p["first"])[:-1] and (step is None or p["first"]["_step"] == before["_step"] + 1)
        start = state if goes_on else 0
        starts.append((p["_part"], start))
        state, before = int(_ALL[p["m"]][start + 1]) - 1, p["last"]
    found = rows.sparkSession.createDataFrame(starts, "_part int, _start int")
    place_of = F.when(F.col("_start") == -1, F.floor(F.col("_m") / 9)).when(F.col("_start") == 0, F.floor(F.col("_m") / 3) % 3).otherwise(F.col("_m") % 3)
    return got.join(F.broadcast(found), "_part").select(*names, (place_of - 1).cast("int").alias("state"))
