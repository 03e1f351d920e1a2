"""The stateful signal as a stream of several files against a plain walk; no group holds more than a slice of time."""

import random

from pyspark.sql import functions as F

from tidepanel.operators.factors import FactorConfig
from tidepanel.streaming import bars as S

CFG = FactorConfig()
START = 1_700_000_000_000_000


def walk(rows, mark):
    """(symbol, t, id) to state, in order of time and id; rows beyond the watermark are not out yet."""
    got, state = {}, {}
    for symbol, t, i, s in sorted(rows, key=lambda r: (r[1], r[2])):
        if t > mark:
            continue
        was = state.get(symbol, 0)
        if s is None:
            now = 0
        elif was == 0:
            now = 1 if s < -CFG.s_open else -1 if s > CFG.s_open else 0
        else:
            now = 0 if (was == 1 and s > -CFG.s_close_long) or (was == -1 and s < CFG.s_close_short) else was
        got[symbol, t, i] = state[symbol] = now
    return got


def test_signal_of_several_files_and_slices(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(rnd.choice(["A", "A", "A", "B", None]), START + rnd.randrange(400_000_000), i, rnd.choice([None, rnd.uniform(-2, 2), rnd.uniform(-2, 2)]))
            for i in range(3000)]
    last = START + 400_000_500
    mark = (last // 1000 - 60_000) * 1000
    rows += [("A", mark + d, 5000 + d, 1.5) for d in (-1500, -1000, -999, -1, 0, 1, 999)] + [("C", mark, 6000, -2.0), ("A", last, 7000, 0.1)]
    rows.sort(key=lambda r: r[1] + (rnd.randrange(30_000_000) if r[2] != 7000 else 10 ** 9))      # out of order by up to 30 s
    schema = "symbol string, us long, event_id long, s double"
    for k in range(4):
        part = rows[k * len(rows) // 4:(k + 1) * len(rows) // 4]
        spark.createDataFrame(part, schema).select("symbol", F.timestamp_micros("us").alias("ts"), "event_id", "s").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("symbol string, ts timestamp, event_id long, s double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    coded = S.run_to_table(S.hysteresis_stream(stream, CFG, "60 seconds", 60), "signal", f"{tmp_path}/run")
    got = {(r["symbol"], r["t"], r["event_id"]): r["state"] for r in S.slice_states(coded).collect()}
    want = walk(rows, mark)
    assert coded.count() == len(want) and got == want
    # what waits is what lies beyond the watermark; slices behind it have left the state
    held = spark.read.format("statestore").load(f"{tmp_path}/run/signal/state").select(
        F.col("key.slice").alias("slice"), F.octet_length("value.groupState.held").alias("bytes")).collect()
    assert all((r["slice"] + 1) * 60_000_000 > mark for r in held)
    assert sum(r["bytes"] for r in held) == 24 * (len(rows) - len(want))
