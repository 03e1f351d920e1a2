"""Rows behind the watermark are counted by run, to the row."""

import datetime as dt

from tidepanel.streaming import bars as S


def test_dropped_rows_by_run(spark, tmp_path):
    day = lambda d, n, start: [(start + i, dt.datetime(2024, 1, d, 1, 0, i), 1, "ab"[i % 2], float(i), None) for i in range(n)]
    # the third run is half late: its first day is closed, its last is not
    runs = [day(5, 6, 0) + day(6, 4, 10), day(2, 7, 20), day(3, 3, 30) + day(6, 5, 40)]
    for n, rows in enumerate(runs, 1):
        spark.createDataFrame(rows, S.EVENT_SCHEMA).write.parquet(f"{tmp_path}/in/part={n}")
        progress = []
        out = S.run_to_table(S.event_bars(S.read_events(spark, f"{tmp_path}/in/part=*")), "bars", str(tmp_path), progress=progress)
        counts = S.run_counts(spark, "bars", str(tmp_path), progress, out)
    got = [tuple(r) for r in counts.select("run", "input_rows", "dropped_rows").orderBy("run").collect()]
    assert got == [(1, 10, 0), (2, 7, 7), (3, 8, 3)]
    assert all(r["dropped_groups"] <= r["dropped_rows"] for r in counts.collect())
