"""The store of keys written once."""

from pyspark.sql import functions as F

from tidepanel.streaming import bars as S


def test_replays_and_repeats_leave_one_row_and_touch_their_own_buckets(spark, tmp_path):
    path = str(tmp_path / "keys")
    write = S.idempotent_sink(path, "k", buckets=8)
    batch = lambda *ks: spark.createDataFrame([(k, k * 10) for k in ks], "k long, v long")
    write(batch(*range(40), 3, 3), 0)
    write(batch(5, 6, 100), 1)
    write(batch(5, 6, 100), 1)          # the same batch once more
    write(batch(*range(40)), 0)         # and an older one
    write(batch(100, 101), 2)
    write(batch(7), 3)                  # nothing new
    kept = spark.read.parquet(path)
    assert sorted(r["k"] for r in kept.collect()) == [*range(40), 100, 101]
    assert kept.where("k = 100").first()["epoch"] == 1
    home = kept.where("k = 100").first()["bucket"]
    seen = S.stored_keys(spark, path, "k", [home])
    assert all(f"/bucket={home}/" in f for f in seen.inputFiles())
    assert seen.count() == kept.where(F.col("bucket") == home).count() < 42
    assert S.stored_keys(spark, path, "k", [8]) is None
