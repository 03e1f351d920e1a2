"""Each operator and each stage on the messy table, on an empty one, and twice for the same result."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidepanel.llm.decontaminate import decontaminate, find_benchmark_words
from tidepanel.llm.exact import exact_groups
from tidepanel.llm.language import identify, keep_identified
from tidepanel.llm.licences import scan_licences
from tidepanel.llm.maxent import Shape, fit_and_score
from tidepanel.llm.mixing import mix, plan_mix
from tidepanel.llm.pii import find_personal_data
from tidepanel.llm.sharding import kd_shards
from tidepanel.llm.simhash import drop_near_duplicates, near_duplicates
from tidepanel.llm.urls import judge_urls

BENCH = "item_id long, text string"


def bench(spark):
    return spark.createDataFrame([(1, None), (None, "ab"), (2, ""), (3, "Ab")], BENCH)


OPERATORS = {
    "decontaminate": lambda s, d: find_benchmark_words(d, bench(s)), "mix": lambda s, d: plan_mix(d), "language": lambda s, d: identify(d),
    "urls": lambda s, d: judge_urls(d, url="text"), "simhash": lambda s, d: near_duplicates(d), "exact": lambda s, d: exact_groups(d),
    "pii": lambda s, d: find_personal_data(d), "maxent": lambda s, d: fit_and_score(d, Shape(classes=4, width=5, class_bits=8, word_bits=8, dictionary=40)),
    "licences": lambda s, d: scan_licences(d), "shards": lambda s, d: kd_shards(d, shards=3),
}
STAGES = {"language": keep_identified, "simhash": drop_near_duplicates, "mix": mix,
          "decontaminate": lambda d: decontaminate(d, bench(d.sparkSession))}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, messy, none, name):
    out = OPERATORS[name](spark, messy)
    assert out.count() == messy.count()
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert {"doc_id", "source"} <= set(out.columns)
    assert OPERATORS[name](spark, none).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_the_columns(messy, none, name):
    out = STAGES[name](messy)
    assert out.columns == messy.columns
    assert 0 < out.count() <= 3 * messy.count()
    assert STAGES[name](none).count() == 0


def test_pipeline_runs_through(spark, tmp_path, messy):
    messy.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(out) and set(out["shard"]) <= set(range(8))
    assert not ({3, 4, 5, 8} & set(out["doc_id"].dropna().astype(int)))      # no letter: the first stage drops them
    assert not ({9} & set(out["doc_id"].dropna().astype(int)))               # the whole text is a benchmark item


def test_pipeline_on_an_empty_table(spark, tmp_path, none):
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_results_do_not_change_between_runs(spark, messy):
    for name in ("mix", "shards", "maxent", "language"):
        cols = {"mix": ["taken"], "shards": ["shard"], "maxent": ["score"], "language": ["score"]}[name]
        rows = [sorted(map(str, OPERATORS[name](spark, messy.where("doc_id IS NOT NULL").coalesce(1)).select("doc_id", *cols).collect())) for _ in range(2)]
        assert rows[0] == rows[1], name


def test_copies_and_nulls_meet(messy):
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_groups(messy).where("group_size > 2").select("doc_id", "keep_id", "group_size").collect()}
    assert {(1, 1, 5), (2, 1, 5), (None, 1, 5), (7, 1, 5)} <= got
    assert exact_groups(messy).where("kept").count() == messy.select(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")).distinct().count()
    assert drop_near_duplicates(messy).where("doc_id IN (1, 2, 7)").count() == 1
