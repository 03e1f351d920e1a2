"""The registered queries: SQL where there is some, whole rows, and the keys that the driver reads."""

import pytest

from tidepanel.llm.queries import ORACLES, QUERIES
SF = "/root/testdata/sf0.01"
from tools.check_oracle import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_agrees(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF)[3] == "ok"


def test_each_operator_has_one_query():
    import corpus_pipeline  # noqa: F401
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14)) and "pipeline" in QUERIES
