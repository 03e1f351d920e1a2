import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidepanel.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", master="local[4]", shuffle_partitions=4, extra={"spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def toy(spark):
    """A random-walk panel of 12 symbols x 160 days with a hole, a late listing and volumes."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(5)
    days = pd.bdate_range("2020-01-01", periods=160)
    x = 50 * np.exp(np.cumsum(rng.normal(0, 0.02, (160, 12)), axis=0))
    x[40:47, 3] = np.nan
    x[:90, 7] = np.nan
    rows = [(d.date(), f"S{j:02d}", float(x[i, j]), float(rng.integers(100, 1000)), i)
            for i, d in enumerate(days) for j in range(12) if x[i, j] == x[i, j]]
    df = spark.createDataFrame(rows, "date date, symbol string, adj_close double, volume double, t int")
    wide = pd.DataFrame(x, columns=[f"S{j:02d}" for j in range(12)])
    return df.cache(), wide
