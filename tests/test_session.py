"""The shared folder and tables written once."""

import os

from tidepanel.session import collecting, drop_tables, materialise, shared_root


def test_tables_are_written_once_and_dropped(spark):
    paths: list[str] = []
    with collecting(paths):
        t = materialise(spark.range(3), "x")
    materialise(spark.range(2), "y")
    assert t.count() == 3 and len(paths) == 1
    folder = paths[0].removeprefix("file:")
    assert folder.startswith(shared_root(spark).removeprefix("file:")) and os.path.isdir(folder)
    drop_tables(spark, paths)
    assert not paths and not os.path.exists(folder)
