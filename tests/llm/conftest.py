import random

import pytest

SF = "/root/testdata/sf0.01"
#: Every operator sees these: nulls in each column, empty and blank texts, ties, repeated rows, a very long text, and
#: columns that clash with what operators add or use inside.
EXTRA = "size string, hits string, fingerprint string, Shard string, target string, `_row` string, `_fp` string, rule string, spans string, n_tokens string, lang_pred string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


@pytest.fixture(scope="session")
def messy(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdeéüß") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    same = text(40)
    rows = [(1, same, "en", "b", 1), (2, same, "en", "a", 1), (2, same, "en", "a", 1), (3, None, None, None, None), (None, same, "de", "a", 3),
            (4, "", "en", "a", 0), (5, " \t\n ", "fr", None, 3), (6, text(40_000), "en", "b", 9), (7, same.replace(" ", "  \n"), "en", "b", 1),
            (8, "12345 !!", "de", "a", 8), (9, "Ab", "de", "c", 2), (None, None, None, None, None)]
    rows += [(10 + i, text(rnd.randint(1, 80)), rnd.choice(["en", "de", None]), rnd.choice("abc"), i) for i in range(40)]
    return spark.createDataFrame([r + ("x",) * 11 for r in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
