"""Hints of two words, whatever stands between them."""

import pytest

from tidepanel.llm.licences import scan_licences


@pytest.mark.parametrize("text, want", [("All rights\treserved", "arr"), ("All rights  reserved.", "arr"), ("All rights-reserved", "arr"),
                                        ("This is free and unencumbered software released into the public  domain.", "unlicense")])
def test_hints_with_other_blanks(spark, text, want):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert scan_licences(docs).select("sentence_ids").first()[0] == [want]
