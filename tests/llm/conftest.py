"""Rows that every operator must stand: nulls, empty and long texts, ties, repeated rows, clashing names."""

import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Documents with extra columns whose names clash with those that operators make."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "one two three four"), (6, "one two three four"), (6, "one two three four"), (None, "no id here, only text"), (None, None), (7, long), (8, long + " end"), (9, "é" * 50 + "\x00\x1c 中文 😀")]
    # Names used inside the operators, as an input might have them.
    names = "id kept score fp sig maybe text_key spans terms cuts t h cover map_word in_0 c0 component".split()
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(i, t, None, *["x"] * len(names)) for i, t in rows], schema)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
