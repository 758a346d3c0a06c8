from __future__ import annotations

import pytest

#: Texts that every operator must take: null, empty, white space, one word, wide characters, a very long text and repeats.
ODD = [None, "", " \n\t", "word", "é𝒳🙂 　x\x00y ▁ ", "12 34-56", "a" * 30_000, "ab cd " * 20_000, "word", "word"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with a null id, a repeated row, nulls in all columns and extra columns whose names clash with operators' own."""
    rows = [(i, t, None if i % 2 else "en", i, "k", None) for i, t in enumerate(ODD)]
    rows += [(3, "word", None, 3, "k", None), (None, "lost id", None, None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row long, key string, content string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
