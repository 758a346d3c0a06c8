from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from loomlens.llm import common, exact_dedup

from ..compare import assert_same

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    assert_same(exact_dedup.op7_exact_dedup(spark, SF), exact_dedup.SQL, SF)


ROWS = [(1, "a b"), (2, "ab "), (3, "a  b"), (4, "a\nb"), (5, None), (6, ""), (7, " \t"), (8, "A b"), (9, "x" * 50_000), (10, "x" * 50_000 + " "), (11, "ba")]


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return sorted((i, min(g)[1], len(g), i == min(g)[1]) for g in groups.values() for _, i in g)


@pytest.mark.parametrize("digest", [lambda c: F.sha2(c, 256), lambda c: (F.length(c) % 2).cast("string")])
@pytest.mark.parametrize("salts", [1, 3])
def test_groups_whatever_the_digest(spark, digest, salts):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = exact_dedup.classify(docs, digest=digest, salts=salts).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got)) == plain(ROWS)


def test_odd_rows(odd, none):
    assert exact_dedup.classify(odd).count() == odd.count() and exact_dedup.classify(none).count() == 0
    kept = exact_dedup.dedup(odd)
    assert kept.columns == odd.columns and exact_dedup.dedup(none).count() == 0
    texts = [re.sub(r"\s", "", r["text"] or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) and texts.count("word") == 1  # repeated rows of one document stay once


def test_ids_that_are_text(spark):
    rows = [("b", "x y"), ("a", "xy "), ("a2", "x  y"), (None, "xy  "), ("z", None), ("y", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.classify(docs).collect()}
    # the longest stays, then the least id, and a null id comes last
    assert got == {"b": ("a2", 4, False), "a": ("a2", 4, False), "a2": ("a2", 4, True), None: ("a2", 4, False), "z": ("y", 2, False), "y": ("y", 2, True)}
    assert sorted(r["doc_id"] for r in exact_dedup.dedup(docs).collect()) == ["a2", "y"]


def test_hot_groups_are_joined_apart(spark, monkeypatch):
    """Half of the rows are one text: with so low a bound it is hot, others are not; all get the same results."""
    rows = [(i, "same" if i % 2 else f"t{i % 7}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for hot in (1, 3, 1024):
        monkeypatch.setattr(common, "HOT", hot)
        got = exact_dedup.classify(docs).select("doc_id", "keep_id", "group_size", "kept").collect()
        assert sorted(map(tuple, got)) == plain(rows)
