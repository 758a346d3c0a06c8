"""Every query of the session analytics gives the rows of its SQL; those without SQL hold invariants."""

from __future__ import annotations

import pytest

from loomlens.plans.catalog import ORACLE_SQL, QUERIES

from .compare import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_frequent_phrases_hold_no_less_frequent_part(spark):
    rows = QUERIES["frequent_phrases"](spark, SF).orderBy("place").collect()
    assert 0 < len(rows) <= 80
    for i, r in enumerate(rows):
        assert not any(r["phrase"] in p["phrase"] and r["n"] <= p["n"] for p in rows[:i])


def test_kmeans_gives_each_turn_one_of_k_clusters(spark):
    rows = QUERIES["kmeans_clusters"](spark, SF).collect()
    n = len(rows)
    assert n == QUERIES["user_turns"](spark, SF).count()
    assert {r["cluster"] for r in rows} <= set(range(min(6, max(2, round((n / 2) ** 0.5)))))


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
