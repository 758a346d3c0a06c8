"""Queries that must carry whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_fold_returns_more_than_a_prefix(spark):
    rows = QUERIES["runner_event_fold"](spark, SF)
    assert rows.agg(F.max(F.length("final_text"))).first()[0] > 20


def test_chunk_hashes_are_their_own(spark):
    records = QUERIES["chunk_records"](spark, SF)
    assert records.select("content_hash").distinct().count() == records.count() == records.select("project", "chunk").distinct().count()


def test_kmeans_report_covers_all_turns(spark):
    rows = QUERIES["kmeans_report"](spark, SF).collect()
    assert sum(r["size"] for r in rows) == QUERIES["user_turns"](spark, SF).count()
    assert [r["size"] for r in rows] == sorted((r["size"] for r in rows), reverse=True) and all(0 < len(r["top_terms"]) <= 6 and 0 < len(r["examples"]) <= 4 for r in rows)
