"""Versioned buckets: what a run rewrites, failures, lost folders, runs at the same time, the registry, reloaded results."""

from __future__ import annotations

import pytest

from loomlens.operators import workflow
from loomlens.plans import routes, versioned
from loomlens.sources import sessions

SCHEMA = "session_file string, n int"


def index(spark, marks):
    return spark.createDataFrame(sorted(marks.items()), "session_file string, fingerprint string")


def counting(asked):
    def compute(work):
        asked.append(sorted(r["session_file"] for r in work.collect()))
        return work.selectExpr("session_file", "length(session_file) AS n")

    return compute


def state(table):
    return {(p, b): f for p, x in table.current().folders.items() for b, f in x.items()}


def test_one_changed_session_rewrites_one_bucket(spark, tmp_path):
    route, asked = routes.Route(str(tmp_path), "p", "r", 16), []
    marks = {f"s{i}": "1" for i in range(1000)}
    rows, changed = routes.run(route, index(spark, marks), counting(asked), SCHEMA, "r1")
    table = route.table(spark, SCHEMA)
    before = state(table)
    assert changed and rows.count() == 1000 and len(before) == 32
    rows, changed = routes.run(route, index(spark, marks), counting(asked), SCHEMA, "r2")
    assert not changed and state(table) == before and len(asked) == 1
    marks["s7"] = "2"
    rows, changed = routes.run(route, index(spark, marks), counting(asked), SCHEMA, "r3")
    after = state(table)
    moved = {k for k in after if after[k] != before[k]}
    assert changed and asked[1] == ["s7"] and rows.count() == 1000 and len(moved) == 2 and len({b for _, b in moved}) == 1
    del marks["s9"]
    rows, changed = routes.run(route, index(spark, marks), counting(asked), SCHEMA, "r4")
    assert changed and asked[2] == [] and rows.count() == 999 and rows.where("session_file = 's9'").isEmpty()
    assert routes.snapshot(route, spark, SCHEMA, "r1").count() == 1000
    with pytest.raises(KeyError):
        routes.snapshot(route, spark, SCHEMA, "r2")
    assert table.vacuum(keep=1) == 4 and table.read("rows").count() == 999 and table.numbers() == [3]


def test_a_failure_leaves_the_state_before(spark, tmp_path, monkeypatch):
    route = routes.Route(str(tmp_path), "p", "r", 4)
    marks = {"a": "1", "b": "1"}
    routes.run(route, index(spark, marks), counting([]), SCHEMA, "r1")
    marks["a"] = "2"

    def fails(work):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        routes.run(route, index(spark, marks), fails, SCHEMA, "r2")
    with monkeypatch.context() as m:
        m.setattr(versioned.Table, "swap", lambda *_: fails(None))
        with pytest.raises(RuntimeError):
            routes.run(route, index(spark, marks), lambda w: w.selectExpr("session_file", "99 AS n"), SCHEMA, "r3")
    table = route.table(spark, SCHEMA)
    assert sorted(map(tuple, table.read("rows").collect())) == [("a", 1), ("b", 1)] and table.current().run == "r1"
    asked = []
    rows, _ = routes.run(route, index(spark, marks), counting(asked), SCHEMA, "r4")
    assert asked == [["a"]] and rows.count() == 2


def test_lost_buckets_are_computed_again(spark, tmp_path):
    route, asked = routes.Route(str(tmp_path), "p", "r", 4), []
    marks = {f"s{i}": "1" for i in range(12)}
    rows, _ = routes.run(route, index(spark, marks), counting(asked), SCHEMA, "r1")
    want = sorted(map(tuple, rows.collect()))
    table = route.table(spark, SCHEMA)
    folder = table.current().folders["rows"][min(table.current().folders["rows"])]
    gone = sorted(r["session_file"] for r in spark.read.parquet(f"{table.folder.home}/{folder}").collect())
    table.folder.delete(folder)
    rows, changed = routes.run(route, index(spark, marks), counting(asked), SCHEMA, "r2")
    assert changed and asked[1] == gone and sorted(map(tuple, rows.collect())) == want


def test_the_second_of_two_runs_starts_over(spark, tmp_path):
    table = versioned.Table(spark, str(tmp_path), {"rows": "k string, n int"}, "k", 4)
    one = lambda k, n: spark.createDataFrame([(k, n)], "k string, n int")
    start = table.current()
    buckets = range(4)
    table.replace(start, {"rows": one("a", 1)}, buckets, "first")
    with pytest.raises(versioned.Conflict):
        table.replace(start, {"rows": one("b", 2)}, buckets, "second")
    assert [tuple(r) for r in table.read("rows").collect()] == [("a", 1)]
    seen = []

    def step(version):
        if not seen:  # another run comes first
            table.replace(table.current(), {"rows": table.read("rows").union(one("c", 3))}, buckets, "other")
        seen.append(version.number)
        return table.replace(version, {"rows": table.read("rows", version).union(one("b", 2))}, buckets, "second")

    table.change(step)
    assert seen == [1, 2] and sorted(r["k"] for r in table.read("rows").collect()) == ["a", "b", "c"]


def test_registry_keeps_every_project_in_order(spark, tmp_path):
    table = routes.registry(spark, str(tmp_path))
    meta = spark.createDataFrame([("s1", 4, 2, 1), ("s2", 6, 3, 0)], "session_file string, message_count long, user_turn_count long, tool_call_count long")
    for project, route, run, now in (("q", "workflow", "r1", "t1"), ("b", "workflow", "r2", "t2"), ("q", "blindspot", "r3", "t3"), ("q", "workflow", "r4", "t4")):
        routes.register(table, project, f"/{project}", route, run, now, meta)
    rows = [r.asDict() for r in routes.projects(table).collect()]
    assert [(r["project_id"], r["created_at"], r["last_analyzed_at"], r["latest_run"], r["route_runs"]) for r in rows] == [
        ("b", "t2", "t2", "r2", {"workflow": "t2"}), ("q", "t1", "t4", "r4", {"workflow": "t4", "blindspot": "t3"})
    ]
    assert all((r["session_count"], r["message_count"], r["user_turn_count"], r["tool_call_count"]) == (2, 10, 5, 1) for r in rows)


def test_reloaded_sessions_give_the_direct_result(spark, tmp_path):
    calls = sessions.tool_calls_from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    parts = workflow.partials(calls).withColumnRenamed("session", "session_file")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    route = routes.Route(str(tmp_path), "p", "workflow", 8)
    marks = calls.selectExpr("session AS session_file", "'1' AS fingerprint").distinct()
    asked = []

    def compute(work):
        asked.append(work.count())
        return parts.join(work, "session_file", "left_semi")

    half = marks.where("CAST(session_file AS BIGINT) % 2 = 0")
    routes.run(route, half, compute, schema, "r1")
    rows, _ = routes.run(route, marks, compute, schema, "r2")
    assert sum(asked) == marks.count() and max(asked) < marks.count()
    loaded = routes.in_session_order(rows).withColumnRenamed("session_file", "session")
    order = [r["session"] for r in loaded.select("session").collect()]
    assert order == sorted(order)
    ranked = lambda df: [tuple(map(str, r)) for r in workflow.in_order(df).select("type", "name", "n", "confidence", "evidence", "observed").collect()]
    assert ranked(workflow.candidates_of(loaded)) == ranked(workflow.candidates(calls))
    top = lambda p: sorted(map(str, workflow.top_counters(workflow.finals(p)).collect()))
    assert top(loaded) == top(workflow.partials(calls))
