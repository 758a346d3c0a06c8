"""Small functions by hand."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from loomlens.functions import text as tx
from loomlens.operators import reminders, runners
from loomlens.sources import files, sessions
from loomlens.streaming import jobs


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_paths_and_names(spark):
    paths = [("/home/u/x",), ("/home/u/x/a/b.py",), ("/home/u",), ("/home/u/n",), ("/etc",), ("/home/u/xy",)]
    assert values(spark, paths, "p string", tx.display_path(F.col("p"), "/home/u/x", "/home/u").alias("d")) == [("~/x",), ("<PROJECT>/a/b.py",), ("~",), ("~/n",), ("/etc",), ("~/xy",)]
    assert values(spark, [(" run 1/2 é",), ("--a.b_c",)], "s string", tx.stable_session_id(F.col("s")).alias("d")) == [("run-1-2",), ("a.b_c",)]
    assert sessions.session_dir_name("/home/u/x/") == "--home-u-x--"


def test_heads_and_evidence(spark):
    assert values(spark, [(["a", "b", "a", "c"],)], "a array<string>", tx.unique_head(F.col("a"), 2).alias("d")) == [(["a", "b"],)]
    guide = " x HTTP \nno\n\ncurl y\nHTTP again\nping"
    assert values(spark, [(guide,)], "g string", reminders.evidence_lines(F.col("g"), ["HTTP", "curl"], 2).alias("d")) == [(["x HTTP", "curl y"],)]
    rules = [("a", "notify", "m"), ("", "notify", "m"), ("b", "shout", "m"), ("c", "confirm", None)]
    valid = reminders.valid(spark.createDataFrame(rows := rules, "id string, mode string, message string"))
    assert [r["valid"] for r in valid.collect()] == [True, False, False, False] and len(rows) == 4


def test_chunk_report(spark):
    got = values(spark, [("c1", ["s"], [], ["ls", "cd"])], "k string, s array<string>, r array<string>, c array<string>", runners.chunk_report(F.col("k"), F.col("s"), F.col("r"), F.col("c")).alias("d"))
    assert got == [("# Chunk c1\n## Sessions\n- s\n## Files\n- none\n## Commands\n- ls\n- cd",)]


def test_folders_of_a_run(tmp_path):
    with pytest.raises(FileNotFoundError):
        files.input_folders(tmp_path)
    for name in ("workflow", "corrections"):
        (tmp_path / name).mkdir()
    assert files.input_folders(tmp_path)["workflow"] == tmp_path / "workflow"
    (tmp_path / "manifest.json").write_text(json.dumps({"project": str(tmp_path)}))
    assert files.project_root(tmp_path / "manifest.json") == tmp_path
    (tmp_path / "manifest.json").write_text(json.dumps({"project": "/no/such"}))
    assert files.project_root(tmp_path / "manifest.json") is None


def test_windowed_counts(spark):
    at = lambda d, h: dt.datetime(2025, 1, d, h)
    rows = spark.createDataFrame([(at(1, 1), "view"), (at(1, 23), "view"), (at(2, 1), "view"), (at(2, 1), "click")], "ts timestamp, event_type string")
    assert sorted(r["n"] for r in jobs.windowed_counts(rows).collect()) == [1, 1, 2]
