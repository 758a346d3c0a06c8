"""Model steps: stored reports that still hold are not made again; projects are written and judged in rounds."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from loomlens.operators import chunking, runners
from loomlens.plans import catalog

SF = "/root/testdata/sf0.001"


class Counted:
    """Leaves a file for every call, as the calls are made by other processes."""

    def __init__(self, folder):
        folder.mkdir()
        self.folder = str(folder)

    def __call__(self, request):
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
            f.write(request.text)
        if request.text == "bad":
            raise RuntimeError("no model")
        return f"report of {request.text}"

    def taken(self):
        from pathlib import Path

        texts = sorted(p.read_text() for p in Path(self.folder).iterdir())
        for p in Path(self.folder).iterdir():
            p.unlink()
        return texts


def test_reports_that_hold_are_not_made_again(spark, tmp_path):
    model, store = Counted(tmp_path / "calls"), runners.report_store(spark, str(tmp_path / "store"), 4)
    chunks = lambda texts: spark.createDataFrame(sorted(texts.items()), "chunk_id string, text string").withColumn("content_hash", F.sha2("text", 256))
    texts = {f"p/{i}": f"text {i}" for i in range(20)} | {"p/x": "bad"}
    run = lambda n, **k: {r["chunk_id"]: (r["status"], r["report"]) for r in runners.map_chunks_once(chunks(texts), store, f"r{n}", model, **k).collect()}
    first = run(1)
    assert len(model.taken()) == 21 and first["p/3"] == ("completed", "report of text 3") and first["p/x"] == ("failed", "no model")
    second = run(2)
    assert model.taken() == ["bad"] and {k: v for k, v in second.items() if k != "p/x"} == {k: ("cached", r) for k, (_, r) in first.items() if k != "p/x"}
    texts["p/x"] = "good"
    assert run(3)["p/x"] == ("completed", "report of good") and model.taken() == ["good"]
    assert {s for s, _ in run(4).values()} == {"cached"} and model.taken() == []
    texts["p/7"] = "changed"
    assert run(5)["p/7"] == ("completed", "report of changed") and model.taken() == ["changed"]
    assert {s for s, _ in run(6, prompt_version="v2").values()} == {"completed"} and len(model.taken()) == 21
    assert run(7, prompt_version="v2", name="cli-json", model="m", thinking="low")["p/1"][0] == "completed" and len(model.taken()) == 21
    assert run(8, prompt_version="v2", name="cli-json", model="other", thinking="low")["p/1"][0] == "completed" and len(model.taken()) == 21
    del texts["p/0"]
    assert len(run(9, prompt_version="v2", name="cli-json", model="other", thinking="low")) == 20 and model.taken() == []
    texts.clear()
    assert runners.map_chunks_once(chunks({"a": "b"}).limit(0), store, "r10", model).count() == 0 and model.taken() == []


def test_projects_are_tried_until_they_pass(spark, tmp_path):
    pass_at = {"one": 1, "two": 2, "never": 9, "broken": 1, "dumb": 1}
    calls = str(tmp_path)

    def model(request):
        with open(f"{calls}/{uuid.uuid4().hex}", "w", encoding="utf-8") as f:
            f.write(f"{request.task} {request.text.split()[-1]} {request.attempt} {bool(request.critique)}")
        project = request.text.split()[-1]
        assert request.session == f"distill-{project}"
        if request.task == "synthesis":
            if project == "broken":
                raise RuntimeError("no answer")
            return "nothing" if project == "dumb" else "\n".join(f"=== {n} ===\ntext {request.attempt} of {project}" for n in runners.BUNDLE)
        ok = request.attempt >= pass_at[project]
        return json.dumps({"raw_score": 40 if ok else 20 + request.attempt, "must_fix": [] if ok else ["evidence"]})

    packets = spark.createDataFrame([(p, f"packet of {p}") for p in pass_at], "project string, packet string")
    results, tries = runners.synthesise_projects(packets, model)
    got = {r["project"]: (r["attempt"], r["status"], r["score"], r["error"]) for r in results.collect()}
    assert got == {
        "one": (1, "completed", 40.0, None), "two": (2, "completed", 40.0, None), "never": (3, "needs_review", 23.0, None), "broken": (1, "failed", None, "no answer"), "dumb": (1, "failed", None, "no bundle")
    }
    texts = {r["project"]: r["documents"] for r in results.where("documents IS NOT NULL").collect()}
    assert texts["two"]["patterns.md"] == "text 2 of two" and texts["never"]["project_context.md"] == "text 3 of never"
    assert tries.count() == 8 and "evidence" in tries.where("project = 'two' AND attempt = 1").first()["critique"]
    made = sorted(p.read_text() for p in tmp_path.iterdir())
    assert [c for c in made if " two " in c] == ["synthesis two 1 False", "synthesis two 2 True", "validation two 1 False", "validation two 2 False"]
    assert len([c for c in made if " one " in c]) == 2 and len([c for c in made if " never " in c]) == 6 and len([c for c in made if "broken" in c or "dumb" in c]) == 2
    assert runners.synthesise_projects(packets.limit(0), model)[0].count() == 0


def test_stand_in_writes_reports_and_bundles(spark):
    reports = catalog._reports(spark, SF)
    rows = runners.chunk_reports(catalog._chunks(spark, SF))
    assert rows.count() == reports.count() and rows.where("report IS NULL").isEmpty()
    (r,) = runners.chunk_reports(
        spark.createDataFrame([("p", "chunk_001", ["s"], ["a", "b", "c", "d"], [], ["ls"], "t1", "t2", "medium")], "project string, chunk_id string, source_sessions array<string>, referenced array<string>, changed array<string>, commands array<string>, start_time string, end_time string, relevance string")
    ).collect()
    assert "covers: t1 to t2; sessions: s\n- relevance: medium\n- changed paths: 0; referenced paths: 4; commands: 1\n" in r["report"] and "changed=none; referenced=a, b, c, d; commands=ls" in r["report"] and "work goes on at: a, b, c\n" in r["report"]
    done = reports.where("status IN ('completed', 'cached')")
    used = chunking.select_for_synthesis(reports).select("project", "chunk_id", F.lit(True).alias("used"))
    sides = done.join(used, ["project", "chunk_id"], "left").select("project", "chunk", "chunk_id", F.coalesce("used", F.lit(False)).alias("used"))
    bundles = runners.stand_in_bundles(chunking.synthesis_heads(chunking.first_uses(reports)), sides)
    assert bundles.count() == done.select("project").distinct().count()
    parts = bundles.select(runners.split_bundle(F.col("bundle")).alias("d")).collect()
    assert all(set(p["d"]) == set(runners.BUNDLE) and "chunk_00" in p["d"]["patterns.md"] for p in parts)


def test_mean_of_a_rubric(spark):
    rows = spark.sql("SELECT map('a', 1.0D, 'b', 2.0D, 'c', 2.0D) AS m UNION ALL SELECT CAST(map() AS map<string,double>) UNION ALL SELECT NULL")
    assert [r["v"] for r in rows.select(runners.rubric_mean(F.col("m")).alias("v")).collect()] == [1.67, 0.0, 0.0]


def test_prompts():
    assert runners.bundle_prompt("a {{CRITIQUE_BLOCK}}\n{{BUNDLE_FORMAT}}", " fix \n") == "a fix\n=== project_context.md ===\n...markdown...\n\n=== collaboration_guide.md ===\n...markdown...\n\n=== patterns.md ===\n...markdown..."
    assert "no critique" in runners.bundle_prompt("{{CRITIQUE_BLOCK}}") and runners.validation_prompt("{{THRESHOLD}}/{{MAX_RETRIES}}", 35.4, 3) == "35/3"


LINES = [
    {"type": "message_update", "message": {"model": "m1"}, "assistantMessageEvent": {"type": "text_delta", "delta": "he"}},
    {"type": "message_update", "assistantMessageEvent": {"type": "other", "delta": "no"}},
    "not json",
    {"type": "message_end", "message": {"role": "user", "model": "m9", "content": [{"type": "text", "text": "asked"}]}},
    {"type": "message_update", "assistantMessageEvent": {"type": "text_delta", "delta": "llo"}},
    {"type": "compaction_end", "errorMessage": "not aborted"},
    {"type": "auto_retry_end", "success": True, "finalError": "fine"},
]
ENDS = {
    "deltas": ([], ("hello", None)),
    "end": ([{"type": "message_end", "message": {"role": "assistant", "model": "m2", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}}], ("ab", None)),
    "empty": ([{"type": "message_end", "message": {"role": "assistant", "content": [{"type": "image"}]}}], ("hello", None)),
    "retry": ([{"type": "auto_retry_end", "finalError": "gone"}, {"type": "auto_retry_end", "success": False, "finalError": ""}], ("hello", "gone")),
    "aborted": ([{"type": "compaction_end", "aborted": True, "errorMessage": "full"}], ("hello", "full")),
}


def test_events_fold_alike_in_a_table_and_in_a_runner(spark):
    rows = [(k, i, x if isinstance(x, str) else json.dumps(x)) for k, (more, _) in ENDS.items() for i, x in enumerate([*LINES, *more])]
    many = [("long", i, json.dumps({"type": "message_update", "assistantMessageEvent": {"type": "text_delta", "delta": f"{i} "}})) for i in range(3 * runners.PIECE)]
    got = {r["run_id"]: r for r in runners.fold_runner_events(spark.createDataFrame(rows + many, "run_id string, line_no int, line string").repartition(5)).collect()}
    for k, (_, want) in ENDS.items():
        text = "\n".join(line for name, _, line in rows if name == k)
        assert (got[k]["text"], got[k]["error"]) == runners.said_by(text) == want
    assert [got[k]["model"] for k in ("deltas", "end", "empty")] == ["m1", "m2", "m1"]
    assert got["long"]["text"] == "".join(f"{i} " for i in range(3 * runners.PIECE))


def test_a_command_is_a_runner(tmp_path):
    import sys

    import pytest

    program = tmp_path / "model.py"
    program.write_text("""
import json, sys
prompt = sys.stdin.read()
if "fail" in prompt:
    print(json.dumps({"type": "auto_retry_end", "finalError": "no quota"})); sys.exit(3)
if "crash" in prompt:
    sys.stderr.write(" broken\\n pipe "); sys.exit(1)
if "silent" not in prompt:
    print(json.dumps({"type": "message_end", "message": {"role": "assistant", "content": [{"type": "text", "text": " ".join(sys.argv[1:]) + "|" + prompt}]}}))
""")
    model = runners.CommandRunner((sys.executable, str(program), "{task}", "{session}", "{attempt}"), (("chunk", "Read this. "),), timeout=60)
    assert model(runners.Request("chunk", "text", 2, "", "s1")) == "chunk s1 2|Read this.\n\n---\ntext"
    assert model(runners.Request("synthesis", "packet", 1, "more")) == "synthesis  1|more\n\n---\npacket"
    for text, message in (("fail", "no quota"), ("crash", "broken pipe"), ("silent", "no text")):
        with pytest.raises(RuntimeError, match=message):
            model(runners.Request("chunk", text))
    assert runners.build_runner("cli-json", model) is model
