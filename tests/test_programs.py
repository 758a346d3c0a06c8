"""Whole runs over a small log written by hand: every result file, and the lines of the report one by one."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from loomlens.operators import packet, reports
from loomlens.plans import programs
from loomlens.sources import sessions

NOW = dt.datetime(2026, 1, 2, 3, 4, 5)


def message(role, text, *calls):
    parts = [{"type": "text", "text": text}] + [{"type": "toolCall", "name": n, "arguments": a} for n, a in calls]
    return {"type": "message", "timestamp": "t", "message": {"role": role, "content": parts}}


def read(p):
    return "read", {"path": f"/work/app/{p}"}


def edit(p):
    return "edit", {"path": f"/work/app/{p}"}


def bash(c):
    return "bash", {"command": c}


LOGS = {
    "a.jsonl": [
        {"type": "session", "id": "A", "timestamp": "2026-01-01T00:00:00Z"},
        {"type": "model_change", "provider": "x", "modelId": "m1"},
        message("assistant", "before anyone asked", read("early.py")),
        message("user", "改一下登录页"),
        message("assistant", "已修改", read("a.py"), read("a.py"), edit("a.py"), bash("cd /work/app && npm test")),
        message("user", "不是这个意思，先不要改"),
        message("assistant", "ok", read("b.py"), read("a.py"), edit("a.py"), bash("cd /work/app && npm test")),
    ],
    "b.jsonl": [
        {"type": "session", "id": "B", "timestamp": "2026-01-02T00:00:00Z"},
        {"type": "model_change", "provider": "x", "modelId": "m2"},
        {"type": "model_change", "provider": "x", "modelId": "m1"},
        message("user", " \n "),
        message("user", "go on please"),
        message("assistant", "fine", ("write", {"path": "/home/me/notes.md"}), bash("ls")),
        message("user", "thanks"),
    ],
}
REPORT = """# Workflow report

Generated: 2026-01-02 03:04:05Z

## Scope

- Project cwd: `/work/app`
- Session dir: `/logs`
- Sessions: 2
- User turns: 5
- Messages: 9
- Tool calls: 10

## What this run can extract

{about}

## Sessions

- `a.jsonl` — 2 turns, 8 tool calls
  - First prompt: 改一下登录页
- `b.jsonl` — 3 turns, 2 tool calls
  - First prompt: go on please

## Top tools

- `read` × 4
- `bash` × 3
- `edit` × 2
- `write` × 1

## Hot files

- `<PROJECT>/a.py` × 5
- `<PROJECT>/b.py` × 1
- `~/notes.md` × 1

## Repeated commands

- ×2 `cd <PROJECT> && npm test`

## Candidate patterns

### 1. hot_file_workflow [high]

- Path: `<PROJECT>/a.py`
- Interactions: 5
- Read count: 3
- Edit count: 2
- Read→edit turns: 2
- Edit→validate turns: 2
- Tools: edit, read
- Evidence: a.jsonl#turn1, a.jsonl#turn2

### 2. repeated_command [medium]

- Command: `cd <PROJECT> && npm test`
- Count: 2
- Evidence: a.jsonl#turn1, a.jsonl#turn2

### 3. repeated_tool_sequence [low]

- Sequence: `read -> edit -> bash`
- Count: 2
- Evidence: a.jsonl#turn1, a.jsonl#turn2

## Suggested next packaging

{next}
"""


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    for name, lines in LOGS.items():
        (folder / name).write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in lines) + "\n\n", encoding="utf-8")
    return sessions.entries(spark, str(folder))


PROJECT = programs.Project("/work/app", "/logs", "/home/me")


@pytest.fixture(scope="module")
def made(log, tmp_path_factory):
    home = tmp_path_factory.mktemp("runs")
    programs.run_workflow(log, PROJECT, home / "workflow", now=NOW)
    programs.run_corrections(sessions.messages_from_entries(log), PROJECT, home / "corrections", now=NOW)
    return home


def test_workflow_run(made):
    home = made / "workflow"
    assert {p.name for p in home.iterdir()} == set(reports.WORKFLOW_FILES.values())
    assert (home / "report.md").read_text() == REPORT.format(about="\n".join(reports.ABOUT), next="\n".join(reports.NEXT))
    load = lambda name: json.loads((home / name).read_text())
    assert load("project_summary.json") == {"cwd": "/work/app", "session_dir": "/logs", "session_count": 2, "total_messages": 9, "total_user_turns": 5, "total_tool_calls": 10}
    assert load("counters.json") == {
        "tools": {"read": 4, "bash": 3, "edit": 2, "write": 1}, "models": {"x/m1": 2, "x/m2": 1}, "paths": {"<PROJECT>/a.py": 5, "<PROJECT>/b.py": 1, "~/notes.md": 1},
        "commands": {"cd <PROJECT> && npm test": 2, "ls": 1}, "sequences": {"read -> edit -> bash": 2, "write -> bash": 1},
    }
    assert list(load("counters.json")["tools"]) == ["read", "bash", "edit", "write"]
    assert [s["tools"] for s in load("sessions.json")] == [{"read": 4, "edit": 2, "bash": 2}, {"write": 1, "bash": 1}]
    assert [(s["models"], s["started_at"][:10], s["message_count"]) for s in load("sessions.json")] == [(["x/m1"], "2026-01-01", 5), (["x/m2", "x/m1"], "2026-01-02", 4)]
    turns = load("turns.json")
    assert [(t["session_file"], t["session_id"], t["turn_index"], t["user_preview"]) for t in turns] == [("a.jsonl", "A", 1, "改一下登录页"), ("a.jsonl", "A", 2, "不是这个意思，先不要改"), ("b.jsonl", "B", 1, ""), ("b.jsonl", "B", 2, "go on please"), ("b.jsonl", "B", 3, "thanks")]
    assert turns[0]["tool_sequence"] == ["read", "edit", "bash"] and turns[0]["read_paths"] == ["/work/app/a.py"] * 2 and turns[4]["commands"] == []
    first = load("candidate_patterns.json")[0]
    assert first == {
        "type": "hot_file_workflow", "confidence": "high", "path": "<PROJECT>/a.py", "evidence": ["a.jsonl#turn1", "a.jsonl#turn2"],
        "observations": {"interactions": 5, "read_count": 3, "edit_count": 2, "read_then_edit_turns": 2, "edit_then_validate_turns": 2, "tools": ["edit", "read"]},
    }


def test_corrections_run(made):
    home = made / "corrections"
    (event,) = json.loads((home / "events.json").read_text())
    assert (event["trigger_turn"], event["event_type"], event["secondary_types"], event["missing_constraint"], event["impact"], event["avoidable"], event["confidence"]) == (
        2, "direction_mismatch", ["late_constraint"], "不是这个意思，先不要改", "assistant_already_executed", True, 0.83
    )
    profile = json.loads((home / "profile.json").read_text())
    assert profile["event_types"] == {"direction_mismatch": 1} and profile["event_count"] == 1 and profile["stable_patterns"][0]["evidence_examples"] == ["a.jsonl#turn2"] and profile["profiles"] == []
    assert "- `direction_mismatch` × 1 — " in (home / "report.md").read_text()


def test_review_packet(log, made):
    home = programs.run_review(log, sessions.messages_from_entries(log), PROJECT, made, made / "review")
    document = json.loads((home / "review_packet.json").read_text())
    assert [t["turn_index"] for t in document["workflow"]["representative_turns"]][:2] == [1, 2] and document["corrections"]["event_count"] == 1
    assert document["workflow"]["top_tools"][0] == {"name": "read", "count": 4} and document["workflow"]["report_excerpt"][0] == "# Workflow report"
    text = (home / "review_packet.md").read_text()
    for lines in (
        "## Scope\n\n- Project: `/work/app`\n- Source root: `/logs`\n- Workflow sessions: 2\n- Workflow user turns: 5\n- Workflow tool calls: 10\n- Correction events: 1\n",
        "- hot_file_workflow / high\n  - path: `<PROJECT>/a.py`\n  - interactions: 5\n  - read/edit: 3/2\n  - evidence: a.jsonl#turn1\n  - evidence: a.jsonl#turn2\n- repeated_command / medium\n  - command: `cd <PROJECT> && npm test`\n  - count: 2\n",
        "- repeated_tool_sequence / low\n  - sequence: `read -> edit -> bash`\n  - count: 2\n",
        "- `a.jsonl#turn1` 改一下登录页\n  - tools: read -> edit -> bash\n  - edit_paths: /work/app/a.py\n  - command: `cd <PROJECT> && npm test`\n",
        "- ×2 `cd <PROJECT> && npm test`\n- ×1 `ls`\n", "### Event types\n\n- `direction_mismatch` × 1\n", "- `a.jsonl#turn2` `direction_mismatch` (0.83)\n  - original: 改一下登录页\n  - assistant: 已修改\n  - evidence: 不是这个意思，先不要改\n",
        "- `command_loop_sop`\n  - why: ", "- `action_report.md` — short", f"## Rules for final synthesis\n\n- {packet.OUTPUT_RULES[0]}\n",
    ):
        assert lines in text, lines
    with pytest.raises(FileNotFoundError):
        programs.run_review(log, sessions.messages_from_entries(log), PROJECT, made / "none", made / "x")


def test_blindspot_run(spark, tmp_path):
    rows = [(f"s{i}.jsonl", 2 * j, "user", f"look at the login page number {j % 3} and tell me what you think") for i in range(4) for j in range(4)] + [(f"s{i}.jsonl", 9, "user", "不是这个意思，我指的是 the other page") for i in range(3)]
    messages = spark.createDataFrame([(*r, 0) for r in rows], "session_file string, line_no int, role string, text string, tool_calls int")
    home = programs.run_blindspot(messages, PROJECT, tmp_path / "b", now=NOW)
    assert {p.name for p in home.iterdir()} == set(reports.BLINDSPOT_FILES.values())
    load = lambda name: json.loads((home / name).read_text())
    assert len(load("user_turns.json")) == 19 and 0 < len(load("method_phrases.json")) <= 80
    found = load("method_dbscan_clusters.json")
    assert sum(c["size"] for c in found) == 19 and found[0]["size"] >= 16 and all(set(e) == {"session_file", "turn_index", "preview"} for c in found for e in c["examples"])
    assert sum(c["size"] for c in load("method_kmeans_clusters.json")) == 19
    assert {c["session_file"] for c in load("method_correction_chains.json")} == {"s0.jsonl", "s1.jsonl", "s2.jsonl"} and load("method_blindspot_rules.json")
    text = (home / "blindspot_report.md").read_text()
    assert "- User turns analyzed: 19" in text and "### Cluster" in text and (home / "comparison.md").read_text().startswith("# Comparison of methods\n\nGenerated: 2026-01-02")


def test_distill_run(spark, tmp_path):
    from loomlens.operators import chunking, runners
    from loomlens.plans.config import Config

    compiled = tmp_path / "compiled"
    compiled.mkdir()
    for day in range(1, 7):
        lines = [f'[user]\nstep {day} {i}\n[assistant]\n* Read "src/r{i}.py"\n* Edit "src/e{day}.py"\n* Bash "pytest   -q {day}"' for i in range(4)]
        (compiled / f"2026-01-0{day}_s.min.txt").write_text("\n".join(lines))
    (compiled / "2026-01-02_s.txt").write_text("whole")
    (compiled / "2026-01-07_s.min.txt").write_text("")
    records = programs.files.session_records(spark, str(compiled)).orderBy("start_time").collect()
    first = (compiled / "2026-01-01_s.min.txt").read_text()
    r = records[0]
    assert (r["session_name"], r["start_time"], r["end_time"], r["char_count"], r["line_count"], r["estimated_tokens"], r["source_jsonl"], r["txt_path"]) == ("2026-01-01_s", "2026-01-01", "2026-01-01", len(first), 24, -(-len(first) // 4), None, None)
    assert (r["referenced"], r["changed"], r["commands"]) == ([f"src/r{i}.py" for i in range(4)], ["src/e1.py"], ["pytest -q 1"]) and r["min_path"] == str(compiled / "2026-01-01_s.min.txt")
    assert records[1]["txt_path"] == str(compiled / "2026-01-02_s.txt") and len(records) == 6  # an empty file is no session

    policy = chunking.Policy(600, 900, 1000)
    home = tmp_path / "out"
    model = runners.stand_in_model((20.0, 36.0))
    run = lambda n, runner=model, **k: programs.run_distill(spark, str(compiled), Config(**k), home, n, runner, policy=policy)
    out = run("r1")
    n = out["stats"]["selected"]
    assert n == len(list((home / "runs" / "r1" / "chunks" / "project").iterdir())) == len(list((home / "runs" / "r1" / "reports").iterdir())) > 1 and out["stats"]["completed"] == n
    assert (out["status"], out["score"], [a["status"] for a in out["attempts"]]) == ("completed", 36.0, ["open", "completed"])
    assert out["changed"] == [f"src/e{d}.py" for d in range(1, 7)] and out["referenced"] == [f"src/r{i}.py" for i in range(4)] and out["commands"] == [f"pytest -q {d}" for d in range(1, 7)]
    assert "bound more tightly" in (home / "final" / "patterns.md").read_text() and "chunk_001" in (home / "final" / "project_context.md").read_text()
    assert json.loads((home / "runs" / "r1" / "manifest.json").read_text())["stats"] == out["stats"]
    with (compiled / "2026-01-06_s.min.txt").open("a") as f:
        f.write("\nmore")
    out = run("r2", runners.stand_in_model((10.0,)))
    assert out["stats"]["cached"] == n - 1 and out["stats"]["completed"] == 1 and (out["status"], len(out["attempts"])) == ("needs_review", 3)
    out = run("r3", only_chunk="chunk_002")
    assert (out["status"], out["skip_reason"], out["stats"]["selected"], out["stats"]["cached"], out["stats"]["skipped"]) == ("analysed", "only_chunk=chunk_002", 1, 1, n - 1)

    def broken(request):
        raise RuntimeError("away")

    with pytest.raises(ValueError, match="no finished"):
        programs.run_distill(spark, str(compiled), Config(prompt_version="v9"), tmp_path / "other", "r1", broken, policy=policy)
