from __future__ import annotations

import datetime as dt
import json
import os

import pytest

from loomlens.operators import corrections
from loomlens.plans import routes
from loomlens.sources import files, sessions


def test_files(tmp_path):
    assert files.load_json(tmp_path / "no.json", {"x": 1}) == {"x": 1}
    with pytest.raises(FileNotFoundError):
        files.required(tmp_path / "no.json")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "f").touch()
    assert files.first_existing("f", [tmp_path / "a", tmp_path / "b"]) == tmp_path / "b" / "f"
    assert files.first_existing("g", [tmp_path / "a"], tmp_path) == tmp_path / "g"
    assert files.append_once(tmp_path / "A.md", "see x") and not files.append_once(tmp_path / "A.md", "see x")
    assert files.excerpt("# T\ntext\n- a\n12. b\nGenerated: now\n") == ["# T", "- a", "12. b", "Generated: now"]
    assert files.run_id(dt.datetime(2026, 1, 2, 3, 4, 5)) == "20260102T030405Z"


def test_compiled_sessions_by_manifest_or_folder(spark, tmp_path):
    for name in ("2026-02_b", "2026-01_a"):
        (tmp_path / f"{name}.min.txt").write_text(f"[user]\n{name}")
    (tmp_path / "manifest.json").write_text(json.dumps({"items": [{"name": "2026-02_b", "outputs": {"min": "2026-02_b.min.txt"}}, {"name": "x", "outputs": {"min": "gone"}}, {"outputs": {}}]}))
    assert [r["session_name"] for r in files.manifest_sessions(spark, str(tmp_path)).collect()] == ["2026-01_a", "2026-02_b"]
    (row,) = files.manifest_sessions(spark, str(tmp_path), str(tmp_path / "manifest.json")).collect()
    assert (row["session_name"], row["start_time"], row["text"]) == ("2026-02_b", "2026-02", "[user]\n2026-02_b")


def test_a_route_recomputes_what_changed_and_equals_a_full_run(spark, tmp_path):
    messages = sessions.messages_from_conversations(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet"))
    route = routes.Route(str(tmp_path), "p", "corrections")
    schema = "session_file string, trigger_turn int, event_type string"
    asked = []

    def compute(all_messages):
        def f(work):
            asked.append(sorted(r["session_file"] for r in work.collect()))
            return corrections.events(all_messages.join(work, "session_file", "left_semi")).select("session_file", "trigger_turn", "event_type")

        return f

    def index(rows, mark):
        return rows.select("session_file").distinct().selectExpr("session_file", f"'{mark}' AS fingerprint")

    first, changed = routes.run(route, index(messages, "1"), compute(messages), schema, "r1")
    assert changed and sorted(map(tuple, first.collect())) == sorted(map(tuple, corrections.events(messages).select("session_file", "trigger_turn", "event_type").collect()))
    _, changed = routes.run(route, index(messages, "1"), compute(messages), schema, "r2")
    assert not changed and len(asked) == 1
    fewer = messages.where("session_file <> '1'")
    rows, changed = routes.run(route, index(fewer, "1"), compute(fewer), schema, "r3")
    assert changed and asked[1] == []
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, corrections.events(fewer).select("session_file", "trigger_turn", "event_type").collect()))


def test_rules_files_in_order_and_ignored_ids(tmp_path, monkeypatch):
    from loomlens.operators import reminders
    from loomlens.sources import rules

    monkeypatch.delenv(rules.RULES_SETTING, raising=False)
    assert rules.load_rules(tmp_path) == []
    document = lambda name: json.dumps({"rules": [{"id": name, "mode": "notify", "message": "m", "must_match_any": ["x"]}, {"id": "off", "mode": "notify", "message": "m", "enabled": False}]})
    (tmp_path / "reminder_rules.json").write_text(document("root"))
    assert [r.id for r in rules.load_rules(tmp_path)] == ["root"]
    final = tmp_path / ".loomlens" / "final"
    final.mkdir(parents=True)
    (final / "reminder_rules.json").write_text(document("final"))
    assert [r.id for r in rules.load_rules(tmp_path)] == ["final"]
    (tmp_path / "named.json").write_text(document("named"))
    monkeypatch.setenv(rules.RULES_SETTING, str(tmp_path / "named.json"))
    assert [r.id for r in rules.load_rules(tmp_path)] == ["named"]
    said = []
    (tmp_path / "named.json").write_text("[not json")
    os.utime(tmp_path / "named.json", ns=(1, 1))
    assert rules.load_rules(tmp_path, said.append) == [] and len(said) == 1

    rule, seen = reminders.Rule("r", cooldown="session_once", message="m"), set()
    assert not rules.decide(tmp_path, rule, "cancel", seen) and not seen
    assert rules.decide(tmp_path, rule, "send_and_ignore", seen) and seen == {"r"} and rules.load_ignored(tmp_path) == {"r"}
    rules.reset_ignored(tmp_path)
    assert rules.load_ignored(tmp_path) == frozenset()
    (tmp_path / rules.IGNORED_PLACE).write_text('{"ignored_rule_ids": 3}')
    assert rules.load_ignored(tmp_path, said.append) == frozenset() and len(said) == 2
