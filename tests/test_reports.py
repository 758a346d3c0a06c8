"""Reports and named result files over small tables."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from loomlens.operators import reports
from loomlens.plans import catalog

SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2025, 1, 2, 3, 4, 5)


def test_workflow_report_by_hand(spark, tmp_path):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    lines = reports.workflow_report(
        {"cwd": "/x", "session_count": 1}, frame([("a.jsonl", 2, 3, "hello"), ("b.jsonl", 1, 0, None)], "file string, user_turns int, tool_calls int, first_user_preview string"),
        frame([("read", 2), ("bash", 5)], "tool string, n int"), frame([], "path string, n int"), frame([("ls", 1)], "command string, n int"),
        frame([("repeated_tool_sequence", "read>edit", 4, "medium", ["a#turn1", "a#turn2"]), ("hot_file_workflow", "a.py", 3, "high", [])], "type string, name string, n int, confidence string, evidence array<string>"), NOW,
    )
    reports.write_results({"report": lines, "project": {"cwd": "/x", "name": "é"}, "turns": frame([(1, "é")], "turn int, text string")}, reports.WORKFLOW_FILES, tmp_path)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["project_summary.json", "report.md", "turns.json"]
    assert json.loads((tmp_path / "turns.json").read_text()) == [{"turn": 1, "text": "é"}] and "é" in (tmp_path / "project_summary.json").read_text()
    text = (tmp_path / "report.md").read_text()
    assert text.startswith("# Workflow report\n\nGenerated: 2025-01-02 03:04:05Z\n\n## Scope\n\n- Project cwd: `/x`\n- Sessions: 1\n\n## What this run can extract\n\n" + reports.ABOUT[0])
    assert "## Sessions\n\n- `a.jsonl` — 2 turns, 3 tool calls\n  - First prompt: hello\n- `b.jsonl` — 1 turns, 0 tool calls\n\n## Top tools\n\n- `bash` × 5\n- `read` × 2\n\n## Hot files\n\n## Repeated commands\n\n- No repeated commands" in text.replace("\n\n\n", "\n\n")
    assert "### 1. hot_file_workflow [high]\n\n- Path: `a.py`\n- Interactions: 3\n\n### 2. repeated_tool_sequence [medium]\n\n- Sequence: `read -> edit`\n- Count: 4\n- Evidence: a#turn1, a#turn2\n\n## Suggested next packaging" in text
    assert text.endswith(reports.NEXT[-1] + "\n")


def test_other_reports_over_the_tables(spark, tmp_path):
    q = lambda name: catalog.QUERIES[name](spark, SF)
    events = catalog._events(spark, SF)
    lines = list(reports.correction_report("/x", 3, events.count(), q("event_type_counts"), q("missing_constraint_counts"), catalog.corrections.representative(events), catalog.corrections.user_profiles(events), {}, NOW))
    assert f"- Events: {events.count()}" in lines and sum(x.startswith("### ") for x in lines) == min(12, events.count())
    labelled = catalog._labelled(spark, SF)
    own = catalog.phrases.cluster_report(catalog._weights(spark, SF), q("dbscan_clusters"), "turn")
    rules = catalog.blindspot.rule_summary(catalog.blindspot.rule_hits(labelled))
    lines = list(reports.blindspot_report("/x", 5, q("frequent_phrases"), own, own, rules, catalog.blindspot.chains(labelled), q("blindspot_profile"), NOW))
    assert sum(x.startswith("### Cluster") for x in lines) == 2 * min(6, own.count()) and "## Blindspot profile" in lines
    said = list(reports.comparison(q("frequent_phrases"), q("kmeans_clusters"), q("dbscan_clusters"), rules, catalog.blindspot.chains(labelled), NOW))
    noise = q("dbscan_clusters").where("cluster IS NULL").count()
    assert f"- DBSCAN 近似簇数：{own.count()}，噪声点：{noise}" in said and f"- 规则命中的盲区标签数：{rules.count()}" in said
    reports.write_results({"report": lines}, reports.BLINDSPOT_FILES, tmp_path / "run")
    assert reports.copy_public(tmp_path / "run", tmp_path / "public", reports.BLINDSPOT_FILES.values()) == ["blindspot_report.md"]
    reports.publish_documents({"patterns.md": "p\n"}, tmp_path / "run", tmp_path / "final")
    assert (tmp_path / "final" / "patterns.md").read_text() == "p\n"


def test_settings():
    from loomlens.plans import config

    c = config.Config.from_env({"LOOMLENS_MAX_VALIDATION_RETRIES": "5", "LOOMLENS_ANALYSIS_ONLY": "Yes", "LOOMLENS_MODEL": ""}, only_chunk=None)
    assert (c.max_validation_retries, c.analysis_only, c.model, c.validation_threshold, c.skip_reason) == (5, True, None, 35.0, "analysis_only")
    assert config.Config(only_chunk="chunk_002").skip_reason == "only_chunk=chunk_002" and config.Config().skip_reason == "disabled"
    assert str(c.folders("/r")["final"]) == "/r/experiments/default/final"
    p = config.Config.from_env({}, mode="project", project_root="/p")
    assert str(p.folders("/r")["final"]) == "/p/.loomlens/final"
    for bad in ({"mode": "other"}, {"mode": "project"}):
        with pytest.raises(ValueError, match="mode"):
            config.Config.from_env({}, **bad).folders("/r")
    assert config.session_cache_name("a.b.jsonl") == "a.b.json"
