"""Fixtures of session logs, packing, rules, folds and incremental runs."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from loomlens.functions import text as tx
from loomlens.functions.patterns import SESSION_LOGS
from loomlens.operators import blindspot, chunking, corrections, incremental, packet, phrases, reminders, runners, workflow
from loomlens.sources import sessions


def say(role, text=None, *calls):
    content = ([{"type": "text", "text": text}] if text is not None else []) + [{"type": "toolCall", "name": n, "arguments": a} for n, a in calls]
    return {"type": "message", "timestamp": "t", "message": {"role": role, "content": content}}


LOG = [
    {"type": "session", "id": "s1", "timestamp": "2026-01-01T00:00:00Z"},
    say("assistant", "early", ("read", {"path": "x"})),
    say("user", "改一下登录页"),
    say("toolResult", "ignored"),
    say("assistant", "已修改", ("read", {"path": "a.py"}), ("edit", {"path": "a.py"}), ("", {"path": "nameless"})),
    say("user", "不是这个意思，先不要改"),
    say("user", "**Resume Session x"),
    say("assistant", None, ("bash", {"command": "python -m pytest"}), ("bash", {"command": ""})),
]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("logs")
    lines = [json.dumps(e, ensure_ascii=False) for e in LOG]
    (folder / "one.jsonl").write_text("\n".join(lines[:3] + ["", *lines[3:]]) + "\n", encoding="utf-8")
    return str(folder)


def test_log_gives_the_one_event(spark, log):
    messages = sessions.messages_from_entries(sessions.entries(spark, log))
    (e,) = corrections.events(messages, SESSION_LOGS).collect()
    assert (e["trigger_turn"], e["event_type"], e["secondary_types"]) == (2, "direction_mismatch", ["late_constraint"])
    assert (e["original_user_turn"], e["assistant_tool_calls"], e["missing_constraint"]) == (1, 3, "不是这个意思，先不要改")
    assert (e["impact"], e["avoidable"], e["confidence"]) == ("assistant_already_executed", True, 0.83)


def test_log_gives_tool_calls_after_the_first_user(spark, log):
    calls = sessions.tool_calls_from_entries(sessions.entries(spark, log))
    rows = {r["turn"]: r for r in workflow.turns(calls).collect()}
    assert rows[1]["sequence"] == ["read", "edit"] and rows[1]["read_paths"] == ["a.py"]
    assert rows[3]["commands"] == ["python -m pytest"]  # a resumed session's first text counts as a turn here
    stats = {r["path"]: r for r in workflow.path_stats(calls).collect()}
    assert (stats["a.py"]["read_edit"], stats["a.py"]["edit_validate"]) == (1, 0)


def test_models_and_commands_of_a_log(spark, tmp_path):
    lines = [
        {"type": "model_change", "provider": "p", "modelId": "m1"}, {"type": "message", "message": {"role": "user", "content": [{"type": "text", "text": "go"}]}},
        {"type": "message", "message": {"role": "assistant", "content": [{"type": "toolCall", "name": "bash", "arguments": {"command": "cd /home/u/x &&  ls /tmp/pi-hypa-backup-20250101-101010"}}]}},
        {"type": "model_change", "provider": "", "modelId": "m2"}, {"type": "message", "message": {"role": "assistant", "content": [{"type": "toolCall", "name": "bash", "arguments": {"command": "cd /home/u/x && ls /tmp/pi-hypa-backup-20250102-111111"}}]}},
        {"type": "model_change", "provider": "p", "modelId": "m1"}, {"type": "model_change"},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    log = sessions.entries(spark, str(tmp_path))
    assert {r["model"]: (r["n"], r["n_sessions"]) for r in sessions.model_counts(log).collect()} == {"p/m1": (2, 1), "m2": (1, 1)}
    assert [r["model"] for r in sessions.with_model(log).orderBy("line_no").collect()] == ["p/m1"] * 3 + ["m2"] * 2 + ["p/m1"] * 2
    counts = workflow.counts(sessions.tool_calls_from_entries(log, cwd="/home/u/x"), "command").collect()
    assert [tuple(r) for r in counts] == [("cd <PROJECT> && ls /tmp/pi-hypa-backup-<TIMESTAMP>", 2)]


def test_metadata_and_numbering_with_resume_artifacts(spark, log):
    entries = sessions.entries(spark, log)
    (m,) = sessions.session_metadata(entries, sessions.file_stats(spark, log)).collect()
    assert (m["session_id"], m["message_count"], m["user_turn_count"], m["tool_call_count"]) == ("s1", 7, 3, 6)
    assert m["fingerprint"] == f"{m['size_bytes']}:{m['mtime']}"
    turns = blindspot.user_turns(sessions.messages_from_entries(entries)).orderBy("turn_index").collect()
    assert [t["turn_index"] for t in turns] == [1, 2]


def test_lines_of_split_files_are_numbered_on(spark, tmp_path):
    for name, n in (("a", 500), ("b", 3), ("c", 0)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"type": "t", "id": str(i)}) + "\n" + "\n" * (i % 7 == 0) for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        log = sessions.entries(spark, str(tmp_path))
        got = {(r["session_file"], r["entry"]["id"]): r["line_no"] for r in log.collect()}
        assert log.rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {(f"{name}.jsonl", str(i)): i + (i + 6) // 7 for name, n in (("a", 500), ("b", 3)) for i in range(n)}


def test_packing_in_pieces_equals_one_fold(spark):
    rng = random.Random(6)
    policy = chunking.Policy(40, 80, 90)
    rows = [(p, s // 3 if p == "p" else s, s, rng.choice([0, 3, 10, 30, 45, 85])) for p in ("p", "q") for s in range(300)]
    want = {}
    for p in ("p", "q"):
        no, held, was = 0, 0, None
        for _, session, i, n in (r for r in rows if r[0] == p):
            if was is not None and ((session != was and held >= 40) or held + n > 80):
                no, held = no + 1, 0
            held, was = held + n, session
            want[p, i] = no
    got = chunking.pack(spark.createDataFrame(rows, "project string, session long, ord long, n_chars long"), policy).collect()
    assert {(r["project"], r["ord"]): r["chunk"] for r in got} == want


def test_malformed_lines_raise_or_give_null(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"type": "session"}\nnot json\n')
    with pytest.raises(Exception):  # noqa: B017
        sessions.entries(spark, str(tmp_path)).collect()
    assert sessions.entries(spark, str(tmp_path), strict=False).where("entry.type IS NULL").count() == 1


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("v")).first()["v"]


@pytest.mark.parametrize(("value", "want"), [(None, ""), ("a\r\nb\rc\x00\x7f\t", "a\nb\nc\t"), ("\x85x\x9f", "x")])
def test_sanitize(spark, value, want):
    assert one(spark, value, tx.sanitize) == want


@pytest.mark.parametrize("n", [159, 160, 161, 400])
def test_one_line_cuts_after_the_limit(spark, n):
    got = one(spark, "é" * n, lambda c: tx.one_line(c, 160))
    assert got == ("é" * n if n <= 160 else "é" * 159 + "…")


def test_one_line_of_wide_space(spark):
    assert one(spark, "　a　\n b ", lambda c: tx.one_line(c, 160)) == "a b"


def test_normalize(spark):
    assert one(spark, "See /home/me/x.py and `code` at https://a.b/c 12", tx.normalize) == "see <path> and <code> at <url> <num>"


@pytest.mark.parametrize(("c", "want"), [("pytest -q", False), ("python -m pytest", True), ("npm run build", True), ("build", False)])
def test_validation_markers(spark, c, want):
    assert one(spark, c, tx.is_validation_command) is want


def test_arrays(spark):
    row = spark.range(1).select(tx.collapse_runs(F.array(*map(F.lit, "aabba"))).alias("r"), tx.bullets(F.array().cast("array<string>")).alias("n"), tx.bullets(F.array(F.lit("x"))).alias("b")).first()
    assert (row["r"], row["n"], row["b"]) == (list("aba"), "- none", "- x")


@pytest.mark.parametrize(
    ("sizes", "same", "want"),
    [([30, 30, 30], False, [0, 0, 1]), ([30, 60], False, [0, 1]), ([30, 50], False, [0, 0]), ([45, 30], True, [0, 0]), ([85], False, [0])],
)
def test_packing(spark, sizes, same, want):
    rows = spark.createDataFrame([("p", 0 if same else i, i, n) for i, n in enumerate(sizes)], "project string, session long, ord long, n_chars long")
    got = chunking.pack(rows, chunking.Policy(40, 80, 90)).orderBy("ord").collect()
    assert [r["chunk"] for r in got] == want


def test_blocks_and_traces(spark):
    text = '[user]\nfix login\n[assistant]\n* Read "src/a.py"\n* Edit "src/a.py"\n* Bash "pytest   -q"'
    parts = text.split("\n[assistant]")
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = chunking.blocks(docs).where("doc_id = 1").orderBy("block").collect()
    assert [(b["line_start"], b["line_end"]) for b in got] == [(1, 2), (3, 6)]
    assert [b["n_chars"] for b in got] == [len(parts[0]), len("[assistant]" + parts[1])]
    t = chunking.traces(docs).where("doc_id = 1").first()
    assert (t["referenced"], t["changed"], t["commands"]) == (["src/a.py"], ["src/a.py"], ["pytest -q"])
    assert chunking.blocks(docs).where("doc_id > 1").count() == 0


@pytest.mark.parametrize(("text", "want"), [
    ("", []), ("a", [(1, 1, 1)]), ("a\n", [(1, 1, 2)]), ("\n", [(1, 1, 0)]), ("a\r\nb", [(1, 2, 3)]), ("  [user] x\ny\n\n[assistant]\n", [(1, 3, 14), (4, 4, 12)]),
    ("x\n[user]\ny", [(1, 1, 1), (2, 3, 8)]), ("x\u2028[user]", [(1, 1, 1), (2, 2, 6)]), ("\n[user]\n", [(1, 1, 0), (2, 2, 7)]),
])
def test_blocks_by_hand(spark, text, want):
    got = chunking.blocks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("block").collect()
    assert [(b["line_start"], b["line_end"], b["n_chars"]) for b in got] == want


def test_chunk_record_by_hand(spark):
    """Two sessions in one chunk: the first whole, the second cut into two segments."""
    first, second = "[user]\nshort\n", "[user]\n" + "a" * 40 + "\n[assistant]\n" + "b" * 40
    texts = spark.createDataFrame([("s1_x", first), ("s2_y", second)], "session string, text string")
    policy = chunking.Policy(least=500, soft=1000, hard=60)
    whole, rows = chunking.sizes(texts, "session"), chunking.blocks(texts, "session")
    cut = chunking.block_segments(rows, whole, policy, "session")
    listed = sorted(map(tuple, chunking.segments(cut, whole, "session").select("session", "segment", "n_chars", "line_start", "line_end").collect()))
    assert listed == [("s1_x", 0, 13, 1, 3), ("s2_y", 0, 47, 1, 2), ("s2_y", 1, 52, 3, 4)]
    packed = spark.createDataFrame([("p", s, n, i, a, b, 4) for i, (s, n, _, a, b) in enumerate(listed)], "project string, session string, segment long, ord long, line_start int, line_end int, chunk long")
    about = spark.createDataFrame([("s1_x", "s1", "s1", "/m/1", "/t/1", None, ["r", "q"], [], ["c"]), ("s2_y", "s2", "s2", "/m/2", None, "y.jsonl", ["q", "z"], ["w"], [])], "session string, start_time string, end_time string, min_path string, txt_path string, source_jsonl string, referenced array<string>, changed array<string>, commands array<string>")
    r = chunking.chunk_records(packed, chunking.segment_texts(cut, texts, "session"), about).first()
    fence = lambda s, m, t, span, text: f"### Session {s}\n- min: `{m}`\n- txt: `{t}`\n- line_range: `{span}`\n\n```text\n{text}\n```\n"
    content = "# chunk_005\n\n## Sources\n\n" + "\n".join([
        fence("s1_x", "/m/1", "/t/1", "1-3", "[user]\nshort"), fence("s2_y", "/m/2", "n/a", "1-2", "[user]\n" + "a" * 40), fence("s2_y", "/m/2", "n/a", "3-4", "[assistant]\n" + "b" * 40),
    ])
    assert r["content"] == content and r["n_chars"] == len(content) and r["line_count"] == content.count("\n") + 1
    assert r["content_hash"] == hashlib.sha256(content.encode()).hexdigest() and r["tokens"] == -(-len(content) // 4)
    assert (r["chunk_id"], r["source_sessions"], r["source_files"], r["start_time"], r["end_time"]) == ("chunk_005", ["s1_x", "s2_y"], ["y.jsonl"], "s1", "s2")
    assert (r["referenced"], r["changed"], r["commands"], r["relevance"]) == (["r", "q", "z"], ["w"], ["c"], "high")


def test_chunk_files_and_prompts(spark, tmp_path):
    rows = spark.createDataFrame([("p", "chunk_001", "# a\n"), ("p", "chunk_002", "# b\n")], "project string, chunk_id string, content string")
    chunking.write_chunk_files(rows, str(tmp_path))
    assert {f.name: f.read_text() for f in (tmp_path / "p").iterdir()} == {"chunk_001.md": "# a\n", "chunk_002.md": "# b\n"}
    assert runners.chunk_prompt("Read {{CHUNK_FILE}}, {{OTHER}}.\n\n", "/c.md", "v1") == "Read /c.md, {{OTHER}}.\n\n---\nPrompt version: v1\n"
    assert runners.build_runner("fake") is runners.stand_in
    with pytest.raises(ValueError, match="unsupported"):
        runners.build_runner("other")


def test_synthesis_packet_by_hand(spark):
    rows = [("p", 0, "chunk_001", ["s1", "s2"], "low", "completed", "/r/1", " one\n"), ("p", 1, "chunk_002", [], "high", "cached", None, "two"), ("p", 2, "chunk_003", ["s3"], "high", "failed", "/r/3", "no")]
    reports = spark.createDataFrame(rows, "project string, chunk long, chunk_id string, source_sessions array<string>, relevance string, status string, report_path string, report string")
    want = "# Synthesis packet\n\n## Used chunk reports\n\n### chunk_002\n- relevance: high\n- source_sessions: none\n- report_path: missing\n\ntwo\n\n## Ignored or lower-weight chunks\n\n- chunk_001: relevance=low report=/r/1\n"
    assert chunking.synthesis_input(reports).first()["packet"] == want
    stats = chunking.run_stats(reports).first()
    assert tuple(stats) == ("p", 3, 1, 1, 1, 0) and tuple(chunking.run_stats(reports, "chunk_002").first()) == ("p", 1, 0, 1, 0, 2)
    with pytest.raises(ValueError, match="no such chunk"):
        chunking.run_stats(reports, "chunk_009")
    r = chunking.synthesis_rollup(reports).first()
    assert (r["used_chunk_ids"], r["ignored_chunk_ids"], r["ignored_report_paths"]) == (["chunk_002"], ["chunk_001"], ["/r/1"])


CASES = [
    ("先别直接改代码，先看设计方案再判断", []),
    ("更新 README 和包页", ["readme-display-scope-clarify"]),
    ("改 README 预览图然后发布", ["readme-display-scope-clarify", "preview-before-release", "publish-confirm"]),
    ("commit 一下", ["publish-confirm"]),
    ("用 curl 验证网络", ["network-validation-clarify"]),
    ("验证 readonly 模式", ["sandbox-mode-clarify"]),
    ("不要 push，先放着", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_reminder_cases(spark, text, want):
    turns = spark.createDataFrame([("s", 1, text)], "session_file string, turn_index int, text string")
    found = reminders.matches(turns, reminders.GUIDE_RULES)
    assert sorted(r["rule_id"] for r in found.collect()) == sorted(want)
    shown = [r["rule_id"] for r in reminders.visible(found).collect()]
    assert shown == ["publish-confirm"] if "publish-confirm" in want else len(shown) == min(2, len(want))


def test_cooldown_once_per_session(spark):
    turns = spark.createDataFrame([("s", i, "设计方案请判断") for i in (1, 2)] + [("t", 1, "设计方案请判断")], "session_file string, turn_index int, text string")
    got = reminders.cooled(reminders.matches(turns, reminders.GUIDE_RULES)).collect()
    assert sorted((r["session_file"], r["turn_index"]) for r in got) == [("s", 1), ("t", 1)]


def test_guide_rules_follow_the_guide():
    assert [r.id for r in reminders.rules_for_guide("about HTTP")] == ["network-validation-clarify"]


def test_incremental_equals_full(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "session_file string, fingerprint string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "session_file string, fingerprint string")
    diff = incremental.index_diff(before, now)
    assert {r["session_file"]: r["status"] for r in diff.collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "new"}
    work = incremental.worklist(diff, now, before)
    assert {r["session_file"] for r in work.collect()} == {"b", "d"}
    assert incremental.has_changes(incremental.index_diff(before, before.where("session_file <> 'c'")))  # a deletion alone is a change
    assert not incremental.has_changes(incremental.index_diff(now, now))


def test_partials_add_up(spark):
    calls = sessions.tool_calls_from_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    some, rest = calls.where("session < '5'"), calls.where("session >= '5'")
    split = workflow.finals(workflow.partials(some).unionByName(workflow.partials(rest)))
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, workflow.finals(workflow.partials(calls)).collect()))


def test_validation_by_hand(spark):
    text = 'x ```json {"raw_score": 36.125, "passed": false, "must_fix": ["m"], "dimension_scores": {"Signal": 7}, "which_chunk_overweighted": ["chunk_002"], "rewrite_direction": {"patterns.md": ["shorter", "cite"], "other": []}} ```'
    v = one(spark, text, runners.parse_validation)
    assert (v["score"], v["passed"], v["summary"], v["rubric"], v["must_fix"], v["overweighted"]) == (36.12, True, "通过", {"Signal": 7.0}, ["m"], ["chunk_002"])
    assert v["critique"].splitlines() == [
        "# Self-validation critique (score 36.12/50)", "", "- summary: 通过", "- dimension_scores:", "  - Signal: 7.0", "- must_fix:", "  - m", "- which_chunk_overweighted:", "  - chunk_002",
        "- rewrite_direction:", "  - patterns.md:", "    - shorter", "    - cite", "  - other:", "- threshold: 35.0", "- passed: True",
    ]
    v = one(spark, "no", runners.parse_validation)
    assert (v["score"], v["passed"], v["summary"], v["rubric"]) == (0.0, False, "未通过", {})


def test_bundle_by_hand(spark):
    text = "\n=== project_context.md ===\n a\n\n=== collaboration_guide.md ===\nb\n=== patterns.md ===\nc\n"
    assert one(spark, text, runners.split_bundle) == {"project_context.md": "a", "collaboration_guide.md": "b", "patterns.md": "c"}
    assert one(spark, text.replace("b\n", " \n"), runners.split_bundle) is None and one(spark, "a", runners.split_bundle) is None


def test_rules_document_round_trip():
    made = reminders.generated("先谈设计\n  边界要清楚 \n别的")
    assert [(r["id"], r["evidence"]) for r in made["rules"]] == [("design-boundary-clarify", ["先谈设计", "边界要清楚"])]
    (rule,) = reminders.loaded(made)
    assert rule.all_groups == reminders.GUIDE_RULES[0].all_groups
    made["rules"][0]["enabled"] = False
    assert reminders.loaded(made) == [] and reminders.loaded({"default_enabled": False, "rules": [{"id": "a", "mode": "notify", "message": "m"}]}) == []


def test_confirm_rank_by_hand(spark):
    """Ten for the mode, three for high confidence, one for the term."""
    turns = spark.createDataFrame([("s", 1, "please push it")], "session_file string, turn_index int, text string")
    assert [(r["rule_id"], r["rank"]) for r in reminders.matches(turns, reminders.GUIDE_RULES).collect()] == [("publish-confirm", 14)]


@pytest.mark.parametrize("rare", [0, 4, 12])
def test_similar_pairs_in_blocks_equal_plain_products(spark, monkeypatch, rare):
    monkeypatch.setattr(phrases, "SIMILAR_RARE", rare)
    monkeypatch.setattr(phrases, "SIMILAR_BLOCK", 7)
    monkeypatch.setattr(phrases, "SIMILAR_COLUMNS", 5)
    rng = random.Random(3)
    vectors = {}
    for i in range(40):
        w = {f"g{rng.randrange(12)}": rng.random() for _ in range(4)}
        n = sum(x * x for x in w.values()) ** 0.5
        vectors[f"t{i:02}"] = {g: x / n for g, x in w.items()}
    df = spark.createDataFrame([(k, g, x) for k, v in vectors.items() for g, x in v.items()], "turn string, gram string, w double")
    want = {(a, b): round(sum(x * vectors[b].get(g, 0) for g, x in vectors[a].items()), 6) for a in vectors for b in vectors if a < b}
    got = {(r["a"], r["b"]): r["similarity"] for r in phrases.similar_pairs(df, "turn").collect()}
    assert got == pytest.approx({p: x for p, x in want.items() if x >= phrases.SIMILAR}) and len(got) > 50


def test_cluster_report_by_hand(spark):
    rows = [("a", "x", 1.0), ("b", "x", 0.6), ("b", "y", 0.8), ("c", "x", 0.8), ("c", "y", 0.6), ("d", "z", 1.0)]
    weights = spark.createDataFrame(rows, "turn string, gram string, w double")
    members = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a"), ("d", None)], "turn string, cluster string")
    (r,) = phrases.cluster_report(weights, members, "turn", examples=2).collect()
    assert (r["cluster"], r["size"], r["top_terms"], r["examples"]) == ("a", 3, ["x", "y"], ["c", "b"])


def test_synthesis_stops_when_it_passes():
    scores = iter([20.0, 36.0, 50.0])
    got = runners.synthesise("p", runners.stand_in, lambda _: next(scores))
    assert (got["attempt"], got["status"]) == (2, "completed")
    assert runners.synthesise("p", runners.stand_in, lambda _: 1.0)["status"] == "needs_review"
    assert sum(runners.rubric_scores(50).values()) == 50


def test_a_failing_model_leaves_a_row(spark):
    def fails(request):
        raise RuntimeError("no model")

    (r,) = runners.map_chunks(spark.createDataFrame([(1, "t")], "chunk_id long, text string"), fails).collect()
    assert (r["status"], r["report"]) == ("failed", "no model")


def test_packet_is_json(spark, tmp_path):
    doc = packet.packet({"tools": spark.createDataFrame([("a", 1)], "tool string, n long")})
    packet.write_json(doc, str(tmp_path / "p.json"))
    assert json.loads((tmp_path / "p.json").read_text()) == {"tools": [{"tool": "a", "n": 1}]}  # its layout: test_programs.py
