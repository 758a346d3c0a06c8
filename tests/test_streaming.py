from __future__ import annotations

import time

from loomlens.operators import corrections, reminders
from loomlens.sources import sessions
from loomlens.streaming import jobs

SF = "/root/testdata/sf0.001"


def consume(query, n, seconds=60):
    """Waits until ``n`` rows are done; a query whose state expires goes on with empty batches, and is stopped."""
    until = time.monotonic() + seconds
    try:
        while sum(p["numInputRows"] for p in query.recentProgress) < n:
            assert query.isActive and time.monotonic() < until, query.exception()
            time.sleep(0.2)
    finally:
        query.stop()


def test_stream_of_messages_maintains_the_events(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    messages = lambda df: sessions.messages_from_conversations(df)
    stream = messages(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = jobs.maintain_corrections(stream, lambda s: messages(table).join(s, "session_file", "left_semi"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    cols = ["session_file", "trigger_turn", "event_type", "confidence"]
    got = sorted(tuple(map(str, r)) for r in jobs.maintained_corrections(spark, str(tmp_path / "out")).select(*cols).collect())
    assert got == sorted(tuple(map(str, r)) for r in corrections.events(messages(table)).select(*cols).collect())


def test_a_session_without_events_loses_its_old_ones(spark, tmp_path):
    schema = "session_file string, line_no int, role string, text string, tool_calls int"
    talk = lambda s, last: [(s, 0, "user", "do it", 0), (s, 1, "assistant", "done", 1), (s, 2, "user", last, 0)]
    state = {"rows": talk("a", "no, that one") + talk("b", "no, that one")}

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = jobs.maintain_corrections(stream, lambda s: spark.createDataFrame(state["rows"], schema).join(s, "session_file", "left_semi"), str(tmp_path / "out"), str(tmp_path / "cp"), 4)
        assert query.awaitTermination(90)
        return sorted(r["session_file"] for r in jobs.maintained_corrections(spark, str(tmp_path / "out"), 4).collect())

    assert run(state["rows"]) == ["a", "b"]
    state["rows"] = talk("a", "thanks") + talk("b", "no, that one")
    assert run(talk("a", "thanks")) == ["b"]


def test_cooldown_state_shows_a_rule_once(spark, tmp_path):
    rows = [("s", i, "diese tion that") for i in range(4)] + [("t", 0, "tion that orth")]
    spark.createDataFrame(rows, "session_file string, turn_index int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session_file string, turn_index int, text string").parquet(str(tmp_path / "in"))
    query = jobs.cooled_matches(stream).writeStream.format("memory").queryName("cooled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    consume(query, len(rows))
    got = sorted((r["session_file"], r["turn_index"], r["rule_id"]) for r in spark.table("cooled").collect())
    batch = reminders.cooled(reminders.matches(spark.createDataFrame(rows, "session_file string, turn_index int, text string")))
    assert got == sorted((r["session_file"], r["turn_index"], r["rule_id"]) for r in batch.collect())


def test_seen_rules_outlive_batches_and_expire(spark, tmp_path):
    schema = "session_file string, turn_index int, text string"
    shown = []

    def batch(rows, _):
        shown.append(sorted((r["session_file"], r["turn_index"], r["rule_id"]) for r in rows.collect()))

    def say(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        found = jobs.cooled_matches(stream, rules, keep_ms=20_000)
        query = found.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "cp")).start()
        consume(query, len(rows))

    rules = [reminders.Rule(name, cooldown=name, message="m", any_terms=("tion",)) for name in ("session_once", "turn_once")]
    say([("s", 3, "tion"), ("s", 1, "tion"), ("t", 1, "none")])
    say([("s", 4, "tion"), ("t", 2, "tion")])
    time.sleep(22)
    say([("s", 5, "tion")])
    got = [b for b in shown if b]
    assert got[0] == [("s", 1, "session_once"), ("s", 1, "turn_once"), ("s", 3, "turn_once")]
    assert got[1] == [("s", 4, "turn_once"), ("t", 2, "session_once"), ("t", 2, "turn_once")]
    assert got[2] == [("s", 5, "session_once"), ("s", 5, "turn_once")]  # the session was silent for longer than seen rules are kept
