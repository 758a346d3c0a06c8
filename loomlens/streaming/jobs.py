"""Structured Streaming forms: corrections kept per session, and session cooldown of reminders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.shipping import ship
from ..operators import corrections, reminders
from ..plans.versioned import Table, Version


def _events_table(spark: SparkSession, folder: str, buckets: int) -> Table:
    fields = corrections.events(spark.createDataFrame([], "session_file string, line_no int, role string, text string, tool_calls int")).schema
    return Table(spark, folder, {"events": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)}, "session_file", buckets)


def maintain_corrections(messages: DataFrame, full: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Recomputes the events of sessions with new messages; ``full`` reads all messages of given sessions.

    Each batch replaces all rows of its sessions, in the buckets that hold them, and becomes visible as a whole; a session
    that has no events any more loses its old ones, and a replayed batch changes nothing.
    """
    spark = messages.sparkSession
    table = _events_table(spark, folder, buckets)

    def batch(rows: DataFrame, number: int) -> None:
        sessions = rows.select("session_file").distinct().persist()
        touched = [r["bucket"] for r in sessions.select(table.bucket().alias("bucket")).distinct().collect()]  # at most one row per bucket
        if touched:
            fresh = corrections.events(full(sessions))

            def step(version: Version) -> Version:
                kept = table.read("events", version, touched).join(sessions, "session_file", "left_anti")
                return table.replace(version, {"events": kept.unionByName(fresh)}, touched, f"batch {number}")

            table.change(step)
        sessions.unpersist()

    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintained_corrections(spark: SparkSession, folder: str, buckets: int = 64) -> DataFrame:
    """The events that ``maintain_corrections`` keeps."""
    return _events_table(spark, folder, buckets).read("events")


#: How long a session's seen rules are kept after they last matched.
SEEN_MS = 7 * 24 * 3600 * 1000
#: The state store that has maps and expiry.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Cooldown(StatefulProcessor):
    """Lets a session_once rule through once per session: a map from seen rules to the turn that showed them, each entry with an expiry."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "rule_id string", "turn_index int", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # a session's matches of one batch, in order of turns
        for r in sorted(rows, key=lambda r: (r["turn_index"], r["rule_id"])):
            if r["cooldown"] == "session_once":
                rule = (r["rule_id"],)
                again = self.seen.containsKey(rule)
                # a rule that matches again is kept for longer
                self.seen.updateValue(rule, self.seen.getValue(rule) if again else (r["turn_index"],))
                if again:
                    continue
            yield Row(session_file=r["session_file"], turn_index=r["turn_index"], rule_id=r["rule_id"])

    def close(self) -> None:
        pass


def cooled_matches(turns: DataFrame, rules: list[reminders.Rule] = reminders.TABLE_RULES, keep_ms: int = SEEN_MS) -> DataFrame:
    """Streaming matches after cooldown. State is one entry per session and seen rule, which goes ``keep_ms`` after its last match.

    A session that is silent for that long begins anew. Sets the state store that has such maps, if it is another one.
    """
    spark = turns.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    found = reminders.matches(turns, rules).select("session_file", "turn_index", "rule_id", "cooldown")
    return found.groupBy("session_file").transformWithState(Cooldown(keep_ms), "session_file string, turn_index int, rule_id string", "append", "processingTime")


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Tool calls per window of event time; late rows beyond the watermark are dropped by Spark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
