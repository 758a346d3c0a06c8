"""Correction events: a user turn that corrects what an assistant just did."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import CATEGORY_SUGGESTIONS, INVENTED_WORDS, MISSING_CONSTRAINT, PRIORITY, PatternSet, lookup, matched
from ..functions.text import first_line, is_resume_artifact, one_line, sanitize, turn_ref

PREVIEW = 160


def ordinals(messages: DataFrame) -> DataFrame:
    """User and assistant messages without resume artifacts, numbered by role within the session."""
    own = messages.where("role IN ('user', 'assistant')").where(~((F.col("role") == "user") & is_resume_artifact(F.col("text"))))
    by_role = Window.partitionBy("session_file", "role").orderBy("line_no")
    return own.withColumn("text", sanitize(F.col("text"))).withColumn("role_turn", F.row_number().over(by_role))


def confidence(n: Column, tools: Column) -> Column:
    """0.72 for one category and 0.06 for each more, up to four; 0.05 more after tool calls."""
    base = F.least(n, F.lit(4)) * 6 + 66
    return (base + F.when(tools > 0, 5).otherwise(0)).cast("double") / 100


def events(messages: DataFrame, patterns: PatternSet = INVENTED_WORDS) -> DataFrame:
    """All correction events. One exchange, by session; every look back or ahead is a window."""
    rows = ordinals(messages).withColumn("categories", F.when(F.col("role") == "user", matched(F.col("text"), patterns.categories, PRIORITY)))
    order = Window.partitionBy("session_file").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -2)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    user = F.when(F.col("role") == "user", F.struct("role_turn", "text", "categories"))
    seen = rows.select(
        "*",
        F.lag(F.struct("role", "text", "tool_calls")).over(order).alias("previous"),
        F.last(user, ignorenulls=True).over(before).alias("original"),
        F.coalesce(F.max(F.col("role") == "assistant").over(after), F.lit(False)).alias("answered"),
    )
    hit = seen.where((F.col("role") == "user") & (F.col("previous.role") == "assistant") & (F.size("categories") > 0) & F.col("original").isNotNull())
    kind, tools = F.get("categories", F.lit(0)), F.col("previous.tool_calls")
    line = first_line(F.col("text"))
    return hit.select(
        "session_file",
        F.col("role_turn").alias("trigger_turn"),
        kind.alias("event_type"),
        F.slice("categories", F.lit(2), F.size("categories")).alias("secondary_types"),
        F.col("original.role_turn").alias("original_user_turn"),
        one_line(F.col("original.text"), PREVIEW).alias("original_user_preview"),
        one_line(F.col("previous.text"), PREVIEW).alias("assistant_preview"),
        tools.alias("assistant_tool_calls"),
        one_line(F.col("text"), PREVIEW).alias("evidence"),
        F.when(F.length(line) <= 40, line).otherwise(lookup(kind, MISSING_CONSTRAINT)).alias("missing_constraint"),
        F.when(tools > 0, "assistant_already_executed").when(F.col("answered"), "answer_revised").otherwise("correction_without_revision").alias("impact"),
        (~F.array_contains("original.categories", kind)).alias("avoidable"),
        confidence(F.size("categories"), tools).alias("confidence"),
        lookup(kind, CATEGORY_SUGGESTIONS).alias("suggestion"),
    )


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def ranked(counts: DataFrame, name: str) -> DataFrame:
    """Counts of a bounded set of names with their place: the largest first, ties by name."""
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), name)))


def first_refs(rows: DataFrame, keys: list[str], order: list[str], ref: Column, k: int, name: str) -> DataFrame:
    """The first k references of each key in order, as an array: ranks first, so no group is ever collected whole."""
    w = Window.partitionBy(*keys).orderBy(*order)
    top = rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).select(*keys, "_rank", ref.alias("_ref"))
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_ref"))), lambda x: x["_ref"]).alias(name))


EVENT_ORDER = ["session_file", "trigger_turn", "original_user_turn", "event_type"]


def profile(rows: DataFrame) -> DataFrame:
    """Per event type: events, sessions, a bucket of the mean confidence and the first four references."""
    hundredths = F.round(F.col("confidence") * 100).cast("long")
    counts = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("session_file").alias("n_sessions"), F.sum(hundredths).alias("hundredths"))
    mean = F.col("hundredths") / F.col("n_events")
    bucket = F.when(mean >= 86, "high").when(mean >= 76, "medium").otherwise("low")
    refs = first_refs(rows, ["event_type"], EVENT_ORDER, turn_ref(F.col("session_file"), F.col("trigger_turn")), 4, "refs")
    return counts.join(refs, "event_type").select("event_type", "n_events", "n_sessions", bucket.alias("confidence"), "refs", lookup(F.col("event_type"), CATEGORY_SUGGESTIONS).alias("suggestion"))


#: Profile names by the event type that supports them.
PROFILE_NAMES = {"late_constraint": "constraints_arrive_late", "direction_mismatch": "semantic_alignment_needs_repair", "verbosity_mismatch": "prefers_dense_brief_answers"}


def user_profiles(rows: DataFrame) -> DataFrame:
    """Profiles with two events at least: confidence high from four on, first four references."""
    p = profile(rows.where(F.col("event_type").isin(*PROFILE_NAMES))).where("n_events >= 2")
    return p.select(lookup(F.col("event_type"), PROFILE_NAMES).alias("name"), F.when(F.col("n_events") >= 4, "high").otherwise("medium").alias("confidence"), F.col("refs").alias("support"), F.col("suggestion").alias("user_suggestion"))


def representative(rows: DataFrame, k: int = 12) -> DataFrame:
    """The k events of highest confidence and most tool calls (a top-k report)."""
    return rows.orderBy(F.desc("confidence"), F.desc("assistant_tool_calls"), "session_file", "trigger_turn").limit(k)
