"""Workflow mining: turns of tool calls, their counters and the patterns that repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_runs, is_validation_command, turn_ref
from .corrections import first_refs

READ_TOOLS = ["read", "hypa_read"]


def turns(calls: DataFrame, first: bool = False) -> DataFrame:
    """One row per turn: tools in order, the sequence without repeats, paths by use, commands; with ``first`` also the least ord."""
    each = calls.groupBy("session", "turn").agg(F.array_sort(F.collect_list(F.struct("ord", "tool", "path", "command"))).alias("c"))

    def pick(field: str, tools: list[str] | None) -> Column:
        own = F.filter("c", lambda x: x[field].isNotNull() & (x["tool"].isin(*tools) if tools else F.lit(True)))
        return F.transform(own, lambda x: x[field])

    tools = F.transform("c", lambda x: x["tool"])
    return each.select("session", "turn", tools.alias("tools"), collapse_runs(tools).alias("sequence"), pick("path", READ_TOOLS).alias("read_paths"), pick("path", ["edit"]).alias("edit_paths"), pick("path", ["write"]).alias("write_paths"), pick("command", None).alias("commands"), *([F.col("c")[0]["ord"].alias("ord")] if first else []))


def counts(calls: DataFrame, key: str) -> DataFrame:
    return calls.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def top(rows: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent, ties by first appearance (a top-k report)."""
    return rows.orderBy(F.desc("n"), "first").limit(k)


def frequent_commands(calls: DataFrame, k: int = 20, least: int = 2) -> DataFrame:
    """Of the k most frequent commands those that were given ``least`` times or more (a top-k report)."""
    rows = calls.where(F.col("command").isNotNull()).groupBy("command").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("session", "turn", "ord")).alias("first"))
    return top(rows, k).where(F.col("n") >= least).select("command", "n")


def project_totals(calls: DataFrame) -> DataFrame:
    """One row: sessions, turns with calls, calls, distinct tools, paths and commands."""
    return calls.agg(
        F.countDistinct("session").alias("n_sessions"), F.countDistinct("session", "turn").alias("n_turns"), F.count(F.lit(1)).alias("n_calls"),
        F.countDistinct("tool").alias("n_tools"), F.countDistinct("path").alias("n_paths"), F.countDistinct("command").alias("n_commands"),
    )


def sequences(turn_rows: DataFrame) -> DataFrame:
    own = turn_rows.where(F.size("sequence") > 0)
    return own.groupBy("sequence").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("session", "turn")).alias("first"))


#: Turns that a partial keeps of each key, and references that its final one has.
KEPT_TURNS = 5


def partials(calls: DataFrame) -> DataFrame:
    """Counters by session, as kept between runs: session, kind, name, tool, n, first (turn, ord) and the first five turns.

    Kinds are tool, path, command, tool_path (with its tool), sequence, read_edit and edit_validate. What
    two tables of partials count of different sessions, their union counts as well.
    """
    none = F.lit(None).cast("string")
    item = lambda kind, name, tool=none: F.struct(F.lit(kind).alias("kind"), name.alias("name"), tool.alias("tool"))
    path = F.col("path")
    said = F.array(item("tool", F.col("tool")), item("path", path), item("command", F.col("command")), item("tool_path", path, F.when(path.isNotNull(), F.col("tool"))))
    by_call = calls.select("session", "turn", "ord", F.explode(F.filter(said, lambda x: x["name"].isNotNull())).alias("i")).select("session", "turn", "i.*", "ord")
    by_call = by_call.groupBy("session", "kind", "name", "tool", "turn").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
    whole = turns(calls, first=True).where(F.size("sequence") > 0).select("session", "turn", F.struct(F.lit("sequence").alias("kind"), F.array_join("sequence", ">").alias("name"), none.alias("tool")).alias("i"), "ord")
    both = F.filter(F.array(F.when((F.col("reads") > 0) & (F.col("edits") > 0), item("read_edit", path)), F.when(F.col("validated") & F.col("edited") & (F.col("edits") + F.col("writes") > 0), item("edit_validate", path))), lambda x: x.isNotNull())
    used = path_turns(calls).select("session", "turn", F.explode(both).alias("i"), "ord")
    by_turn = whole.unionByName(used).select("session", "i.*", "turn", F.lit(1).cast("long").alias("n"), "ord")
    key = ["session", "kind", "name", "tool"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("turn"))
    kept = F.array_sort(F.collect_list(F.when(F.col("rank") <= KEPT_TURNS, F.col("turn")))).alias("turns")
    return by_call.unionByName(by_turn).withColumn("rank", rank).groupBy(*key).agg(F.sum("n").alias("n"), F.min(F.struct("turn", "ord")).alias("first"), kept)


def finals(parts: DataFrame) -> DataFrame:
    """kind, name, tool, n, n_sessions and the first appearance of every key; sums and least values, whatever the order of the partials."""
    first = F.min(F.struct("session", F.col("first.turn").alias("turn"), F.col("first.ord").alias("ord"))).alias("first")
    return parts.groupBy("kind", "name", "tool").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_sessions"), first)


def top_counters(final: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent names of each kind, ties by first appearance: kind, place, name, n (a top-k report)."""
    order = Window.partitionBy("kind").orderBy(F.desc("n"), "first")
    return final.where("tool IS NULL").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("kind", "place", "name", "n")


def kept_refs(parts: DataFrame, kind: str) -> DataFrame:
    """name and the first five references (``evidence``) of a kind's keys; a key's first five sessions hold them."""
    order = Window.partitionBy("name").orderBy("session")
    some = parts.where(F.col("kind") == kind).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= KEPT_TURNS)
    refs = F.transform("turns", lambda t: turn_ref(F.col("session"), t)).alias("refs")
    held = some.select("name", "rank", refs).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("rank", "refs"))).alias("held"))
    return held.select("name", F.slice(F.flatten(F.transform("held", lambda h: h["refs"])), 1, KEPT_TURNS).alias("evidence"))


def candidates_of(parts: DataFrame) -> DataFrame:
    """All candidate patterns from stored partials: the same rows as ``candidates`` has from the calls."""
    final = finals(parts)
    of = lambda kind, tools=None: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("tool").isin(*tools) if tools else F.lit(True)), F.col("n"))), F.lit(0))
    stats = final.where("kind IN ('path', 'tool_path', 'read_edit', 'edit_validate')").groupBy(F.col("name").alias("path")).agg(
        of("path").alias("interactions"), of("tool_path", READ_TOOLS).alias("read_count"), of("tool_path", ["edit", "write"]).alias("edit_count"), of("read_edit").alias("read_edit"), of("edit_validate").alias("edit_validate"),
        F.array_sort(F.collect_set("tool")).alias("tools"), F.min(F.when(F.col("kind") == "path", F.struct("first.session", "first.turn"))).alias("first"),
    )
    files = warm(stats).join(kept_refs(parts, "path").withColumnRenamed("name", "path"), "path")
    own = lambda kind: final.where((F.col("kind") == kind) & (F.col("n") >= 2)).join(kept_refs(parts, kind), "name")
    length = F.size(F.split("name", ">"))
    seqs = own("sequence").where(length >= 2).withColumn("confidence", F.when(length == 2, "medium").otherwise("low"))
    return _candidates(files, seqs, own("command").withColumn("confidence", F.lit("medium")))


def path_turns(calls: DataFrame) -> DataFrame:
    """Uses of each path in each turn, with what the turn did: one table that all path counters come from."""
    turn = Window.partitionBy("session", "turn")
    flagged = calls.select(
        "session", "turn", "ord", "tool", "path",
        F.max(F.coalesce(is_validation_command(F.col("command")), F.lit(False))).over(turn).alias("validated"),
        F.max((F.col("tool") == "edit") & F.col("path").isNotNull()).over(turn).alias("edited"),
    ).where("path IS NOT NULL")
    return flagged.groupBy("session", "turn", "path").agg(
        F.count(F.lit(1)).alias("uses"),
        F.count_if(F.col("tool").isin(*READ_TOOLS)).alias("reads"),
        F.count_if(F.col("tool") == "edit").alias("edits"),
        F.count_if(F.col("tool") == "write").alias("writes"),
        F.collect_set("tool").alias("tools"),
        F.first("validated").alias("validated"),
        F.first("edited").alias("edited"),
        F.min("ord").alias("ord"),
    )


def path_stats(calls: DataFrame) -> DataFrame:
    rows = path_turns(calls)
    return rows.groupBy("path").agg(
        F.sum("uses").alias("interactions"),
        F.sum("reads").alias("read_count"),
        (F.sum("edits") + F.sum("writes")).alias("edit_count"),
        F.count_if((F.col("reads") > 0) & (F.col("edits") > 0)).alias("read_edit"),
        F.count_if(F.col("validated") & F.col("edited") & (F.col("edits") + F.col("writes") > 0)).alias("edit_validate"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tools")))).alias("tools"),
        F.min(F.struct("session", "turn")).alias("first"),
    )


def warm(stats: DataFrame) -> DataFrame:
    """Of paths with their counters those that are used often and in more than one way, with a confidence."""
    dotted = F.contains(F.element_at(F.split("path", "/"), -1), F.lit("."))
    few = F.size("tools") < 2
    s = stats.where("interactions >= 3 AND read_count + edit_count > 0").where(dotted | (F.col("edit_count") > 0) | (F.col("read_count") >= 2)).where(~few | (F.col("read_edit") > 0) | (F.col("edit_validate") > 0))
    high = (F.col("read_edit") >= 2) | (F.col("edit_validate") >= 2) | ((F.col("read_count") >= 3) & (F.col("edit_count") >= 3))
    return s.withColumn("confidence", F.when(high, "high").otherwise("medium"))


def hot_files(calls: DataFrame) -> DataFrame:
    """Paths that are used often and in more than one way, with a confidence and five references."""
    refs = first_refs(path_turns(calls), ["path"], ["session", "turn"], turn_ref(F.col("session"), F.col("turn")), 5, "evidence")
    return warm(path_stats(calls)).join(refs, "path")


def repeated_sequences(turn_rows: DataFrame) -> DataFrame:
    own = sequences(turn_rows).where("n >= 2").where(F.size("sequence") >= 2)
    refs = first_refs(turn_rows, ["sequence"], ["session", "turn"], turn_ref(F.col("session"), F.col("turn")), 5, "evidence")
    return own.withColumn("confidence", F.when(F.size("sequence") == 2, "medium").otherwise("low")).join(refs, "sequence")


def repeated_commands(calls: DataFrame) -> DataFrame:
    rows = calls.where("command IS NOT NULL")
    own = rows.groupBy("command").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("session", "turn", "ord")).alias("first")).where("n >= 2")
    turn_rows = rows.select("command", "session", "turn").distinct()
    refs = first_refs(turn_rows, ["command"], ["session", "turn"], turn_ref(F.col("session"), F.col("turn")), 5, "evidence")
    return own.withColumn("confidence", F.lit("medium")).join(refs, "command")


def candidates(calls: DataFrame) -> DataFrame:
    """All candidate patterns in one table: type, name, n, confidence, evidence, and columns to order by."""
    seqs = repeated_sequences(turns(calls)).withColumn("name", F.array_join("sequence", ">"))
    return _candidates(hot_files(calls), seqs, repeated_commands(calls).withColumnRenamed("command", "name"))


def _candidates(files: DataFrame, seqs: DataFrame, cmds: DataFrame) -> DataFrame:
    weight = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0).alias("weight")
    seen = F.struct(*[F.lit(None).cast("long").alias(c) for c in ("read_count", "edit_count", "read_edit", "edit_validate")], F.lit(None).cast("array<string>").alias("tools"))
    cols = lambda kind, rank, name, n, observed: [F.lit(kind).alias("type"), F.col(name).alias("name"), F.col(n).alias("n"), "confidence", "evidence", observed.alias("observed"), weight, F.lit(rank).alias("type_rank"), F.struct("first.session", "first.turn").alias("first")]
    hot = files.select(*cols("hot_file_workflow", 0, "path", "interactions", F.struct("read_count", "edit_count", "read_edit", "edit_validate", "tools")))
    return hot.unionByName(seqs.select(*cols("repeated_tool_sequence", 1, "name", "n", seen))).unionByName(cmds.select(*cols("repeated_command", 2, "name", "n", seen)))


def in_order(rows: DataFrame) -> DataFrame:
    """Candidates in the order of a report: the surest, then the most frequent, then files, sequences and commands by first appearance."""
    return rows.orderBy(F.desc("weight"), F.desc("n"), "type_rank", "first", "name")


def representative_turns(calls: DataFrame, k: int = 8) -> DataFrame:
    """The k turns that stand for the patterns: their evidence in order, then the busiest (a top-k report)."""
    rank = F.struct((-F.col("weight")).alias("w"), (-F.col("n")).alias("n"), "type_rank", "first", "name")
    refs = candidates(calls).select(rank.alias("rank"), F.posexplode(F.slice("evidence", 1, 4)).alias("place", "ref"))
    refs = refs.groupBy("ref").agg(F.min(F.struct("rank", "place")).alias("order")).orderBy("order").limit(k)
    rows = turns(calls).withColumn("ref", turn_ref(F.col("session"), F.col("turn")))
    score = F.size("commands") * 3 + F.size("edit_paths") * 3 + F.size("write_paths") * 2 + F.size("sequence")
    scored = rows.select("ref", "session", "turn", score.cast("long").alias("score")).where("score > 0")
    from_patterns = refs.join(scored, "ref").select(F.lit(0).alias("source"), "order", "ref", "session", "turn", "score")
    busiest = scored.join(F.broadcast(refs.select("ref")), "ref", "left_anti").orderBy(F.desc("score"), "session", "turn").limit(k)  # k rows at most are broadcast
    both = from_patterns.unionByName(busiest.withColumn("source", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("source", "order", F.desc("score"), "session", "turn").limit(k).select("source", "session", "turn", "score")
