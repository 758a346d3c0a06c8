"""User turns, rule hits, correction chains and the profile built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import INVENTED_WORDS, RULE_TEXTS, PatternSet, lookup, matched
from ..functions.text import is_resume_artifact, normalize, one_line, sanitize
from .corrections import first_refs

PREVIEW = 180


def user_turns(messages: DataFrame, cwd: str = "") -> DataFrame:
    """User turns numbered before resume artifacts are dropped, with preview and normalised text."""
    order = Window.partitionBy("session_file").orderBy("line_no")
    rows = messages.where("role = 'user'").withColumn("turn_index", F.row_number().over(order)).where(~is_resume_artifact(F.col("text")))
    text = sanitize(F.col("text"))
    return rows.select("session_file", "turn_index", text.alias("text"), one_line(F.col("text"), PREVIEW).alias("preview"), normalize(F.col("text"), cwd).alias("normalized"))


def with_labels(turns: DataFrame, patterns: PatternSet = INVENTED_WORDS) -> DataFrame:
    """Each turn's rule labels; the rule of late constraints holds from the second turn on."""
    labels = matched(F.col("text"), patterns.rules)
    late = F.filter(labels, lambda x: (x != patterns.late_rule) | (F.col("turn_index") > 1))
    return turns.withColumn("labels", late)


def rule_hits(labelled: DataFrame) -> DataFrame:
    return labelled.select("session_file", "turn_index", "preview", F.explode("labels").alias("label"))


def rule_summary(hits: DataFrame, k: int = 6) -> DataFrame:
    ref = F.concat_ws("#", "session_file", F.col("turn_index").cast("string"))
    refs = first_refs(hits, ["label"], ["session_file", "turn_index"], ref, k, "examples")
    counts = hits.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    texts = {k: v[0] for k, v in RULE_TEXTS.items()}
    return counts.join(refs, "label").select("label", "n", "examples", lookup(F.col("label"), texts).alias("description"))


def chains(labelled: DataFrame, patterns: PatternSet = INVENTED_WORDS, later: int = 6, turns: int = 12) -> DataFrame:
    """Sessions in which a turn after the first kept one brings a constraint.

    "After the first" goes by position among kept turns, not by number. Only the first few turns of
    a session are gathered, ranked by a window.
    """
    order = Window.partitionBy("session_file").orderBy("turn_index")
    hit = F.arrays_overlap("labels", F.array(*[F.lit(x) for x in patterns.chain_rules]))
    rows = labelled.select("session_file", "turn_index", "preview", hit.alias("hit"), F.row_number().over(order).alias("place"))
    late = F.col("hit") & (F.col("place") > 1)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("*", count(F.col("hit")).alias("n_hit"), count(late).alias("n_late"))
    rows = rows.where((F.col("place") == 1) | F.col("hit"))

    def gather(ok: Column, value: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct(F.col("turn_index").alias("i"), value.alias("v"))))), lambda x: x["v"])

    out = rows.groupBy("session_file").agg(
        F.max(F.when(F.col("place") == 1, F.col("preview"))).alias("first_prompt"),
        gather(late & (F.col("n_late") <= later), F.concat(F.lit("turn"), F.col("turn_index").cast("string"), F.lit(": "), F.col("preview"))).alias("later_constraints"),
        gather(F.col("hit") & (F.col("n_hit") <= turns), F.col("turn_index")).alias("correction_turns"),
    )
    return out.where(F.size("later_constraints") > 0)


#: Traits with the rules whose hits they sum and the least sum.
TRAITS = {"token_sensitive": (("token_budget_control",), 3), "scope_often_clarified_late": (("scope_clarification", "late_constraint"), 5), "exploratory_tester": (("exploratory_request",), 8)}
DENSE_TRAIT, DENSE_LEAST = "prefers_dense_brief_answers", 3


def profile(labelled: DataFrame, patterns: PatternSet = INVENTED_WORDS) -> DataFrame:
    """The traits that enough turns support: one aggregate row, unfolded."""
    sums = {t: F.sum(F.aggregate(F.array(*[F.array_contains("labels", r).cast("int") for r in rules]), F.lit(0), lambda a, x: a + x)) for t, (rules, _) in TRAITS.items()}
    row = labelled.agg(*[F.coalesce(s, F.lit(0)).cast("long").alias(t) for t, s in sums.items()], F.count_if(F.contains("text", F.lit(patterns.dense_marker))).alias(DENSE_TRAIT))
    least = {**{t: n for t, (_, n) in TRAITS.items()}, DENSE_TRAIT: DENSE_LEAST}
    traits = F.explode(F.array(*[F.struct(F.lit(t).alias("trait"), F.col(t).alias("evidence_count"), F.lit(n).alias("least")) for t, n in least.items()]))
    return row.select(traits.alias("t")).where("t.evidence_count >= t.least").select("t.trait", "t.evidence_count")
