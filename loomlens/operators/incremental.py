"""Incremental maintenance: what changed between two indexes, what to recompute, what to reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_diff(previous: DataFrame, current: DataFrame, key: str = "session_file", mark: str = "fingerprint") -> DataFrame:
    """Status of every key of either index: new, changed, unchanged or deleted (one full outer join)."""
    p, c = previous.select(F.col(key).alias("p"), F.col(mark).alias("was")), current.select(F.col(key).alias("c"), F.col(mark).alias("now"))
    status = F.when(F.col("p").isNull(), "new").when(F.col("c").isNull(), "deleted").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("changed")
    return p.join(c, F.col("p") == F.col("c"), "full_outer").select(F.coalesce("p", "c").alias(key), status.alias("status"))


def worklist(diff: DataFrame, current: DataFrame, cache: DataFrame, key: str = "session_file", mark: str = "fingerprint") -> DataFrame:
    """Keys to recompute: new or changed ones, and those whose cache is missing or stale; each with its reason."""
    stale = current.join(cache.select(F.col(key), F.col(mark).alias("cached")), key, "left").where(~F.col(mark).eqNullSafe(F.col("cached"))).select(key, F.lit("cache").alias("reason"))
    fresh = diff.where("status IN ('new', 'changed')").select(key, F.col("status").alias("reason"))
    return fresh.unionByName(stale).groupBy(key).agg(F.max("reason").alias("reason"))


def has_changes(diff: DataFrame) -> bool:
    """Deletions count as changes, so that a report is never reused after one."""
    return not diff.where("status <> 'unchanged'").isEmpty()


#: Fixed value: the runner whose reports hold for one model and one setting of thinking only.
MODEL_RUNNER = "cli-json"


def cache_hits(chunks: DataFrame, state: DataFrame, prompt_version: str, runner: str, model: str | None = None, thinking: str | None = None) -> DataFrame:
    """Each chunk and whether its stored report still holds: finished, of the same content, prompt and runner (and
    model and thinking, where the runner has them), and with a report that is there.

    ``state`` has chunk_id, content_hash, prompt_version, status, runner_type, model, thinking, report_path (null if the file is gone).
    """
    kept = state.withColumnRenamed("content_hash", "stored_hash")
    same = (F.col("status") == "completed") & (F.col("content_hash") == F.col("stored_hash")) & (F.col("prompt_version") == prompt_version) & (F.col("runner_type") == runner)
    if runner == MODEL_RUNNER:
        same = same & F.col("model").eqNullSafe(F.lit(model)) & F.col("thinking").eqNullSafe(F.lit(thinking))
    same = same & (F.col("report_path") != "")
    return chunks.select("chunk_id", "content_hash").join(kept, "chunk_id", "left").select("chunk_id", "content_hash", F.coalesce(same, F.lit(False)).alias("hit"))


def upsert(registry: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The registry with the given rows in place of those of the same key."""
    return registry.join(rows.select(key), key, "left_anti").unionByName(rows)
