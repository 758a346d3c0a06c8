"""Stateful runs: what changed is recomputed, by buckets of sessions; every run leaves a version; a registry knows the projects."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental
from .versioned import Table, Version

INDEX = "session_file string, fingerprint string"


@dataclass(frozen=True)
class Route:
    """Where a route of a project keeps its sessions' results, its index and the versions of both."""

    home: str
    project: str
    name: str
    buckets: int = 64

    def table(self, spark: SparkSession, schema: str) -> Table:
        return Table(spark, f"{self.home}/{self.project}/{self.name}", {"rows": schema, "index": INDEX}, "session_file", self.buckets)


def run(route: Route, current: DataFrame, compute: Callable[[DataFrame], DataFrame], schema: str, run_id: str) -> tuple[DataFrame, bool]:
    """All sessions' results after recomputing what has to be, and whether anything changed.

    ``current`` has session_file and fingerprint; ``compute`` maps the sessions to recompute to rows
    with session_file in ``schema``. New and changed sessions replace their rows, deleted ones lose
    theirs (a deletion alone counts as a change), and sessions whose stored rows are gone are computed again. Only
    buckets that hold such sessions are written; a failure before the last step leaves the state as it was.
    """
    spark = current.sparkSession
    table = route.table(spark, schema)
    changed = False

    def step(version: Version) -> Version:
        nonlocal changed
        before = table.read("index", version)
        lost = table.lost(version)
        diff = incremental.index_diff(before, current).persist()
        cache = before.where(~table.bucket().isin(lost)) if lost else before
        work = incremental.worklist(diff, current, cache).select("session_file").persist()
        gone = diff.where("status = 'deleted'").select("session_file")
        touched = [r["bucket"] for r in work.union(gone).select(table.bucket().alias("bucket")).distinct().collect()]  # at most one row per bucket
        changed = bool(touched)
        if touched:
            out = work.union(gone)
            kept = table.read("rows", version, touched).join(out, "session_file", "left_anti")
            index = current.select("session_file", "fingerprint").where(table.bucket().isin(touched))
            version = table.replace(version, {"rows": kept.unionByName(compute(work).select(*kept.columns)), "index": index}, touched, run_id)
        work.unpersist()
        diff.unpersist()
        return version

    after = table.change(step)
    return table.read("rows", after), changed


def in_session_order(rows: DataFrame, key: str = "session_file") -> DataFrame:
    """Stored rows as a run lists its sessions."""
    return rows.orderBy(key)


def snapshot(route: Route, spark: SparkSession, schema: str, run_id: str) -> DataFrame:
    """The results as a run left them."""
    table = route.table(spark, schema)
    return table.read("rows", table.of_run(run_id))


PROJECTS = (
    "project_id string, project_cwd string, created_at string, last_analyzed_at string, latest_run string, "
    "session_count long, message_count long, user_turn_count long, tool_call_count long, route_runs map<string,string>"
)


def registry(spark: SparkSession, home: str) -> Table:
    return Table(spark, f"{home}/registry", {"projects": PROJECTS}, "project_id", 16)


def register(table: Table, project_id: str, cwd: str, route: str, run_id: str, now: str, metadata: DataFrame) -> Version:
    """Puts a run into the registry: one row per project, which keeps the time of its first run and the last run of each other route.

    ``metadata`` has a session's counts, as from ``session_metadata``. Runs that register at the same time both stay.
    """
    totals = metadata.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("message_count", "user_turn_count", "tool_call_count")], F.count(F.lit(1)).alias("session_count"))
    fresh = totals.select(
        F.lit(project_id).alias("project_id"), F.lit(cwd).alias("project_cwd"), F.lit(now).alias("created_at"), F.lit(now).alias("last_analyzed_at"), F.lit(run_id).alias("latest_run"),
        "session_count", "message_count", "user_turn_count", "tool_call_count", F.create_map(F.lit(route), F.lit(now)).alias("route_runs"),
    )

    def step(version: Version) -> Version:
        bucket = fresh.select(table.bucket().alias("bucket")).first()["bucket"]
        old = table.read("projects", version, [bucket])
        was = old.select("project_id", F.col("created_at").alias("_created"), F.col("route_runs").alias("_runs"))
        others = F.map_filter(F.coalesce("_runs", F.create_map().cast("map<string,string>")), lambda k, _: k != route)
        rows = fresh.join(was, "project_id", "left").withColumn("created_at", F.coalesce("_created", "created_at")).withColumn("route_runs", F.map_concat(others, "route_runs"))
        return table.replace(version, {"projects": incremental.upsert(old, rows.select(*old.columns), "project_id")}, [bucket], run_id)

    return table.change(step)


def projects(table: Table) -> DataFrame:
    """The registry, in order of project ids."""
    return table.read("projects").orderBy("project_id")
