"""Packing as a parallel prefix: runs summed up equal the plain fold, for small runs at random and for one project of many segments."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from loomlens.operators import chunking


def plain(sizes, sessions, least, most, state=(0, -1, None)):
    closed, held, last = state
    numbers = []
    for n, s in zip(sizes, sessions, strict=True):
        if held >= 0 and ((s != last and held >= least) or held + n > most):
            closed, held = closed + 1, 0
        held, last = max(held, 0) + n, s
        numbers.append(closed)
    return numbers, (closed, held, last)


def test_a_run_is_summed_up_for_every_state_before_it():
    rng = random.Random(8)
    for _ in range(400):
        least = rng.randrange(0, 12)
        most = least + rng.randrange(0, 12)
        n = rng.randrange(1, 14)
        sizes = [rng.choice([0, 1, 2, 5, 9, 30]) for _ in range(n)]
        sessions = [str(rng.randrange(3)) for _ in range(n)]
        border = np.array([i > 0 and s != sessions[i - 1] for i, s in enumerate(sessions)])
        run = {"first_session": sessions[0], "last_session": sessions[-1], **chunking._summary(np.array(sizes, np.int64), border, least, most)}
        for held in range(-1, most + 32):
            for last in ("0", "1"):
                state = (7, held, None if held < 0 else last)
                assert chunking._after(run, state, least, most) == plain(sizes, sessions, least, most, state)[1]
        assert len(run["steps"]) <= n


def test_one_project_of_many_segments_fills_many_tasks(spark):
    policy = chunking.Policy(4_000, 8_000, 9_000)
    n = 1_000_000
    h = F.pmod(F.xxhash64("id"), F.lit(997))
    rows = spark.range(n, numPartitions=8).select(
        F.when(F.col("id") < n - 500, "big").otherwise(F.concat(F.lit("small"), (F.col("id") % 7).cast("string"))).alias("project"), F.floor(F.col("id") / (1 + h % 5)).alias("session"), F.col("id").alias("ord"), (h * 3).alias("n_chars")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        packed = chunking.pack(rows, policy)
        parts = packed.groupBy(F.spark_partition_id().alias("part")).agg(F.count_if(F.col("project") == "big").alias("n")).where("n > 0").count()
        got = packed.toPandas().sort_values(["project", "ord"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts >= 4 and len(got) == n
    for _, own in got.groupby("project"):
        assert plain(own["n_chars"].tolist(), own["session"].tolist(), 4_000, 8_000)[0] == own["chunk"].tolist()


def test_projects_without_names_and_no_rows(spark):
    rows = spark.createDataFrame([(None, 1, 1, 50), (None, 2, 2, 50), ("", 1, 1, 5)], "project string, session long, ord long, n_chars long")
    got = chunking.pack(rows, chunking.Policy(40, 80, 90))
    assert sorted((r["project"] or "-", r["ord"], r["chunk"]) for r in got.collect()) == [("-", 1, 0), ("-", 1, 0), ("-", 2, 1)]
    assert chunking.pack(rows.limit(0)).count() == 0
