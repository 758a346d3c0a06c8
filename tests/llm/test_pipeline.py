"""The pipeline against plain Python over the whole smallest tables."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from loomlens.llm import pieces
from loomlens.llm.common import text_bytes

from .test_exact_dedup import plain as plain_copies
from .test_models import letters, plain_output_codes
from .test_near_stage import plain_kept as plain_near_kept

SF = "/root/testdata/sf0.001"


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_clean(docs, items):
    windows = set()
    for t in items:
        w = words_of(t)
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    sizes = {len(w) for w in windows}
    out = {}
    for i, t in docs.items():
        w, hit = words_of(t), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
        if not (hit and 20 * len(hit) >= len(w)):
            out[i] = t
    return out


def test_run_equals_plain_stages(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = {i: t for i, t, _ in rows}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    losses = plain_output_codes(rows, lambda i: True)[1]
    docs = {i: t for i, t in docs.items() if letters(t) and min(losses[i]) < math.log(2)}
    docs = {i: docs[i] for i, _, _, kept in plain_copies(list(docs.items())) if kept}
    near = plain_near_kept(docs)
    docs = {i: t for i, t in docs.items() if i in near}
    docs = plain_clean(docs, items)
    with open(pieces.MODEL, "rb") as f:
        ids, n = pieces.Pieces(f.read()).encode(*text_bytes(pa.array(list(docs.values()))))
    first = np.concatenate([[0], np.cumsum(n)])
    want = {i: ids[first[k] : first[k + 1]].tolist() for k, i in enumerate(docs)}
    got = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"]: r["ids"] for r in got.collect()} == want
    assert got.where("NOT decoded_ok").count() == 0


def test_stages_take_odd_rows_and_keep_columns(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() <= odd.count()


def test_batches_of_the_stages_are_bounded_by_bytes(spark):
    corpus_pipeline.ready(spark)
    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("abcdefgh"), 1000).alias("text"))
    sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) >= 32_000_000 and max(r["n"] for r in sizes) < 9_000_000
