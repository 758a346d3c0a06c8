"""The near-copy stage against a plain search over n-grams of five words at 0.8."""

from __future__ import annotations

import re

import corpus_pipeline
from loomlens.llm import jaccard_join as jj

from .test_jaccard import family

SF = "/root/testdata/sf0.001"


def five_word_sets(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def plain_kept(docs):
    sets, root = {i: five_word_sets(t) for i, t in docs.items()}, {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in docs:
        for y in docs:
            n = len(sets[x] & sets[y])
            if x < y and n and 100 * n >= 80 * (len(sets[x]) + len(sets[y]) - n):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i for i in docs if find(i) == i}


def test_stage_drops_copies_that_three_words_at_90_keep(spark):
    words = [f"v{i}" for i in range(100)]
    other = [*words[:30], "x", *words[31:70], "y", *words[71:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, SF).collect()] == [1]
    assert jj.one_per_component(docs).count() == 2


def test_stage_equals_plain_search(spark):
    docs = family(5, (1, 3, 5, 6, 9, 14, 30, 60, 150), 12)
    docs |= {len(docs): None, len(docs) + 1: ""}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, df, SF).collect()} == plain_kept(docs)


def test_stage_equals_plain_search_on_the_tables(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r["doc_id"]: r["text"] for r in df.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, df, SF).collect()} == plain_kept(docs)
