from __future__ import annotations

import random

import numpy as np
import pytest

from loomlens.llm import decontaminate as dc

from ..compare import assert_same

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    assert_same(dc.op4_decontamination(spark, SF), dc.SQL, SF)


def windows(words):
    n = min(13, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def test_hits_equal_plain_search_in_one_block_or_many(spark):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abcdef") for _ in range(n))) for i, n in enumerate([0, 1, 3, 12, 13, 14, 40])] + [(7, None), (None, "q r s")]
    items[1] = (1, "z")
    docs = []
    for i in range(60):
        words = [rng.choice("abcdefgh") for _ in range(rng.randrange(60))]
        if rng.random() < 0.6:
            passage = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[: rng.randrange(len(passage) + 1)] if rng.random() < 0.3 else passage
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in docs:
        words, hit, names = t.split(), set(), set()
        for item, text in items:
            for w in windows((text or "").split()):
                for p in range(len(words) - len(w) + 1):
                    if tuple(words[p : p + len(w)]) == w:
                        hit |= set(range(p, p + len(w)))
                        names.add("" if item is None else str(item))
        want[i] = (len(words), len(hit), sorted(names))
    for size in (1 << 20, 8):
        got = {r["row"]["doc_id"]: (r["found"]["n_words"], r["found"]["n_hit"], sorted(set(r["found"]["items"]))) for r in dc.annotate(df, bench, block_bytes=size).collect()}
        assert got == want


def test_suffix_array_is_sorted():
    t = np.random.default_rng(1).integers(0, 3, 200)
    sa = dc.suffix_array(t, 200)
    assert [list(t[i:]) for i in sa] == sorted(list(t[i:]) for i in range(200))


def test_matches_are_maximal_and_located(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"x y {item} z")], "doc_id long, text string")
    (m,) = dc.annotate(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).first()["found"]["matches"]
    assert m.asDict() == {"item": "5", "item_word": 0, "doc_word": 2, "words": 20}


def test_matches_are_the_longest_that_no_other_contains():
    rng = random.Random(8)
    items = [" ".join(rng.choice("ab") for _ in range(n)) for n in (13, 14, 30, 60, 5, 2)]
    block = dc.Block([(str(i), t) for i, t in enumerate(items)])
    texts = [" ".join([*(rng.choice("abc") for _ in range(40)), rng.choice(items), *(rng.choice("ab") for _ in range(40))]) for _ in range(30)]
    found = dc.shard(*dc.text_bytes(dc.pa.array(texts)), block).to_pylist()
    for text, got in zip(texts, found, strict=True):
        words, best = text.split(), {}
        for item in items:
            its = item.split()
            least = min(13, len(its))
            for p in range(len(words)):
                for q in range(len(its) - least + 1):
                    k = 0
                    while p + k < len(words) and q + k < len(its) and words[p + k] == its[q + k]:
                        k += 1
                    if k >= least:
                        best[p] = max(best.get(p, 0), k)
        # where a window of 13 begins, only its suffixes are asked; a short item is a match as a whole
        want, reach = [], -1
        for p in sorted(best):
            if p + best[p] > reach:
                want.append((p, best[p]))
                reach = p + best[p]
        assert [(m["doc_word"], m["words"]) for m in got["matches"]] == want
        for m in got["matches"]:
            assert words[m["doc_word"] :][: m["words"]] == items[int(m["item"])].split()[m["item_word"] :][: m["words"]]


def test_long_repeats_cost_their_sum(spark):
    """200,000 equal words against an item of 1,000: pairs of places would be 200 million."""
    text, item = "line " * 200_000, "line " * 1_000
    (got,) = dc.shard(*dc.text_bytes(dc.pa.array([text])), dc.Block([("a", item), ("b", "line line")])).to_pylist()
    assert (got["n_words"], got["n_hit"], got["items"], got["spans"]) == (200_000, 200_000, ["a", "b"], [0, 200_000])
    assert {m["words"] for m in got["matches"]} == {1_000} and len(got["matches"]) == 199_001


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "word"), (2, None), (3, "ab cd")], "item_id long, text string")
    assert dc.annotate(odd, bench).count() == odd.count() and dc.annotate(none, bench).count() == 0
    assert dc.annotate(odd, bench.limit(0)).where("found.n_hit > 0").count() == 0
    kept = dc.decontaminate(odd, bench)
    assert kept.columns == odd.columns and kept.where("text = 'word'").count() == 0 and kept.where("text IS NULL").count() == 2


@pytest.mark.parametrize(("hit", "words", "want"), [(0, 0, False), (1, 20, True), (1, 21, False)])
def test_rule(spark, hit, words, want):
    df = spark.sql(f"SELECT named_struct('n_hit', {hit}, 'n_words', {words}) AS found")
    assert df.select(dc.contaminated().alias("c")).first()["c"] is want
