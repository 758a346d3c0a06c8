"""Block-max search: its SQL, a brute force over odd rows with small segments, and skipped blocks."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomlens.llm import lexical
from tests.compare import assert_same

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def brute(docs, queries, k):
    counted = [(i, Counter(words(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in counted if c), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in queries:
        scored = []
        for i, c in counted:
            m = 50 + 50 * c.total() * n_docs // total if total else 50
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(words(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return sorted(map(str, out))


def test_query_equals_sql(spark):
    assert_same(lexical.op12_block_max(spark, SF), lexical.SQL, SF)


@pytest.mark.parametrize("sizes", [{}, {"segment_docs": 7}, {"segment_bytes": 2000}])
def test_search_equals_brute_force(spark, odd, sizes):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "é", "x1"]
    texts = [" ".join(rng.choices(vocabulary, weights=range(33, 0, -1), k=rng.randrange(60))) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(texts, 100), (100, texts[0]), (101, texts[0]), (None, texts[3])], "doc_id long, text string").union(odd.select("doc_id", "text")).repartition(3)
    queries = spark.createDataFrame(
        [(i, " ".join(rng.choices(vocabulary, k=5))) for i in range(12)] + [(3, "word W3"), (None, "w1"), (90, None), (91, " ,"), (92, "nowhere"), (93, "WORD ab")], "item_id long, text string"
    )
    found = lexical.index(docs, **sizes)
    for k, more in ((4, {}), (50, {"query_bytes": 8, "window": 5})):
        got = lexical.search(found, queries.withColumn("doc_id", F.lit(1)), k=k, **more)
        assert sorted(str(tuple(r)) for r in got.select("item_id", "rank", "doc_id", "score").collect()) == brute([tuple(r) for r in docs.collect()], [tuple(r) for r in queries.collect()], k)


def test_empty_tables(spark, odd, none):
    asked = spark.createDataFrame([(1, "word")], "item_id long, text string")
    assert lexical.search(lexical.index(none), asked).count() == 0
    found = lexical.index(odd)
    assert lexical.search(found, asked.limit(0)).count() == 0
    assert lexical.search(found, asked).count() == 4  # the rows that hold the word
    wordless = lexical.index(spark.createDataFrame([(1, None), (2, " ,")], "doc_id long, text string"))
    assert (wordless.n_docs, wordless.n_terms, lexical.search(wordless, asked).count()) == (0, 0, 0)


def test_ids_may_be_text(spark):
    docs = spark.createDataFrame([("b", "one"), ("a", "one"), ("c", "one two")], "name string, body string")
    asked = spark.createDataFrame([("q", "ONE two")], "item string, question string")
    rows = lexical.search(lexical.index(docs, id_col="name", text_col="body"), asked, id_col="item", text_col="question").orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == ["c", "a", "b"]


def segment(texts):
    held = lexical.Segment()
    arrow = pa.array(texts)
    data, offs = lexical.text_bytes(arrow)
    held.add(pa.array(range(len(texts))), data, offs)
    n = [len(words(t)) for t in texts]
    batches = list(held.rows(0, 0, sum(x > 0 for x in n), sum(n), pa.int64()))
    table = pa.Table.from_batches(batches).to_pylist()
    m = np.frombuffer(table[0]["heads"], np.int64)
    return {r["term"]: lexical.Postings(r["df"], r["heads"], r["payload"], m) for r in table[1:]}


def test_blocks_below_the_threshold_stay_packed():
    rng = random.Random(5)
    texts = ["common " * rng.randrange(1, 4) + "filler " * rng.randrange(1, 40) + ("rare" if i in (700, 4000) else "") for i in range(6000)]
    lists = segment(texts)
    asked = [(lists["rare"], 9000), (lists["common"], 40)]
    docs, scores = lexical.best(asked, 6000, 2, 1, window=1024)
    everything = Counter()
    for p, w in ((lists["rare"], 9000), (lists["common"], 40)):
        plain = lexical.Postings(p.n, np.stack([p.first, p.last, p.top, np.diff(p.at)], axis=1).astype(np.int32).tobytes(), p.payload.tobytes(), p.m)
        for d, i in zip(*plain.read(np.arange(len(plain.first))), strict=True):
            everything[int(d)] += w * int(i)
    want = sorted(everything.items(), key=lambda x: (-x[1], x[0]))[:2]
    assert list(zip(docs.tolist(), scores.tolist(), strict=True)) == want and {d for d, _ in want} == {700, 4000}
    assert len(lists["common"].ready) == 47 and lists["common"].ready.sum() <= 10  # the first window's, and one for the other
    # a floor from earlier segments leaves even those packed
    lists = segment(texts)
    assert lexical.best([(lists["rare"], 9000), (lists["common"], 40)], 6000, 2, want[-1][1], window=1024)[0].tolist() == docs.tolist()
    assert lists["common"].ready.sum() <= 2


def test_packed_numbers_come_back():
    rng = np.random.default_rng(6)
    values = np.concatenate([[0, 127, 128, 16383, 16384, (1 << 31) - 1], rng.integers(0, 1 << 31, 500), rng.integers(0, 200, 500)])
    data, size = lexical.packed(values)
    assert lexical.unpacked(data).tolist() == values.tolist() and int(size.sum()) == len(data)
    assert lexical.unpacked(lexical.packed(np.array([3, 4]))[0]).tolist() == [3, 4]


def test_levels_thin_out():
    n = Counter(lexical._level(p << 24 | s) for p in range(4000) for s in range(2))
    assert 7300 < n[0] < 7700 and 400 < n[1] < 560 and n[2] < 60
    assert lexical.lengths(np.array([10**9]), 10**10, 10**13).tolist() == [50 + 50 * 10**19 // 10**13]
