from __future__ import annotations

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from loomlens.llm import jaccard_join as jj

from ..compare import assert_same

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    assert_same(jj.op5_jaccard_join(spark, SF), jj.SQL, SF)


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def plain(docs, threshold):
    sets, parent = {i: shingle_set(t) for i, t in docs.items()}, {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in docs:
        for y in docs:
            if x < y and sets[x] and sets[y]:
                n = len(sets[x] & sets[y])
                if 100 * n >= threshold * (len(sets[x]) + len(sets[y]) - n):
                    a, b = sorted((find(x), find(y)))
                    parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in docs}


def family(seed, lengths, copies):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    docs = {}
    for n in lengths:
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(copies):
            x = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                p = rng.randrange(len(x))
                x[p : p + 1] = rng.choice([[rng.choice(words)], [], [x[p], rng.choice(words)]]) if len(x) > 1 else x[p : p + 1]
            docs[len(docs)] = " ".join(x)
    return docs


def links(docs, threshold):
    """Plain counts of links beside the components."""
    sets = {i: shingle_set(t) for i, t in docs.items()}
    out = dict.fromkeys(docs, 0)
    for x in docs:
        for y in docs:
            n = len(sets[x] & sets[y])
            if x != y and n and 100 * n >= threshold * (len(sets[x]) + len(sets[y]) - n):
                out[x] += 1
    return {i: (*v, out[i]) for i, v in plain(docs, threshold).items()}


def found(df, threshold):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jj.join(df, threshold=threshold).collect()}


@pytest.mark.parametrize(("threshold", "block", "dense"), [(90, 256, 48), (90, 4, 48), (80, 256, 4), (80, 5, 3)])
def test_components_and_links_equal_plain_search(spark, monkeypatch, threshold, block, dense):
    monkeypatch.setattr(jj, "BLOCK", block)
    monkeypatch.setattr(jj, "DENSE", dense)
    docs = family(threshold, (1, 2, 5, 9, 10, 13, 30, 60, 150), 12)
    docs |= {len(docs): None, len(docs) + 1: "", len(docs) + 2: " \n"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert found(df, threshold) == links(docs, threshold)


def test_many_similar_texts_that_do_not_link(spark):
    """A large group that shares most n-grams: few of its pairs reach the threshold, and none is lost."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    docs = {}
    for i in range(600):
        x = list(base)
        for p in rng.sample(range(60), rng.choice([1, 3, 3, 3])):
            x[p] = f"v{rng.randrange(40)}"
        docs[i] = " ".join(x)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    want = links(docs, 90)
    assert 0 < sum(n for *_, n in want.values()) < 60_000
    assert found(df, 90) == want


@pytest.mark.parametrize("threshold", [50, 80, 90, 95])
def test_prefixes_of_linked_sets_share_what_is_asked_for(threshold):
    rng = np.random.default_rng(threshold)
    order = jj.Order(rng.integers(1, 1000, 1 << jj.SLOT_BITS))
    for size in (1, 2, 5, 9, 10, 19, 40, 100, 333, 900):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        drop = int(size * (100 - threshold) / (100 + threshold))
        for _ in range(20):
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, rng.integers(0, drop + 1), dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common < threshold * (len(a) + len(b) - common):
                continue
            g, owner = order.place(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]))
            length, need = jj.prefix(np.array([len(a), len(b)]), threshold)
            shared = np.intersect1d(*[g[owner == i][: length[i]] for i in (0, 1)])
            assert len(shared) >= need.max()


def test_order_is_rare_first_and_cut_by_mass():
    counts = np.random.default_rng(1).integers(0, 100, 1 << jj.SLOT_BITS)
    order = jj.Order(counts, 4)
    h = np.random.default_rng(2).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    place, owner = order.place(h, np.zeros(len(h), np.int64))
    back = {int(p): c for p, c in zip(order.place(np.sort(h), np.arange(len(h)))[0], counts[(np.sort(h) >> np.uint64(64 - jj.SLOT_BITS)).astype(int)], strict=True)}
    seen = [back[int(p)] for p in place]
    assert seen == sorted(seen) and len(place) == len(np.unique(h))
    assert np.ptp(np.bincount(order.fragment(np.arange(1 << jj.SLOT_BITS, dtype=np.uint64)[np.repeat(order.rank.astype(int), counts)] << np.uint64(64 - jj.SLOT_BITS)))) < 1000


def test_ids_that_are_text(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [("b", text), ("a", text + " z"), ("c", text), ("d", "other words here"), (None, "lone words stay")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jj.join(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"a": (59, "a", 2), "b": (58, "a", 2), "c": (58, "a", 2), "d": (1, "d", 0), None: (1, None, 0)}


def test_components_of_chains(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000 - i, 999 - i) for i in range(200)] + [(5000, i) for i in range(5001, 5100)] + [(7, 7)], "a long, b long")
    got = jj.components(edges, str(tmp_path / "c")).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["label"], set()).add(r["node"])
    assert sorted(map(sorted, by.values())) == [list(range(301)), list(range(800, 1001)), list(range(5000, 5100))]
    assert jj.components(edges.limit(0), str(tmp_path / "none")).count() == 0


def test_odd_rows(odd, none):
    rows = jj.join(odd)
    assert rows.count() == odd.count() and jj.join(none).count() == 0
    assert rows.where("n_shingles = 0 AND NOT component_id <=> doc_id").count() == 0
    kept = jj.one_per_component(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.where("text = 'word'").collect()} == {3}


def test_stored_steps_free_their_shuffle_files(spark, tmp_path):
    from loomlens.llm.common import FREED, stored

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in re.findall(r"shuffle_\d+_", disk.getAllBlocks().mkString(" "))}
    before = shuffles()
    assert stored(spark.range(1000).repartition(7, "id"), str(tmp_path / "t")).count() == 1000
    assert spark.conf.get(FREED, "false") == "false"
    deadline = time.time() + 20
    while shuffles() - before and time.time() < deadline:  # removed in the background
        time.sleep(0.2)
    stored_left = shuffles() - before
    assert len(stored_left) <= 1  # that of the count just above


def test_postings_stay_where_a_set_of_a_fitting_size_shares_the_gram():
    rng = random.Random(4)
    rows = sorted({(g, 1 + n % 2 if g % 5 == 0 else 0, 5 + n * 3, n) for g in range(40) for n in rng.sample(range(60), g % 4 + 1)})
    rows = sorted([*rows, *rows[::3]])  # copies in several tasks
    want = {(g, n) for g, s, z, n in rows if s or any(g == h and n != m and min(z, y) * 100 >= max(z, y) * 80 for h, t, y, m in rows)}
    schema = pa.schema([("gram", pa.int64()), ("node", pa.int64()), ("need", pa.int32()), ("size", pa.int32()), ("share", pa.int32())])
    for step in (1, 3, 1000):
        batches = [pa.RecordBatch.from_pylist([{"gram": g, "node": n, "need": 1, "size": z, "share": s} for g, s, z, n in rows[i : i + step]], schema) for i in range(0, len(rows), step)]
        got = [(r["gram"], r["node"]) for b in jj.shared_postings(batches, 80) for r in b.to_pylist()]
        assert set(got) == want and len(got) == len({(g, s, n) for g, s, _, n in rows if (g, n) in want})


def test_chains_of_unlike_sets_are_not_sent_between_blocks():
    rows = [(1, 3, 0, [0, 1]), (1, 3, 0, [0, 2]), (1, 3, 0, [0, 2]), (1, 3, 0, [0, 2]), (2, 1, 1, [0, 1]), (3, 2, 1, [1, 2])]
    schema = pa.schema([("node", pa.int64()), ("need", pa.int32()), ("block", pa.int32()), ("blocks", pa.list_(pa.int32())), ("width", pa.int32())])
    batch = pa.RecordBatch.from_pylist([dict(zip(schema.names, (*r, len(r[3])), strict=True)) for r in rows], schema)
    assert [tuple(r.values()) for b in jj.other_blocks([batch]) for r in b.to_pylist()] == [(1, 2), (2, 0)]
