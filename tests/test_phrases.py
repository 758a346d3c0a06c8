"""Phrases against the plain greedy choice, folded turns, and vectors made without Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomlens.functions.ordering import numbered
from loomlens.operators import phrases
from loomlens.plans import catalog

SF = "/root/testdata/sf0.001"


def greedy(rows, k=80):
    kept = []
    for r in sorted(rows, key=lambda r: (-r["weight"], -r["n"], -len(r["gram"]), r["gram"])):
        if not any(r["phrase"] in p and r["n"] <= n for p, n in kept):
            kept.append((r["phrase"], r["n"]))
            if len(kept) == k:
                break
    return kept


def test_phrases_equal_the_greedy_choice(spark):
    rng = random.Random(7)
    made = [("".join(rng.choices("ab cd", k=rng.randrange(3, 9))), rng.randrange(2, 9)) for _ in range(3000)]
    tables = [spark.createDataFrame(sorted(dict(made).items()), "gram string, n long").withColumn("n_texts", F.lit(2)), catalog._gram_counts(spark, SF)]
    for counts in tables:
        want = greedy(phrases.phrase_candidates(counts).collect())
        got = phrases.frequent_phrases(counts)
        assert [(r["phrase"], r["n"]) for r in got.orderBy("place").collect()] == want and len(want) == 80
        assert got.where("score <> n * length(phrase)").isEmpty()


def test_equal_turns_are_one_node(spark):
    texts = spark.range(100_000).select(F.format_string("t%06d", "id").alias("turn"), F.when(F.col("id") % 50_000 == 7, "quite another request altogether").when(F.col("id") == 9, "zz").otherwise("please continue with the work").alias("normalized"))
    nodes, members = phrases.folded(texts, "turn")
    assert sorted(map(tuple, nodes.select("turn", "copies").collect())) == [("t000000", 99_997), ("t000007", 2), ("t000009", 1)]
    assert members.count() == 100_000 and members.groupBy("of").count().count() == 3
    nodes = nodes.persist()
    weights = phrases.tfidf(nodes, ["turn"], copies="copies").persist()
    pairs = phrases.similar_pairs(weights, "turn", n_texts=3).persist()
    assert pairs.count() == 0
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    found = phrases.similar_clusters(nodes, members, pairs, weights, "turn")
    sizes = {(r["cluster"], r["size"]): r["count"] for r in found.groupBy("cluster", "size").count().collect()}
    assert sizes == {("t000000", 99_997): 99_997, ("t000007", 2): 2, (None, 1): 1}
    report = phrases.cluster_report(weights, found, "turn", of=members).collect()
    assert [(r["cluster"], r["size"], r["examples"]) for r in report] == [("t000000", 99_997, [f"t{i:06d}" for i in (0, 1, 2, 3)]), ("t000007", 2, ["t000007", "t050007"])]


def test_folded_weights_are_those_of_all_texts(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["abcd", "abce", "bcde", "zzzz", "abcdabcd"])) for i in range(60)]
    texts = spark.createDataFrame(rows, "turn long, normalized string")
    nodes, members = phrases.folded(texts, "turn")
    one = {(r["turn"], r["gram"]): r["w"] for r in phrases.tfidf(texts, ["turn"]).collect()}
    two = {(r["turn"], r["gram"]): r["w"] for r in phrases.tfidf(nodes, ["turn"], copies="copies").join(members.withColumnRenamed("turn", "m"), F.col("turn") == F.col("of")).select(F.col("m").alias("turn"), "gram", "w").collect()}
    assert one == pytest.approx(two)


def test_vectors_hold_the_weights_and_no_python(spark):
    weights = catalog._weights(spark, SF).persist()
    rows, n = phrases.vectors(weights, "turn")
    order = [r["gram"] for r in weights.select("gram").distinct().orderBy("gram").collect()]
    assert n == len(order)
    want = {}
    for r in weights.collect():
        want.setdefault(r["turn"], {})[r["gram"]] = r["w"]
    for r in rows.collect():
        v = r["features"]
        assert v.size == n and {order[i]: w for i, w in zip(v.indices, v.values, strict=True)} == want[r["turn"]]
    plan = rows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_numbers_follow_the_order(spark):
    rows = spark.range(5000).select((F.xxhash64("id") % 1000).alias("x"), "id")
    got = numbered(rows, ["x", "id"], "place").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(5000)) and [(r["x"], r["id"]) for r in got] == sorted((r["x"], r["id"]) for r in got)
    assert numbered(rows.limit(0), ["x"], "place").count() == 0


def made_turns(spark, n, seed):
    """Invented texts of two kinds of syllables, some of them equal."""
    rng = random.Random(seed)
    kinds = [["the", "on", "er", "and", "in", "re", "st", "ble"], ["que", "la", "do", "mi", "rra", "os", "ga", "cion"]]
    made = []
    for i in range(n):
        say = rng.choice(kinds)
        made.append((f"s{i % 7}#{i}", " ".join("".join(rng.choices(say, k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 12)))))
    return spark.createDataFrame([*made, *[(f"z#{k}", t) for k, t in made[::9]]], "turn string, normalized string")


@pytest.mark.parametrize("block,columns,rare", [(5000, 2048, 12), (40, 2048, 12), (30, 16, 2)])
def test_pairs_and_links_of_vectors_equal_plain_products(spark, monkeypatch, block, columns, rare):
    for name, value in (("BLOCK", block), ("COLUMNS", columns), ("RARE", rare), ("TILE", 11), ("STEP", 50), ("PIVOTS", 4)):
        monkeypatch.setattr(phrases, f"SIMILAR_{name}", value)
    nodes, members = phrases.folded(made_turns(spark, 150, block), "turn")
    nodes = nodes.persist()
    long = phrases.tfidf(nodes, ["turn"], copies="copies").persist()
    vectors = phrases.tfidf_vectors(nodes, "turn", copies="copies")
    own = {(r["turn"], r["gram"]): r["w"] for r in phrases._by_gram(vectors).collect()}
    assert own == pytest.approx({(r["turn"], r["gram"]): r["w"] for r in long.collect()})
    of = {}
    for (turn, gram), w in own.items():
        of.setdefault(turn, {})[gram] = w
    want = {(a, b): x for a in of for b in of if a < b and (x := round(sum(w * of[b].get(g, 0) for g, w in of[a].items()), 6)) >= 0.25}
    pairs = phrases.similar_pairs(vectors, "turn", least=0.25)
    got = {(r["a"], r["b"]): r["similarity"] for r in pairs.collect()}
    assert got == pytest.approx(want, abs=2e-6) and pairs.count() == len(got) > 100
    links = phrases.similar_links(vectors, "turn", least=0.25)
    clusters = [{r["turn"]: (r["cluster"], r["size"]) for r in phrases.similar_clusters(nodes, members, edges, w, "turn").collect()} for edges, w in ((pairs, long), (links, vectors))]
    assert clusters[0] == clusters[1] and len({c for c, _ in clusters[0].values()}) > 2
    assert links.count() < pairs.count() and {tuple(sorted(r)) for r in links.select("a", "b").collect()} <= {(a, b) for a in of for b in of if a < b}
    members = members.join(spark.createDataFrame([(t, c) for t, (c, _) in clusters[0].items()], "turn string, cluster string"), "turn")
    reports = [sorted(map(str, phrases.cluster_report(w, members.select("turn", "cluster"), "turn", of=members.select("turn", "of")).collect())) for w in (long, vectors)]
    assert reports[0] == reports[1] and reports[0]


def test_a_round_deals_out_three_times_the_vectors_at_most(spark, monkeypatch):
    """However many blocks there are; each vector went to every block at once before."""
    monkeypatch.setattr(phrases, "SIMILAR_BLOCK", 16)
    nodes, _ = phrases.folded(made_turns(spark, 300, 1), "turn")
    dealt, blocks = phrases._dealt(phrases.tfidf_vectors(nodes, "turn", copies="copies"), "turn", None)
    size = dict(dealt.groupBy("block").count().collect())
    n, met = sum(size.values()), set()
    assert blocks > 16 and set(size) <= set(range(blocks))
    for now in phrases._rounds(blocks):
        rows = phrases._round(dealt, now, blocks).join(dealt.select("key", "block"), "key").select("i", "side", "block").collect()
        assert len(rows) <= 3 * n
        seen = [(r["i"], r["block"]) for r in rows if r["side"] == 1]
        assert all(r["i"] == r["block"] for r in rows if r["side"] == 0) and len(seen) == sum(size[b] for i in now for b in size if b > i)
        met |= set(seen)
    assert met == {(i, j) for i in range(blocks) for j in size if i < j}


@pytest.mark.parametrize("n,block", [(300, 16), (300, 5000), (40, 3)])
def test_links_shuffle_nothing_and_store_no_vectors(spark, monkeypatch, n, block):
    """Vectors were stored twice, and dealt out anew in each round."""
    monkeypatch.setattr(phrases, "SIMILAR_BLOCK", block)
    nodes, members = phrases.folded(made_turns(spark, n, 2), "turn")
    nodes = nodes.persist()
    plain, near = (phrases.tfidf_vectors(nodes, "turn", copies="copies", near=x) for x in (False, True))
    own = {r["turn"]: sorted(r["weights"]) for r in plain.collect()}
    assert own == {r["turn"]: sorted(r["weights"]) for r in near.collect()} and own
    pairs = phrases.similar_pairs(plain, "turn", least=0.3)
    kept, keep = [], phrases.stored
    monkeypatch.setattr(phrases, "stored", lambda rows: kept.append(rows) or keep(rows))
    links = phrases.similar_links(near, "turn", least=0.3)
    assert len(kept) == -(-len(own) // block)
    assert all(rows.columns == ["a", "b"] and "Exchange" not in rows._jdf.queryExecution().executedPlan().toString() for rows in kept)
    clusters = [{tuple(r) for r in phrases.similar_clusters(nodes, members, edges, w, "turn").collect()} for edges, w in ((pairs, plain), (links, near))]
    assert clusters[0] == clusters[1] and len(clusters[0]) == n + -(-n // 9)


def test_links_of_texts_that_share_nothing(spark):
    nodes, _ = phrases.folded(spark.createDataFrame([("a", "xy"), ("b", "zw"), ("c", "")], "turn string, normalized string"), "turn")
    assert phrases.similar_links(phrases.tfidf_vectors(nodes, "turn", copies="copies", near=True), "turn").isEmpty()
