"""Fill-in-the-middle: the query's SQL, a plain version over odd texts, and exact restoring."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from loomlens.llm import fill_middle
from tests.compare import assert_same

SF = "/root/testdata/sf0.001"


def plain(doc_id, text, moved=90):
    text = text or ""
    t = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    p, m, s = "".join(t[:a]), "".join(t[a:b]), "".join(t[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= moved:
        return doc_id, len(t), "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, len(t), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(t), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_query_equals_sql(spark):
    assert_same(fill_middle.op13_fill_middle(spark, SF), fill_middle.SQL, SF)


def test_outputs_equal_the_plain_version(spark, odd, none):
    texts = ["<", "<P", "a<S>b", "x<M>", "S>P>M>", "<<>>" * 9, "áb" * 50, "A" * 70_000 + "é" + "b" * 70_000, "é" * 200_000, "a1" * 40_000]
    rows = odd.select("doc_id", "text").union(spark.createDataFrame([(100 + k, texts[k % len(texts)]) for k in range(300)], "doc_id long, text string"))
    got = fill_middle.rearrange(rows, moved=100)
    shown = sorted(map(str, (tuple(r) for r in got.collect())))
    assert shown == sorted(str(plain(r["doc_id"], r["text"], 100)) for r in rows.collect())
    assert {r[0] for r in got.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    back = got.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text"))
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()))
    assert fill_middle.rearrange(odd).count() == odd.count() and fill_middle.rearrange(none).count() == 0


def test_rates(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    n = {r["form"]: r["count"] for r in fill_middle.rearrange(docs).groupBy("form").count().collect()}
    assert 220 < n["plain"] < 380 and 450 < n["spm"] < 630
