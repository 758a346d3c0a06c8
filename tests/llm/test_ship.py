"""Every operator that starts Python workers brings its code to them: run where workers find no package."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
PROGRAM = r"""
import sys
sys.path.insert(0, sys.argv[1])  # the driver alone
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
name = sys.argv[3]
docs = spark.createDataFrame([(i, f"some words of text number {i} stand here and there", "en" if i % 2 else "de") for i in range(12)], "doc_id long, text string, lang string")
labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
items = docs.where("doc_id < 2").select(F.col("doc_id").alias("item_id"), "text")
from loomlens.llm import decontaminate, fill_middle, jaccard_join, language_id, lexical, ogg, pieces, ppm, quality, token_counts
run = {
    "ppm": lambda: ppm.score(docs, docs),
    "pieces": lambda: pieces.encode(docs),
    "decode": lambda: pieces.decode(spark.createDataFrame([(1, [5, 6])], "doc_id long, ids array<int>")),
    "decontaminate": lambda: decontaminate.annotate(docs, items),
    "jaccard_join": lambda: jaccard_join.join(docs),
    "quality": lambda: quality.score(docs, quality.train(docs, labels)),
    "token_counts": lambda: token_counts.count(docs),
    "language_id": lambda: language_id.predict(docs, language_id.train(docs)),
    "ogg": lambda: ogg.decode(ogg.store(docs)),
    "demultiplex": lambda: ogg.demultiplex(spark.createDataFrame([(1, bytearray(b"OggS"))], "doc_id long, media binary")),
    "lexical": lambda: lexical.search(lexical.index(docs), items),
    "fill_middle": lambda: fill_middle.rearrange(docs),
}
for k in name.split(","):
    run[k]().collect()
    print("ran", k)
    # the next one must bring the code itself
    spark.stop()
    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs = spark.createDataFrame([(i, f"some words of text number {i} stand here and there", "en" if i % 2 else "de") for i in range(12)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    items = docs.where("doc_id < 2").select(F.col("doc_id").alias("item_id"), "text")
"""
NAMES = ["ppm", "pieces", "decode", "decontaminate", "jaccard_join", "quality", "token_counts", "language_id", "ogg", "demultiplex", "lexical", "fill_middle"]


def test_operators_bring_their_code(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "p.py").write_text(PROGRAM)
    got = subprocess.run([sys.executable, str(tmp_path / "p.py"), str(ROOT), str(tmp_path / "shared"), ",".join(NAMES)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert [x.split()[1] for x in got.stdout.splitlines() if x.startswith("ran ")] == NAMES, got.stderr[-2000:]
