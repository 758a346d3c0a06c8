"""From raw documents to token ids: language, exact copies, near copies, test items, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is
written as Parquet in the cluster's shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlens.llm import decontaminate, exact_dedup, jaccard_join, language_id, pieces
from loomlens.llm.common import read, ship, work_dir


#: Bytes of an Arrow batch: 10,000 whole texts fill tens of MB in an executor, and again in each of its Python workers.
BATCH_BYTES = "8m"


def ready(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects: null texts, texts without a letter, and texts that no
    language's codeword fits better than chance; the model is trained on the documents that name a language.

    Repeated rows are each judged; without any language, every document goes; extra columns stay.
    """
    ready(spark)
    marked = language_id.predict(docs, language_id.train(docs), keep=docs.columns)
    return marked.where(~F.col("rejected")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the longest original of each group of texts that differ in white space at most (ties: the least id; rows with
    null ids last; repeated rows once). Null counts as empty; no rows give none; extra columns stay."""
    ready(spark)
    return exact_dedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each component of near copies (n-grams of five words, 0.8).

    Null and wordless texts are no copies and stay, as do rows with null ids; extra columns stay.
    """
    ready(spark)
    return jaccard_join.one_per_component(docs, threshold=80, words=5)


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more stand in passages of test items.

    Null and wordless texts stay; repeated rows are each judged; extra columns stay.
    """
    ready(spark)
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_bytes, decoded_ok and the token ids; null and empty texts have none."""
    ready(spark)
    return pieces.encode(docs)


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("test_items", test_items),
    ("encoding", encoding),
]

#: SQL has no language model and no piece encoder; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, home = read(spark, sf_dir, "documents"), work_dir(spark)
    for name, stage in STAGES:
        path = f"{home}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
