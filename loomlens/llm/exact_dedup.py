"""Exact deduplication by skew-safe combining (DataFrame functions only).

Copies are combined three times: Spark's map-side partial aggregate keeps one row per
content in every input partition, the salted groups (digest, salt, content) merge these,
and the salts' winners of a content are combined over all salts. Every stage groups by the
whole content beside its digest, so digests that collide never join different texts. No
stage sees more rows of one content than one per map task or one per salt. On the way back the
members of hot groups meet their winner in shares.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import met, read, small, stored, work_dir

#: The characters that are deleted before texts are compared.
BLANKS = " \t\n\x0b\x0c\r"
_BIG = 9223372036854775807
_WORD = "18446744073709551616"


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _rank(kind: T.DataType) -> tuple[Callable[[Column, Column], Column], Callable[[Column], Column], Callable[[Column], Column]]:
    """How rows are ranked by length and then by smaller id (null ids last), the greatest rank first: the
    rank of (id, size), and from a rank the id and the size. Whole numbers are packed into one, which
    hash aggregates take; ids of another type rank as a struct."""
    if isinstance(kind, T.IntegralType):
        big, word = F.lit(_BIG).cast("decimal(20,0)"), F.lit(_WORD).cast("decimal(20,0)")

        def rank(doc_id: Column, size: Column) -> Column:
            low = big - F.coalesce(doc_id.cast("long"), F.lit(_BIG)).cast("decimal(20,0)")
            return -(size.cast("decimal(11,0)") * word + low).cast("decimal(38,0)")

        def low(r: Column) -> Column:
            return F.pmod(-r, word)

        def keep(r: Column) -> Column:
            found = (big - low(r)).cast("long")
            return F.when(found != _BIG, found).cast(kind)

        return rank, keep, lambda r: ((-r - low(r)) / word).cast("int")
    return lambda doc_id, size: F.struct((-size).alias("size"), doc_id.isNull().alias("none"), doc_id.alias("id")), lambda r: r["id"], lambda r: -r["size"]


def classify(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 32,
    digest: Callable[[Column], Column] = lambda c: F.sha2(c, 256),
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 and the text's size in code points.

    Texts are equal when identical after deleting space and \\x09-\\x0D; null is empty, and all
    empty texts are one group. The longest original text (in code points) stays, then the
    smallest id, of whatever type that can be ordered; a null id ranks last, and keep_id is null if
    only null ids are there. Rows that repeat one id and length within a group are the same document
    and share its fate. Very long texts are compared whole, like all others. Extra columns are
    ignored, whatever their names; no rows give no rows. ``digest`` may be any function of the
    text: if it puts two contents in one cell, members find their winner by comparing contents as
    well.
    """
    spark = docs.sparkSession
    rank, keep, keep_size = _rank(docs.schema[id_col].dataType)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).select(
        "id", F.length(F.coalesce("t", F.lit(""))).alias("size"), normalised(F.col("t")).alias("content")
    )
    rows = rows.withColumn("digest", digest(F.col("content")).cast("string"))
    salt = F.pmod(F.xxhash64("id", "size"), F.lit(salts)).cast("int").alias("salt")
    cells = (
        rows.select("digest", salt, "content", rank(F.col("id"), F.col("size")).alias("rank"))
        .groupBy("digest", "salt", "content")
        .agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    )
    won = cells.groupBy("digest", "content").agg(F.min("rank").alias("rank"), F.sum("n").alias("group_size"))
    table = stored(won.drop("content"), f"{work_dir(spark)}/winners")
    if table.groupBy("digest").count().where("count > 1").isEmpty():
        # groups that hold a large part of the rows are dealt in shares
        joined = met(rows.drop("content"), table, ["digest"], "group_size")
    else:  # a digest with several contents: members meet their own content's winner
        joined = rows.join(won, ["digest", "content"])
    joined = joined.select("id", "size", "digest", "group_size", keep(F.col("rank")).alias("keep_id"), keep_size(F.col("rank")).alias("keep_size"))
    return joined.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("size") == F.col("keep_size"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "size",
    )


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; repeated rows of one document stay once.

    A row with a null id stays when its text is the group's winner.
    """
    home = work_dir(docs.sparkSession)
    key = ["doc_id", "size", "text_sha256"]
    marked = stored(classify(docs, id_col=id_col, text_col=text_col).select(*key, "kept"), f"{home}/marked")
    # the columns travel in one struct, so that no name of theirs can clash, and the text within it alone
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"),
        F.length(F.coalesce(text, F.lit(""))).alias("long"), F.sha2(normalised(text), 256).alias("sha"),
    )
    on = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("long") == F.col("size")) & (F.col("sha") == F.col("text_sha256"))
    out = rows.join(small(stored(marked.where(~F.col("kept")).select(*key).distinct(), f"{home}/dropped")), on, "left_anti")
    again = stored(marked.where("kept").groupBy(*key).count().where("count > 1").select(*key), f"{home}/again")
    if not again.isEmpty():
        place = F.row_number().over(Window.partitionBy("id", "long", "sha").orderBy(F.col("row").getField(text_col)))
        one = out.join(small(again), on, "left_semi").withColumn("place", place).where("place = 1").drop("place")
        out = out.join(small(again), on, "left_anti").unionByName(one)
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents")).drop("size")


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents
), w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY content ORDER BY size DESC, doc_id NULLS LAST
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY content) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(content) AS text_sha256
FROM w
"""
