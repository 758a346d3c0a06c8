"""Ranked lexical search with block-max indexes.

Documents are dealt in segments of bounded size. A segment keeps, for each of its terms, the
documents that hold it in blocks of 128 postings: gaps and counts as variable-length bytes, with
the first and last document and the largest impact of the block beside them, uncompressed.

A search walks a segment in windows of ascending documents, all lists at once. Pointers first move
over block heads only: the heads that reach a document bound its score. Lists are then opened
from the rarest on, and of each only blocks with a document whose bound still reaches the
threshold are decompressed; their bounds become scores, and the rest falls away. The threshold is
the k-th score so far, and the segments of earlier rounds pass theirs on: a sixteenth of the
segments goes before the others, a sixteenth of these before them, and so on.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import distinct
from .common import LOWER, read, runs, ship, steps, stored, text_bytes, work_dir

#: Term characters by UTF-8 byte: letters and digits of ASCII, and everything beyond it.
TERM = np.zeros(256, bool)
TERM[48:58] = TERM[65:91] = TERM[97:123] = True
TERM[128:] = True
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

BLOCK = 128
#: A segment ends after so many bytes of text or documents.
SEGMENT_BYTES, SEGMENT_DOCS = 16 << 20, 1 << 17
#: Documents that a search holds bounds of at once.
WINDOW = 1 << 13
#: One in so many segments is searched a round earlier, and of these again.
EARLIER = 16
#: Bytes of query terms in one pass over the index.
QUERY_BYTES = 4 << 20
#: Fixed values of the score.
K1, B_PART, SCALE = 20, 50, 1_000_000_000
_ROWS = 20_000


@dataclass(frozen=True)
class Index:
    """``postings``: a row per segment and term, and one with the term '' that lists the segment's documents and their lengths."""

    postings: DataFrame
    n_docs: int
    n_terms: int


def lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with ``n`` terms each."""
    if len(n) and int(n.max()) * B_PART * n_docs >= 1 << 63:
        return np.array([100 - B_PART + B_PART * int(x) * n_docs // n_terms for x in n], np.int64)
    return 100 - B_PART + B_PART * n.astype(np.int64) * n_docs // max(n_terms, 1)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return SCALE * tf // (1000 * tf + K1 * m)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of whole numbers (seven bits each, low ones first; the last byte is below 128), and their sizes."""
    values = values.astype(np.int64)
    size = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        size += values >> bits > 0
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for i in range(int(size.max(initial=0))):
        ok = size > i
        out[at[ok] + i] = (values[ok] >> 7 * i & 127) | ((size[ok] > i + 1).astype(np.int64) << 7)
    return out, size


def unpacked(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    if len(last) == len(data):
        return data.astype(np.int64)
    first = np.concatenate([[0], last[:-1] + 1])
    shift = 7 * (np.arange(len(data)) - np.repeat(first, last - first + 1))
    return np.add.reduceat((data & 127).astype(np.int64) << shift, first)


class Segment:
    """Documents and postings of one segment while it is gathered."""

    def __init__(self):
        self.ids: list[pa.Array] = []
        self.names: dict[bytes, int] = {}
        self.term, self.doc, self.tf, self.n = [], [], [], []
        self.bytes = self.docs = 0

    def add(self, ids: pa.Array, data: np.ndarray, offs: np.ndarray) -> None:
        count = len(offs) - 1
        starts, ends, row = runs(TERM[data], offs)
        if len(starts):
            low = LOWER[data]
            first, kind = distinct(low, starts, ends)
            raw, names = low.tobytes(), self.names
            numbers = np.array([names.setdefault(raw[a:b], len(names)) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], np.int64)
            key, tf = np.unique(row * len(first) + kind, return_counts=True)
            self.term.append(numbers[key % len(first)].astype(np.int32))
            self.doc.append((key // len(first) + self.docs).astype(np.int32))
            self.tf.append(tf.astype(np.int32))
        self.n.append(np.bincount(row, minlength=count))
        self.ids.append(ids)
        self.docs += count
        self.bytes += len(data)

    def rows(self, number: int, level: int, n_docs: int, n_terms: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        """Documents are numbered by ascending id (nulls last), so that of equal scores the lower number comes first."""
        ids = pa.concat_arrays(self.ids)
        order = pc.sort_indices(ids).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        m = lengths(np.concatenate(self.n)[order], n_docs, n_terms)
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
        yield _batch(number, level, pa.array([""]), pa.array([len(ids)], pa.int32()), pa.array([m.tobytes()], pa.binary()), pa.array([b""], pa.binary()), listed)
        if not self.term:
            return
        key = np.concatenate(self.term).astype(np.int64) << 32 | place[np.concatenate(self.doc)]
        sort = np.argsort(key)
        tf = np.concatenate(self.tf)[sort].astype(np.int64)
        self.term, self.doc, self.tf = [], [], []
        key = key[sort]
        del sort
        doc = key & 0xFFFFFFFF
        new = np.flatnonzero(np.diff(key >> 32, prepend=-1))
        df = np.diff(np.append(new, len(key)))
        # a list's blocks begin at every 128th of its postings
        blocks = -(-df // BLOCK)
        start = np.repeat(new, blocks) + BLOCK * (np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        del key
        values = np.empty(2 * len(doc), np.int64)
        gap = np.diff(doc, prepend=0)
        gap[start] = 0
        values[0::2], values[1::2] = gap, tf - 1
        del gap
        data, size = packed(values)
        del values
        at = np.append(np.cumsum(size) - size, len(data))
        block_at = np.append(at[2 * start], len(data))
        heads = np.stack([doc[start], doc[np.append(start[1:], len(doc)) - 1], np.maximum.reduceat(impacts(tf, m[doc]), start), np.diff(block_at)], axis=1).astype(np.int32)
        head_at = 16 * np.append(np.searchsorted(start, new), len(start))
        list_at = np.append(at[2 * new], len(data))
        names = pa.array(list(self.names), pa.binary()).cast(pa.string())
        nothing = pa.nulls(1, pa.list_(kind))
        for lo in range(0, len(new), _ROWS):
            hi = min(lo + _ROWS, len(new))
            n = hi - lo
            yield _batch(number, level, names.slice(lo, n), pa.array(df[lo:hi].astype(np.int32)), _binary(heads.reshape(-1).view(np.uint8), head_at[lo : hi + 1]), _binary(data, list_at[lo : hi + 1]), nothing.take(pa.array(np.zeros(n, np.int64))))


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    part = np.ascontiguousarray(data[at[0] : at[-1]])
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(part)])


_NAMES = ["segment", "level", "term", "df", "heads", "payload", "ids"]


def _batch(number: int, level: int, *columns: pa.Array) -> pa.RecordBatch:
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, number, np.int64)), pa.array(np.full(n, level, np.int32)), *columns], names=_NAMES)


def _level(number: int) -> int:
    """0 for 15 of 16 segments, 1 for 15 of 16 of the rest, and so on."""
    h, level = zlib.crc32(number.to_bytes(8, "little")), 0
    while h % EARLIER == 0 and level < 8:
        h, level = h // EARLIER, level + 1
    return level


def index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES, segment_docs: int = SEGMENT_DOCS) -> Index:
    """A stored index of all terms of all whole texts.

    Texts are read twice: once for the number of documents with a term and of their terms, then for the
    postings. Null and empty texts have no terms; a very long text may end a segment by itself; rows that
    repeat are documents of their own; null ids are kept; no rows give an empty index; extra columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def counts(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column(0))
            n_docs = n_terms = 0
            for lo, hi in steps(offs):
                _, _, row = runs(TERM[data[offs[lo] : offs[hi]]], offs[lo : hi + 1] - offs[lo])
                n_docs, n_terms = n_docs + len(np.unique(row)), n_terms + len(row)
            yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms])], names=["n_docs", "n_terms"])

    total = rows.select("text").mapInArrow(counts, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = (int(x or 0) for x in total)

    def work(batches):
        from pyspark import TaskContext

        number, held, kind = TaskContext.get().partitionId() << 24, Segment(), None
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            kind = batch.column("doc_id").type
            for lo, hi in steps(offs):
                held.add(batch.column("doc_id").slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                if held.bytes >= segment_bytes or held.docs >= segment_docs:
                    yield from held.rows(number, _level(number), n_docs, n_terms, kind)
                    number, held = number + 1, Segment()
        if held.docs:
            yield from held.rows(number, _level(number), n_docs, n_terms, kind)

    long, whole, string, binary = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType()
    types = [long, whole, string, whole, binary, binary, T.ArrayType(rows.schema["doc_id"].dataType)]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(_NAMES, types, strict=True)])
    return Index(stored(rows.mapInArrow(work, schema), f"{work_dir(spark)}/postings"), n_docs, n_terms)


class Postings:
    """One term's blocks in a segment; they are decompressed when first read."""

    def __init__(self, df: int, heads: bytes, payload: bytes, m: np.ndarray):
        self.n, self.m, self.payload = df, m, np.frombuffer(payload, np.uint8)
        head = np.frombuffer(heads, np.int32).reshape(-1, 4).astype(np.int64)
        self.first, self.last, self.top = head[:, 0], head[:, 1], head[:, 2]
        self.best = int(self.top.max())
        self.at = np.concatenate([[0], np.cumsum(head[:, 3])])
        self.ready = np.zeros(len(head), bool)
        self.doc = self.impact = None

    def read(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of some blocks."""
        if self.doc is None:
            self.doc, self.impact = np.empty(self.n, np.int64), np.empty(self.n, np.int64)
        for b in blocks[~self.ready[blocks]].tolist():
            lo, hi = b * BLOCK, min((b + 1) * BLOCK, self.n)
            values = unpacked(self.payload[self.at[b] : self.at[b + 1]])
            self.doc[lo:hi] = doc = self.first[b] + np.cumsum(values[0::2])
            self.impact[lo:hi] = impacts(values[1::2] + 1, self.m[doc])
            self.ready[b] = True
        if len(blocks) == len(self.ready):
            return self.doc, self.impact
        if blocks[-1] - blocks[0] + 1 == len(blocks):
            part = slice(blocks[0] * BLOCK, (blocks[-1] + 1) * BLOCK)
            return self.doc[part], self.impact[part]
        take = np.concatenate([np.arange(b * BLOCK, min((b + 1) * BLOCK, self.n)) for b in blocks.tolist()])
        return self.doc[take], self.impact[take]


def best(lists: list[tuple[Postings, int]], n: int, k: int, floor: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The k best of ``n`` documents with a score of ``floor`` (at least 1) or more, best first, equal ones by number.

    ``lists`` are the postings and weights of a query's terms.
    """
    docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    bar = max(floor, 1)
    lists = sorted(lists, key=lambda x: x[0].n)
    for lo in range(0, n, window):
        if sum(w * p.best for p, w in lists) < bar:
            break
        hi = min(lo + window, n)
        edge = np.zeros(hi - lo + 1, np.int64)
        moved = []
        for p, w in lists:
            a, b = int(p.last.searchsorted(lo)), int(p.first.searchsorted(hi))
            if a < b:
                start, end, most = np.maximum(p.first[a:b] - lo, 0), np.minimum(p.last[a:b] + 1, hi) - lo, w * p.top[a:b]
                edge[start] += most
                edge[end] -= most
                moved.append((p, w, a, start, end, most))
        bound = np.cumsum(edge[:-1])
        live = bound >= bar
        for p, w, a, start, end, most in moved:
            seen = np.concatenate([[0], np.cumsum(live)])
            if not seen[-1]:
                break
            open_ = np.flatnonzero(seen[end] > seen[start])
            if not len(open_):
                continue
            edge = np.zeros(hi - lo + 1, np.int64)
            edge[start[open_]] -= most[open_]
            edge[end[open_]] += most[open_]
            bound += np.cumsum(edge[:-1])
            doc, impact = p.read(a + open_)
            inside = (doc >= lo) & (doc < hi)
            bound[doc[inside] - lo] += w * impact[inside]
            live &= bound >= bar
        found = np.flatnonzero(live)
        if len(found):
            docs, scores = np.concatenate([docs, found + lo]), np.concatenate([scores, bound[found]])
            keep = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[keep], scores[keep]
            if len(docs) == k:
                bar = max(bar, int(scores[-1]) + 1)
    return docs, scores


def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _query_blocks(queries: DataFrame, size: int) -> Iterator[list[tuple]]:
    """Queries as (id, terms), in blocks of about ``size`` bytes of terms."""
    held, n = [], 0
    for r in queries.toLocalIterator():
        held.append((r["item_id"], r["terms"]))
        n += sum(len(t) for t in r["terms"])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def search(found: Index, queries: DataFrame, *, k: int = 50, id_col: str = "item_id", text_col: str = "text", query_bytes: int = QUERY_BYTES, window: int = WINDOW) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of every query row.

    A query's terms count once. Null, empty and wordless queries have no results, nor do terms that no document
    has; equal scores go by ascending document id, nulls last; query rows that repeat are ranked each; an empty index gives
    none. Queries are taken in blocks of bounded size, each a pass over the index; extra columns are ignored.
    """
    spark = found.postings.sparkSession
    ship(spark)
    lower = F.translate(F.col(f"`{text_col}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.array_distinct(F.regexp_extract_all(lower, F.lit(f"({PATTERN})"), F.lit(1)))
    asked = queries.select(F.col(f"`{id_col}`").alias("item_id"), terms.alias("terms")).where(F.size("terms") > 0)
    home = work_dir(spark)
    id_type = found.postings.schema["ids"].dataType.elementType
    out = None
    for i, block in enumerate(_query_blocks(asked, query_bytes)):
        part = _ranked(found, block, asked.schema["item_id"], id_type, k, window, f"{home}/{i}")
        out = part if out is None else out.unionByName(part)
    schema = T.StructType([asked.schema["item_id"], T.StructField("rank", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])
    return spark.createDataFrame([], schema) if out is None else out


def _ranked(found: Index, block: list[tuple], item: T.StructField, id_type: T.DataType, k: int, window: int, home: str) -> DataFrame:
    spark = found.postings.sparkSession
    names = sorted({t for _, terms in block for t in terms})
    # the terms of one block of queries, of bounded size
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in [*names, ""]], "term string"))
    part = stored(found.postings.join(wanted, "term", "left_semi"), f"{home}/postings")
    df = {r["term"]: r["df"] for r in part.where("term <> ''").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weight = {t: _weight(found.n_docs, n) for t, n in df.items()}
    levels = sorted((r["level"] for r in part.select("level").distinct().collect()), reverse=True)
    best_so_far, floors = None, {}
    for level in levels:
        rows = part.where(F.col("level") == level)
        got = _round(rows, [[(t, weight[t]) for t in terms if t in weight] for _, terms in block], dict(floors), id_type, k, window)
        if best_so_far is not None:
            got = got.unionByName(best_so_far)
        order = Window.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best_so_far = stored(got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("place", "doc_id", "score", "rank"), f"{home}/round{level}")
        floors = {r["place"]: r["score"] for r in best_so_far.where(F.col("rank") == k).select("place", "score").collect()}
        if level != levels[-1]:
            best_so_far = best_so_far.drop("rank")
    if best_so_far is None:
        best_so_far = spark.createDataFrame([], T.StructType([T.StructField("place", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType()), T.StructField("rank", T.IntegerType())]))
    items = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], T.StructType([T.StructField("place", T.IntegerType()), item]))
    return best_so_far.join(F.broadcast(items), "place").select(item.name, F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _round(rows: DataFrame, queries: list[list[tuple[str, int]]], floors: dict[int, int], id_type: T.DataType, k: int, window: int) -> DataFrame:
    """The best documents of each segment for each query, as far as they reach the query's floor."""
    sent = rows.sparkSession.sparkContext.broadcast((queries, floors))
    schema = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("score", T.LongType())])

    def work(table: pa.Table) -> pa.Table:
        queries, floors = sent.value
        columns = {c: table.column(c).combine_chunks() for c in ("term", "df", "heads", "payload", "ids")}
        terms = columns["term"].to_pylist()
        about = terms.index("")
        ids = columns["ids"][about].values
        m = np.frombuffer(columns["heads"][about].as_py(), np.int64)
        df = columns["df"].to_pylist()
        lists = {t: Postings(df[i], columns["heads"][i].as_py(), columns["payload"][i].as_py(), m) for i, t in enumerate(terms) if t}
        places, docs, scores = [], [], []
        for place, query in enumerate(queries):
            held = [(lists[t], w) for t, w in query if t in lists]
            if held:
                d, s = best(held, len(ids), k, floors.get(place, 1), window)
                places.append(np.full(len(d), place, np.int32))
                docs.append(d)
                scores.append(s)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        return pa.table({"place": pa.array(join(places, np.int32)), "doc_id": ids.take(pa.array(join(docs, np.int64))), "score": pa.array(join(scores, np.int64))})

    return rows.select("segment", "term", "df", "heads", "payload", "ids").groupBy("segment").applyInArrow(work, schema)


def op12_block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(read(spark, sf_dir, "documents")), read(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM benchmark WHERE text IS NOT NULL
), c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0
), p AS (
  SELECT r, doc_id, term, CAST(count(*) AS BIGINT) AS tf, any_value(n) AS n
  FROM (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY r, doc_id, term
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, c GROUP BY term, n_docs
), s AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM p JOIN w USING (term) JOIN b USING (term), c GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 50
"""
