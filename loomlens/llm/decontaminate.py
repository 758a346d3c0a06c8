"""Benchmark decontamination by suffix arrays over shards of the training texts.

Every shard (a bounded run of documents within a task) gets a suffix array over its words.
Each distinct window of the test items' suffixes is binary-searched in it: the range of training
suffixes that begin with it are its verbatim occurrences. Ranges stand for all suffixes that share
the window, so that a text and an item that repeat a line cost the sum of their lengths and not
its product. At each place so found, a binary search in the sorted test suffixes gives the longest
verbatim match. Words that no item holds cannot take part in a match, so only stretches of item
words at least as long as the shortest window enter the array: that changes no result and keeps
arrays small.

Test items are read in blocks of bounded size, and each block is broadcast to one pass over the
documents, whatever the size of the benchmark. With several blocks the documents are written
once; a pass reads the texts and returns only what it found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Powers, gather_spans, mix, read, runs, ship, span_hashes, steps, stored, text_bytes, work_dir

WINDOW = 13
#: A document is contaminated when RATE times its hit words reach its words.
RATE = 20
#: Bytes of item text in one broadcast block.
BLOCK_BYTES = 4 << 20

#: Bytes of words: ASCII digits, lower-case letters and everything beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<bigint>,matches:array<struct<item:string,item_word:bigint,doc_word:bigint,words:bigint>>>"
_MATCH = pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("words", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int64())), ("matches", pa.list_(_MATCH))])


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``t`` by the order of the suffixes, compared over ``depth`` places at least (prefix doubling)."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] += np.cumsum(np.diff(key[order]) != 0)
        rank[order] = new
        k *= 2
        if k >= depth or not n or new[-1] == n:
            return order


class Hashed:
    """Word numbers with hashes of all their stretches, for the length of common stretches."""

    def __init__(self, t: np.ndarray):
        self.t = t
        up, self.down = Powers.of(len(t) + 1)
        self.sums = np.zeros(len(t) + 1, np.uint64)
        np.cumsum(mix((t + 2).astype(np.uint64)) * up[: len(t)], out=self.sums[1:])

    def of(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.sums[at + n] - self.sums[at]) * self.down[at]


def common(x: Hashed, at: np.ndarray, y: Hashed, to: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Words that agree from ``at`` of x and ``to`` of y on, ``most`` at most: a binary search for the length."""
    lo, hi = np.zeros(len(at), np.int64), most.copy()
    while (lo < hi).any():
        mid = (lo + hi + 1) >> 1
        same = x.of(at, mid) == y.of(to, mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


class Block:
    """A block of test items: their words as numbers, their suffixes in order, and the distinct windows of these."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        data, offs = text_bytes(pa.array([t for _, t in items], pa.string()))
        data = LOWER[data]
        starts, ends, row = runs(_WORD[data], offs)
        hashes = span_hashes(data, starts, ends)
        self.vocab, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
        self.lengths = (ends - starts)[first]
        self.bytes = gather_spans(data, starts[first], self.lengths)
        self.byte_at = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.names = pa.array([i for i, _ in items], pa.string())
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.vocab & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.window = window
        # words of all items, -1 behind each item
        count = np.bincount(row, minlength=len(items))
        at = np.concatenate([[0], np.cumsum(count)])[:-1]
        words = np.insert(ids, np.concatenate([[0], np.cumsum(count)])[1:], -1) if len(items) else np.zeros(0, np.int64)
        new = np.arange(len(ids)) + row
        place = np.arange(len(ids)) - at[row]
        self.words = Hashed(words)
        self.row, self.place, self.left = (np.zeros(len(words), np.int64) for _ in range(3))
        self.row[new], self.place[new], self.left[new] = row, place, count[row] - place
        size = np.zeros(len(words), np.int64)
        size[new] = np.where(np.minimum(window, count)[row] <= count[row] - place, np.minimum(window, count)[row], 0)
        order = suffix_array(words, int(count.max(initial=1)) + 1) if len(words) else np.zeros(0, np.int64)
        #: Suffixes that begin a window, by size and then in order; suffixes of one window are neighbours.
        self.suffix = order[size[order] > 0]
        self.suffix = self.suffix[np.argsort(size[self.suffix], kind="stable")]
        self.size = size[self.suffix]
        padded = np.concatenate([words, np.full(window, -1)])
        cols = np.arange(window)
        new = np.ones(len(self.suffix) + 1, bool)
        for i in range(1, len(self.suffix), 1 << 16):
            a, b = (self.suffix[x : x + (1 << 16)] for x in (i - 1, i))
            a, n = a[: len(b)], self.size[i : i + len(b)]
            differ = (padded[a[:, None] + cols] != padded[b[:, None] + cols]) & (cols < n[:, None])
            new[i : i + len(b)] = differ.any(1) | (self.size[i - 1 : i - 1 + len(b)] != n)
        #: Where each distinct window's suffixes begin, and the end.
        self.first = np.flatnonzero(new) if len(self.suffix) else np.zeros(1, np.int64)
        self.query = padded[self.suffix[self.first[:-1]][:, None] + cols]
        self.query_size = self.size[self.first[:-1]]
        self.least = int(self.size.min()) if len(self.size) else 0
        # the items of each distinct window, each once
        window_of = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        held = np.unique(window_of * len(items) + self.row[self.suffix]) if len(items) else np.zeros(0, np.int64)
        self.item = held % max(1, len(items))
        self.n_items = np.bincount(held // max(1, len(items)), minlength=len(self.first) - 1)
        self.item_at = np.concatenate([[0], np.cumsum(self.n_items)])[:-1]


def _bound(t: np.ndarray, sa: np.ndarray, q: np.ndarray, size: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of all queries at once: the first suffix not below (or, if ``after``, above) the query."""
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(sa), np.int64)
    cols = np.arange(q.shape[1])
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        diff = np.sign(t[sa[mid][:, None] + cols] - q[open_])
        diff[cols >= size[open_][:, None]] = 0
        sign = diff[np.arange(len(open_)), np.argmax(diff != 0, axis=1)]
        right = sign <= 0 if after else sign < 0
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def search(t: np.ndarray, block: Block, at_once: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (position in ``t``, distinct window) of all occurrences; -1 in ``t`` matches nothing.

    A position has one window of each size at most, so there are at most WINDOW pairs per position.
    """
    sa = suffix_array(t, block.window)
    padded = np.concatenate([t, np.full(block.window, -2)])
    places, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(block.query), at_once):
        q, size = block.query[i : i + at_once], block.query_size[i : i + at_once]
        lo, hi = (_bound(padded, sa, q, size, after) for after in (False, True))
        places.append(gather_spans(sa, lo, hi - lo))
        which.append(i + np.repeat(np.arange(len(q)), hi - lo))
    return np.concatenate(places), np.concatenate(which)


def longest(t: Hashed, block: Block, at: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longest match from each place on that begins with its window: a test suffix and the words that agree.

    The place is looked up among the window's suffixes, which are sorted; a neighbour of where it
    belongs agrees longest. A window of a short item is the whole item.
    """
    gap = np.append(np.flatnonzero(t.t < 0), len(t.t))
    left = gap[np.searchsorted(gap, at)] - at

    def agree(i):
        q = block.suffix[i]
        return common(t, at, block.words, q, np.minimum(left, block.left[q]))

    lo, hi = block.first[window], block.first[window + 1]
    end = hi - 1
    begin = lo.copy()
    while (lo < hi).any():
        mid = np.minimum((lo + hi) >> 1, end)
        k, q = agree(mid), block.suffix[mid]
        below = t.t[np.minimum(at + k, len(t.t) - 1)] < block.words.t[q + k]
        right = (k == block.left[q]) | ((k < left) & ~below)  # a suffix that ends here comes first
        open_ = lo < hi
        lo, hi = np.where(open_ & right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
    before, after = np.maximum(lo - 1, begin), np.minimum(lo, end)
    a, b = agree(before), agree(after)
    return block.suffix[np.where(b > a, after, before)], np.maximum(a, b)


def _lists(owner: np.ndarray, n: int, values: pa.Array, times: int = 1) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]) * times
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)


def shard(data: np.ndarray, offs: np.ndarray, block: Block) -> pa.StructArray:
    """The result of each document of a shard."""
    n = len(offs) - 1
    data = LOWER[data]
    starts, ends, doc = runs(_WORD[data], offs)
    words = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(words)])
    hit, items, matches = _hits(data, starts, ends, first, doc, block)
    s, e, d = runs(hit, first)
    spans = np.stack([s - first[d], e - first[d]], 1).reshape(-1)
    owner, item = items
    at, q, size = matches
    by = doc[at] if len(at) else at
    held = pa.StructArray.from_arrays([block.names.take(pa.array(block.row[q])), pa.array(block.place[q]), pa.array(at - first[by]), pa.array(size)], fields=list(_MATCH))
    return pa.StructArray.from_arrays(
        [pa.array(words), pa.array(np.bincount(doc[hit], minlength=n)), _lists(owner, n, block.names.take(pa.array(item))), _lists(d, n, pa.array(spans), 2), _lists(by, n, held)],
        fields=list(_FOUND),
    )


def _hits(data, starts, ends, first, doc, block):
    """Hit words, (documents, items) of occurring windows, and (word, test suffix, length) of the longest matches that no other contains."""
    z = np.zeros(0, np.int64)
    hit, none = np.zeros(len(starts), bool), ((z, z), (z, z, z))
    if not len(block.query) or not len(starts):
        return hit, *none
    h = span_hashes(data, starts, ends)
    tok = np.full(len(h), -1, np.int64)
    some = np.flatnonzero(block.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(block.vocab, h[some]), len(block.vocab) - 1)
    same = block.vocab[at] == h[some]
    tok[some[same]] = at[same]
    a, b, _ = runs(tok >= 0, first)
    long = b - a >= block.least
    a, b = a[long], b[long]
    if not len(a):
        return hit, *none
    size = b - a
    kept = gather_spans(np.arange(len(tok)), a, size)
    # equal hashes are taken as equal words only if the bytes agree
    got, lens = tok[kept], (ends - starts)[kept]
    bad = lens != block.lengths[got]
    if not bad.all():
        ok = np.flatnonzero(~bad)
        differ = gather_spans(data, starts[kept[ok]], lens[ok]) != gather_spans(block.bytes, block.byte_at[got[ok]], lens[ok])
        bad[ok] = np.add.reduceat(differ, np.concatenate([[0], np.cumsum(lens[ok])])[:-1]) > 0
    got = np.where(bad, -1, got)
    gaps = np.cumsum(size)[:-1]
    t = np.insert(got, gaps, -1)
    word = np.insert(kept, gaps, -1)
    at, w = search(t, block)
    if not len(at):
        return hit, *none
    edge = np.zeros(len(tok) + 1, np.int64)
    np.add.at(edge, word[at], 1)
    np.add.at(edge, word[at] + block.query_size[w], -1)
    hit = np.cumsum(edge[:-1]) > 0
    pairs = np.unique(doc[word[at]] * len(block.query) + w)
    owner, which = pairs // len(block.query), pairs % len(block.query)
    of = np.repeat(owner, block.n_items[which]) * len(block.names) + gather_spans(block.item, block.item_at[which], block.n_items[which])
    of = np.unique(of)
    # the longest window of each place, then the longest match
    order = np.lexsort((-block.query_size[w], at))
    at, w = at[order], w[order]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    at, w = at[new], w[new]
    q, size = longest(Hashed(t), block, at, w)
    reach = np.maximum.accumulate(at + size)
    alone = np.ones(len(at), bool)
    alone[1:] = (at + size)[1:] > reach[:-1]
    return hit, (of // len(block.names), of % len(block.names)), (word[at[alone]], q[alone], size[alone])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[list[tuple[str, str]]]:
    rows, held = [], 0
    for r in benchmark.select(F.col(id_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))).toLocalIterator():
        rows.append((r[0] if r[0] is not None else "", r[1]))
        held += len(r[1]) * 2
        if held >= size:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


_BLOCKS: dict[int, Block] = {}


def _cached(sent) -> Block:
    """The broadcast block, built once per worker process."""
    if sent.id not in _BLOCKS:
        _BLOCKS.clear()
        _BLOCKS[sent.id] = Block(sent.value)
    return _BLOCKS[sent.id]


class _Sent:
    """A broadcast list of items and its number, by which workers keep what they build of it."""

    def __init__(self, spark: SparkSession, items: list[tuple[str, str]]):
        self.broadcast = spark.sparkContext.broadcast(items)
        self.id = f"{spark.sparkContext.applicationId}/{self.broadcast._jbroadcast.id()}"

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}

    @property
    def value(self) -> list[tuple[str, str]]:
        return self.broadcast.value


def _pass(rows: DataFrame, sent: _Sent, carried: str, only_hits: bool) -> DataFrame:
    """``carried`` and found of the rows (of those with hits, if asked) for one block; the text is in column text."""

    def work(batches):
        block = _cached(sent)
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for lo, hi in steps(offs):
                found = shard(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], block)
                out = pa.RecordBatch.from_arrays([batch.column(carried).slice(lo, hi - lo), found], names=[carried, "found"])
                if only_hits:
                    out = out.filter(pa.array(found.field(1).to_numpy() > 0))
                if out.num_rows:
                    yield out

    schema = T.StructType([rows.schema[carried], T.StructField("found", T.StructType.fromDDL(f"found {RESULT}")["found"].dataType)])
    return rows.select(carried, "text").mapInArrow(work, schema)


def _union(lists: list[dict]) -> dict:
    """The results of several blocks for one document."""
    spans: list[int] = []
    for s, e in sorted(p for f in lists for p in zip(f["spans"][::2], f["spans"][1::2], strict=True)):
        if spans and s <= spans[-1]:
            spans[-1] = max(spans[-1], e)
        else:
            spans += [s, e]
    matches, reach = [], -1
    for m in sorted((m for f in lists for m in f["matches"]), key=lambda m: (m["doc_word"], -m["words"])):
        if m["doc_word"] + m["words"] > reach:
            matches.append(m)
            reach = m["doc_word"] + m["words"]
    return {"n_words": lists[0]["n_words"], "n_hit": sum(spans[1::2]) - sum(spans[::2]), "items": sorted({i for f in lists for i in f["items"]}), "spans": spans, "matches": matches}


def _merge(table: pa.Table) -> pa.Table:
    return pa.table({"place": table.column("place").slice(0, 1), "found": pa.array([_union(table.column("found").to_pylist())], _FOUND)})


def annotate(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Columns ``row`` (a struct of the documents' ``keep`` columns, all by default) and ``found``.

    ``found`` has the words, the hit words, the items with occurring windows, hit word ranges and
    the longest verbatim matches that no other contains, one item for each (the first of equals;
    lengths beyond the window are compared by 64-bit hashes). Null and empty texts have no words;
    items without words match nothing; a null item id counts as ''; repeated rows are each treated
    alone; an empty benchmark hits nothing. A very long text is a shard of its own, whose arrays
    grow with its length alone, however often it or an item repeats a line. Clashing names of extra
    columns do no harm, as they stay within ``row``.
    """
    spark = docs.sparkSession
    ship(spark)
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    items, later = next(blocks, []), next(blocks, None)
    if later is None:
        return _pass(rows, _Sent(spark, items), "row", False)
    home = work_dir(spark)
    rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), f"{home}/rows")
    paths = []
    while items is not None:
        paths.append(f"{home}/block{len(paths)}")
        _pass(rows, _Sent(spark, items), "place", len(paths) > 1).write.parquet(paths[-1])
        items, later = later, next(blocks, None)
    # the first block has every document, the others those that they hit
    every = spark.read.parquet(paths[0])
    more = spark.read.parquet(*paths[1:])
    hit = more.select("place").distinct()
    merged = more.unionByName(every.join(hit, "place")).groupBy("place").applyInArrow(_merge, every.schema)
    return rows.select("row", "place").join(every.join(hit, "place", "left_anti").unionByName(merged), "place").select("row", "found")


def contaminated(found: str = "found", rate: int = RATE):
    return (F.col(f"{found}.n_hit") > 0) & (F.col(f"{found}.n_hit") * rate >= F.col(f"{found}.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, rate: int = RATE, **options) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    kept = annotate(docs, benchmark, **options).where(~contaminated(rate=rate))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = annotate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.array_sort(F.array_distinct("found.items"))
    return marked.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        F.col("found.n_hit").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, p, p + least(13, len(w)) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM bw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM iw
), occ AS (
  SELECT d.doc_id, d.p, i.n, i.item_id
  FROM (SELECT doc_id, n, p, list_slice(w, p, p + n - 1) AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes WHERE len(w) >= n)) d
  JOIN iw i ON i.n = d.n AND i.g = d.g
), hits AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occ) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
