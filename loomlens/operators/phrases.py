"""Phrases and similar turns: character n-grams, TF-IDF, neighbours, clusters."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import unwrap_udt

from ..functions.ordering import numbered
from ..functions.shipping import ship
from ..functions.storage import checkpoints, small, stored

# Phrases that are never reported, and parts that no reported phrase holds.
STOP_PHRASES = ["这个", "就是", "然后", "那个", "我们", "一下", "对吧", "应该", "没有", "直接", "可以", "所以", "的话", "现在", "你看", "这个是", "然后呢", "ctrl", "resume", "session", "current", "folder", "num"]
BANNED_PARTS = ["ctrl", "resume", "session", "current folder", "num"]
SIMILAR = 0.38


def grams(texts: DataFrame, key: list[str], low: int, high: int, text: str = "normalized", parts: int = 0) -> DataFrame:
    """Every character n-gram occurrence of every text as (key, gram); short texts have none of the longer ones.

    Texts are dealt by their keys first (to ``parts`` partitions at least), so that what is counted by key and n-gram needs
    no shuffle of the n-grams.
    """
    t = F.col(text)
    texts = texts.repartition(max(parts, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key[0])

    def of_size(n: int):
        all_ = F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substring(t, i, F.lit(n)))
        return F.when(F.length(t) >= n, all_).otherwise(F.array().cast("array<string>"))

    return texts.select(*key, F.explode(F.concat(*[of_size(n) for n in range(low, high + 1)])).alias("gram"))


def gram_counts(texts: DataFrame, key: list[str], low: int = 3, high: int = 8, least: int = 2) -> DataFrame:
    """Occurrences and texts of each n-gram that at least ``least`` texts have (partial sums by text first)."""
    per = grams(texts, key, low, high).groupBy(*key, "gram").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("gram").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_texts")).where(F.col("n_texts") >= least)


def phrase_candidates(counts: DataFrame) -> DataFrame:
    """N-grams that may be reported, with the weight that orders them."""
    raw = F.trim("gram")
    ok = (F.col("n") >= 2) & F.length(raw).between(3, 18) & ~raw.rlike("[<>]") & ~raw.isin(*STOP_PHRASES) & raw.rlike("[a-z一-鿿]") & ~raw.rlike("^[a-z]{1,3}$")
    for part in BANNED_PARTS:
        ok = ok & ~F.contains(raw, F.lit(part))
    return counts.where(ok).select("gram", raw.alias("phrase"), "n", (F.col("n") * F.length("gram")).alias("weight"))


def frequent_phrases(counts: DataFrame, k: int = 80) -> DataFrame:
    """The first k phrases that no more frequent reported phrase contains (a top-k report).

    Candidates go by weight, count, length and n-gram. One falls to any earlier one that holds its phrase and is as
    frequent; whether that one is itself reported does not matter, since whatever it falls to holds the phrase as well. So a
    candidate stays if no part of an earlier one is its phrase, which partial sums tell: of the candidates that hold a part,
    the most frequent of each length (ties: the lesser n-gram) is the first of that length and the only one that can matter.
    """
    rows = phrase_candidates(counts).withColumn("size", F.length("gram"))
    n = F.length("phrase")
    parts = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.transform(F.sequence(F.lit(3), n - i + 1), lambda m: F.substring(F.col("phrase"), i, m)))))
    held = rows.select(F.explode(parts).alias("phrase"), "size", F.struct((-F.col("n")).alias("n"), "gram").alias("key"))
    first = held.groupBy("phrase", "size").agg(F.min("key").alias("key"))
    order = lambda c: F.struct((-c["n"] * c["size"]).alias("w"), (-c["n"]).alias("n"), (-c["size"]).alias("s"), c["gram"].alias("gram"))
    other = first.select("phrase", F.struct((-F.col("key.n")).alias("n"), "size", F.col("key.gram").alias("gram")).alias("o"))
    own = rows.select("phrase", F.struct("n", "size", "gram").alias("c"))
    fallen = own.join(other, "phrase").where((F.col("o.n") >= F.col("c.n")) & (order(F.col("o")) < order(F.col("c")))).select("c.gram").distinct()
    kept = rows.join(fallen, "gram", "left_anti").orderBy(F.desc("weight"), F.desc("n"), F.desc("size"), "gram").limit(k)
    place = F.row_number().over(Window.orderBy(F.desc("weight"), F.desc("n"), F.desc("size"), "gram"))  # k rows
    return kept.select(place.alias("place"), "phrase", "n", (F.col("n") * F.length("phrase")).alias("score"))


def folded(texts: DataFrame, key: str, text: str = "normalized") -> tuple[DataFrame, DataFrame]:
    """Equal texts as one: (key, text, copies), where the least key stands for all, and the members as (key, of)."""
    each = texts.groupBy(text).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))
    members = texts.join(each.select(text, F.col(key).alias("of")), text).select(key, "of")
    return each.select(key, text, "copies"), members


def _counted(texts: DataFrame, key: list[str], low: int, high: int, copies: str | None, parts: int = 0) -> DataFrame:
    """(key, gram, tf, _copies): how often each text has each of its n-grams, and how many texts it stands for."""
    texts = texts.withColumn("_copies", (F.lit(1) if copies is None else F.col(copies)).cast("long"))
    return grams(texts, [*key, "_copies"], low, high, parts=parts).groupBy(*key, "gram").agg(F.count(F.lit(1)).alias("tf"), F.first("_copies").alias("_copies"))


def _texts_with(tf: DataFrame, least: int) -> DataFrame:
    return tf.groupBy("gram").agg(F.sum("_copies").alias("df")).where(F.col("df") >= least)


def _weighed(tf: DataFrame, df: DataFrame, texts: DataFrame, copies: str | None) -> DataFrame:
    """(key, gram, w) before they are scaled."""
    total = texts.agg(F.sum((F.lit(1) if copies is None else F.col(copies)).cast("long")).alias("total"))  # one row
    return tf.join(df, "gram").crossJoin(F.broadcast(total)).withColumn("w", F.col("tf") * (F.log((1 + F.col("total")) / (1 + F.col("df"))) + 1))


def tfidf(texts: DataFrame, key: list[str], low: int = 2, high: int = 5, least: int = 2, copies: str | None = None) -> DataFrame:
    """(key, gram, w): raw counts times ln((1 + texts) / (1 + texts with the gram)) + 1, scaled to unit length by text.

    With ``copies`` a row stands for so many equal texts.
    """
    tf = _counted(texts, key, low, high, copies)
    raw = _weighed(tf, _texts_with(tf, least), texts, copies)
    return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*key)))).select(*key, "gram", "w")


#: Characters of texts of a partition that vectors are made in.
VECTOR_CHARS = 1 << 17


def tfidf_vectors(texts: DataFrame, key: str, low: int = 2, high: int = 5, least: int = 2, copies: str | None = None, near: bool = False) -> DataFrame:
    """The weights of ``tfidf`` as stored vectors: (key, grams, weights, norm), where a weight is to be divided by the norm.

    Unscaled weights have few different values, which Parquet keeps by number. As texts are dealt by key and the counts of
    n-grams are broadcast (unless they are too many), no n-gram of a text is shuffled. With ``near`` n-grams are hashed and
    each vector has its pivot, which is all that ``similar_links`` needs: it then stores no vectors of its own.
    """
    chars = texts.agg(F.sum(F.length("normalized"))).first()[0] or 0
    tf = _counted(texts, [key], low, high, copies, parts=-(-chars // VECTOR_CHARS))
    df = small(stored(_texts_with(tf, least)))

    def normed(tf: DataFrame) -> DataFrame:
        return _packed(_weighed(tf, df, texts, copies), key).withColumn("norm", F.sqrt(F.aggregate("weights", F.lit(0.0), lambda sum_, w: sum_ + w * w)))

    if not near:
        return stored(normed(tf))
    ship(texts.sparkSession)
    few = texts.orderBy(F.xxhash64(key)).limit(SIMILAR_PIVOTS)
    return stored(_with_pivots(_hashed(normed(tf), key), _pivots(_hashed(normed(_counted(few, [key], low, high, copies)), key))).withColumnRenamed("key", key))


def _packed(weights: DataFrame, key: str) -> DataFrame:
    each = weights.groupBy(key).agg(F.collect_list(F.struct("gram", "w")).alias("v"))
    return each.select(key, F.transform("v", lambda x: x["gram"]).alias("grams"), F.transform("v", lambda x: x["w"]).alias("weights"))


def _as_vectors(weights: DataFrame, key: str) -> DataFrame:
    """Vectors as from ``tfidf_vectors``, of which weights by n-gram make some of length 1."""
    return weights if "grams" in weights.columns else stored(_packed(weights, key).withColumn("norm", F.lit(1.0)))


def _by_gram(weights: DataFrame) -> DataFrame:
    """Weights by n-gram: vectors taken apart, other columns kept."""
    if "grams" not in weights.columns:
        return weights
    rest = [c for c in weights.columns if c not in ("grams", "weights", "norm")]
    each = weights.select(*rest, "norm", F.explode(F.arrays_zip("grams", "weights")).alias("x"))
    return each.select(*rest, F.col("x.grams").alias("gram"), (F.col("x.weights") / F.col("norm")).alias("w"))


#: Texts and n-grams of texts of a block of the similarity search, blocks that a task meets one with, texts it meets it with at a time.
SIMILAR_BLOCK, SIMILAR_CELLS, SIMILAR_SPAN, SIMILAR_TILE = 4096, 3 << 19, 2, 512
#: N-grams of a matrix product, rows up to which an n-gram is rare, and products of weights that are added up at a time.
SIMILAR_COLUMNS, SIMILAR_RARE, SIMILAR_STEP = 2048, 12, 1 << 19
#: An n-gram goes into the matrix product if so large a share of a tile's pairs of texts has it; else its pairs are added up one by one.
SIMILAR_DENSE = 0.0025
#: Texts that the others are grouped by, and n-grams of each.
SIMILAR_PIVOTS, SIMILAR_PIVOT_GRAMS = 32, 4096


def _vectors_in(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, and row, n-gram and weight of each n-gram of a batch of vectors."""
    size = batch.column("grams").value_lengths().to_numpy()
    w = batch.column("weights").flatten().to_numpy() / np.repeat(batch.column("norm").to_numpy(), size)
    return batch.column("key").to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size), batch.column("grams").flatten().to_numpy(), w


class _Cell:
    """A block of texts that others are met with: exact products of their vectors, a tile of texts at a time.

    N-grams of many of the block's texts are columns of a matrix. Those that also many of a tile's texts have go into one
    matrix product, and for the others products of weights are added up by pair.
    """

    def __init__(self, least: float, links: bool):
        self.least, self.links, self.batches, self.built = least, links, [], False

    def build(self) -> None:
        self.built = True
        self.keys = np.concatenate([b.column("key").to_numpy(zero_copy_only=False) for b in self.batches])
        each = [_vectors_in(b)[1:] for b in self.batches]
        first = np.cumsum([0, *[b.num_rows for b in self.batches]])
        row = np.concatenate([(r + f).astype(np.int32) for (r, _, _), f in zip(each, first, strict=False)])
        w = np.concatenate([e[2] for e in each])
        self.grams, column, self.count = np.unique(np.concatenate([e[1] for e in each]), return_inverse=True, return_counts=True)
        column, each = column.astype(np.int32), None
        order = np.argsort(column, kind="stable")
        self.row, self.w = row[order], w[order]
        order = None
        self.first = np.cumsum(self.count) - self.count
        often = np.flatnonzero(self.count > SIMILAR_RARE)
        often = often[np.argsort(-self.count[often], kind="stable")[:SIMILAR_COLUMNS]]
        self.place = np.full(len(self.grams), -1)
        self.place[often] = np.arange(len(often))
        self.often = np.zeros((len(often), len(self.keys)))
        at = self.place[column]
        self.often[at[at >= 0], row[at >= 0]] = w[at >= 0]
        self.label = np.arange(len(self.keys))

    def products(self, n: int, row: np.ndarray, gram: np.ndarray, w: np.ndarray) -> np.ndarray:
        size = len(self.keys)
        dots = np.zeros((n, size))
        column = np.searchsorted(self.grams, gram)
        both = np.append(self.grams, 0)[column] == gram
        both &= column < len(self.grams)
        row, column, w = row[both], column[both], w[both]
        n_rows = np.bincount(column, minlength=len(self.grams))
        often = np.flatnonzero((self.place >= 0) & (n_rows > 0) & (n_rows * self.count >= SIMILAR_DENSE * n * size))
        if len(often):
            at = np.full(len(self.grams), -1)
            at[often] = np.arange(len(often))
            here = at[column] >= 0
            m = np.zeros((n, len(often)))
            m[row[here], at[column[here]]] = w[here]
            dots += m @ self.often[self.place[often]]
            row, column, w = row[~here], column[~here], w[~here]
        count, flat = self.count[column], dots.reshape(-1)
        end = np.cumsum(count)
        lo = 0
        while lo < len(row):
            hi = max(lo + 1, int(np.searchsorted(end, end[lo] - count[lo] + SIMILAR_STEP, side="right")))
            c = count[lo:hi]
            of = np.repeat(self.first[column[lo:hi]] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            np.add.at(flat, np.repeat(row[lo:hi] * size, c) + self.row[of], np.repeat(w[lo:hi], c) * self.w[of])
            lo = hi
        return dots

    def meet(self, batch, own: np.ndarray | None = None):
        """Pairs of the batch's texts with the block's; ``own``: the batch is of the block's own, which have these places."""
        for lo in range(0, batch.num_rows, SIMILAR_TILE):
            keys, row, gram, w = _vectors_in(batch.slice(lo, SIMILAR_TILE))
            dots = self.products(len(keys), row, gram, w)
            x, y = np.nonzero(dots >= self.least - 1e-6)
            found = np.round(dots[x, y], 6)
            keep = found >= self.least
            if own is not None:
                keep &= own[lo + x] < y
            x, y, found = x[keep], y[keep], found[keep]
            if not self.links:
                yield self.pairs(keys[x], self.keys[y], found)
            elif own is not None:
                _unite(self.label, own[lo + x], y)
            elif len(x):
                one = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
                _unite(self.label, np.repeat(y[one], np.diff(np.append(one, len(x)))), y)
                yield self.pairs(keys[x[one]], self.keys[y[one]])

    def pairs(self, first: np.ndarray, second: np.ndarray, found: np.ndarray | None = None):
        swap = first > second
        a, b = np.where(swap, second, first), np.where(swap, first, second)
        columns = [pa.array(a, self.type), pa.array(b, self.type)] + ([] if found is None else [pa.array(found)])
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "similarity"][: len(columns)])

    def add(self, batch, side: int, whole: bool):
        self.type = batch.schema.field("key").type
        if side == 0:
            self.batches.append(batch)
            return
        yield from self.open(whole)
        if len(self.keys):
            yield from self.meet(batch)

    def open(self, whole: bool):
        """Once, when all of the block is there; ``whole``: the block is met with itself here."""
        if self.built:
            return
        if not self.batches:
            self.built, self.keys, self.label = True, np.zeros(0, object), np.zeros(0, np.int64)
            return
        self.build()
        block, self.batches = self.batches if whole else [], []
        at = 0
        for batch in block:
            yield from self.meet(batch, np.arange(at, at + batch.num_rows))
            at += batch.num_rows

    def end(self, whole: bool):
        yield from self.open(whole)
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        if self.links and len(moved):
            yield self.pairs(self.keys[moved], self.keys[self.label[moved]])


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Makes one set of the sets of each a and b; a label is the least member of a set."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label[:] = label[label]


def _cells(batches, least: float, span: int):
    """Pairs of cells from rows of (i, chunk, side, key, grams, weights, norm), sorted by the first three."""
    at, cell = None, None
    for batch in batches:
        i, chunk, side = (batch.column(c).to_numpy() for c in ("i", "chunk", "side"))
        edge = np.append(np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (chunk[1:] != chunk[:-1]) | (side[1:] != side[:-1])))[: len(i)], len(i))
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if (i[lo], chunk[lo]) != at:
                if cell is not None:
                    yield from cell.end(at[0] // span == at[1])
                at, cell = (i[lo], chunk[lo]), _Cell(least, False)
            yield from cell.add(batch.slice(lo, hi - lo), side[lo], at[0] // span == at[1])
    if cell is not None:
        yield from cell.end(at[0] // span == at[1])


def _grouped(batches, grams: np.ndarray, weights: np.ndarray):
    """Vectors with the pivot that each is nearest to; a pivot is a column of ``weights``, whose rows are ``grams``."""
    for batch in batches:
        _, row, gram, w = _vectors_in(batch)
        at = np.minimum(np.searchsorted(grams, gram), len(grams) - 1)
        both = grams[at] == gram
        near = np.zeros((batch.num_rows, weights.shape[1]))
        for p in range(weights.shape[1]):
            near[:, p] = np.bincount(row[both], w[both] * weights[at[both], p], minlength=batch.num_rows)
        yield batch.append_column("near", pa.array(near.argmax(axis=1).astype(np.int32)))


def _pivots(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """N-grams and weights of a few texts, like ones side by side."""
    some = rows.select(F.slice("grams", 1, SIMILAR_PIVOT_GRAMS).alias("g"), F.slice("weights", 1, SIMILAR_PIVOT_GRAMS).alias("w"), "norm", "key").orderBy(F.xxhash64("key")).limit(SIMILAR_PIVOTS).collect()
    if not some:
        return np.zeros(1, np.int64), np.zeros((1, 1))
    grams = np.unique(np.concatenate([np.array(r["g"], np.int64) for r in some]))
    weights = np.zeros((len(grams), len(some)))
    for p, r in enumerate(some):
        weights[np.searchsorted(grams, np.array(r["g"], np.int64)), p] = np.array(r["w"]) / r["norm"]
    like, order = weights.T @ weights, [0]
    while len(order) < len(some):
        order.append(max(set(range(len(some))) - set(order), key=lambda p: like[order[-1], p]))
    return grams, weights[:, order]


def _hashed(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.select(F.col(key).alias("key"), F.transform("grams", lambda g: F.xxhash64(g)).alias("grams"), "weights", "norm")


def _with_pivots(rows: DataFrame, pivots: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    return rows.mapInArrow(lambda b: _grouped(b, *pivots), T.StructType([*rows.schema.fields, T.StructField("near", T.IntegerType())]))


def _dealt(vectors: DataFrame, key: str, n_texts: int | None) -> tuple[DataFrame, int]:
    """Vectors by hashed n-grams with their block, and the number of blocks.

    Texts that are nearest to the same pivot follow one another, and blocks are cut from all in turn: like texts meet in few
    cells, and unlike ones have few n-grams in common, which are the work of a cell. Where a text is changes no result.
    """
    n, cells = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()
    blocks = max(1, -(-(n if n_texts is None else n_texts) // SIMILAR_BLOCK), -(-cells // SIMILAR_CELLS))
    rows = vectors.withColumnRenamed(key, "key") if "near" in vectors.columns else _hashed(vectors, key)
    if blocks == 1 or not n:
        return rows.withColumn("block", F.lit(0)).drop("near"), 1
    grouped = rows if "near" in rows.columns else stored(_with_pivots(rows, _pivots(rows)))
    sizes = dict(grouped.groupBy("near").count().collect())  # a row a pivot
    size = [sizes.get(p, 0) for p in range(max(sizes) + 1)]
    of = lambda values: F.array(*[F.lit(int(v)).cast("long") for v in values])[F.col("near")]
    place = of(np.cumsum(size) - size) + F.pmod(F.xxhash64("key"), of(np.maximum(size, 1)))
    return grouped.withColumn("block", F.floor(place * blocks / n).cast("int")).drop("near"), blocks


def _round(dealt: DataFrame, now: list[int], blocks: int) -> DataFrame:
    """Rows of the cells in which these blocks meet themselves and all later ones; side 0 is the block, 1 what it meets."""
    span, last = SIMILAR_SPAN, (blocks - 1) // SIMILAR_SPAN

    def cells(i: int):
        one = lambda chunk, side: F.struct(F.lit(i).alias("i"), chunk.cast("int").alias("chunk"), F.lit(side).alias("side"))
        block = F.transform(F.sequence(F.lit(i // span), F.lit(last)), lambda c: one(c, 0))
        return F.when(F.col("block") == i, block).when(F.col("block") > i, F.array(one(F.floor(F.col("block") / span), 1))).otherwise(F.slice(block, 1, 0))

    rows = dealt.where(F.col("block") >= min(now)).select("key", "grams", "weights", "norm", F.explode(F.concat(*map(cells, now))).alias("cell")).select("cell.*", "key", "grams", "weights", "norm")
    return rows.repartition(sum(last - i // span + 1 for i in now), "i", "chunk").sortWithinPartitions("i", "chunk", "side")


def _rounds(blocks: int) -> list[list[int]]:
    """The first block with the last and so on inwards: as much to meet in each round."""
    return [sorted({k, blocks - 1 - k}) for k in range(-(-blocks // 2))]


def similar_pairs(weights: DataFrame, key: str, least: float = SIMILAR, n_texts: int | None = None) -> DataFrame:
    """Pairs of texts with a cosine of ``least`` or more; ``weights`` are (key, gram, w), or vectors as from ``tfidf_vectors``.

    The bound is low, so that nearly every n-gram of a vector could lead to a partner and a prefix
    filter leaves nearly all pairs. Texts are dealt in blocks instead; a block meets all later ones,
    a few of them a task, in exact products of their vectors. Blocks grow with the texts, memory of a task
    does not. Two blocks a round meet the others, the first with the last and so on inwards, so that a
    round shuffles less than three times the vectors; its result is stored and its shuffle freed, so disk grows with the
    texts and with the pairs, and not with the texts' square. ``n_texts`` sets the number of blocks; without it the texts are counted.
    """
    ship(weights.sparkSession)
    dealt, blocks = _dealt(_as_vectors(weights, key), key, n_texts)
    name, span = weights.schema[key].dataType.simpleString(), SIMILAR_SPAN
    schema = f"a {name}, b {name}, similarity double"
    return reduce(DataFrame.union, [stored(_round(dealt, now, blocks).mapInArrow(lambda b: _cells(b, least, span), schema)) for now in _rounds(blocks)])


def _linked(batches, block: pa.Table, least: float):
    """Links of a block with texts of its own and of others, which come as rows of (own, key, grams, weights, norm)."""
    cell = _Cell(least, True)
    cell.batches, cell.type = block.to_batches(), block.schema.field("key").type
    for batch in batches:
        if not block.num_rows:
            continue
        if not cell.built:
            cell.build()
            order = np.argsort(cell.keys)
        for own in (True, False):
            some = batch.filter(batch.column("own") if own else pc.invert(batch.column("own")))
            if some.num_rows:
                yield from cell.meet(some, order[np.searchsorted(cell.keys, some.column("key").to_numpy(zero_copy_only=False), sorter=order)] if own else None)
    if cell.built:
        yield from cell.end(False)


def _block_links(dealt: DataFrame, i: int, least: float, schema: str) -> DataFrame:
    """Links of a block with itself and all later ones: each task meets its rows with the block, which is broadcast."""
    rows, at = dealt.select("key", "grams", "weights", "norm", (F.col("block") == i).alias("own")), F.col("block")
    block = dealt.sparkSession.sparkContext.broadcast(rows.where(at == i).drop("own").toArrow())
    try:
        return stored(rows.where(at >= i).mapInArrow(lambda b: _linked(b, block.value, least), schema))
    finally:
        block.destroy()


def similar_links(weights: DataFrame, key: str, least: float = SIMILAR) -> DataFrame:
    """Links (a, b) that join the same texts as all ``similar_pairs`` do: of each task, so many at most as it has texts.

    A block at a time, which has a bounded size, is broadcast and meets its own texts and those of all later blocks where
    they are read. Nothing is shuffled, so that the stored vectors are all that the disk holds besides the links.
    """
    ship(weights.sparkSession)
    dealt, blocks = _dealt(_as_vectors(weights, key), key, None)
    name = weights.schema[key].dataType.simpleString()
    return reduce(DataFrame.union, [_block_links(dealt, i, least, f"a {name}, b {name}") for i in range(blocks)])


def components(nodes: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, cluster): the least member of each node's component; least labels and pointer jumping, a checkpoint each round."""
    edges = pairs.select("a", "b").union(pairs.select("b", "a")).checkpoint()
    now = nodes.select(key, F.col(key).alias("cluster")).checkpoint()
    while True:
        near = edges.join(now.withColumnRenamed(key, "b"), "b").groupBy("a").agg(F.min("cluster").alias("near"))
        new = now.join(near, now[key] == near["a"], "left").select(key, "cluster", F.least("cluster", F.coalesce("near", "cluster")).alias("new"))
        jump = new.select(F.col(key).alias("new"), F.col("new").alias("further"))
        new = new.join(jump, "new", "left").select(key, "cluster", F.coalesce("further", "new").alias("new")).checkpoint()
        if new.where("new <> cluster").isEmpty():
            return now
        now = new.select(key, F.col("new").alias("cluster"))


def dbscan(nodes: DataFrame, pairs: DataFrame, key: str, copies: str | None = None) -> DataFrame:
    """Clusters of at least two (every point with a neighbour is a core point); noise has a null cluster.

    With ``copies`` a node stands for so many equal points, which are neighbours of one another.
    """
    rows = components(nodes.select(key), pairs, key)
    n = F.lit(1)
    if copies is not None:
        rows, n = rows.join(nodes.select(key, copies), key), F.col(copies)
    sizes = rows.groupBy("cluster").agg(F.sum(n).alias("size"))  # sums first: a cluster may hold most points
    return rows.join(sizes, "cluster").select(key, F.when(F.col("size") > 1, F.col("cluster")).alias("cluster"), "size")


def similar_clusters(nodes: DataFrame, members: DataFrame, pairs: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """Clusters of all texts from those of distinct ones: (key, cluster, size). ``nodes`` and ``members`` are from ``folded``.

    Copies are neighbours unless they have no n-grams that others share, as points without weights have no neighbour at all.
    """
    bare = nodes.join(weights.select(key).distinct(), key, "left_anti").select(key, F.lit(True).alias("bare"))
    marked = nodes.join(bare, key, "left").withColumn("copies", F.when(F.col("bare"), 1).otherwise(F.col("copies")))
    found = dbscan(marked, pairs, key, "copies")
    return members.join(found.withColumnRenamed(key, "of"), "of").select(key, "cluster", "size")


#: Starts of k-means that run at once, and n-gram weights of a partition of its vectors.
KMEANS_AT_ONCE, KMEANS_CELLS = 8, 2_000_000


def vectors(weights: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(key, features) with sparse vectors over all n-grams, by built-in functions alone, and how many n-grams there are.

    Vectors are written as the plain fields that their type is stored as, and read with the type.
    """
    vocabulary = numbered(weights.select("gram").distinct(), ["gram"], "i")
    n_grams = vocabulary.count()
    cells = weights.join(vocabulary, "gram").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), "w"))).alias("c"))
    plain = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(n_grams).alias("size"), F.transform("c", lambda x: x["i"]).alias("indices"), F.transform("c", lambda x: x["w"]).alias("values"))
    path = f"{checkpoints(weights.sparkSession).rstrip('/')}/loomlens-{uuid.uuid4().hex}"
    cells.select(key, plain.alias("features")).write.parquet(path)
    schema = T.StructType([weights.schema[key], T.StructField("features", VectorUDT())])
    return weights.sparkSession.read.schema(schema).parquet(path), n_grams


def kmeans(weights: DataFrame, key: str, starts: int = 20, seed: int = 0) -> DataFrame:
    """(key, cluster) by k-means over the sparse TF-IDF vectors of all n-grams; k grows with the root of half the texts, 2 to 6.

    Of ``starts`` fits with seeds of their own, the one of least cost is taken.
    """
    features, _ = vectors(weights, key)
    n, cells = features.agg(F.count(F.lit(1)), F.sum(F.size(unwrap_udt("features")["indices"]))).first()
    if n < 4:
        return features.select(key, F.lit(None).cast("int").alias("cluster")).limit(0)
    rows = features.repartition(max(1, -(-cells // KMEANS_CELLS)), key).persist()
    k = min(6, max(2, round((n / 2) ** 0.5)))
    # the starts do not wait for one another; of equal costs the first seed is taken
    with ThreadPoolExecutor(KMEANS_AT_ONCE) as pool:
        fits = list(pool.map(lambda i: KMeans(k=k, seed=seed + i, maxIter=20, solver="row").fit(rows), range(starts)))
    best = min(fits, key=lambda m: m.summary.trainingCost)
    rows.unpersist()
    return best.transform(features).select(key, F.col("prediction").alias("cluster"))


def cluster_report(weights: DataFrame, members: DataFrame, key: str, terms: int = 6, examples: int = 4, of: DataFrame | None = None) -> DataFrame:
    """Clusters by size: the heaviest terms of the centroid and the members nearest to it.

    With ``of`` (key, of; as from ``folded``) weights are those of distinct texts, and members all texts. Weights may be
    vectors as from ``tfidf_vectors``.

    ``members`` has the key and its cluster; null clusters (noise) are left out. Of the eight heaviest
    terms (ties: the later n-gram) those with weight are kept, six at most; members that are as near
    follow in order of their keys.
    """
    everyone = members.where("cluster IS NOT NULL").select(key, "cluster")
    everyone = everyone.withColumn("of", F.col(key)) if of is None else everyone.join(of, key)
    own = stored(everyone.groupBy("of").agg(F.first("cluster").alias("cluster"), F.count(F.lit(1)).alias("copies")).withColumnRenamed("of", key))
    sizes = own.groupBy("cluster").agg(F.sum("copies").alias("size"))
    held = _by_gram(weights.join(small(own), key))
    centroid = stored(held.groupBy("cluster", "gram").agg(F.sum(F.col("w") * F.col("copies")).alias("total")).join(sizes, "cluster").select("cluster", "gram", (F.col("total") / F.col("size")).alias("c")))
    heavy = Window.partitionBy("cluster").orderBy(F.round("c", 9).desc(), F.desc("gram"))
    top = centroid.withColumn("place", F.row_number().over(heavy)).where((F.col("place") <= min(8, terms)) & (F.col("c") > 0))
    top = top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "gram"))), lambda x: x["gram"]).alias("top_terms"))
    norm = centroid.groupBy("cluster").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("norm"))
    dots = held.join(small(centroid), ["cluster", "gram"]).groupBy("cluster", key).agg(F.sum(F.col("w") * F.col("c")).alias("dot"))
    near = own.join(dots, ["cluster", key], "left").join(norm, "cluster", "left").withColumn("similarity", F.round(F.coalesce(F.col("dot") / F.col("norm"), F.lit(0.0)), 6))
    best = Window.partitionBy("cluster").orderBy(F.desc("similarity"), key)
    # of equal texts the first few can be examples
    early = everyone.withColumn("place", F.row_number().over(Window.partitionBy("of").orderBy(key))).where(F.col("place") <= examples).select(key, "of")
    near = near.select("cluster", "similarity", F.col(key).alias("of")).join(early, "of")
    shown = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= examples)
    shown = shown.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(key).alias("k")))), lambda x: x["k"]).alias("examples"))
    return sizes.join(top, "cluster", "left").join(shown, "cluster").orderBy(F.desc("size"), "cluster")
