"""Language-model scores by prediction by partial matching, beside a word-unigram base.

The model is a byte-context trie of order 5, counted over all training texts. A symbol that a
context has not seen escapes to the next shorter one; the escape estimate is method D (half the
distinct symbols over the occurrences; a symbol gets its count less one half), and symbols that
the longer context knows are excluded from the shorter one's counts. The pretrained trie then
gives each document's code length. Training counts of byte 6-grams hold the whole trie: shorter contexts are their sums.

A trie that is too large for one broadcast is split into blocks of bounded size by the last two
bytes of the contexts, and where two are not enough by three, four or five: a single context has
256 entries at most. What such a block lacks of shorter contexts is a small table of their counts,
which all blocks get. Each block is one pass over the documents, which returns numbers only; the
code lengths of the passes add up exactly.

Word counts of the base are kept whole as well: the most frequent words (down to the count that
keeps them within a fixed number) are broadcast, all others meet the documents in a join on the
word's 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACE, read, runs, ship, span_hashes, steps, stored, text_bytes, work_dir
from .language_id import fold

ORDER = 5
#: Bytes that UTF-8 never has stand for the places before a text and for its end.
PAD, END = 0xFE, 0xFF
#: Symbols that can be coded: all bytes, one of them as the end.
ALPHABET = 256
#: Trie entries (6-grams) in one broadcast block, some 16 bytes each.
BLOCK_ENTRIES = 4_000_000
#: Frequent words that are broadcast at most; the rest is joined.
FREQUENT = 1 << 20
#: Entries that a task holds before it merges them.
HELD = 3_000_000
WORD, GRAM = 0, 1


def gram_keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 6-gram (five bytes of context, one symbol) at each byte and at each text's end, and the rows."""
    n = len(offs) - 1
    new = offs + np.arange(n + 1) * (ORDER + 1)
    row = np.repeat(np.arange(n), np.diff(offs))
    stream = np.full(int(new[-1]), PAD, np.uint64)
    stream[np.arange(len(data)) + ORDER + row * (ORDER + 1)] = data
    stream[new[1:] - 1] = END
    key = np.zeros(len(stream), np.uint64)
    for i in range(ORDER + 1):
        key[ORDER:] |= stream[i : len(stream) - ORDER + i] << np.uint64(8 * (ORDER - i))
    coded = np.ones(len(stream), bool)
    for i in range(ORDER):
        coded[new[:-1] + i] = False
    return key[coded], np.repeat(np.arange(n), np.diff(offs) + 1)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    starts, ends, row = runs(~SPACE[data], offs)
    return span_hashes(data, starts, ends), row


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def corpus_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(kind, key, n): counts of word hashes and of 6-grams over all texts; each task sends an entry once."""

    def work(batches):
        held: dict[int, list] = {WORD: [], GRAM: []}
        size = {WORD: 0, GRAM: 0}

        def add(kind, keys):
            u, n = np.unique(keys, return_counts=True)
            held[kind].append((u, n))
            size[kind] += len(u)
            if size[kind] > HELD:
                held[kind] = [_merged(held[kind])]
                size[kind] = len(held[kind][0][0])
                if size[kind] > HELD // 2:
                    yield from send(kind)

        def send(kind):
            if held[kind]:
                keys, n = _merged(held[kind])
                held[kind], size[kind] = [], 0
                for i in range(0, len(keys), 1 << 16):
                    k = keys[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(n[i : i + (1 << 16)])], names=["kind", "key", "n"])

        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for lo, hi in steps(offs):
                d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                yield from add(WORD, word_hashes(d, o)[0])
                yield from add(GRAM, gram_keys(d, o)[0])
        for kind in held:
            yield from send(kind)

    rows = docs.select(F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "kind tinyint, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Level:
    """Contexts of one length: sorted (context, symbol) keys with counts, and totals by context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        n = len(keys)
        contexts = keys >> np.uint64(8)
        first = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1])) if n else np.zeros(0, np.int64)
        self.contexts, self.first = contexts[first], first.astype(np.int32)
        self.total = np.add.reduceat(counts, first, dtype=np.float64) if n else np.zeros(0)
        self.kinds = np.diff(np.append(first, n)).astype(np.float32)

    @staticmethod
    def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def symbol(self, keys: np.ndarray) -> np.ndarray:
        """Counts of (context, symbol) keys, 0 if absent."""
        at, ok = self._find(self.keys, keys)
        return np.where(ok, self.counts[at], 0.0) if len(self.counts) else np.zeros(len(keys))

    def context(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._find(self.contexts, keys >> np.uint64(8))


def _suffix(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & np.uint64((1 << (8 * (order + 1))) - 1)


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], _narrow(np.add.reduceat(counts[order], first, dtype=np.int64) if len(keys) else np.zeros(0, np.int64))


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where these are enough."""
    return counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts


class Trie:
    """All levels of a block of contexts; ``low`` has the counts of order 1, whole, and ``split`` those of
    the contexts, by order, whose longer contexts lie in several blocks."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray], split: dict[int, tuple[np.ndarray, np.ndarray]] | None = None):
        if (keys[1:] < keys[:-1]).any():
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
        self.levels: dict[int, Level] = {ORDER: Level(keys, counts)}
        for k in range(ORDER - 1, 1, -1):
            longer = self.levels[k + 1]
            u, n = _added(_suffix(longer.keys, k), longer.counts)
            if split and k in split:
                whole, times = split[k]
                own = ~np.isin(u >> np.uint64(8), whole >> np.uint64(8))
                u, n = np.concatenate([u[own], whole]), np.concatenate([n[own], times])
                by_key = np.argsort(u)
                u, n = u[by_key], n[by_key]
            self.levels[k] = Level(u, n)
        pairs, n = low
        order = np.argsort(pairs)
        self.levels[1] = Level(pairs[order], n[order])
        self.levels[0] = Level(*_added(_suffix(pairs, 0), n))
        # by context of each level: what its symbols sum to in the next shorter context
        self.known = {}
        for k in range(1, ORDER + 1):
            lv = self.levels[k]
            shorter = self.levels[k - 1].symbol(_suffix(lv.keys, k - 1))
            self.known[k] = np.add.reduceat(shorter, lv.first) if len(lv.first) else np.zeros(0)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each distinct 6-gram's symbol after its context."""
        lv = self.levels[ORDER]
        at, ok = Level._find(lv.keys, keys)
        out = np.zeros(len(keys))
        if ok.any():
            at = at[ok]
            where = np.searchsorted(lv.first, at, side="right") - 1
            out[ok] = np.log10((2.0 * lv.counts[at] - 1) / (2 * lv.total[where]))
        rest = np.flatnonzero(~ok)
        if len(rest):
            out[rest] = self._escaped(keys[rest])
        return out

    def _escaped(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        live = np.arange(len(keys))
        # symbols and their counts that the longer context excludes at this level
        gone_n, gone_kinds = np.zeros(len(keys)), np.zeros(len(keys))
        for k in range(ORDER, -1, -1):
            lv, own = self.levels[k], _suffix(keys[live], k)
            at, there = lv.context(own)
            who, at = live[there], at[there]
            if len(who):
                fresh = lv.kinds[at] - gone_kinds[who]
                weight = 2 * (lv.total[at] - gone_n[who])
                c = lv.symbol(own[there])
                hit = c > 0
                out[who[hit]] += np.log10((2 * c[hit] - 1) / weight[hit])
                miss = ~hit & (fresh > 0)  # without fresh symbols the escape is certain
                out[who[miss]] += np.log10(fresh[miss] / weight[miss])
                gone_kinds[who] = lv.kinds[at]
                if k:
                    gone_n[who] = self.known[k][at]
                live = live[~np.isin(live, who[hit])]
            if not len(live):
                return out
        out[live] -= np.log10(ALPHABET - gone_kinds[live])
        return out


class Claim:
    """Contexts that belong to a block: groups by their last bytes, as {number of bytes: groups}."""

    def __init__(self, groups: list[tuple[int, int]]):
        self.by_length = {k: np.sort(np.array([g for m, g in groups if m == k], np.uint64)) for k in {m for m, _ in groups}}

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for k, own in self.by_length.items():
            out |= Level._find(own, _suffix(keys, k) >> np.uint64(8))[1]
        return out

    def where(self):
        """The same as a condition on a column ``key``."""
        return [(_group(k), [int(x) for x in own]) for k, own in self.by_length.items()]


def _group(length: int):
    """The last ``length`` bytes of the context of a 6-gram in column ``key``."""
    return F.shiftrightunsigned("key", 8).bitwiseAND((1 << (8 * length)) - 1)


def _plan(grams: DataFrame, size: int) -> tuple[list[Claim], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Blocks of at most ``size`` entries (256 at least), and the counts of the contexts that are split.

    The driver receives 2**16 sizes at most, and 256 sizes and 256 counts for each group that is
    split, of which there are fewer than entries / size at each length.
    """
    groups: list[tuple[int, int, int]] = []
    split: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    rest, length = grams, 2
    while True:
        sizes = [(r[0], r[1]) for r in rest.groupBy(_group(length).alias("group")).count().collect()]
        large = sorted(g for g, n in sizes if n > size) if length < ORDER else []
        groups += sorted((length, g, n) for g, n in sizes if n <= size or length == ORDER)
        if not large:
            break
        rest = rest.where(_group(length).isin(large))
        suffix = F.col("key").bitwiseAND((1 << (8 * (length + 1))) - 1)
        whole = rest.groupBy(suffix.alias("key")).agg(F.sum("n").alias("n")).toArrow()
        split[length] = (whole.column("key").to_numpy().view(np.uint64), whole.column("n").to_numpy().astype(np.float64))
        length += 1
    blocks: list[list[tuple[int, int]]] = [[]]
    held = 0
    for k, g, n in groups:
        if held and held + n > size:
            blocks.append([])
            held = 0
        blocks[-1].append((k, g))
        held += n
    return [Claim(b) for b in blocks], split


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """The words from the least count on (a power of 2**(1/8)) that at most ``most`` words reach."""
    step = F.floor(F.log2("n") * 8).cast("int")
    bins = sorted(((r[0], r[1]) for r in words.groupBy(step.alias("step")).count().collect()), reverse=True)  # some 500 rows at most
    least, held = None, 0
    for k, n in bins:
        held += n
        if held > most:
            break
        least = k
    return words.where(F.lit(False)) if least is None else words.where(step >= least)


def score(
    docs: DataFrame, training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    block_entries: int = BLOCK_ENTRIES, frequent: int = FREQUENT,
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score (log10).

    Null texts are empty: one token, the end. Repeated rows are each scored, and each counted if
    they are training rows. Without training rows all contexts escape and every base count is 0.
    Very long texts are scored whole, alone in their step. Null ids pass through; extra columns are
    ignored, whatever their names; no rows give none.
    """
    spark = docs.sparkSession
    ship(spark)
    home = work_dir(spark)
    counts = stored(corpus_counts(training, text_col), f"{home}/counts")
    texts = training.count()
    words, grams = counts.where(F.col("kind") == WORD).select("key", "n"), counts.where(F.col("kind") == GRAM).select("key", "n")
    n_words, kinds = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = int(n_words or 0) + texts
    vocabulary = kinds + (texts > 0)
    top = _frequent(words, frequent).toArrow()
    keys = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    sent_words = spark.sparkContext.broadcast((keys[order], top.column("n").to_numpy()[order], total, vocabulary, texts))
    low_key = F.col("key").bitwiseAND(0xFFFF)
    low_rows = grams.groupBy(low_key.alias("key")).agg(F.sum("n").alias("n")).toArrow()  # at most 2**16 rows
    low = (low_rows.column("key").to_numpy().view(np.uint64), low_rows.column("n").to_numpy())
    claims, split = _plan(grams, block_entries)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if len(claims) > 1:
        rows = stored(rows, f"{home}/texts")
    schema = T.StructType([
        T.StructField("row", T.LongType()), rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()),
        T.StructField("score", T.DoubleType()), T.StructField("rare", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType())),
    ])
    scored = more = None
    for i, claim in enumerate(claims):
        own = grams.where(F.lit(False))
        for group, held in claim.where():
            own = own.union(grams.where(group.isin(held) if len(claims) > 1 else F.lit(True)))
        table = own.toArrow()
        # the first block also takes the contexts that no training text has
        others = [c for c in claims if c is not claim] if i == 0 else None
        keys = table.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)  # workers use the sorted arrays as they are
        sent = spark.sparkContext.broadcast((f"{home}/{i}", claim, others, keys[order], _narrow(table.column("n").to_numpy()[order]), low, split))

        def work(batches, sent=sent, first=i == 0):
            yield from _score_batches(batches, sent.value, sent_words.value if first else None)

        if i == 0:
            scored = stored(rows.mapInArrow(work, schema), f"{home}/block{i}")
        else:
            part = stored(rows.select("row", "text").mapInArrow(work, "row long, more double"), f"{home}/block{i}")
            more = part if more is None else more.union(part)
    if more is not None:
        scored = scored.join(more.groupBy("row").agg(F.sum("more").alias("more")), "row").withColumn("score", F.col("score") + F.col("more"))

    logs = lambda c: F.log10((c + 0.5) / F.lit(total + 0.5 * (vocabulary + 1)))
    pairs = scored.select("row", F.explode(F.arrays_zip(F.col("rare").alias("key"), F.col("times").alias("times"))).alias("p")).select("row", "p.key", "p.times")
    found = pairs.join(words, "key", "left")
    c = F.coalesce("n", F.lit(0))
    rare = found.groupBy("row").agg(F.sum(F.col("times") * logs(c)).alias("rare_base"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    return scored.drop("rare", "times").join(rare, "row", "left").select(
        "doc_id", "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
    )


_TRIES: dict[str, Trie] = {}


def _trie(name: str, *parts) -> Trie:
    """The block's trie, built once per worker process."""
    if name not in _TRIES:
        _TRIES.clear()
        _TRIES[name] = Trie(*parts)
    return _TRIES[name]


def _score_batches(batches, block, words):
    """All numbers of each text for the first block (with ``words``), its part of the score for the others."""
    name, claim, others, keys, n, low, split = block
    trie = _trie(name, keys, n, low, split)
    if words is not None:
        vocabulary, counts, total, kinds, texts = words
        weight = np.log10(total + 0.5 * (kinds + 1))
    for batch in batches:
        data, offs = text_bytes(batch.column("text"))
        for lo, hi in steps(offs):
            d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            size = hi - lo
            g, row = gram_keys(d, o)
            u, at = np.unique(g, return_inverse=True)
            value = np.zeros(len(u))
            own = claim.holds(u) if others is None else ~np.any([c.holds(u) for c in others] or [np.zeros(len(u), bool)], axis=0)
            value[own] = trie.log10(u[own])
            score = np.bincount(row, weights=value[at], minlength=size)
            held = {f: batch.column(f).slice(lo, size) for f in batch.schema.names}
            if words is None:
                yield pa.RecordBatch.from_arrays([held["row"], pa.array(score)], names=["row", "more"])
                continue
            h, doc = word_hashes(d, o)
            u, at = np.unique(h, return_inverse=True)
            if len(vocabulary):
                i = np.minimum(np.searchsorted(vocabulary, u), len(vocabulary) - 1)
                common = vocabulary[i] == u
                value = np.where(common, np.log10(counts[i] + 0.5) - weight, 0.0)
            else:
                common, value = np.zeros(len(u), bool), np.zeros(len(u))
            tokens = np.bincount(doc, minlength=size)
            known = np.bincount(doc[common[at]], minlength=size)
            base = np.bincount(doc, weights=value[at], minlength=size)
            left = ~common[at]
            order = np.lexsort((h[left], doc[left]))
            rd, rh = doc[left][order], h[left][order]
            new = np.ones(len(rd), bool)
            new[1:] = (np.diff(rd) != 0) | (rh[1:] != rh[:-1])
            begin = np.flatnonzero(new)
            times = np.diff(np.append(begin, len(rd))).astype(np.int32)
            lists = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rd[begin], minlength=size))]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    held["row"], held["doc_id"], pa.array(tokens + 1), pa.array(known + (texts > 0)),
                    pa.array(base + np.log10(texts + 0.5) - weight), pa.array(score),
                    pa.ListArray.from_arrays(lists, pa.array(rh[begin].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(times)),
                ],
                names=["row", "doc_id", "n_tokens", "n_known", "base", "score", "rare", "times"],
            )


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, docs.where(fold("doc_id", 5) != 1))
    return scored.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
