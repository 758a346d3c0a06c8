"""N-gram Jaccard self-join by vertical partitioning.

The global order of n-grams runs from rare to frequent. How frequent an n-gram is, is counted
over all texts in a table of a fixed number of slots (an n-gram's slot is a part of its hash);
the order is by the slot's count, then by hash, so every set is sorted alike, whatever the counts
are worth. The order is cut into fragments of equal mass, and a set's part in a fragment is a
segment.

Sets that reach the threshold share some of their first n-grams of an order (prefix filter, with
more than one n-gram asked for, in proportion to size). Slots hold ever more n-grams as the corpus
grows, so this order goes by the words first: words are far fewer, and an n-gram of rare words is
rare at any size (n-grams whose slot stands out, as those of repeated lines, come last). Sets that
share too few of them with others of a size that allows a link have no partner. The others form groups by chains of shared first n-grams; a group is dealt
in blocks of bounded size; a block is a cell, and so are two blocks with those of their sets that
share enough of their first n-grams with the other block, so that chains of unlike sets, which grow
with the corpus, are not sent from block to block. In every cell
and every fragment the overlaps of the segments are counted apart, each by its own task; pairs
that cannot reach the threshold, whatever the other fragments hold, are left out there. The
partial counts are then summed per pair, and the threshold decides.

A cell passes on, per set, its number of links and the least set that links reach within the
cell, so that groups of near copies are not expanded into rows of pairs, and yet every pair of
different sets is counted. Equal sets are one node from the start and count by their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import LOWER, SPACE, met, mix, read, runs, ship, small, span_hashes, steps, stored, text_bytes, work_dir

N = 3
THRESHOLD = 90
#: Bits of an n-gram's hash that name its slot: the table of counts has 2**SLOT_BITS entries, whatever the corpus.
SLOT_BITS = 18
#: Fragments of the global order.
FRAGMENTS = 8
#: Sets, and n-grams of sets, that a block of a group holds, about.
BLOCK, BLOCK_GRAMS = 256, 1 << 20
#: N-grams that a task compares in one step, unless one cell has more.
STEP_GRAMS = 1 << 18
#: Sets of a cell from which on overlaps are counted by matrix products, of so many n-grams each.
DENSE, COLUMNS = 48, 2048

_LOW = np.uint64(64 - SLOT_BITS)
#: An n-gram of a slot with more than a HOT-th of all n-grams is dealt in so many shares.
HOT, SHARES = 1024, 64


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> _LOW).astype(np.int64)


def shingles(data: np.ndarray, offs: np.ndarray, n: int = N, cost: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's distinct n-grams of words, sorted within the text, the rows, and the sums of the words' costs
    by slot (without costs: the hashes of all words)."""
    low = LOWER[data]
    starts, ends, row = runs(~SPACE[low], offs)
    h = span_hashes(low, starts, ends)
    count = np.bincount(row, minlength=len(offs) - 1)
    first = np.concatenate([[0], np.cumsum(count)])
    size = np.minimum(count, n)[row]
    place = np.arange(len(h)) - first[row]
    begin = np.flatnonzero(place + size <= count[row])
    out = np.zeros(len(begin), np.uint64)
    for i in range(n):
        more = i < size[begin]
        out[more] = mix(out[more] * np.uint64(0x9E3779B97F4A7C15) + h[begin[more] + i] + np.uint64(i + 1))
    if cost is None:
        return *_sorted(out, row[begin]), h
    total, by_word = np.zeros(len(begin), np.int64), cost[_slot(h)]
    for i in range(n):
        more = i < size[begin]
        total[more] += by_word[begin[more] + i]
    return _sorted(out, row[begin], total)


def _sorted(out: np.ndarray, owner: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct values of each owner in ascending order, with what else belongs to a value; owners ascend already."""
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], owner[new], *[x[order][new] for x in more]


class Rarity:
    """The order of prefixes, rare n-grams first, from counts of slots of n-grams and of words.

    Slots of many n-grams have counts near the mean; only what stands out by far tells of a frequent n-gram, by its
    magnitude. The others go by the frequencies of their words, then by hash.
    """

    def __init__(self, grams: np.ndarray, words: np.ndarray):
        excess = (grams - grams.mean()) / (4 * np.sqrt(grams.mean()) + 1)
        self.level = np.floor(np.log2(np.maximum(excess, 1))).astype(np.int64)
        self.hot = grams * HOT > grams.sum()
        self.cost = np.rint(8 * np.log2(1.0 + words)).astype(np.int64)

    def sort(self, h: np.ndarray, owner: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each owner's set in this order; they come sorted by owner and hash."""
        order = np.argsort((owner << 24) | (self.level[_slot(h)] << 16) | np.minimum(total, 0xFFFF), kind="stable")
        return h[order], owner[order]


class Order:
    """The global order: an n-gram's place is its slot's rank by count, then the rest of its hash."""

    def __init__(self, counts: np.ndarray, fragments: int = FRAGMENTS):
        by_count = np.argsort(counts, kind="stable")
        self.rank = np.empty(len(counts), np.uint64)
        self.rank[by_count] = np.arange(len(counts), dtype=np.uint64)
        mass = np.cumsum(counts[by_count], dtype=np.float64)
        cuts = np.searchsorted(mass, mass[-1] * np.arange(1, fragments) / fragments) + 1
        self.cuts = cuts.astype(np.uint64) << _LOW

    def place(self, h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of n-grams, a bijection of their hashes, in the order of each owner's set."""
        return _sorted((self.rank[(h >> _LOW).astype(np.int64)] << _LOW) | (h & ((np.uint64(1) << _LOW) - np.uint64(1))), owner)

    def fragment(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, places, side="right")


def misses(n: np.ndarray, threshold: int) -> np.ndarray:
    """How many n-grams of a set of n a linked set can lack."""
    return n - (n * threshold + 99) // 100


def prefix(n: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Length of a set's indexed prefix, and how many n-grams of it some other prefix must share.

    If two sets overlap in ``a`` n-grams or more, their first ``|x| - a + k`` and ``|y| - a + k``
    n-grams share ``k`` at least; ``k`` grows with size, so the least partner's is asked for.
    """
    shared = lambda m: np.minimum(misses(m, threshold) // 2 + 1, np.maximum(m - misses(m, threshold), 1))
    return np.minimum(misses(n, threshold) + shared(n), n), shared(np.maximum((n * threshold + 99) // 100, 1))


def _fingerprints(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    count = np.bincount(owner, minlength=n)
    some = np.flatnonzero(count)
    out = np.zeros(n, np.uint64)
    if len(some):
        first = (np.concatenate([[0], np.cumsum(count)])[:-1])[some]
        out[some] = mix(np.add.reduceat(mix(h), first) ^ (np.bitwise_xor.reduceat(mix(h + np.uint64(77)), first) * np.uint64(3)) ^ count[some].astype(np.uint64))
    return out


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _parts(batches, words: int, cost: np.ndarray | None = None):
    """Bounded steps of the batches' texts: first row, last row, hashes, owners, what else ``shingles`` gives, sizes and
    fingerprints of the sets."""
    for batch in batches:
        data, offs = text_bytes(batch.column("text"))
        for lo, hi in steps(offs):
            h, owner, more = shingles(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], words, cost)
            yield batch, lo, hi, h, owner, more, np.bincount(owner, minlength=hi - lo), _fingerprints(h, owner, hi - lo)


SETS, SLOTS = 0, 1


def sets(docs: DataFrame, text_col: str, id_col: str, words: int = N) -> DataFrame:
    """Two kinds of rows in one pass. SETS: doc_id, node (the set's 64-bit fingerprint, null without words) and size
    of every row. SLOTS: in node a slot (of n-grams, then of words), in size its count; each task sends a slot once."""
    ship(docs.sparkSession)

    def work(batches):
        counts = np.zeros(2 << SLOT_BITS, np.int64)
        by_gram, by_word = counts[: 1 << SLOT_BITS], counts[1 << SLOT_BITS :]
        for batch, lo, hi, h, _, word, size, fp in _parts(batches, words):
            by_gram += np.bincount(_slot(h), minlength=len(by_gram))
            by_word += np.bincount(_slot(word), minlength=len(by_word))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, SETS, np.int32)), batch.column("doc_id").slice(lo, hi - lo), pa.array(fp.view(np.int64), mask=size == 0), pa.array(size.astype(np.int64))], names=names)
        at = np.flatnonzero(counts)
        for i in range(0, len(at), 1 << 16):
            a = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), SLOTS, np.int32)), pa.nulls(len(a), id_type), pa.array(a.astype(np.int64)), pa.array(counts[a])], names=names)

    names = ["kind", "doc_id", "node", "size"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("node", T.LongType()), T.StructField("size", T.LongType())])
    id_type = to_arrow_type(schema["doc_id"].dataType)
    return rows.mapInArrow(work, schema)


def _postings(docs: DataFrame, rarity, text_col: str, threshold: int, words: int) -> DataFrame:
    """(gram, node, need, size, share) of the first n-grams of every row's set, once per task's step of copies; share is 0,
    or else a hot n-gram's share. Sets too small for a link with a different one have none."""

    def work(batches):
        rank = rarity.value
        for _, _, _, h, owner, total, size, fp in _parts(batches, words, rank.cost):
            once = np.zeros(len(size), bool)
            once[np.unique(fp, return_index=True)[1]] = True
            once &= size * 100 >= threshold * (size + 1)
            use = once[owner]
            g, own = rank.sort(h[use], owner[use], total[use])
            size = np.where(once, size, 0)
            first = np.concatenate([[0], np.cumsum(size)])[:-1]
            length, need = prefix(size, threshold)
            head = np.arange(len(g)) - first[own] < length[own]
            g, own = g[head], own[head]
            share = np.where(rank.hot[_slot(g)], 1 + (mix(fp[own]) % np.uint64(SHARES)).astype(np.int32), 0)
            yield pa.RecordBatch.from_arrays([_signed(g), _signed(fp[own]), pa.array(need[own].astype(np.int32)), pa.array(size[own].astype(np.int32)), pa.array(share.astype(np.int32))], names=["gram", "node", "need", "size", "share"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(work, "gram long, node long, need int, size int, share int")


def shared_postings(batches, threshold: int):
    """(gram, node, need, size), each once, of nodes whose n-gram another node has whose size allows a link; from postings
    sorted by gram, share, size and node. All of a share stay. Of a run no more than a row is held from batch to batch."""
    held, met_before = None, False

    def out(t, keep):
        return t.select(["gram", "node", "need", "size"]).filter(pa.array(keep))

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        gram, node, size, share = (t.column(c).to_numpy() for c in ("gram", "node", "size", "share"))
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
        t, gram, size, share = t.filter(pa.array(new)), gram[new], size[new].astype(np.int64), share[new]
        # of all sizes the next one allows most
        near = (gram[1:] == gram[:-1]) & (size[:-1] * 100 >= size[1:] * threshold)
        keep = np.append(near, False) | np.append(met_before, near) | (share > 0)
        yield from out(t.slice(0, t.num_rows - 1), keep[:-1]).to_batches()
        held, met_before = t.slice(t.num_rows - 1), bool(keep[-1])
    if held is not None:
        yield from out(held, [met_before]).to_batches()


def _segments(docs: DataFrame, order, nodes: DataFrame, text_col: str, id_col: str, words: int) -> DataFrame:
    """node, size, fragment, before (n-grams in the fragments before) and grams, a row per segment, for the nodes given with one document each."""

    def work(batches):
        for _, _, _, h, owner, _, size, fp in _parts(batches, words):
            g, own = order.value.place(h, owner)
            part = order.value.fragment(g)
            new = np.ones(len(g), bool)
            new[1:] = (own[1:] != own[:-1]) | (part[1:] != part[:-1])
            begin = np.flatnonzero(new)
            o = own[begin]
            before = begin - np.concatenate([[0], np.cumsum(size)])[o]
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(g)).astype(np.int32)), _signed(g))
            yield pa.RecordBatch.from_arrays([_signed(fp[o]), pa.array(size[o].astype(np.int32)), pa.array(part[begin].astype(np.int32)), pa.array(before.astype(np.int32)), lists], names=["node", "size", "fragment", "before", "grams"])

    wanted = small(nodes.select("first_id").distinct())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    # an id may have rows of other sets, and a set several such rows
    return rows.select("text").mapInArrow(work, "node long, size int, fragment int, before int, grams array<long>")


def _runs_of(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    n = len(columns[0])
    new = np.ones(n + 1, bool)
    if n:
        new[1:n] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _pairs(group: np.ndarray, row: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, common n-grams) of all pairs of rows of one group that share any; the first row is the smaller."""
    order = np.lexsort((row, gram, group))
    group, row, gram = group[order], row[order], gram[order]
    edge = _runs_of(group, gram)
    length = np.diff(edge)
    a, b, n = [], [], []
    # cells of many sets: one product of a 0/1 matrix with itself for so many n-grams at a time
    wide = _runs_of(group)
    for lo, hi in zip(wide[:-1], wide[1:], strict=True):
        if hi - lo < DENSE or len(who := np.unique(row[lo:hi])) < DENSE:
            continue
        runs_here = slice(*np.searchsorted(edge, [lo, hi]))
        column = np.cumsum(np.isin(np.arange(lo, hi), edge[runs_here])) - 1
        shared = (length[runs_here] > 1)[column]
        length[runs_here] = 0  # done here
        if not shared.any():
            continue
        at, column = np.searchsorted(who, row[lo:hi][shared]), column[shared]
        column = np.cumsum(np.append(True, np.diff(column) > 0)) - 1
        total = np.zeros((len(who), len(who)), np.float32)
        for c in range(0, column[-1] + 1, COLUMNS):
            s, e = np.searchsorted(column, [c, c + COLUMNS])
            m = np.zeros((len(who), COLUMNS), np.float32)
            m[at[s:e], column[s:e] - c] = 1
            total += m @ m.T
        i, j = np.nonzero(np.triu(total, 1))
        a.append(who[i])
        b.append(who[j])
        n.append(total[i, j].astype(np.int64))
    # the others: each run of one n-gram gives its pairs, place k with each place before
    starts = edge[:-1][length > 1]
    length = length[length > 1]
    base = int(row.max(initial=0)) + 1
    keys = []
    for k in range(1, int(length.max(initial=1))):
        s = starts[length > k]
        for back in range(k):
            keys.append(row[s + back] * base + row[s + k])
    if keys:
        u, c = np.unique(np.concatenate(keys), return_counts=True)
        a.append(u // base)
        b.append(u % base)
        n.append(c)
    some = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return some(a), some(b), some(n)


_KEY = ["group", "i", "j"]
#: Pairs in one row of partial counts.
_ROW_PAIRS = 1 << 14
_PAIR = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int32()), ("least", pa.int32()), ("copies_a", pa.int64()), ("copies_b", pa.int64())])


def _whole_groups(batches, columns: list[str], at_once: int, weight: str):
    """Tables of whole runs of equal ``columns`` from sorted batches, of about ``at_once`` in the sum of ``weight``."""
    held, load = None, 0
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        load += int(np.sum(batch.column(weight).to_numpy()))
        if load < at_once:
            continue
        edge = _runs_of(*[held.column(c).to_numpy() for c in columns])
        if len(edge) > 2:
            yield held.slice(0, edge[-2]).combine_chunks()
            held = held.slice(edge[-2])
            load = int(np.sum(held.column(weight).to_numpy()))
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _flat(column) -> pa.Array:
    return pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], column.type.value_type)


def partial_overlaps(batches, threshold: int):
    """The partial counts of each cell and fragment, from rows of segments sorted by cell and fragment."""
    columns = [*_KEY, "fragment"]
    for t in _whole_groups(batches, columns, STEP_GRAMS, "width"):
        edge = _runs_of(*[t.column(c).to_numpy() for c in columns])
        group_of = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        width, size, before, side = (t.column(c).to_numpy().astype(np.int64) for c in ("width", "size", "before", "side"))
        node, copies = t.column("node").to_numpy(), t.column("copies").to_numpy()
        rows = np.repeat(np.arange(t.num_rows), width)
        a, b, n = _pairs(group_of[rows], rows, _flat(t.column("grams")).to_numpy(zero_copy_only=False))
        # a cell of two blocks holds the pairs between them; its blocks have cells of their own
        least = -(-(size[a] + size[b]) * threshold // (100 + threshold))
        after = size - before - width
        room = n + np.minimum(before[a], before[b]) + np.minimum(after[a], after[b])
        two = (t.column("i").to_numpy() != t.column("j").to_numpy())[a]
        ok = (room >= least) & (np.minimum(size[a], size[b]) * 100 >= np.maximum(size[a], size[b]) * threshold) & (~two | (side[a] != side[b]))
        a, b, n, least = a[ok], b[ok], n[ok], least[ok]
        swap = node[a] > node[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        order = np.argsort(group_of[a], kind="stable")
        a, b, n, least = a[order], b[order], n[order], least[order]
        of = group_of[a]
        cut = _runs_of(of, np.arange(len(of)) // _ROW_PAIRS)
        if len(cut) < 2:
            continue
        pairs = pa.StructArray.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.array(n.astype(np.int32)), pa.array(least.astype(np.int32)), pa.array(copies[a]), pa.array(copies[b])], fields=list(_PAIR))
        where = edge[of[cut[:-1]]]
        yield pa.RecordBatch.from_arrays([*[t.column(c).take(pa.array(where)).combine_chunks() for c in columns], pa.array(np.diff(cut).astype(np.int32)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pairs)], names=[*columns, "width", "pairs"])


def other_blocks(batches):
    """(node, other) for the blocks but its own with which a node shares as many n-grams as it needs; from rows of a node's
    n-grams, sorted by node, with the blocks that hold them."""
    for t in _whole_groups(batches, ["node"], STEP_GRAMS, "width"):
        edge = _runs_of(t.column("node").to_numpy())
        width = t.column("width").to_numpy().astype(np.int64)
        of = np.repeat(np.repeat(np.arange(len(edge) - 1), np.diff(edge)), width)
        block = _flat(t.column("blocks")).to_numpy(zero_copy_only=False).astype(np.int64)
        base = int(block.max(initial=0)) + 1
        key, count = np.unique(of * base + block, return_counts=True)
        of, block, at = key // base, key % base, edge[:-1][key // base]
        need, own, node = (t.column(c).to_numpy() for c in ("need", "block", "node"))
        keep = (count >= need[at]) & (block != own[at])
        yield pa.RecordBatch.from_arrays([pa.array(node[at][keep]), pa.array(block[keep].astype(np.int32))], names=["node", "other"])


def least_reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number that links reach from each of 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        # whoever a label stands for takes part as well
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def summed(batches):
    """Per set of a cell that has links: the least set reached, and its links; from partial counts sorted by cell."""
    for t in _whole_groups(batches, _KEY, STEP_GRAMS, "width"):
        edge = _runs_of(*[t.column(c).to_numpy() for c in _KEY])
        cell = np.repeat(np.repeat(np.arange(len(edge) - 1), np.diff(edge)), t.column("width").to_numpy())
        flat = _flat(t.column("pairs"))
        a, b, n, least, ca, cb = (flat.field(i).to_numpy() for i in range(6))
        order = np.lexsort((b, a, cell))
        cut = _runs_of(cell[order], a[order], b[order])
        first = order[cut[:-1]]
        linked = np.add.reduceat(n[order].astype(np.int64), cut[:-1]) >= least[first] if len(first) else np.zeros(0, bool)
        first = first[linked]
        if not len(first):
            continue
        c = cell[first]
        # numbers of the sets by cell and node, so that the least number is the least node
        both = np.stack([np.concatenate([c, c]), np.concatenate([a[first], b[first]])])
        key, at = np.unique(both, axis=1, return_inverse=True)
        at = at.reshape(-1)
        x, y = at[: len(first)], at[len(first) :]
        label = least_reached(x, y, key.shape[1])
        links = np.bincount(x, weights=cb[first], minlength=key.shape[1]) + np.bincount(y, weights=ca[first], minlength=key.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(key[1]), pa.array(key[1][label]), pa.array(links.astype(np.int64))], names=["node", "low", "links"])


def components(edges: DataFrame, home: str) -> DataFrame:
    """(node, label) of all nodes that ``edges`` (a, b) hold; a component's nodes have one label, a node of it.

    In each round a label goes over to its least neighbour by an order that the round's number
    draws, and the edges are contracted, so that labels become fewer by a constant share a round
    (by expectation), whatever the shape of the graph. Rounds are written.
    """
    edges = edges.where("a <> b")
    edges = stored(edges.union(edges.select("b", "a")).distinct(), f"{home}/edges")
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    moves = 0
    while edges.count():
        drawn = lambda c: F.struct(F.xxhash64(c, F.lit(moves)).alias("draw"), F.col(c).alias("node"))  # noqa: E731, B023
        to = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min(drawn("b")).alias("b"), F.first(drawn("a")).alias("a")).select("node", F.least("a", "b")["node"].alias("to")), f"{home}/to{moves}")
        side = lambda x: to.select(F.col("node").alias(x), F.col("to").alias(f"to_{x}"))  # noqa: E731, B023
        contracted = edges.join(side("a"), "a").join(side("b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        edges = stored(contracted.where("a <> b").distinct(), f"{home}/edges{moves}")
        moves += 1
        # all that a label went over to; read from the written rounds
        labels = labels.join(to.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return stored(labels, f"{home}/labels")


def _size_class(size, threshold: int):
    """Classes of sizes a little wider than the ratio of linked sets, so that these are in the same class or the next."""
    return F.floor(F.log(size) / (np.log(max(100 / threshold, 1.0001)) * 1.000001)).cast("int")


def node_links(docs: DataFrame, known: DataFrame, slots: DataFrame, *, text_col: str, id_col: str, threshold: int, home: str, words: int = N) -> DataFrame:
    """(node, low, links) per cell and linked node: a linked node of the cell, and how many rows of other sets link.

    ``known`` has node, first_id, copies and size of each set, ``slots`` the counts of both orders' slots.
    """
    spark = docs.sparkSession
    counts = np.zeros(2 << SLOT_BITS, np.int64)
    table = slots.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most 2 * 2**SLOT_BITS rows
    counts[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    by_gram, by_word = counts[: 1 << SLOT_BITS], counts[1 << SLOT_BITS :]
    order, rarity = spark.sparkContext.broadcast(Order(by_gram)), spark.sparkContext.broadcast(Rarity(by_gram, by_word))
    # one shuffle: what no other set has goes where the n-grams meet
    dealt = _postings(docs, rarity, text_col, threshold, words).repartition("gram", "share").sortWithinPartitions("gram", "share", "size", "node")
    members = stored(dealt.mapInArrow(lambda b: shared_postings(b, threshold), "gram long, node long, need int, size int"), f"{home}/members")
    # sets that share enough of their first n-grams with sets of a size that allows a link, then with such sets alone
    able = members.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"), F.first("size").alias("size")).where("n >= need")
    able = able.select("node", "need", _size_class(F.col("size"), threshold).alias("class"))
    keyed = members.select("gram", "node").join(able, "node").withColumn("class", F.explode(F.array("class", F.col("class") - 1)))
    keyed = keyed.select(F.xxhash64("gram", "class").alias("key"), "gram", "node", "need")
    several = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    keyed = stored(keyed.join(several, "key"), f"{home}/keyed")
    able = keyed.groupBy("node").agg(F.count_distinct("gram").alias("n"), F.first("need").alias("need"), F.min("key").alias("first")).where("n >= need")
    able = stored(able.select("node", "first", "need").join(known, "node"), f"{home}/able")
    members = stored(keyed.select("key", "node").join(able.select("node"), "node", "left_semi"), f"{home}/members2")
    low = members.groupBy("key").agg(F.min("node").alias("a"))
    label = components(members.join(low, "key").select("a", F.col("node").alias("b")), f"{home}/groups")

    # blocks: sets with the same first shared n-gram together, unless these are too many for a block
    placed = able.join(label, "node")
    groups = placed.groupBy("label").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    firsts = placed.groupBy("label", "first").agg((F.count(F.lit(1)) > BLOCK).alias("many"))
    dealt = placed.join(groups, "label").join(firsts, ["label", "first"])
    block = F.pmod(F.xxhash64("first", F.when(F.col("many"), F.col("node"))), F.col("blocks")).cast("int")
    dealt = stored(dealt.select("node", "need", "copies", "first_id", F.col("label").alias("group"), "blocks", block.alias("block")), f"{home}/dealt")
    # cells: each block, and two blocks for those of their sets that share enough n-grams with the other one
    held = members.join(dealt.where("blocks > 1").select("node", "need", "group", "block"), "node")
    many = held.groupBy("group", "key").agg(F.collect_set("block").alias("blocks")).where(F.size("blocks") > 1)
    met_blocks = held.join(many, ["group", "key"]).select("node", "need", "block", "blocks", F.size("blocks").alias("width"))
    reached = met_blocks.repartition("node").sortWithinPartitions("node").mapInArrow(other_blocks, "node long, other int")
    reached = stored(reached, f"{home}/reached").join(dealt, "node")
    own = dealt.select("node", "copies", "group", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side"))
    where = own.union(reached.select("node", "copies", "group", F.least("block", "other"), F.greatest("block", "other"), (F.col("block") > F.col("other")).cast("int")))

    segments = _segments(docs, order, dealt.select("node", "first_id"), text_col, id_col, words)
    segments = stored(segments.dropDuplicates(["node", "fragment"]).join(dealt.select("node"), "node", "left_semi"), f"{home}/segments")
    rows = segments.join(where, "node").withColumn("width", F.size("grams"))
    schema = "group long, i int, j int, fragment int, width int, pairs array<struct<a:long,b:long,common:int,least:int,copies_a:long,copies_b:long>>"
    cell = [*_KEY, "fragment"]
    partial = rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(lambda b: partial_overlaps(b, threshold), schema)
    links = partial.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(summed, "node long, low long, links long")
    return stored(links, f"{home}/links")


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, words: int = N) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the least id reachable by links) and
    n_links (the other rows that it links with).

    Documents link when 100 * overlap >= threshold * union of their sets of n-grams of ``words`` words (a text
    of fewer words is one n-gram). Null, empty and wordless texts have no n-grams and link with
    nothing. Rows with equal sets are linked; an id that repeats with different texts is treated
    row by row. Null ids are never a component's id unless all its ids are null. Very long texts
    are steps of their own; their segments are as long as they need. No rows give none; extra
    columns are ignored. Sets are told apart by 64-bit fingerprints of their n-grams' hashes: with
    n distinct sets the chance that any two are confused is below n**2 / 2**65.
    """
    home = work_dir(docs.sparkSession)
    both = stored(sets(docs, text_col, id_col, words), f"{home}/rows")
    rows = both.where(F.col("kind") == SETS).select("doc_id", "node", F.col("size").alias("n_shingles"))
    slots = both.where(F.col("kind") == SLOTS).select(F.col("node").alias("slot"), F.col("size").alias("n"))
    known = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").cast("int").alias("size"))
    known = stored(known, f"{home}/known")
    links = node_links(docs, known, slots, text_col=text_col, id_col=id_col, threshold=threshold, home=home, words=words)
    label = components(links.select(F.col("node").alias("a"), F.col("low").alias("b")), f"{home}/linked")
    label = stored(label.join(known, "node").select("node", "label", "first_id"), f"{home}/label")
    least = label.groupBy("label").agg(F.min("first_id").alias("component"))
    far = label.join(least, "label").select("node", "component")
    counts = links.groupBy("node").agg(F.sum("links").alias("others"))
    by_node = known.join(far, "node", "left").join(counts, "node", "left").select(
        "node", "copies", F.coalesce("component", "first_id").alias("component_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    )
    without = rows.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    found = met(rows.where("node IS NOT NULL"), stored(by_node, f"{home}/by_node"), ["node"], "copies")
    return found.select("doc_id", "n_shingles", "component_id", "n_links").union(without)


def one_per_component(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, words: int = N) -> DataFrame:
    """The documents without those that a link or a chain of links joins to one with a smaller id.

    All columns stay; rows with a null id stay.
    """
    marked = join(docs, id_col=id_col, text_col=text_col, threshold=threshold, words=words)
    gone = stored(marked.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), f"{work_dir(docs.sparkSession)}/gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"))
    kept = rows.join(small(gone), F.col("id") == F.col("gone"), "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, list_slice(w, p, p + least(3, len(w)) - 1) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS p FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 190 * common >= 90 * (x.n + y.n)
), both_ AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT e.b, r.c FROM reach r JOIN both_ e ON e.a = r.doc_id WHERE r.c < e.b
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM both_ GROUP BY 1) l ON l.doc_id = w.doc_id JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY 1) r ON r.doc_id = w.doc_id
"""
