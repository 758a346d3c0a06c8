"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The model file's pieces and scores are read by a small protocol-buffer reader and taken as log
scores, whatever they are (a file of merge ranks makes the best segmentation the one of the least
sum of ranks); vocabularies are given, never trained. The trie is built over the pieces' bytes. All positions of a batch's distinct pieces of text walk the trie at once,
and the best segmentation is found start by start for all of them. Characters that no piece
covers become byte pieces. Decoding joins the pieces' bytes and turns the white-space marker
back into spaces.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import cut, distinct, spread
from .common import gather_spans, read, ship, steps, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_MARK = np.frombuffer(MARK.encode(), np.uint8)
NORMAL, UNKNOWN, BYTE, USER = 1, 2, 6, 4
#: What an uncovered character costs beyond the worst piece.
UNKNOWN_PENALTY = 10.0
#: Chunks of the same length class are segmented together, so that a long one does not hold up the short ones.
LENGTHS = (96, 512, 4096)
STEP = 1 << 19


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return out, i


def _fields(b: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def load_pieces(model: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) in the order of ids."""
    out = []
    for number, value in _fields(model):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif n == 3:
                    kind = v
            out.append((piece, score, kind))
    return out


class DoubleArray:
    """A trie in two arrays: child of s by byte c is base[s] + c if check[base[s] + c] is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        keys, values = [keys[i] for i in order], [values[i] for i in order]
        size = max(1024, 4 * sum(map(len, keys)) + 512)
        base, check, value = [0] * size, [-1] * size, [-1] * size
        used = bytearray(size)
        used[0] = 1
        free = wide = 257  # below, a child would need a base under 1
        todo = [(0, 0, len(keys), 0)]
        while todo:
            state, lo, hi, depth = todo.pop()
            if lo < hi and len(keys[lo]) == depth:
                value[state] = values[lo]
                lo += 1
            if lo == hi:
                continue
            groups, i = [], lo
            while i < hi:
                c, j = keys[i][depth] + 1, i
                while j < hi and keys[j][depth] + 1 == c:
                    j += 1
                groups.append((c, i, j))
                i = j
            while used[free]:
                free += 1
            # single children fill the gaps; states with more look on from where the last one was put
            b = max(1, (free if len(groups) == 1 else max(free, wide)) - groups[0][0])
            while any(used[b + c] for c, *_ in groups):
                b += 1
            if len(groups) > 1:
                wide = b + groups[0][0]
            base[state] = b
            for c, i, j in groups:
                used[b + c] = 1
                check[b + c] = state
                todo.append((b + c, i, j, depth + 1))
        last = used.rfind(1) + 258
        self.base, self.check, self.value = (np.array((x + [y] * 258)[:last]) for x, y in ((base, 0), (check, -1), (value, -1)))

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Children of many states at once; -1 where there is none."""
        to = np.minimum(self.base[state] + byte + 1, len(self.check) - 1)
        return np.where((self.check[to] == state) & (self.base[state] > 0), to, -1)


class Pieces:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes):
        rows = load_pieces(model)
        self.scores = np.array([s for _, s, _ in rows])
        words = [i for i, (p, _, k) in enumerate(rows) if k in (NORMAL, USER) and p]
        self.trie = DoubleArray([rows[i][0].encode() for i in words], words)
        self.longest = max((len(rows[i][0].encode()) for i in words), default=1)
        self.unknown = (min((self.scores[i] for i in words), default=0.0) if words else 0.0) - UNKNOWN_PENALTY
        self.byte_ids = np.zeros(256, np.int64)
        out = []
        for i, (p, _, k) in enumerate(rows):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
                out.append(bytes([int(p[3:5], 16)]))
            else:
                out.append(p.replace(MARK, " ").encode() if k in (NORMAL, USER) else b"")
        self.out_size = np.array([len(b) for b in out], np.int64)
        self.out_at = np.concatenate([[0], np.cumsum(self.out_size)])[:-1]
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.fallback = np.array([k == BYTE for *_, k in rows])
        #: Pieces that hold a marker behind another character would cross the cuts.
        self.crossing = any(MARK in rows[i][0].lstrip(MARK) for i in words)

    def normalise(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Identity with a marker before each text (not before an empty one) and for each space."""
        n = len(offs) - 1
        size = np.where(data == 32, 3, 1)
        total = np.concatenate([[0], np.cumsum(size)])
        some = np.diff(offs) > 0
        new = np.concatenate([[0], np.cumsum(total[offs[1:]] - total[offs[:-1]] + 3 * some)])
        row = np.repeat(np.arange(n), np.diff(offs))
        at = total[:-1] - total[offs[row]] + new[row] + 3
        out = np.zeros(int(new[-1]), np.uint8)
        out[at] = data
        heads = np.concatenate([new[:-1][some], at[data == 32]])
        for i in range(3):
            out[heads + i] = _MARK[i]
        return out, new

    def edges(self, data: np.ndarray, ends: np.ndarray, start: np.ndarray):
        """Walks the trie from all positions ``start`` at once: (position's number, length, piece), depth by depth."""
        state = np.zeros(len(start), np.int64)
        live = np.arange(len(start))
        for depth in range(self.longest):
            live = live[start[live] + depth < ends[live]]
            if not len(live):
                return
            state[live] = self.trie.step(state[live], data[start[live] + depth])
            live = live[state[live] >= 0]
            found = self.trie.value[state[live]]
            yield live[found >= 0], depth + 1, found[found >= 0]

    def segment(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best segmentations of many chunks, one after another, and their numbers."""
        lens = ends - starts
        at = np.concatenate([[0], np.cumsum(lens)])[:-1]
        flat = gather_spans(data, starts, lens)
        total = len(flat)
        chunk = np.repeat(np.arange(len(lens)), lens)
        end = (at + lens)[chunk]
        inner = (flat & 0xC0) == 0x80
        char = np.ones(total, np.int64)
        char[flat >= 0xC0], char[flat >= 0xE0], char[flat >= 0xF0] = 2, 3, 4
        char = np.minimum(char, end - np.arange(total))
        begin = np.flatnonzero(~inner)
        walk = list(self.edges(flat, end[begin], begin))
        if walk:
            src = begin[np.concatenate([w[0] for w in walk])]
            size = np.concatenate([np.full(len(w[0]), w[1]) for w in walk])
            piece = np.concatenate([w[2] for w in walk])
        else:
            src = size = piece = np.zeros(0, np.int64)
        # a character that is no piece itself may be unknown
        single = np.zeros(total, bool)
        single[src[size == char[src]]] = True
        lone = begin[~single[begin]]
        src, size = np.concatenate([src, lone]), np.concatenate([size, char[lone]])
        piece = np.concatenate([piece, np.full(len(lone), -1)])
        cost = np.where(piece >= 0, self.scores[piece], self.unknown)
        # scores and back pointers at places 0..length of each chunk; one more place per chunk
        place = lambda x: x + chunk[x]
        best = np.full(total + len(lens), -np.inf)
        back = np.zeros(total + len(lens), np.int64)
        by = np.full(total + len(lens), -1, np.int64)
        best[at + np.arange(len(lens))] = 0.0
        off = src - at[chunk[src]]
        order = np.lexsort((size, off))
        src, size, piece, cost, off = src[order], size[order], piece[order], cost[order], off[order]
        # edges of one start and one length reach different places, so each group is one assignment
        cuts = np.flatnonzero((np.diff(off) != 0) | (np.diff(size) != 0)) + 1
        for lo, hi in zip(np.concatenate([[0], cuts]), np.append(cuts, len(src)), strict=True):
            if lo == hi:
                continue
            a = place(src[lo:hi])
            b = a + size[lo]
            new = best[a] + cost[lo:hi]
            up = new > best[b]
            best[b[up]], back[b[up]], by[b[up]] = new[up], size[lo], piece[lo:hi][up]
        # walk back from the ends of all chunks together
        now = at + lens + np.arange(len(lens))
        first = at + np.arange(len(lens))
        who = np.flatnonzero(lens > 0)
        owners, places, kinds, widths = [], [], [], []
        while len(who):
            p = now[who]
            owners.append(who)
            places.append(p - back[p] - who)
            kinds.append(by[p])
            widths.append(back[p])
            now[who] = p - back[p]
            who = who[now[who] > first[who]]
        if not owners:
            return np.zeros(0, np.int64), np.zeros(len(lens), np.int64)
        owners, places, kinds, widths = map(np.concatenate, (owners, places, kinds, widths))
        order = np.argsort(places, kind="stable")
        owners, places, kinds, widths = owners[order], places[order], kinds[order], widths[order]
        n = np.where(kinds >= 0, 1, widths)
        ids = np.repeat(kinds, n)
        raw = ids < 0
        ids[raw] = self.byte_ids[gather_spans(flat, places, n)[raw]]
        return ids, np.bincount(owners, weights=n, minlength=len(lens)).astype(np.int64)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each."""
        data, offs = self.normalise(data, offs)
        marked = data.copy()
        heads = np.flatnonzero((data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2])) if len(data) > 2 else np.zeros(0, np.int64)
        # for cutting only: a marker is a space, its other bytes go with it
        for i in range(3):
            marked[heads + i] = 32
        space = np.zeros(256, bool)
        space[32] = not self.crossing
        starts, ends, row = cut(marked, offs, space)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(offs) - 1, np.int64)
        first, kind = distinct(data, starts, ends)
        size = (ends - starts)[first]
        counts = np.zeros(len(first), np.int64)
        by_length = np.searchsorted(LENGTHS, size)
        parts = []
        for c in np.unique(by_length):
            who = np.flatnonzero(by_length == c)
            parts.append((who, *self.segment(data, starts[first[who]], ends[first[who]])))
        for who, _, n in parts:
            counts[who] = n
        at = np.concatenate([[0], np.cumsum(counts)])[:-1]
        ids = np.zeros(int(counts.sum()), np.int64)
        for who, got, n in parts:
            ids[gather_spans(np.arange(len(ids)), at[who], n)] = got
        out, per = spread(ids, counts, kind)
        return out, np.bincount(row, weights=per, minlength=len(offs) - 1).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, one after another, and each text's offset; the space before a text goes."""
        size = self.out_size[ids]
        data = gather_spans(self.out, self.out_at[ids], size)
        at = np.concatenate([[0], np.cumsum(size)])
        first = np.concatenate([[0], np.cumsum(counts)])
        offs = at[first]
        heads = offs[:-1][(np.diff(offs) > 0)]
        lead = heads[data[heads] == 32]
        keep = np.ones(len(data), bool)
        keep[lead] = False
        gone = np.concatenate([[0], np.cumsum(~keep)])
        return data[keep], offs - gone[offs]


def encode(docs: DataFrame, *, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_bytes (byte-fallback tokens), decoded_ok, and ``ids`` (or, with ``digest``, ids_sha256 of them as int32).

    decoded_ok says whether decoding gives back the text exactly, which holds unless the text itself
    has the marker U+2581 (that decodes to a space). Null and empty texts have no tokens. Of equally
    good segmentations of the text up to any place the one with the longest last piece is taken. Very long texts are steps of
    their own; a stretch without white space takes time in proportion to its length. Repeated
    rows are each encoded; null ids pass through; extra columns are ignored. ``model`` is the path
    of a model file, read by Spark.
    """
    spark = docs.sparkSession
    ship(spark)
    # a fixed file of a few hundred kB
    path = model if "://" in model else f"file://{model}"
    with open(model, "rb") if "://" not in model else _remote(spark, path) as f:
        sent = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def work(batches):
        enc = _cached(sent.value)
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for lo, hi in steps(offs, STEP):
                d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                ids, n = enc.encode(d, o)
                back, at = enc.decode(ids, n)
                same = np.diff(at) == np.diff(o)
                if len(back) == len(d) and same.all():
                    wrong = np.flatnonzero(back != d)
                    same[np.searchsorted(o, wrong, side="right") - 1] = False
                else:
                    same = np.array([back[at[i] : at[i + 1]].tobytes() == d[o[i] : o[i + 1]].tobytes() for i in range(hi - lo)], bool)
                first = np.concatenate([[0], np.cumsum(n)])
                fall = np.concatenate([[0], np.cumsum(enc.fallback[ids])])[first]
                small = ids.astype("<i4")
                if digest:
                    last = pa.array([hashlib.sha256(small[first[i] : first[i + 1]].tobytes()).hexdigest() for i in range(hi - lo)], pa.string())
                else:
                    last = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(small))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(np.diff(fall).astype(np.int64)), pa.array(same), last], names=schema.names)

    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("decoded_ok", T.BooleanType()),
        T.StructField("ids_sha256", T.StringType()) if digest else T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])
    return rows.mapInArrow(work, schema)


def decode(tokens: DataFrame, *, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text from arrays of ids; a null array gives null, control ids give nothing, bytes that are no UTF-8 become U+FFFD."""
    ship(tokens.sparkSession)
    with open(model, "rb") as f:
        sent = tokens.sparkSession.sparkContext.broadcast(f.read())
    rows = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def work(batches):
        enc = _cached(sent.value)
        for batch in batches:
            out = []
            for ids in batch.column("ids").to_pylist():
                if ids is None:
                    out.append(None)
                    continue
                a = np.array(ids, np.int64)
                out.append(enc.decode(a, np.array([len(a)]))[0].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(work, T.StructType([rows.schema["doc_id"], T.StructField("text", T.StringType())]))


class _remote:
    """A file that only Spark reads, as a context manager."""

    def __init__(self, spark: SparkSession, path: str):
        self.bytes = bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def read(self) -> bytes:
        return self.bytes


_CACHE: dict[bytes, Pieces] = {}


def _cached(model: bytes) -> Pieces:
    """One encoder per worker process and model."""
    key = hashlib.sha256(model).digest()
    if key not in _CACHE:
        _CACHE[key] = Pieces(model)
    return _CACHE[key]


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), digest=True)
