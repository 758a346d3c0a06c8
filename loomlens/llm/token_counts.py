"""Token counts of sections by offset-mapped attribution.

Every document is encoded once, whole, by a public byte-level BPE vocabulary; token lengths give
each token's character span, and the sorted spans are interval-joined to the sorted sections
(lines here; any ascending section starts will do). Rule for tokens that cross a boundary: the
token goes to the section that holds most of its characters, the earliest such section on a tie.
A character that is split over several tokens belongs to the span of each.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import cut, distinct, spread
from .common import SPACE, read, ship, steps, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer that belongs to the vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beyond ASCII: texts that hold any are encoded without being cut.
_WIDE_SPACE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
STEP = 2 << 20


class Encoder:
    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.size[i] = len(piece)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of ids of each."""
        n = len(offs) - 1
        starts, ends, row = cut(data, offs, SPACE)
        # suspects: bytes that begin wide white space, told exactly by the pattern
        lead = np.isin(data, (0xE1, 0xE2, 0xE3))
        lead[:-1] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        odd = np.unique(np.searchsorted(offs, np.flatnonzero(lead), side="right") - 1)
        odd = np.array([i for i in odd if _WIDE_SPACE.search(data[offs[i] : offs[i + 1]].tobytes().decode())], np.int64)
        if len(odd):
            plain = ~np.isin(row, odd)
            starts = np.concatenate([starts[plain], offs[odd]])
            ends = np.concatenate([ends[plain], offs[odd + 1]])
            order = np.argsort(starts, kind="stable")
            starts, ends = starts[order], ends[order]
            row = np.searchsorted(offs, starts, side="right") - 1
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        first, kind = distinct(data, starts, ends)
        raw = data.tobytes()
        got = [self.bpe.encode_ordinary(raw[a:b].decode()) for a, b in zip(starts[first], ends[first], strict=True)]
        sizes = np.array([len(g) for g in got], np.int64)
        ids, per = spread(np.array([i for g in got for i in g], np.int64), sizes, kind)
        return ids, np.bincount(row, weights=per, minlength=n).astype(np.int64)


_CACHE: dict[tuple[bytes, str], Encoder] = {}


def _cached(vocabulary: bytes, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    key = (hashlib.sha256(vocabulary).digest(), pattern)
    if key not in _CACHE:
        _CACHE[key] = Encoder(vocabulary, pattern)
    return _CACHE[key]


def line_starts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places where lines begin, and their rows; a line keeps its line feed."""
    at = np.zeros(len(data) + 1, bool)
    at[offs[:-1][np.diff(offs) > 0]] = True
    at[1:] |= data == 10
    at[offs[1:]] &= np.isin(offs[1:], offs[:-1][np.diff(offs) > 0])
    at[len(data)] = False
    starts = np.flatnonzero(at)
    return starts, np.searchsorted(offs, starts, side="right") - 1


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token span and whether it crosses a boundary; ``bounds`` are ascending section starts."""
    edge = np.append(bounds, stop)
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    out = first.copy()
    live = np.flatnonzero(last > first)
    most = edge[first[live] + 1] - starts[live]
    k = 1
    while len(live):
        ok = first[live] + k <= last[live]
        live, most = live[ok], most[ok]
        section = first[live] + k
        held = np.minimum(ends[live], edge[section + 1]) - edge[section]
        up = held > most
        out[live[up]], most[up] = section[up], held[up]
        k += 1
    return out, last > first


def count(
    docs: DataFrame, *, vocabulary: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text",
    sections: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] = line_starts,
) -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_crossing and ``sections`` of (start, end, n_tokens) in characters.

    ``sections`` maps a batch's bytes and offsets to byte places of section starts and their rows;
    every non-empty text must have a section at its start. Null and empty texts have no tokens and
    no sections; a very long text is a step of its own; of sections that hold as many of a token's
    characters the earliest gets it; repeated rows are each counted; null ids pass through; extra columns are ignored.
    The vocabulary is a fixed file, read on the driver.
    """
    ship(docs.sparkSession)
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    section = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n_tokens", pa.int64())])

    def work(batches):
        enc = _cached(sent.value, pattern)
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for lo, hi in steps(offs, STEP):
                d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                ids, n = enc.encode(d, o)
                size = enc.size[ids]
                e = np.cumsum(size)
                chars = np.concatenate([[0], np.cumsum((d & 0xC0) != 0x80)])
                # the character that holds a token's first byte, and the one after that of its last byte
                s_char, e_char = chars[e - size + 1] - 1, chars[e]
                bounds, owner = sections(d, o)
                b_char = chars[bounds]
                at, crossing = attribute(s_char, e_char, b_char, int(chars[-1]))
                per = np.bincount(at, minlength=len(bounds))
                doc = np.repeat(np.arange(hi - lo), n)
                base = chars[o[:-1]][owner]
                stop = np.append(b_char, chars[-1])[1:]
                held = pa.StructArray.from_arrays([pa.array(b_char - base), pa.array(stop - base), pa.array(per)], fields=list(section))
                lists = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=hi - lo))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(np.bincount(doc[crossing], minlength=hi - lo)), pa.ListArray.from_arrays(pa.array(lists), held)],
                    names=["doc_id", "n_tokens", "n_crossing", "sections"],
                )

    return rows.mapInArrow(work, T.StructType([
        rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("n_crossing", T.LongType()),
        T.StructField("sections", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "end", "n_tokens")]))),
    ]))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count(read(spark, sf_dir, "documents"))
    shown = F.transform("sections", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["n_tokens"].cast("string")))
    return counted.select("doc_id", "n_tokens", F.size("sections").cast("long").alias("n_sections"), "n_crossing", F.sha2(F.array_join(shown, ","), 256).alias("sections_sha256"), F.array_max(F.transform("sections", lambda s: s["n_tokens"])).alias("largest_section"))
