"""Helpers that the corpus operators share: work tables and byte-level kernels."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship

#: Bytes of text that one numpy step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20

#: ASCII lower-casing of bytes; everything else stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: White space of the contracts: space and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_RNG = np.random.default_rng(20260101)
#: A random 64-bit value per byte, and an odd multiplier with its inverse modulo 2**64.
_BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``.

    Where the setting is absent, a local folder is set on a single machine; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="loomlens-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/loomlens-{uuid.uuid4().hex}"


#: Whether Spark removes an action's shuffle files at its end, and not only when the driver collects its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes ``df`` as Parquet in a shared folder and reads it: cuts lineage, survives lost executors, and frees the disk
    of the shuffles that led to it."""
    conf = df.sparkSession.conf
    before = conf.get(FREED, None)
    conf.set(FREED, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.unset(FREED) if before is None else conf.set(FREED, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key that more than one in so many rows have is hot, so hot keys number less than this.
HOT = 1024


def met(rows: DataFrame, table: DataFrame, keys: list[str], counted: str) -> DataFrame:
    """``rows`` joined with the one row of ``table`` for their ``keys``; ``counted`` in it says how many rows have the key.

    A hot key is dealt in shares, each about a HOT-th of all rows, and its row in the table is there
    once for each share (at most 2 * HOT rows in all), so no task gets a whole hot group. The hot keys,
    less than HOT, are broadcast. ``table`` is a stored one.
    """
    total = table.agg(F.sum(counted)).first()[0] or 0
    hot = table.where(F.col(counted) * HOT > total).select(*keys, F.ceil(F.col(counted) * HOT / F.lit(max(total, 1))).cast("int").alias("_shares"))
    shares = F.coalesce("_shares", F.lit(1))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_share", F.pmod(F.monotonically_increasing_id(), shares).cast("int")).drop("_shares")
    each = table.join(F.broadcast(hot), keys, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_shares")
    return dealt.join(each, [*keys, "_share"]).drop("_share")


#: Rows up to this number (some 350 bytes each at most, as they are held) are broadcast instead of shuffling texts; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def small(table: DataFrame) -> DataFrame:
    """A stored table of keys, marked for broadcast if its counted rows are within the bound."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column as one byte array, and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offs = offs[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def steps(offs: np.ndarray, size: int = STEP_BYTES):
    """Row ranges that hold about ``size`` bytes each (one row at least)."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of ``mask`` that stay within a row."""
    n = len(mask)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[offs] = True
    on = np.zeros(n + 1, bool)
    on[:n] = mask
    before = np.zeros(n + 1, bool)
    before[1:] = mask
    starts = np.flatnonzero(on & (~before | first))
    ends = np.flatnonzero(before & (~on | first))
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix)."""
    h = h.copy() if h.base is None else h + np.uint64(0)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Powers:
    """Powers of the hash base and of its inverse, grown on demand and kept for the worker's life."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(cls, name, np.cumprod(x))
        return cls.up, cls.down


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of byte spans, mixed with their lengths."""
    up, down = Powers.of(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gather_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of many spans, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, data.dtype)
    out = np.ones(total, np.int64)
    ok = lengths > 0
    s, n = starts[ok], lengths[ok]
    at = np.zeros(len(s), np.int64)
    np.cumsum(n[:-1], out=at[1:])
    out[at] = s
    out[at[1:]] -= s[:-1] + n[:-1] - 1
    return data[np.cumsum(out)]
