"""Ogg physical bitstreams in binary columns: written from texts, and read with every check.

Reading verifies each page's checksum and looks for the next capture pattern after a damaged one,
tells logical streams apart by serial number, puts packets together from lacing values across
pages (a packet that lost a page is dropped), and derives the time of every packet from the granule
position of the page that it ends on. Writing stores a payload as two channels of unsigned 8-bit
samples, a logical stream each, whose pages alternate.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, ship, steps, text_bytes

#: Fixed values of the format: capture pattern, page header, header flags, granule position of a page on which no packet ends.
CAPTURE = b"OggS"
PAGE = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NO_PACKET = -1

#: Our stream head: mark, samples a second, channel, channels. A packet holds 8-bit samples of one channel.
HEAD = struct.Struct("<8sIHH")
MARK = b"\x01pcm8\x00\x00\x00"
RATE, CHANNELS, SAMPLES = 8000, 2, 960
#: Payloads are a positive multiple of so many bytes.
UNIT = 192
#: Lacing values of a page; packets of 960 samples have four, so packets run over the ends of pages.
SEGMENTS = 30

_FLIP = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(data: bytes) -> int:
    """The format's CRC-32 (0x04C11DB7, most significant bit first, from 0, not inverted): zlib's is the same on flipped bits."""
    crc = zlib.crc32(data.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_FLIP), "big")


def page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    bare = PAGE.pack(CAPTURE, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing + body
    return bare[:22] + struct.pack("<I", checksum(bare)) + bare[26:]


def track_pages(serial: int, packets: list[tuple[bytes, int]], segments: int = SEGMENTS) -> Iterator[bytes]:
    """The pages of one logical stream from its packets and their granule positions; the first packet has a page alone."""
    sequence, flags = 0, FIRST
    lacing, body, granule, continued = bytearray(), bytearray(), NO_PACKET, 0
    for k, (data, position) in enumerate(packets):
        lace = bytes([255]) * (len(data) // 255) + bytes([len(data) % 255])
        done = 0
        while done < len(lace):
            part = lace[done : done + segments - len(lacing)]
            body += data[done * 255 : (done + len(part)) * 255]
            lacing += part
            done += len(part)
            ended = done == len(lace)
            if ended:
                granule = position
            last = ended and k == len(packets) - 1
            if len(lacing) == segments or last or (ended and k == 0):
                yield page(flags | continued | (LAST if last else 0), granule, serial, sequence, bytes(lacing), bytes(body))
                sequence, flags, continued = sequence + 1, 0, 0 if ended else CONTINUED
                lacing, body, granule = bytearray(), bytearray(), NO_PACKET


def multiplexed(tracks: list[Iterator[bytes]]) -> bytes:
    """All first pages, then the pages of the tracks in turn."""
    out, live = [], list(tracks)
    while live:
        after = []
        for t in live:
            if (p := next(t, None)) is not None:
                out.append(p)
                after.append(t)
        live = after
    return b"".join(out)


def written(payload: bytes) -> bytes:
    """A payload as channels of samples; serial numbers come from its hash."""
    digest = hashlib.sha256(payload).digest()
    base = int.from_bytes(digest[:4], "little")
    tracks = []
    for c in range(CHANNELS):
        samples = payload[c::CHANNELS]
        packets = [(HEAD.pack(MARK, RATE, c, CHANNELS), 0)]
        packets += [(samples[i : i + SAMPLES], min(i + SAMPLES, len(samples))) for i in range(0, len(samples), SAMPLES)]
        tracks.append(track_pages((base + c) % (1 << 32), packets))
    return multiplexed(tracks)


@dataclass
class Stream:
    """A logical stream: whole packets, each with the granule position of its page if it is the last that ends there (else None)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    positions: list[int | None] = field(default_factory=list)
    pages: int = 0
    lost: int = 0
    closed: bool = False
    _next: int = 0
    _part: list[bytes] | None = None

    def take(self, flags: int, granule: int, sequence: int, lacing: bytes, body: bytes) -> None:
        if sequence != self._next:
            self.lost += 1
            self._part = None
        self._next, self.pages, self.closed = sequence + 1, self.pages + 1, bool(flags & LAST)
        # a fragment whose beginning is lost is passed over; one without its end is dropped
        part = self._part if flags & CONTINUED else []
        lost_head = part is None
        at, kept = 0, len(self.packets)
        size = 0
        for x in lacing:
            size += x
            if x == 255:
                continue
            piece = body[at : at + size]
            if lost_head:
                lost_head = False
            else:
                self.packets.append(b"".join([*part, piece]) if part else piece)
                self.positions.append(None)
            at, size, part = at + size, 0, []
        if size or (lacing and lacing[-1] == 255):
            self._part = None if lost_head else [*part, body[at:]]
        else:
            self._part = None
        if len(self.packets) > kept:
            self.positions[-1] = granule if granule >= 0 else None

    def times(self) -> list[tuple[int, int] | None]:
        """First and last-exclusive sample of every packet after the head, for streams whose packets are 8-bit samples.

        A page's granule position is where its last packet ends; those before end where the next begins. In
        a closed stream a position short of the samples cuts the last packet.
        """
        out: list[tuple[int, int] | None] = [None] * len(self.packets)
        reached, first = 0, 1
        for k in range(1, len(self.packets)):
            stop = self.positions[k]
            if stop is None:
                continue
            total = sum(len(p) for p in self.packets[first : k + 1])
            cut = self.closed and k == len(self.packets) - 1 and reached + total > stop
            at = reached if cut else stop - total
            for i in range(first, k + 1):
                out[i] = (at, min(at + len(self.packets[i]), stop))
                at += len(self.packets[i])
            reached, first = stop, k + 1
        return out


def demultiplexed(data: bytes) -> tuple[dict[int, Stream], int, int]:
    """Logical streams by serial number, the number of damaged pages, and the bytes that are in no sound page."""
    streams: dict[int, Stream] = {}
    at, damaged, skipped, n = 0, 0, 0, len(data)
    while at < n:
        end = 0
        if data.startswith(CAPTURE, at):
            if at + PAGE.size <= n:
                _, version, flags, granule, serial, sequence, crc, segments = PAGE.unpack_from(data, at)
                body = at + PAGE.size + segments
                lacing = data[at + PAGE.size : body]
                end = body + sum(lacing) if len(lacing) == segments else n + 1
            if not at + PAGE.size <= n or end > n or version or checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
                damaged, end = damaged + 1, 0
        if end:
            if serial not in streams:
                streams[serial] = Stream(serial)
            streams[serial].take(flags, granule, sequence, lacing, data[body:end])
            at = end
        else:
            after = data.find(CAPTURE, at + 1)
            after = n if after < 0 else after
            skipped += after - at
            at = after
    return streams, damaged, skipped


def samples(streams: dict[int, Stream]) -> tuple[bytes, list[tuple[Stream, np.ndarray]]]:
    """The payload of all channels, and each channel's samples, placed by their times; what is lost is silence (128)."""
    channels = {}
    for s in streams.values():
        if s.packets and len(s.packets[0]) == HEAD.size and s.packets[0].startswith(MARK):
            _, _, channel, total = HEAD.unpack(s.packets[0])
            channels[channel] = (s, total)
    if not channels:
        return b"", []
    total = max(t for _, t in channels.values())
    out = []
    for c in sorted(channels):
        s = channels[c][0]
        times = s.times()
        size = max((t[1] for t in times if t), default=0)
        held = np.full(size, 128, np.uint8)
        for data, t in zip(s.packets, times, strict=True):
            if t and t[0] >= 0:
                held[t[0] : t[1]] = np.frombuffer(data, np.uint8, t[1] - t[0])
        out.append((s, held))
    whole = np.full((max(len(h) for _, h in out), total), 128, np.uint8)
    for c, (_, h) in zip(sorted(channels), out, strict=True):
        if c < total:
            whole[: len(h), c] = h
    return whole.tobytes(), out


def feature(channels: list[tuple[Stream, np.ndarray]]) -> str:
    """For each channel: packets, pages, milliseconds, peak, energy (mean square, rounded down) and crossings of the centre."""
    shown = []
    for s, held in channels:
        wave = held.astype(np.int64) - 128
        crossings = np.count_nonzero(np.diff(wave >= 0))
        energy = int(wave @ wave) // max(len(wave), 1)
        peak = int(np.abs(wave).max(initial=0))
        shown.append(f"packets={len(s.packets) - 1},pages={s.pages},ms={len(held) * 1000 // RATE},peak={peak},energy={energy},crossings={crossings}")
    return ";".join(shown)


def _named(docs: DataFrame, id_col: str, column: str, name: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{column}`").alias(name))


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes of the text and ``media``, an Ogg file of its UTF-8 bytes.

    The bytes are padded with spaces to a positive multiple of 192. Null counts as empty; equal texts give
    equal files; a very long text is a step of its own; null ids pass through, rows that repeat are each
    stored, no rows give none; extra columns are ignored, whatever their names.
    """
    rows = _named(docs, id_col, text_col, "text")

    def work(batches):
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for lo, hi in steps(offs):
                size = np.diff(offs[lo : hi + 1])
                made = []
                for i in range(lo, hi):
                    raw = data[offs[i] : offs[i + 1]].tobytes()
                    made.append(written(raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(size), pa.array(made, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(work, T.StructType([rows.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


_PACKET = "start long, stop long, data binary"
_STREAM = f"serial long, pages int, lost int, closed boolean, packets array<struct<{_PACKET}>>"


def demultiplex(files: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per input row: doc_id, ``damaged`` pages, ``skipped`` bytes and ``streams`` in order of appearance.

    A stream has its serial number, sound pages, places where pages are missing, whether its last page is there, and its whole
    packets with the samples that they span; where the times are not known (the head; after the last page that tells
    one; streams other than 8-bit samples) start is null and stop the page's granule position, if any.
    Null, empty and foreign bytes have no streams; repeated rows are each read.
    """
    rows = _named(files, id_col, media_col, "media")
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(f"damaged long, skipped long, streams array<struct<{_STREAM}>>").fields])
    kind = pa.list_(pa.struct([("serial", pa.int64()), ("pages", pa.int32()), ("lost", pa.int32()), ("closed", pa.bool_()), ("packets", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("data", pa.binary())])))]))

    def shown(s: Stream) -> dict:
        own = bool(s.packets) and s.packets[0].startswith(MARK)
        times = s.times() if own else [None] * len(s.packets)
        packets = [{"start": t[0] if t else None, "stop": t[1] if t else p, "data": d} for d, p, t in zip(s.packets, s.positions, times, strict=True)]
        return {"serial": s.serial, "pages": s.pages, "lost": s.lost, "closed": s.closed, "packets": packets}

    def work(batches):
        for batch in batches:
            media = batch.column("media")
            sizes = [0 if v is None else v for v in pc.binary_length(media).to_pylist()]
            for lo, hi in steps(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)):
                found = [demultiplexed(x or b"") for x in media.slice(lo, hi - lo).to_pylist()]
                streams = pa.array([[shown(s) for s in f[0].values()] for f in found], kind)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), streams], names=schema.names)

    return rows.mapInArrow(work, schema)


def decode(files: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per input row: doc_id, ``damaged`` and ``lost`` pages, the ``payload`` of all channels and the ``feature`` text.

    Samples stand where their times say; what damaged pages took away is silence. Null, empty and foreign bytes
    have an empty payload and feature; repeated rows are each read.
    """
    rows = _named(files, id_col, media_col, "media")
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("damaged long, lost long, payload binary, feature string").fields])

    def work(batches):
        for batch in batches:
            media = batch.column("media")
            sizes = [0 if v is None else v for v in pc.binary_length(media).to_pylist()]
            for lo, hi in steps(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)):
                columns: list[list] = [[], [], [], []]
                for x in media.slice(lo, hi - lo).to_pylist():
                    streams, damaged, _ = demultiplexed(x or b"")
                    payload, channels = samples(streams)
                    for c, v in zip(columns, (damaged, sum(s.lost for s in streams.values()), payload, feature(channels)), strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=schema.names)

    return rows.mapInArrow(work, schema)


def op11_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = store(read(spark, sf_dir, "documents"))
    files = kept.select(F.struct("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")).alias("about"), "media")
    back = decode(files, id_col="about")
    return back.select(
        "doc_id.doc_id", "doc_id.n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -16, 16)).alias("tail_crc32"), "doc_id.media_bytes", "doc_id.media_sha256", "feature", "damaged", "lost",
    )
