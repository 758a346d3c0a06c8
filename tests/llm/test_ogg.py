"""Ogg files: exact round trips, a plain checksum, damage of every kind, packets over pages."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from loomlens.llm import ogg

SF = "/root/testdata/sf0.001"


def plain_checksum(data: bytes) -> int:
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % 192 if raw else 192)


def plain_pages(data: bytes) -> list[tuple]:
    out, at = [], 0
    while at < len(data):
        assert data[at : at + 4] == b"OggS"
        flags, granule, serial, sequence, crc, n = struct.unpack("<BqIIIB", data[at + 5 : at + 27])
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        assert plain_checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) == crc
        out.append((at, end, flags, granule, serial, sequence, lacing))
        at = end
    return out


def test_checksum_equals_the_plain_one():
    rng = random.Random(1)
    for n in (0, 1, 7, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == plain_checksum(data)


def test_files_are_sound_and_packets_run_over_pages():
    payload = random.Random(2).randbytes(192 * 200)
    data = ogg.written(payload)
    pages = plain_pages(data)
    assert len({p[4] for p in pages}) == 2 and [p[2] & ogg.FIRST for p in pages] == [2, 2] + [0] * (len(pages) - 2)
    assert any(p[2] & ogg.CONTINUED for p in pages) and sum(bool(p[2] & ogg.LAST) for p in pages) == 2
    assert max(p[3] for p in pages) == len(payload) // 2
    streams, damaged, skipped = ogg.demultiplexed(data)
    assert (damaged, skipped, [s.lost for s in streams.values()]) == (0, 0, [0, 0])
    assert ogg.samples(streams)[0] == payload and ogg.written(payload) == data


@pytest.mark.parametrize("size", [0, 254, 255, 256, 510, 20_000])
def test_packets_of_any_size(size):
    packets = [(b"head", 0), (b"x" * size, 5), (b"", 6), (b"y" * 255, 7)]
    streams, *_ = ogg.demultiplexed(ogg.multiplexed([ogg.track_pages(9, packets, 4)]))
    assert streams[9].packets == [p for p, _ in packets] and streams[9].closed and streams[9].lost == 0


def test_a_damaged_page_takes_only_its_packets():
    payload = random.Random(3).randbytes(192 * 300)
    data = ogg.written(payload)
    pages = plain_pages(data)
    for hit in range(2, len(pages)):
        start, end = pages[hit][:2]
        for broken in (data[: end - 1] + bytes([data[end - 1] ^ 1]) + data[end:], data[:start] + data[end:], data[:start] + b"junk" + data[end:]):
            streams, damaged, skipped = ogg.demultiplexed(broken)
            back, _ = ogg.samples(streams)
            hurt = pages[hit][4]
            assert (damaged, skipped) in ((1, end - start), (0, 0), (0, 4))
            assert sum(s.lost for s in streams.values()) == (0 if pages[hit][2] & ogg.LAST else 1)
            channel = [p[4] for p in pages[:2]].index(hurt)
            other, own = 1 - channel, payload[channel::2]
            assert back[other::2][: len(payload) // 2] == payload[other::2]
            got = back[channel::2]
            # whatever of the hurt channel is there stands at its own time
            wrong = [i for i in range(0, len(own), 960) if got[i : i + 960] != own[i : i + 960]]
            assert 0 < len(wrong) <= 10 and all(set(got[i : i + 960]) <= {128} for i in wrong)


def test_damage_in_the_capture_pattern_cut_ends_and_foreign_bytes():
    data = ogg.written(b"a" * 192 * 40)
    assert ogg.demultiplexed(b"") == ({}, 0, 0) and ogg.demultiplexed(b"RIFFxxxx")[0] == {}
    assert ogg.samples({}) == (b"", [])
    streams, damaged, skipped = ogg.demultiplexed(b"OggS" + data + data[:40])
    assert damaged == 2 and skipped == 4 + 40 and ogg.samples({k: s for k, s in streams.items()})[0] == b"a" * 192 * 40
    streams, damaged, _ = ogg.demultiplexed(data[:-5])
    assert damaged == 1 and not all(s.closed for s in streams.values())


def test_the_last_position_cuts_a_closed_stream():
    head = ogg.HEAD.pack(ogg.MARK, ogg.RATE, 0, 1)
    streams, *_ = ogg.demultiplexed(ogg.multiplexed([ogg.track_pages(1, [(head, 0), (b"a" * 960, 960), (b"b" * 960, 1000)])]))
    assert streams[1].times()[1:] == [(0, 960), (960, 1000)] and ogg.samples(streams)[0] == b"a" * 960 + b"b" * 40


def test_query_equals_plain_reading(spark):
    rows = {r["doc_id"]: r for r in ogg.op11_ogg(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    files = {r["doc_id"]: bytes(r["media"]) for r in ogg.store(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        r, p, media = rows[d["doc_id"]], padded(d["text"]), files[d["doc_id"]]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len((d["text"] or "").encode()), len(p), hashlib.sha256(p).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(p[-16:]), len(media), hashlib.sha256(media).hexdigest())
        assert (r["damaged"], r["lost"]) == (0, 0) and f"ms={len(p) // 2 * 1000 // 8000}," in r["feature"]


def test_odd_rows(spark, odd, none):
    kept = ogg.store(odd)
    back = ogg.decode(kept)
    assert kept.count() == back.count() == odd.count() and ogg.store(none).count() == ogg.decode(ogg.store(none)).count() == 0
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, padded(r["text"])) for r in odd.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["payload"])) for r in back.collect()) == want
    first = kept.where("doc_id = 0").select("media").first()[0]
    assert {bytes(r[0]) for r in kept.where("n_bytes = 0").select("media").collect()} == {bytes(first)}
    streams = ogg.demultiplex(kept)
    assert streams.where((F.size("streams") != 2) | (F.col("damaged") > 0) | (F.col("skipped") > 0)).count() == 0
    foreign = spark.createDataFrame([(1, None), (2, bytearray()), (3, bytearray(b"OggS")), (3, bytearray(b"x"))], "doc_id long, media binary")
    assert [(r["damaged"], r["skipped"], len(r["streams"])) for r in ogg.demultiplex(foreign).orderBy("doc_id", "skipped").collect()] == [(0, 0, 0), (0, 0, 0), (0, 1, 0), (1, 4, 0)]
    assert [(bytes(r["payload"]), r["feature"]) for r in ogg.decode(foreign).collect()] == [(b"", "")] * 4
