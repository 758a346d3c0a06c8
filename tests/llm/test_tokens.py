"""Pieces and section counts: brute-force segmentation, exact round trips, and the tokenizer's own output."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from loomlens.llm import pieces, token_counts
from loomlens.llm.common import text_bytes

SF = "/root/testdata/sf0.001"
TEXTS = ["", "  a  b\n\n c ", "é𝒳🙂 　x\t\x00y", "a" * 300, "word " * 3, "ÿ", " ", "x\n\n\ny", "— dash", "it's  don't\r\n\n x", "1234-5678", "字符串" * 120, "abcdefgh" * 700, "語" * 40 + " " + "x" * 600]


@pytest.fixture(scope="module")
def model():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Pieces(f.read())


def plain_viterbi(model, table, text):
    b = ("▁" + text.replace(" ", "▁")).encode()
    best, back = [0.0] + [-1e18] * len(b), [None] * (len(b) + 1)
    for i in range(len(b)):
        if b[i] & 0xC0 == 0x80:
            continue
        char = 1 if b[i] < 0xC0 else 2 if b[i] < 0xE0 else 3 if b[i] < 0xF0 else 4
        known = False
        for n in range(1, min(48, len(b) - i) + 1):
            k = table.get(b[i : i + n])
            if k is not None:
                known |= n == char
                if best[i] + model.scores[k] > best[i + n]:
                    best[i + n], back[i + n] = best[i] + model.scores[k], (i, [k])
        if not known and best[i] + model.unknown > best[i + char]:
            best[i + char], back[i + char] = best[i] + model.unknown, (i, [int(model.byte_ids[x]) for x in b[i : i + char]])
    out, p = [], len(b)
    while p:
        p, ids = back[p]
        out = ids + out
    return out


def test_encoding_is_the_best_segmentation(spark, model):
    with open(pieces.MODEL, "rb") as f:
        table = {p.encode(): i for i, (p, _, k) in enumerate(pieces.load_pieces(f.read())) if k in (pieces.NORMAL, pieces.USER) and p}
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(12).collect()]
    docs.append(max((r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), key=len))  # one very long text, whole
    texts = TEXTS + docs
    ids, n = model.encode(*text_bytes(pa.array(texts)))
    first = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == (plain_viterbi(model, table, t) if t else [])
    back, at = model.decode(ids, n)
    assert [back[at[i] : at[i + 1]].tobytes().decode() for i in range(len(texts))] == texts


def test_encode_and_decode_frames(spark, odd, none):
    rows = pieces.encode(odd)
    assert rows.count() == odd.count() and pieces.encode(none).count() == 0
    assert rows.join(odd.where("doc_id = 4"), "doc_id").where("NOT decoded_ok").count() == 1  # the marker itself decodes to a space
    assert rows.where("doc_id <> 4 AND NOT decoded_ok").count() == 0
    texts = {r["doc_id"]: r["text"] for r in odd.where("doc_id NOT IN (4, 3)").collect()}
    got = {r["doc_id"]: r["text"] for r in pieces.decode(rows.where("doc_id NOT IN (4, 3)")).collect()}
    assert got == {i: t or "" for i, t in texts.items()}


def test_every_document_decodes(spark):
    rows = pieces.op3_pieces(spark, SF)
    assert rows.where("NOT decoded_ok").count() == 0 and rows.count() == 200


def test_double_array_finds_its_keys():
    rng = random.Random(2)
    keys = sorted({bytes(rng.choices(range(256), k=rng.randrange(1, 6))) for _ in range(500)})
    trie = pieces.DoubleArray(keys, list(range(len(keys))))
    for i, k in enumerate(keys):
        s = np.zeros(1, np.int64)
        for c in k:
            s = trie.step(s, np.array([c]))
        assert trie.value[s[0]] == i
    missing = set(range(256)) - {k[0] for k in keys}
    assert all(trie.step(np.zeros(1, np.int64), np.array([c]))[0] == -1 for c in missing)


@pytest.fixture(scope="module")
def encoder():
    with open(token_counts.VOCABULARY, "rb") as f:
        return token_counts.Encoder(f.read())


def test_cut_texts_encode_like_whole_ones(spark, encoder):
    texts = TEXTS + ["a  b", "x   y  z"] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    ids, n = encoder.encode(*text_bytes(pa.array(texts)))
    first = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == encoder.bpe.encode_ordinary(t)


def plain_sections(encoder, text):
    lines = text.split("\n")
    bounds, at = [], 0
    for i, x in enumerate(lines):
        size = len(x) + (i < len(lines) - 1)
        if size:
            bounds.append((at, at + size))
        at += size
    counts, crossing, place = [0] * len(bounds), 0, 0
    data = text.encode()
    ids = encoder.bpe.encode_ordinary(text)
    for k in ids:
        size = int(encoder.size[k])
        s = sum((c & 0xC0) != 0x80 for c in data[: place + 1]) - 1
        e = sum((c & 0xC0) != 0x80 for c in data[: place + size])
        held = [max(0, min(e, b) - max(s, a)) for a, b in bounds]
        crossing += sum(h > 0 for h in held) > 1
        counts[held.index(max(held))] += 1
        place += size
    return len(ids), crossing, [(a, b, c) for (a, b), c in zip(bounds, counts, strict=True)]


def test_sections_equal_plain_attribution(spark, encoder, odd, none):
    docs = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts = TEXTS + [t[:800] for t in docs[:10]] + sorted((t for t in docs if len(t) < 9000), key=len)[-1:]  # and a long text, whole
    rows = token_counts.count(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert (r["n_tokens"], r["n_crossing"], [tuple(s) for s in r["sections"]]) == plain_sections(encoder, texts[r["doc_id"]])
    assert token_counts.count(odd).count() == odd.count() and token_counts.count(none).count() == 0


def test_rule_of_crossing_tokens():
    at, crossing = token_counts.attribute(np.array([0, 3, 8]), np.array([3, 9, 12]), np.array([0, 5, 10]), 12)
    assert at.tolist() == [0, 1, 1] and crossing.tolist() == [False, True, True]  # a tie goes to the earlier section
