"""Language-model scores, language and quality: brute force where there is one, else held-out accuracy."""

from __future__ import annotations

import collections
import math
import re
import unicodedata
import zlib

import numpy as np
import pytest

from loomlens.llm import language_id, ppm, quality

SF = "/root/testdata/sf0.001"
MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


def plain_ppm(training, text):
    counts = [collections.defaultdict(collections.Counter) for _ in range(ppm.ORDER + 1)]

    def coded(t):
        return bytes([ppm.PAD] * ppm.ORDER) + (t or "").encode() + bytes([ppm.END])

    for t in training:
        s = coded(t)
        for p in range(ppm.ORDER, len(s)):
            for k in range(ppm.ORDER + 1):
                counts[k][s[p - k : p]][s[p]] += 1

    def score(t):
        s, out = coded(t), 0.0
        for p in range(ppm.ORDER, len(s)):
            gone = set()
            for k in range(ppm.ORDER, -1, -1):
                context = counts[k].get(s[p - k : p], {})
                live = {c: n for c, n in context.items() if c not in gone}
                total = 2 * sum(live.values())
                if s[p] in live:
                    out += math.log10((2 * live[s[p]] - 1) / total)
                    break
                if live:
                    out += math.log10(len(live) / total)
                gone |= set(context)
            else:
                out += math.log10(1 / (256 - len(gone)))
        return out

    return [score(t) for t in text]


def test_ppm_equals_plain_counting(spark, texts):
    got = {r["doc_id"]: r for r in ppm.op1_ppm(spark, SF).collect()}
    training = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    c = collections.Counter(x for t in training for x in tokens(t))
    total, kinds = sum(c.values()), len(c)
    for i, t in texts.items():
        own = tokens(t)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[x] > 0 for x in own), total)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in own), rel=1e-9)
    some = list(texts)[:12]
    assert [got[i]["score"] for i in some] == pytest.approx(plain_ppm(training, [texts[i] for i in some]), rel=1e-9)


def test_ppm_blocks_and_joined_words_change_nothing(spark, odd, none):
    training = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = lambda df: sorted(str([f"{v:.10g}" if isinstance(v, float) else v for v in r]) for r in df.collect())
    whole = rows(ppm.score(odd, training))
    # 400 entries: many a pair of context bytes has more and is split by its third byte, and some by the fourth
    few = ppm.score(odd, training.limit(3), block_entries=400, frequent=20)
    assert rows(few) == rows(ppm.score(odd, training.limit(3)))
    assert rows(ppm.score(odd, training, block_entries=5_000, frequent=20)) == whole
    assert few.count() == odd.count() and ppm.score(none, training).count() == 0
    assert ppm.score(odd, none).where("n_known > 0 OR base_score <> 0").count() == 0


def test_blocks_are_bounded_and_hold_every_entry_once(spark):
    """One pair of context bytes, and one of three, has more entries than a block."""
    rng = np.random.default_rng(5)
    tail = np.where(rng.random(40_000) < 0.7, 0x6520, rng.integers(0, 1 << 16, 40_000))
    third = np.where(rng.random(40_000) < 0.7, 0x74, rng.integers(0, 256, 40_000))
    context = (rng.integers(0, 1 << 16, 40_000) << 24) | (third << 16) | tail
    keys = np.unique((context << 8) | rng.integers(0, 256, 40_000))
    grams = spark.createDataFrame([(int(k), 1) for k in keys], "key long, n long")
    claims, split = ppm._plan(grams, 1_000)
    held = np.array([c.holds(keys.astype(np.uint64)) for c in claims])
    assert (held.sum(0) == 1).all() and held.sum(1).max() <= 1_000
    assert set(split) == {2, 3} and len(split[2][0]) <= 256 * 50


def test_language_of_held_out_texts(spark, odd, none):
    docs = spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang")
    held = language_id.op9_language_id(spark, MID).where("held_out").join(docs, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held) and all(0 <= r["score"] <= 1 for r in held)
    model = language_id.train(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = language_id.predict(odd, model, keep=odd.columns).collect()
    assert len(rows) == odd.count()
    assert all((r["lang_pred"] == "und") == (not any(unicodedata.category(c)[0] == "L" for c in r["row"]["text"] or "")) for r in rows)
    assert language_id.predict(none, model).count() == 0
    untaught = language_id.predict(odd, language_id.train(none))
    assert {r["lang_pred"] for r in untaught.collect()} == {"und"}


@pytest.mark.parametrize(("text", "letter"), [("² ½ ①", False), ("٣ Ⅷ _ 7", False), ("𝟘 🙂", False), ("ª", True), ("中", True), ("1 ß", True), ("", False), (None, False)])
def test_letters_are_category_l(spark, text, letter):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = language_id.Model(["aa", "bb"], np.ones((2, language_id.BUCKETS)))
    assert (language_id.predict(docs, model).first()["lang_pred"] != "und") == letter


def plain_buckets(text, sizes, buckets, code=lambda b: b):
    """Counts of hashed byte n-grams, one n-gram at a time."""
    data, out = code((text or "").encode()), collections.Counter()
    for size in sizes:
        for i in range(len(data) - size + 1):
            h = (0x811C9DC5 + size * 7919) % 2**32
            for c in data[i : i + size]:
                h = ((h ^ c) * 16777619) % 2**32
            h ^= h >> 15
            h = (h * 0x2C1B3C6D) % 2**32
            h ^= h >> 13
            out[h % buckets] += 1
    return out


def language_code(data):
    out = bytearray()
    for i, c in enumerate(data):
        if chr(c).isascii():
            out.append(ord(chr(c).lower()) if chr(c).isalpha() else 32)
        else:
            out.append(c + 32 if i and data[i - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97 else c)
    return bytes(out)


def plain_output_codes(docs, taught):
    """Languages and a loss for each of every document: training and decoding with a loop for each n-gram, bit and codeword."""
    learn = collections.defaultdict(collections.Counter)
    count = {i: plain_buckets(t, language_id.SIZES, language_id.BUCKETS, language_code) for i, t, _ in docs}
    for i, t, lang in docs:
        if lang is not None and t is not None and taught(i):
            learn[lang].update(count[i])
    langs, size = sorted(learn), language_id.BUCKETS
    rate = {x: [(learn[x][b] + 0.5) / (sum(learn[x].values()) + 0.5 * size) for b in range(size)] for x in langs}
    code = language_id.code_matrix(len(langs))
    weights, trust = [], []
    for bit in range(code.shape[1]):
        plus, minus = ([x for x, row in zip(langs, code, strict=True) if row[bit] == v] for v in (1, -1))
        w = [math.log(sum(rate[x][b] for x in plus) / len(plus)) - math.log(sum(rate[x][b] for x in minus) / len(minus)) for b in range(size)]
        weights.append(w)
        trust.append(max(0.05, min(row[bit] * sum(r * v for r, v in zip(rate[x], w, strict=True)) for x, row in zip(langs, code, strict=True))))
    out = {}
    for i, _, _ in docs:
        n = max(1, sum(count[i].values()))
        margin = [sum(c * w[b] for b, c in count[i].items()) * min(n, language_id.EVIDENCE) / n for w in weights]
        out[i] = [sum(math.log1p(math.exp(-m * c)) * u / sum(trust) for m, c, u in zip(margin, row, trust, strict=True)) for row in code]
    return langs, out


def letters(t):
    return any(unicodedata.category(c)[0] == "L" for c in t or "")


def test_output_codes_equal_plain_decoding(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    langs, losses = plain_output_codes(docs, lambda i: zlib.crc32(str(i).encode()) % 5 != 0)
    got = {r["doc_id"]: r for r in language_id.op9_language_id(spark, SF).collect()}
    for i, t, _ in docs:
        if not letters(t):
            assert got[i]["lang_pred"] == "und"
            continue
        loss = losses[i]
        best = min(range(len(langs)), key=loss.__getitem__)
        assert got[i]["lang_pred"] == langs[best]
        assert got[i]["score"] == pytest.approx(1 / sum(math.exp(loss[best] - x) for x in loss), abs=1e-4)


def test_texts_of_no_learned_language_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.train(docs)
    odd = [(1, "XQZK 17!! WVJX QXQZ!! KJXW ZZQ 99 VXKQ!! " * 10), (2, "x" * 400), (3, "12 34"), (4, docs.where("lang = 'de'").first()["text"])]
    got = {r["row"]["doc_id"]: (r["rejected"], r["lang_pred"]) for r in language_id.predict(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert got[1][0] and got[1][1] != "und" and got[3] == (True, "und") and got[4] == (False, "de")
    kept = language_id.predict(docs, model).where("NOT rejected").count()
    assert kept >= 0.99 * docs.where("text RLIKE '[a-z]'").count()


def test_votes_equal_plain_neighbours(spark):
    """Every document's neighbours searched one by one among the labelled vectors."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), per_class=40)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()] + [None, ""]
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        x = quality.features(*quality.text_bytes(quality.pa.array([t], quality.pa.string())))[0].astype(float)
        grams = plain_buckets(t, (2, 3), quality.GRAMS)
        length = math.sqrt(sum(math.log1p(n) ** 2 for n in grams.values()))
        assert all(x[b] == pytest.approx(math.log1p(n) / length, abs=1e-5) for b, n in grams.items())
        v = [sum((x[b] * model.idf[b] - model.mean[b]) * model.axes[b, k] for b in range(len(x))) for k in range(model.axes.shape[1])]
        v = [a / math.sqrt(sum(b * b for b in v)) for a in v]
        sim = sorted(((sum(a * b for a, b in zip(v, w, strict=True)), y) for w, y in zip(model.vectors.tolist(), model.y.tolist(), strict=True)), reverse=True)
        near = sim[: quality.NEIGHBOURS]
        near += [p for p in sim[quality.NEIGHBOURS :] if p[0] >= near[-1][0] - 1e-7]
        weight = [math.exp(quality.SHARPNESS * (s - 1)) + 1e-6 for s, _ in near]
        assert got[i] == pytest.approx(sum(w * y for w, (_, y) in zip(weight, near, strict=True)) / sum(weight), abs=1e-3)


@pytest.mark.parametrize("n", [0, 1, 2, 4, 7, 12])
def test_codewords_differ(n):
    code = language_id.code_matrix(n)
    assert len({tuple(r) for r in code}) == n and set(code.ravel()) <= {1.0, -1.0}
    if n > 2:  # two bits or more apart, so that one wrong bit is noticed
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 2


def test_quality_of_held_out_texts(spark, odd, none):
    labels = spark.read.parquet(f"{MID}/labels.parquet")
    held = quality.op6_quality(spark, MID).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in held)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), per_class=16)
    assert len(model.y) <= 32
    assert quality.score(odd, model).where("score BETWEEN 0 AND 1").count() == odd.count() and quality.score(none, model).count() == 0
    assert {r["score"] for r in quality.score(odd, quality.train(docs, labels.limit(0))).collect()} == {0.5}
