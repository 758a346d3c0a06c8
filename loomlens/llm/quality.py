"""Quality classification by nearest-neighbour voting in a latent-semantic space.

Texts become TF-IDF weights of hashed byte n-grams plus a few indicators of their make-up
(shares of capitals, symbols and repeated words). A truncated singular value decomposition of
a bounded sample of labelled rows gives the latent space; the sample's vectors are broadcast,
and the exact cosine products of every document with all of them are computed block by block.
The nearest labels vote with weights that grow with similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, SPACE, read, runs, ship, span_hashes, steps, text_bytes
from .language_id import fold
from .ngrams import histogram

#: Labelled rows of each class that the neighbours are taken from (the documented bound of the sample).
SAMPLE_PER_CLASS = 1024
GRAMS = 2048
BINS = 12
#: Shares that are binned: capitals, symbols, digits, repeated words, white space, distinct words, line length.
SHARES = 7
WIDTH = GRAMS + SHARES * BINS
RANK = 48
NEIGHBOURS = 15
SHARPNESS = 8.0
STEP = 1 << 19
STEP_ROWS = 512


def _shares(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows of shares in 0..1."""
    n = len(offs) - 1
    size = np.maximum(np.diff(offs), 1)
    row = np.repeat(np.arange(n), np.diff(offs))
    per = lambda mask: np.bincount(row[mask], minlength=n)
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    space = SPACE[data]
    symbol = ~(letter | digit | space | (data == 46) | (data == 44))
    starts, ends, doc = runs(~space, offs)
    words = np.maximum(np.bincount(doc, minlength=n), 1)
    distinct = np.zeros(n)
    again = np.zeros(n)
    if len(starts):
        h = span_hashes(LOWER[data], starts, ends)
        order = np.lexsort((h, doc))
        new = np.ones(len(h), bool)
        new[1:] = (np.diff(doc[order]) != 0) | (h[order][1:] != h[order][:-1])
        distinct = np.bincount(doc[order][new], minlength=n)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        again = np.bincount(doc[same], minlength=n)
    lines = per(data == 10) + 1
    return np.stack([per(upper) / size, per(symbol) / size, per(digit) / size, again / words, per(space) / size, distinct / words, np.minimum(1, words / lines / 100)], 1)


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Damped counts of n-grams per row, scaled to unit length, and indicators of binned shares (soft bins)."""
    h = np.log1p(histogram(data, offs, GRAMS, (2, 3)))
    h /= np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-9)
    at = np.sqrt(np.clip(_shares(data, offs), 0, 1)) * (BINS - 1)
    bins = np.maximum(0, 1 - np.abs(at[:, :, None] - np.arange(BINS)))
    return np.concatenate([h, bins.reshape(len(h), -1) * 0.35], axis=1).astype(np.float32)


def _each(batch):
    data, offs = text_bytes(batch.column("text"))
    for lo, hi in steps(offs, STEP):
        for a in range(lo, hi, STEP_ROWS):
            b = min(hi, a + STEP_ROWS)
            yield a, b, features(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])


class Model:
    """The latent space and the labelled vectors in it."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rank: int = RANK, seed: int = 3):
        self.y = y.astype(np.float32)
        df = (x > 0).sum(0)
        self.idf = (np.log((1 + len(x)) / (1 + df)) + 1).astype(np.float32)
        w = x * self.idf
        self.mean = w.mean(0) if len(w) else np.zeros(x.shape[1], np.float32)
        w = w - self.mean
        rank = min(rank, *w.shape) if len(w) else 0
        rng = np.random.default_rng(seed)
        q = np.linalg.qr(w @ rng.standard_normal((w.shape[1], rank + 10)).astype(np.float32))[0] if rank else np.zeros((0, 0), np.float32)
        for _ in range(4 if rank else 0):  # power iterations of the randomised decomposition
            q = np.linalg.qr(w @ np.linalg.qr(w.T @ q)[0])[0]
        self.axes = np.linalg.svd(q.T @ w, full_matrices=False)[2][:rank].T.astype(np.float32) if rank else np.zeros((x.shape[1], 0), np.float32)
        self.vectors = self.project(x)

    def project(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.idf - self.mean) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.y):
            return np.full(len(x), 0.5)
        sim = self.project(x) @ self.vectors.T
        # the k nearest, and all that are as near as the last of them
        last = np.partition(sim, -min(k, sim.shape[1]), axis=1)[:, -min(k, sim.shape[1])]
        # a shared floor, so that a text without a close neighbour still gets a vote
        w = np.where(sim >= last[:, None], np.exp(SHARPNESS * (sim - 1)) + 1e-6, 0)
        return np.clip(w @ self.y / w.sum(1), 0, 1)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fits on at most ``per_class`` labelled rows of each class, taken by a hash of the id.

    Rows with a null id, text or label are left out; an id with several labels counts for each.
    Without labelled rows every score is 0.5.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    order = F.xxhash64("id", F.lit(11))
    chosen = [known.where(F.col("label") == c).orderBy(order, "id").limit(per_class) for c in (0, 1)]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_class rows

    def extract(batches):
        for batch in batches:
            ids, labs = batch.column("id"), batch.column("label")
            for a, b, x in _each(batch):
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), labs.slice(a, b - a), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())], names=["id", "label", "x"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(sample, "id")
    got = rows.select("id", "label", "text").mapInArrow(extract, T.StructType([rows.schema["id"], T.StructField("label", T.IntegerType()), T.StructField("x", T.BinaryType())]))
    # of several texts with one id the one of the least vector counts, in every run
    table = got.groupBy("id", "label").agg(F.min("x").alias("x")).orderBy("id", "label").collect()
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in table]).astype(np.float32) if table else np.zeros((0, WIDTH), np.float32)
    return Model(x, np.array([r["label"] for r in table]))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every row; null and empty texts are scored like any other text of length 0.

    Neighbours that are as near as the last of the nearest vote as well, so that ties need no order. Very
    long texts are scored whole, alone in their step. Repeated rows get the same score; null ids pass
    through; extra columns are ignored; no rows give none.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        m = sent.value
        for batch in batches:
            s = [m.score(x) for _, _, x in _each(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(s) if s else np.zeros(0), pa.float64())], names=["doc_id", "score"])

    return rows.mapInArrow(work, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs, labels.where(fold("doc_id", 3) != 1))
    scored = score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
