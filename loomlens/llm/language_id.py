"""Language identification by error-correcting output codes.

Each language has a codeword; a binary classifier over hashed byte n-grams predicts each bit.
The classifiers are linear (log-odds of the pooled, class-balanced n-gram rates of the languages
on either side of a bit), so all are trained from one table of n-gram counts by language, whose
size is languages * buckets whatever the corpus. Decoding sums each bit's logistic loss, weighted
by how well the bit separates the training languages, and takes the codeword with the least; a
text whose two best codewords lie close is flagged ambiguous.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, ship, steps, text_bytes
from .ngrams import histogram, language_bytes

BUCKETS = 4096
SIZES = (1, 2, 3)
#: Bytes per numpy step: rows * buckets counts are held beside them.
STEP = 1 << 19
STEP_ROWS = 512
SMOOTHING = 0.5
#: N-grams beyond which a text gives no more evidence, so that scores of long texts stay comparable.
EVIDENCE = 60.0
AMBIGUOUS = 0.75
#: The loss of a codeword whose bits are told by chance. A text whose best codeword loses as much is in no language that the model knows.
REJECT = float(np.log(2))
UNKNOWN = "und"


def code_matrix(n: int, seed: int = 7) -> np.ndarray:
    """Codewords of n languages as rows of +1 and -1: the exhaustive code up to 7, then a random code."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        bits = [[1] + [1 - 2 * ((b >> i) & 1) for i in range(n - 1)] for b in range(1, 2 ** (n - 1))]
        return np.array(bits, float).T
    rng = np.random.default_rng(seed)
    width = 10 * int(np.ceil(np.log2(n)))
    best, apart = None, -1
    for _ in range(50):
        m = rng.choice([-1.0, 1.0], (n, width))
        m = m[:, np.abs(m.sum(0)) < n]
        least = min((m.shape[1] - m[i] @ m[j]) / 2 for i in range(n) for j in range(i)) if n <= 200 else m.shape[1] / 4
        if least > apart:
            best, apart = m, least
    return best


class Model:
    """Bit classifiers and codewords from n-gram counts by language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        rates = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * counts.shape[1])
        self.code = code_matrix(len(languages))
        bits = self.code.shape[1]
        self.weights = np.zeros((counts.shape[1], bits), np.float32)
        self.trust = np.ones(bits)
        for b in range(bits):
            plus, minus = self.code[:, b] > 0, self.code[:, b] < 0
            if not plus.any() or not minus.any():
                continue
            w = np.log(rates[plus].mean(0)) - np.log(rates[minus].mean(0))
            self.weights[:, b] = w
            # the least mean margin by which a language falls on its side
            margins = self.code[:, b] * (rates @ w)
            self.trust[b] = max(0.05, margins.min())
        self.trust /= self.trust.sum()

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score, ambiguity and rejection of each row of n-gram counts."""
        total = np.maximum(counts.sum(1), 1)
        margin = counts @ self.weights * (np.minimum(total, EVIDENCE) / total)[:, None]
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.trust
        order = np.argsort(loss, axis=1, kind="stable")
        p = np.exp(loss.min(1, keepdims=True) - loss)
        best = order[:, 0]
        score = (p / p.sum(1, keepdims=True))[np.arange(len(p)), best]
        return best, score, score < AMBIGUOUS, loss.min(1) >= REJECT


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a letter, a character of Unicode's category L (digits, fractions and circled numbers are none)."""
    n = len(offs) - 1
    ascii_letter = ((data | 0x20) >= 97) & ((data | 0x20) <= 122)
    row = lambda mask: np.bincount(np.searchsorted(offs, np.flatnonzero(mask), side="right") - 1, minlength=n) > 0
    out = row(ascii_letter)
    for i in np.flatnonzero(~out & row(data >= 0x80)):
        out[i] = any(map(str.isalpha, data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def _each(texts):
    """Bounded pieces of a column of texts: first row, last row, n-gram counts, and whether there is a letter."""
    data, offs = text_bytes(texts)
    for lo, hi in steps(offs, STEP):
        for a in range(lo, hi, STEP_ROWS):
            b = min(hi, a + STEP_ROWS)
            d, o = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
            yield a, b, histogram(language_bytes(d), o, BUCKETS, SIZES), has_letter(d, o)


def train(rows: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from all rows with a language; rows with a null language or text teach nothing.

    The driver receives languages * BUCKETS counts, however many rows there are. Languages are
    taken in sorted order; repeated rows count each time; without any language the model knows none.
    """

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for a, b, counts, _ in _each(batch.column("text")):
                own = langs[a:b]
                for name in set(own):
                    held.setdefault(name, np.zeros(BUCKETS, np.int64))
                    held[name] += counts[own == name].sum(0).astype(np.int64)
        for name, c in held.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])

    ship(rows.sparkSession)
    known = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    table = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(table["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    counts[[languages.index(x) for x in table["lang"]], table["bucket"]] = table["n"]
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``row`` (a struct of ``keep``, by default the id), lang_pred, score, ambiguous, rejected.

    Null texts and texts without a letter (Unicode's category L) are ``und`` with score 0, as is every
    text when the model knows no language. Of languages with equal loss the first in sorted order is
    taken, and the text is ambiguous. Rejected are texts that are ``und``, and those that no codeword
    fits better than chance (with one language or none learned, only the former). Very long texts are counted whole, alone in their step. Rows keep
    their number and repeat if repeated; nulls elsewhere pass through; extra columns stay within ``row``.
    """
    ship(docs.sparkSession)
    keep = [id_col] if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *[F.col(f"`{text_col}`").alias("text")] * (text_col not in keep))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        m = sent.value
        for batch in batches:
            langs, scores, unsure, out = [], [], [], []
            row = batch.column("row")
            # a text among the kept columns is not sent twice
            texts = row.field(keep.index(text_col)) if text_col in keep else batch.column("text")
            for a, b, counts, letter in _each(texts):
                known = letter & bool(m.languages)
                if m.languages:
                    best, score, close, far = m.decode(counts)
                else:
                    best, score, close, far = np.zeros(b - a, int), np.zeros(b - a), np.zeros(b - a, bool), np.zeros(b - a, bool)
                langs += [m.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
                scores += np.where(known, score, 0.0).tolist()
                unsure += (close | ~known).tolist()
                out += ((far & (len(m.languages) > 1)) | ~known).tolist()
            yield pa.RecordBatch.from_arrays([row, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_()), pa.array(out, pa.bool_())], names=["row", "lang_pred", "score", "ambiguous", "rejected"])

    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType()), T.StructField("rejected", T.BooleanType())])
    return rows.mapInArrow(work, schema)


def fold(id_col: str, n: int):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 5) != 0))
    return predict(docs, model).select(
        F.col("row.doc_id").alias("doc_id"), (fold("row.doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous"
    )
