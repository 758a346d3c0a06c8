"""Fill-in-the-middle rearrangement of documents.

A Split pre-tokenizer of the tokenizers library, whose regex matches are isolated, cuts each text
into tokens and gives their code-point offsets; nothing is trained. The number of offsets is n, a
hash of the document's id draws two ranks, and the offsets at these ranks cut the text into
prefix, middle and suffix. No token crosses from another character into following white space, so
texts are cut there first, and each distinct piece of a batch is tokenized once.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import cut, distinct, spread
from .common import SPACE, read, ship, steps, text_bytes

#: Tokens, and the marks of prefix, suffix and middle.
PATTERN = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Short pieces whose lengths a worker keeps; when there are so many, it begins anew.
KNOWN, SHORT = 1 << 18, 64
#: Characters of a piece that the tokenizer is given at once; it ends after a character that is no letter.
PART = 1 << 16


class Splitter:
    """Code-point lengths of the tokens of texts, by an isolated Split."""

    def __init__(self):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(PATTERN), behavior="isolated")
        self.known: dict[bytes, list[int]] = {}

    def lengths(self, text: str) -> list[int]:
        out, lo, n = [], 0, len(text)
        while lo < n:
            hi = min(lo + PART, n)
            while hi < n and text[hi - 1].isascii() and text[hi - 1].isalpha():
                hi += 1
            out += [b - a for _, (a, b) in self.split.pre_tokenize_str(text[lo:hi])]
            lo = hi
        return out

    def piece(self, raw: bytes) -> list[int]:
        got = self.known.get(raw)
        if got is None:
            got = self.lengths(raw.decode())
            if len(raw) <= SHORT:
                if len(self.known) >= KNOWN:
                    self.known.clear()
                self.known[raw] = got
        return got

    def offsets(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the tokens of each text end, in its code points, one text after another; and how many each has."""
        n = len(offs) - 1
        starts, ends, row = cut(data, offs, SPACE)
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        first, kind = distinct(data, starts, ends)
        raw = data.tobytes()
        got = [self.piece(raw[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        sizes, per = spread(np.fromiter(chain.from_iterable(got), np.int64), np.fromiter(map(len, got), np.int64, len(got)), kind)
        count = np.bincount(row, weights=per, minlength=n).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = np.concatenate([[0], np.cumsum(count)])
        return total[1:] - np.repeat(total[at[:-1]], count), count


def _ranks(draw: str, n: int) -> tuple[int, int, int, int]:
    h1, h2, h3, h4 = (int(draw[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = h1 % (n + 1), h2 % (n + 1)
    return min(a, b), max(a, b), h3 % 100, h4 % 100


def rearrange(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salt: str = "1", moved: int = 90, suffix_first: int = 20) -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars and the ``output`` text.

    ``moved`` of 100 documents are rearranged, ``suffix_first`` of 100 of these with the suffix in
    front (spm, else psm); the draws come from the sha256 of ``salt``, a colon and the id. Null counts as
    empty; empty texts and those that hold a mark stay plain, and their lengths of parts are null. A null id
    draws as '' and passes through; rows that repeat an id draw alike; a very long text is a step of its own,
    tokenized in parts; no rows give none; extra columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.sha2(F.concat(F.lit(f"{salt}:"), name), 256).alias("draw"))

    def work(batches):
        splitter = Splitter()
        for batch in batches:
            data, offs = text_bytes(batch.column("text"))
            for lo, hi in steps(offs):
                d, o = data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
                ends, count = splitter.offsets(d, o)
                at = np.concatenate([[0], np.cumsum(count)])
                forms, prefixes, middles, outputs = [], [], [], []
                for i, draw in enumerate(batch.column("draw").slice(lo, hi - lo).to_pylist()):
                    text = d[o[i] : o[i + 1]].tobytes().decode()
                    a, b, third, fourth = _ranks(draw, int(count[i]))
                    if not text or third >= moved or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
                        form, p, m, out = "plain", None, None, text
                    else:
                        e = ends[at[i] : at[i + 1]]
                        p, q = (int(e[x - 1]) if x else 0 for x in (a, b))
                        form, m = "spm" if fourth < suffix_first else "psm", q - p
                        head, tail = PREFIX + text[:p], SUFFIX + text[q:]
                        out = (tail + head if form == "spm" else head + tail) + MIDDLE + text[p:q]
                    forms.append(form)
                    prefixes.append(p)
                    middles.append(m)
                    outputs.append(out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(count), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, pa.string())],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    long, string = T.LongType(), T.StringType()
    fields = [("n", long), ("form", string), ("prefix_chars", long), ("middle_chars", long), ("output", string)]
    return rows.mapInArrow(work, T.StructType([rows.schema["doc_id"], *[T.StructField(c, t) for c, t in fields]]))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of: a rearranged one holds each mark once, as no part does."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        one = F.split(F.substr(output, F.lit(len(first) + 1)), second, 2)
        two = F.split(F.get(one, F.lit(1)), MIDDLE, 2)
        return F.get(one, F.lit(0)), F.get(two, F.lit(0)), F.get(two, F.lit(1))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_, prefix_, middle_ = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rearrange(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents
), r AS (
  SELECT doc_id, text, t, CAST(len(t) AS BIGINT) AS n,
         CAST('0x' || h[1:8] AS BIGINT) % (len(t) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(t) + 1) AS b,
         CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM d
), f AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(t[1:least(a, b)], '') AS p, array_to_string(t[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(t[greatest(a, b) + 1:], '') AS s FROM r
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM f
"""
