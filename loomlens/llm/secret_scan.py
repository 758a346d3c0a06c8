"""Secret scanning (DataFrame functions only): fixed patterns and sliding-window entropy.

Base spans are the three patterns of the contract. The method adds ``entropy`` spans: candidate
strings whose Shannon entropy, taken over every window of fixed width with counts that are
updated by the character that enters and the one that leaves, reaches the limit of their
character class in some window, unless an allow-list pattern or a base span covers them.

Candidates have 16 characters or more; shorter windows than the fixed one need less entropy, in proportion to what they
can hold. A candidate is measured if it has digits and letters, or is of letters that change case as often as a random key
does, or is of 20 or more letters of one case. Digits alone are never keys here.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .native_spans import joined, let, ordered, overlaps, spans

ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
#: What stands before the value of an assignment.
_ASSIGN_HEAD = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
#: A failing match is dropped and not retried; shorter runs hold no longer match either, so the lengths stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}+"
KINDS = ["assign", "access", "hex", "entropy"]

#: Character classes of candidates, with the least entropy in bits of the best window.
CLASSES = {"hex": (r"^[0-9A-Fa-f]++$", 3.0), "letters": (r"^(?:[a-z]++|[A-Z]++)$", 3.7), "base36": (r"^(?:[0-9a-z]++|[0-9A-Z]++)$", 3.5), "base64": (r"^[A-Za-z0-9+/_=-]++$", 3.7)}
#: Candidates that are never secrets: UUIDs, paths and dashed or underscored words, placeholders, runs of an alphabet.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"^/?(?:[A-Za-z]++[/_-])++[A-Za-z]*+[0-9]{0,4}$",
    r"(?i)example|dummy|placeholder|sample|changeme|xxxx|lorem",
    r"(?i)0123456789|abcdefghijkl",
]
WINDOW = 20


def _plogp(c: Column, width: int) -> Column:
    """c * log2(c) from a small table: counts never exceed the window."""
    table = F.array(*[F.lit(float(i * math.log2(i)) if i else 0.0) for i in range(width + 2)])
    return F.get(table, c)


#: Counts of one window are packed into longs, _SLOTS codes of _BITS bits each.
_BITS, _SLOTS = 6, 10


def max_window_entropy(s: Column, width: int = WINDOW, enough: Column | None = None) -> Column:
    """The largest Shannon entropy (bits) of any window of ``width`` ASCII characters of ``s``.

    Characters are split once; a step takes one character in and one out, changes their two counts
    and the sum of c * log2(c) over the counts, and so costs the same wherever the window stands. Once
    a window reaches ``enough``, the rest is passed over. A string that is shorter than the window is
    one window; null and '' give 0. ``width`` is below 2**_BITS.
    """
    if not 0 < width < 1 << _BITS:
        raise ValueError(f"a window has 1 to {(1 << _BITS) - 1} characters")
    one = F.lit(1).cast("long")

    def walk(v: Column) -> Column:
        codes, w = v["codes"], F.least(F.size(v["codes"]), F.lit(width))

        def count(n: Column, code: Column) -> Column:
            place = (code % _SLOTS).cast("int") * _BITS
            return F.call_function("shiftright", F.get(n, F.floor(code / _SLOTS).cast("int")), place).bitwiseAND((1 << _BITS) - 1).cast("int")

        def changed(n: Column, code: Column, by: int) -> Column:
            place, which = (code % _SLOTS).cast("int") * _BITS, F.floor(code / _SLOTS).cast("int")
            bit = F.call_function("shiftleft", one, place)
            return F.transform(n, lambda c, j: F.when(j == which, c + by * bit).otherwise(c))

        def moved(a: Column, code: Column, by: int) -> Column:
            return let(count(a["n"], code), lambda c: F.struct(changed(a["n"], code, by).alias("n"), (a["sum"] - _plogp(c, width) + _plogp(c + by, width)).alias("sum"), a["best"].alias("best")))

        def step(acc: Column, i: Column) -> Column:
            less = F.when(i >= w, moved(acc, F.get(codes, i - w), -1)).otherwise(acc)
            more = let(less, lambda a: moved(a, F.get(codes, i), 1))
            size = w.cast("double")
            entropy = let(more, lambda a: F.struct(a["n"].alias("n"), a["sum"].alias("sum"), F.when(i >= w - 1, F.greatest(a["best"], F.log2(size) - a["sum"] / size)).otherwise(a["best"]).alias("best")))
            return entropy if enough is None else F.when(acc["best"] >= v["enough"], acc).otherwise(entropy)

        start = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-128 // _SLOTS)).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda a: a["best"])

    codes = F.transform(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c))
    held = F.struct(codes.alias("codes"), (F.lit(0.0) if enough is None else enough).alias("enough"))
    return F.when(F.length(s) > 0, let(held, walk)).otherwise(F.lit(0.0))


def secret_like(s: Column) -> Column:
    """Whether a candidate's best window reaches its class's limit and no allow-list pattern holds."""
    limit = F.lit(None).cast("double")
    for pattern, least in reversed(list(CLASSES.values())):
        limit = F.when(s.rlike(pattern), F.lit(least)).otherwise(limit)
    digit, n = s.rlike("[0-9]"), F.length(s)
    # names of several words change case less often than every fifth character
    turns = F.size(F.regexp_extract_all(s, F.lit("[a-z](?=[A-Z])"), F.lit(0)))
    mixed = F.when(digit, s.rlike("[A-Za-z]")).otherwise((turns * 5 >= n) | s.rlike("^(?:[a-z]{20,}+|[A-Z]{20,}+)$"))
    held = mixed & ~s.rlike("|".join(f"(?:{p})" for p in ALLOWED))
    least = F.when(n < WINDOW, limit * F.log2(n.cast("double")) / math.log2(WINDOW)).otherwise(limit)
    return F.when(held, let(least, lambda x: max_window_entropy(s, enough=x) >= x)).otherwise(F.lit(False))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and ``found``, an array of (kind, start, end, match).

    Null and empty texts have no spans; rows that repeat are each scanned; no rows give none.
    Null ids pass through. Extra columns are ignored, whatever their names. A very long text is scanned whole; a long
    candidate takes time in proportion to its length.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id",
        spans(text, "assign", ASSIGN, lambda m: F.length(F.regexp_replace(m, _ASSIGN_HEAD, "")) >= 12).alias("assign"),
        spans(text, "access", ACCESS).alias("access"),
        spans(text, "hex", HEX).alias("hex"),
        spans(text, "entropy", CANDIDATE, secret_like).alias("entropy"),
    )
    base = F.concat("assign", "access", "hex")
    return rows.withColumn("entropy", let(base, lambda b: F.filter("entropy", lambda s: ~overlaps(s, b))))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents"))
    base = ordered([F.col("assign"), F.col("access"), F.col("hex")], KINDS)
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(ordered([F.col(k) for k in KINDS], KINDS)).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
    )
