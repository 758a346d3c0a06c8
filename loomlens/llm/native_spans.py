"""Positions of regular-expression matches by Spark's built-in functions alone.

Spark's regexp functions return strings, not positions. The text is split at the matches, and
a match starts after all pieces and matches before it. The running sums are taken over blocks
of about the square root of the number of matches, so that a text with very many matches does
not cost the square of their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,match:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once and binds it within ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _starts(gaps: Column, sizes: Column) -> Column:
    """Start of each match: gaps are the lengths of the pieces, sizes those of the matches."""

    def body(v: Column) -> Column:
        step, gap, b = v["step"], v["gap"], v["b"]
        blocks = F.sequence(F.lit(0), F.ceil(F.size(step) / b).cast("int") - 1)
        sums = F.transform(blocks, lambda i: total(F.slice(step, i * b + 1, b)))
        return let(
            sums,
            lambda s: F.flatten(
                F.transform(
                    blocks,
                    lambda i: let(
                        F.struct(total(F.slice(s, F.lit(1), i)).alias("base"), F.slice(step, i * b + 1, b).alias("own"), F.slice(gap, i * b + 1, b).alias("gap")),
                        lambda w: F.transform(w["own"], lambda _, j: w["base"] + total(F.slice(w["own"], F.lit(1), j)) + F.get(w["gap"], j)),
                    ),
                )
            ),
        )

    return let(F.struct(gaps.alias("gap"), sizes.alias("size")), lambda p: let(
        F.struct(F.zip_with(F.slice(p["gap"], F.lit(1), F.size(p["size"])), p["size"], lambda g, m: g + m).alias("step"), p["gap"].alias("gap"), F.ceil(F.sqrt(F.size(p["size"]))).cast("int").alias("b")), body))


def spans(text: Column, kind: str, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """The leftmost non-overlapping matches of ``pattern`` that pass ``keep``, as an array of
    (kind, start, end, match); positions count code points, the end is exclusive."""

    def found(t: Column) -> Column:
        return let(
            F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m"), F.split(t, pattern, -1).alias("p")),
            lambda v: F.transform(
                F.arrays_zip(_starts(F.transform(v["p"], F.length), F.transform(v["m"], F.length)).alias("s"), v["m"].alias("m")),
                lambda z: F.struct(F.lit(kind).alias("kind"), z["s"].alias("start"), (z["s"] + F.length(z["m"])).alias("end"), z["m"].alias("match")),
            ),
        )

    out = F.when(text.rlike(pattern), found(text)).otherwise(none())
    return F.filter(out, lambda s: keep(s["match"])) if keep else out


def ordered(arrays: list[Column], kinds: list[str]) -> Column:
    """All spans by start, then by kind as listed."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(F.concat(*arrays), lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def joined(keyed: Column) -> Column:
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def overlaps(a: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < a["end"]) & (a["start"] < o["end"]))
