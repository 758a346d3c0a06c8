"""Personal data by weak supervision (DataFrame functions only).

Base spans (email, ip, card, phone) are the patterns of the contract. Beyond them, wide
candidate patterns propose spans; three labelers - regex shape, gazetteer, context words -
vote on each candidate (1 for, -1 against, 0 abstain). Expectation-maximisation over the
counts of vote patterns (at most kinds * 3**labelers rows, whatever the corpus) estimates each
labeler's reliability for each kind; its posteriors are the soft labels on which a logistic span
classifier over a fixed set of indicator features is trained. Candidates that it accepts and that
meet no base span are added; no rule stands beside the classifier. The gazetteers are a parameter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored, work_dir
from .native_spans import joined, let, none, ordered, overlaps, spans

# A run that fails at its start fails at every later start as well, so that matches begin only at a run's start or where
# the last match ended; possessive quantifiers change no match here and keep Java's matcher iterative and linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "written_email", "national_phone", "national_id", "person"]

#: Wide patterns of candidates.
CANDIDATES = {
    "written_email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z0-9-]++)++",
    "national_phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "person": r"(?<![A-Za-z])(?:(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Don|Sra?)\.?\x20[A-Z][a-z]++|[A-Z][a-z]++\x20[A-Z][a-z]++)(?:\x20[A-Z][a-z]++){0,2}+",
}
#: What a text must hold for any candidate of the kind.
NEEDED = {"written_email": r"[\[(](?:at|AT)[\])]", "national_phone": "[0-9]{4}", "national_id": "-[0-9]{2}-", "person": r"[A-Z][a-z]+\.?\x20[A-Z][a-z]"}
TITLE = r"^(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Don|Sra?)\b"


@dataclass(frozen=True)
class Gazetteers:
    """Lists that the gazetteer labeler looks words up in; any public list can be passed instead of these (lower case).

    Fixed values: common given names of five languages, endings of domains, telephone area codes that are not given
    out, identity numbers known from advertising.
    """

    names: tuple[str, ...] = tuple(
        "james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen "
        "christopher lisa daniel nancy matthew betty anthony margaret mark sandra donald ashley steven kimberly paul emily andrew donna joshua michelle "
        "kenneth carol kevin amanda brian dorothy george melissa edward deborah peter anna maria laura julia alice hans karl heinz klaus juergen wolfgang "
        "petra sabine monika ursula renate helga ingrid sophie lena jonas lukas felix jean pierre michel andre philippe marie nathalie isabelle sylvie "
        "catherine camille louis jose antonio manuel francisco carmen isabel dolores pilar luis carlos juan pedro miguel giuseppe giovanni francesco "
        "luca marco paolo giulia chiara francesca sara alessandro".split()
    )
    domains: tuple[str, ...] = tuple("com org net edu gov mil int info biz io ai co app dev de fr es it uk eu us ca au nl be ch at se no dk fi pl pt ie jp cn in br mx ru".split())
    dead_areas: tuple[str, ...] = tuple("000 111 222 333 444 555 666 777 888 999".split())
    printed_ids: tuple[str, ...] = ("123-45-6789", "078-05-1120", "219-09-9999")


#: Words before a span that speak for its kind.
CONTEXT = {
    "written_email": r"(?i)(?:e-?mail|mail|contact|write|reach)[^\n]{0,20}$",
    "national_phone": r"(?i)(?:phone|tel|call|mobile|fax|number)[^\n]{0,20}$",
    "national_id": r"(?i)(?:ssn|social security|tax id|id number)[^\n]{0,20}$",
    "person": r"(?i)\b(?:dear|name|signed|by|from|contact|regards|sincerely|mr|mrs|told|met|with)\b[^\n]{0,12}$",
}
LABELERS = ["regex", "gazetteer", "context"]
CONTEXT_CHARS = 40
EM_ROUNDS, FIT_ROUNDS = 60, 600
#: Share of candidates that are taken for true before any vote: candidate patterns are wide.
PRIOR = 0.3


def luhn(match: Column) -> Column:
    """Whether the digits of a match are 12 to 19 and pass the Luhn test."""
    digits = F.regexp_replace(match, "[^0-9]", "")

    def test(d: Column) -> Column:
        def value(i: Column) -> Column:
            x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
            twice = F.when(x >= 5, x * 2 - 9).otherwise(x * 2)
            return F.when(i % 2 == 1, twice).otherwise(x)

        n = F.length(d)
        fits = (n >= 12) & (n <= 19)
        return F.when(fits, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0).otherwise(False)

    return let(digits, test)


def _octets(match: Column) -> Column:
    return match.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")


def _digits_between(match: Column, low: int, high: int) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", "")).between(low, high)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _votes(kind: str, match: Column, before: Column, lists: Gazetteers) -> dict[str, Column]:
    never = F.lit(False)
    listed = lambda c, held: F.lower(c).isin(*held) if held else never
    if kind == "written_email":
        shape = _vote(match.rlike(r"[\[(](?:dot|DOT)[\])]"), match.rlike(r"^[0-9]"))
        ending = listed(F.regexp_extract(match, "[A-Za-z0-9-]+$", 0), lists.domains)
        known = _vote(ending, ~ending)
    elif kind == "national_phone":
        shape = _vote(match.rlike(r"^\(?[2-9]") & match.rlike(r"^\([0-9]{3}\)|^([0-9]{3})([.-])[2-9][0-9]{2}\2"), match.rlike(r"^\(?[01]") | match.rlike(r"^[0-9]{3}[\x20.-]0"))
        dead = listed(F.regexp_extract(match, "[0-9]{3}", 0), lists.dead_areas)
        known = _vote(~dead, dead)
    elif kind == "national_id":
        # never given out: 000, 666, 900 and above; group 00; serial 0000
        wrong = match.rlike(r"^(?:000|666|9)|-00-|-0000$")
        shape = _vote(~wrong, wrong)
        known = _vote(never, listed(match, lists.printed_ids))
    else:
        shape = _vote(match.rlike(TITLE), before.rlike(r"(?:^|[.!?:]\s?|\n)$"))
        some = F.exists(F.split(F.lower(match), r"[\x20.]+"), lambda w: listed(w, lists.names))
        known = _vote(some, ~some)
    return {"regex": shape, "gazetteer": known, "context": _vote(before.rlike(CONTEXT[kind]), before.rlike(r"(?i)(?:version|build|page|isbn|order|part|serial|item|model|invoice)[^\n]{0,8}$"))}


def _features(match: Column, before: Column) -> dict[str, Column]:
    """Indicators, so that the classifier sees a bounded number of distinct rows."""
    size, digits = F.length(match), F.length(F.regexp_replace(match, "[^0-9]", ""))
    return {
        "long": size > 16,
        "digits": digits * 2 > size,
        "parens": match.rlike(r"[(\[]"),
        "dash": match.rlike("-"),
        "upper": match.rlike("[A-Z].*[A-Z]"),
        "after_colon": before.rlike(r"[:=]\x20?$"),
        "line_start": before.rlike(r"(?:^|\n)$"),
    }


FEATURES = ["long", "digits", "parens", "dash", "upper", "after_colon", "line_start"]


def _candidates(text: Column, lists: Gazetteers) -> Column:
    """All candidates with votes (array of tinyint-like ints) and features (bit mask)."""
    out = []
    for kind, pattern in CANDIDATES.items():
        found = F.when(text.rlike(NEEDED[kind]), spans(text, kind, pattern)).otherwise(none())

        def describe(s: Column) -> Column:  # called before the loop goes on
            before = F.substring(text, F.greatest(s["start"] - CONTEXT_CHARS + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT_CHARS)))
            return let(
                F.struct(s.alias("s"), before.alias("before")),
                lambda v: F.struct(
                    *[v["s"][f].alias(f) for f in ("kind", "start", "end", "match")],
                    *[x.alias(n) for n, x in _votes(kind, v["s"]["match"], v["before"], lists).items()],
                    *[x.cast("int").alias(n) for n, x in _features(v["s"]["match"], v["before"]).items()],
                ),
            )

        out.append(F.transform(found, describe))
    return F.concat(*out)


def em(patterns: dict[tuple, int], rounds: int = EM_ROUNDS, prior: float = PRIOR) -> tuple[dict, dict]:
    """Dawid-Skene with two classes per kind: (kind, votes...) -> count gives the posterior of
    each pattern and, per kind and labeler, (P(right | vote, true), P(right | vote, false)).

    ``prior`` is the share of true candidates to start from. Each kind is estimated alone.
    """
    post: dict[tuple, float] = {}
    found: dict[str, dict] = {}
    for kind in sorted({k[0] for k in patterns}):
        own = {k: c for k, c in patterns.items() if k[0] == kind}
        n = len(next(iter(own))) - 1
        hit, share = [(0.75, 0.75)] * n, prior
        for _ in range(rounds):
            for k in own:
                a, b = math.log(share), math.log(1 - share)
                for v, (t, f) in zip(k[1:], hit, strict=True):
                    if v:
                        a += math.log(t if v > 0 else 1 - t)
                        b += math.log(1 - f if v > 0 else f)
                post[k] = 1 / (1 + math.exp(min(700, b - a)))
            weight = 2 / prior  # as much as two true candidates
            share = (sum(c * post[k] for k, c in own.items()) + weight * prior) / (sum(own.values()) + weight)
            new = []
            for i in range(n):
                t, f = [3.0, 4.0], [3.0, 4.0]
                for k, c in own.items():
                    if v := k[i + 1]:
                        t[0] += c * post[k] * (v > 0)
                        t[1] += c * post[k]
                        f[0] += c * (1 - post[k]) * (v < 0)
                        f[1] += c * (1 - post[k])
                new.append((min(0.99, t[0] / t[1]), min(0.99, f[0] / f[1])))
            hit = new
        found[kind] = dict(zip(LABELERS, hit, strict=False))
    return post, found


def fit(rows: list[tuple[list[float], float, float]], rounds: int = FIT_ROUNDS, l2: float = 1.0) -> list[float]:
    """Logistic regression by gradient steps on (features, soft label, weight); the last weight is the bias."""
    if not rows:
        return []
    width, total = len(rows[0][0]) + 1, sum(w for *_, w in rows)
    beta = [0.0] * width
    step = 1 / (width / 4 + l2 / max(total, 1))  # no larger than the curvature allows
    for _ in range(rounds):
        g = [l2 * b / max(total, 1) for b in beta]
        for x, y, w in rows:
            z = beta[-1] + sum(a * b for a, b in zip(beta, x, strict=False))
            d = (1 / (1 + math.exp(-max(-30, min(30, z)))) - y) * w / total
            for i, a in enumerate(x):
                g[i] += d * a
            g[-1] += d
        beta = [b - step * d for b, d in zip(beta, g, strict=True)]
    return beta


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, gazetteers: Gazetteers = Gazetteers()) -> DataFrame:
    """One row per input row: doc_id, the base spans by kind and ``added``, accepted candidates.

    Spans are (kind, start, end, match) in code points, end exclusive. Null and empty texts have
    none; repeated rows are each searched and each counted by the estimation; without candidates
    nothing is estimated or added. Very long texts are searched whole, by patterns that take time in
    proportion. Spans that begin alike are ordered by kind. Null ids pass through. Extra columns are
    ignored, whatever their names.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digit = text.rlike("[0-9]")
    found = rows.select(
        "doc_id",
        F.when(F.contains(text, F.lit("@")), spans(text, "email", EMAIL)).otherwise(none()).alias("email"),
        F.when(digit, spans(text, "ip", IP, _octets)).otherwise(none()).alias("ip"),
        F.when(digit, spans(text, "card", CARD, luhn)).otherwise(none()).alias("card"),
        F.when(F.contains(text, F.lit("+")), spans(text, "phone", PHONE, lambda m: _digits_between(m, 9, 15))).otherwise(none()).alias("phone"),
        _candidates(text, gazetteers).alias("candidates"),
    )
    base = F.concat(*BASE)
    found = found.withColumn("candidates", let(base, lambda b: F.filter("candidates", lambda s: ~overlaps(s, b))))
    table = stored(found, f"{work_dir(docs.sparkSession)}/spans")
    keys = ["kind", *LABELERS, *FEATURES]
    # at most 4 kinds * 3**3 votes * 2**7 features rows, however large the corpus
    counts = table.select(F.explode("candidates").alias("c")).groupBy(*[F.col(f"c.{k}").alias(k) for k in keys]).count().collect()
    votes: dict[tuple, int] = {}
    for r in counts:
        key = (r["kind"], *[r[v] for v in LABELERS])
        votes[key] = votes.get(key, 0) + r["count"]
    post, _ = em(votes)
    beta: dict[str, list[float]] = {}
    for kind in sorted({r["kind"] for r in counts}):
        own = sorted((r for r in counts if r["kind"] == kind), key=lambda r: tuple(map(str, r)))
        beta[kind] = fit([([float(r[v]) for v in [*LABELERS, *FEATURES]], post[(kind, *[r[v] for v in LABELERS])], float(r["count"])) for r in own])

    def accepted(s: Column) -> Column:
        out = F.lit(False)
        for kind, weights in beta.items():
            z = F.lit(weights[-1])
            for name, w in zip([*LABELERS, *FEATURES], weights, strict=False):
                z = z + s[name] * F.lit(w)
            out = F.when(s["kind"] == kind, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) >= least).otherwise(out)
        return out

    plain = lambda s: F.struct(*[s[f].alias(f) for f in ("kind", "start", "end", "match")])
    return table.withColumn("added", F.transform(F.filter("candidates", accepted), plain)).drop("candidates")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents"))
    base = ordered([F.col(k) for k in BASE], KINDS)
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(ordered([*[F.col(k) for k in BASE], F.col("added")], KINDS)).alias("spans"),
    )
