"""Text functions as column builders; all run inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: commands that count as validation hold one of these, in lower case.
VALIDATION_MARKERS = [" build", "build ", "npm run build", " vitest", " pytest", " unittest", " test", "pnpm test", "npm test"]
#: How a resumed session's first user text begins.
RESUME_MARKS = ["**Resume Session", "Resume Session (Current Folder)"]
_SPACE = r"(?U)\s+"


def sanitize(c: Column) -> Column:
    """Null becomes ''; line ends become LF; control characters but tab and LF go."""
    lines = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    return F.regexp_replace(lines, "[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f]", "")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """White-space runs become one space; the ends are stripped."""
    return F.trim(F.regexp_replace(c, _SPACE, " "))


def one_line(c: Column, limit: int, clean: bool = True) -> Column:
    """One line of at most ``limit`` characters, the last an ellipsis if it was cut."""
    line = collapse(sanitize(c) if clean else F.coalesce(c, F.lit("")))
    cut = F.concat(F.rtrim(F.substring(line, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(line) > limit, cut).otherwise(line)


def normalize(c: Column, cwd: str = "") -> Column:
    """Placeholders for the project, paths, code, addresses and numbers; lower case; one line."""
    out = sanitize(c)
    if cwd:
        out = F.replace(out, F.lit(cwd), F.lit(" <PROJECT> "))
    for pattern, mark in ((r"(?U)/home/\w+(?:/[\w.@-]+)+", "PATH"), ("`[^`]+`", "CODE"), (r"(?U)https?://\S+", "URL"), (r"(?U)\d+", "NUM")):
        out = F.regexp_replace(out, pattern, f" <{mark}> ")
    return collapse(F.lower(out))


def normalize_command(c: Column, cwd: str = "") -> Column:
    out = sanitize(c)
    if cwd:
        out = F.replace(out, F.lit(cwd), F.lit("<PROJECT>"))
    return collapse(F.regexp_replace(out, r"/tmp/pi-hypa-backup-\d{8}-\d{6}", "/tmp/pi-hypa-backup-<TIMESTAMP>"))


def display_path(c: Column, cwd: str, home: str) -> Column:
    """A path as it is shown: below the project's folder or the home folder by their marks."""
    path, cwd = sanitize(c), cwd.rstrip("/")
    inside = F.concat(F.lit("<PROJECT>/"), F.substring(path, F.lit(len(cwd) + 2), F.length(path)))
    below = F.concat(F.lit("~/"), F.substring(path, F.lit(len(home) + 2), F.length(path)))
    return F.when(F.startswith(path, F.lit(f"{cwd}/")), inside).when(path == home, "~").when(F.startswith(path, F.lit(f"{home}/")), below).otherwise(path)


def is_resume_artifact(c: Column) -> Column:
    text = strip(F.coalesce(c, F.lit("")))
    return reduce(lambda a, b: a | b, (F.startswith(text, F.lit(m)) for m in RESUME_MARKS))


def is_validation_command(c: Column) -> Column:
    low = F.lower(c)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in VALIDATION_MARKERS))


def estimate_tokens(n: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(n / 4).cast("long")


def text_lines(c: Column) -> Column:
    return F.split(c, "\\n|\\u2028|\\u2029")


def first_line(c: Column) -> Column:
    """The first line that is not blank, stripped; null without one."""
    lines = F.transform(text_lines(sanitize(c)), strip)
    return F.get(F.filter(lines, lambda x: x != ""), F.lit(0))


def collapse_runs(a: Column) -> Column:
    """An array without elements that repeat the one before."""
    return F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1)))


def unique_head(a: Column, k: int) -> Column:
    return F.slice(F.array_distinct(a), 1, k)


def ordered_unique(a: Column) -> Column:
    return F.array_distinct(F.filter(a, lambda x: x.isNotNull() & (x != "")))


def bullets(a: Column) -> Column:
    lines = F.array_join(F.transform(a, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(a) > 0, lines).otherwise("- none")


def any_of(c: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(c, F.lit(t)) for t in terms), F.lit(False))


def turn_ref(session: Column, turn: Column) -> Column:
    return F.concat(session.cast("string"), F.lit("#turn"), turn.cast("string"))


def parse_turn_ref(ref: Column) -> tuple[Column, Column]:
    """Session and turn of "session#turnN"; nulls where the text has another form."""
    pattern = r"^(.+)#turn(\d+)$"
    ok = ref.rlike(pattern)
    return F.when(ok, F.regexp_extract(ref, pattern, 1)), F.when(ok, F.regexp_extract(ref, pattern, 2).cast("int"))


def project_id(c: Column, default: str = "project") -> Column:
    dashed = F.regexp_replace(F.replace(c, F.lit("/"), F.lit("-")), r"[^A-Za-z0-9._-]", "_")
    out = F.regexp_replace(F.regexp_replace(dashed, "-+", "-"), "^[-_.]+|[-_.]+$", "")
    return F.when(out == "", default).otherwise(out)


def stable_session_id(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")


def relevance(n_referenced: Column, n_changed: Column, n_commands: Column, chars: Column) -> Column:
    return F.when(n_changed > 0, "high").when((n_referenced > 0) | (n_commands > 0), "medium").when(chars < 2000, "low").otherwise("unknown")


def json_object(c: Column) -> Column:
    """From the first brace to the last, without a code fence; '' if there is none."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def trace(c: Column, tools: str) -> Column:
    """Ordered distinct arguments of the trace lines of the given tools."""
    return ordered_unique(F.regexp_extract_all(c, F.lit(rf'(?m)^\*\s+(?:{tools})\s+"([^"]+)"'), F.lit(1)))
