"""Markdown reports and named result files of a run.

A report is a title, the time, and sections; a section is a heading and a stream of lines. Lists
that a report shows whole are read partition by partition, top lists are bounded by their limits, so
that the driver never holds a table.
"""

from __future__ import annotations

import datetime as dt
import json
import shutil
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The files of each kind of result, in the order in which they are written.
WORKFLOW_FILES = {"project": "project_summary.json", "sessions": "sessions.json", "turns": "turns.json", "counters": "counters.json", "candidates": "candidate_patterns.json", "report": "report.md"}
BLINDSPOT_FILES = {
    "turns": "user_turns.json", "phrases": "method_phrases.json", "kmeans": "method_kmeans_clusters.json", "dbscan": "method_dbscan_clusters.json", "rules": "method_blindspot_rules.json",
    "chains": "method_correction_chains.json", "profile": "blindspot_profile.json", "comparison": "comparison.md", "report": "blindspot_report.md",
}
CORRECTION_FILES = {"events": "events.json", "profile": "profile.json", "report": "report.md"}
#: What the workflow report covers, and what may be done with it.
ABOUT = [
    "- sessions: when, with which models, how they began, how many tools they used", "- turns: what was asked, then the tools, files and commands in order", "- files that are read and edited again and again",
    "- commands that come back, and checks after edits", "- patterns that may be worth a skill or a prompt",
]
NEXT = ["- `candidate_patterns.json` is the list to choose from.", "- Of `turns.json` the turns that a candidate names are enough to read.", "- What is sure and frequent goes first; automation can wait."]
#: What each method of the comparison shows.
METHODS = ["1. phrases: wording that comes back", "2. k-means: broad topics", "3. density clusters: requests that read alike", "4. rules: labels with a suggestion each", "5. chains: constraints that came after the first prompt"]
BEST_FOR = ["- phrases: habits of wording", "- k-means: the main topics", "- density clusters: the same correction said again", "- rules: advice that can be followed at once", "- chains: what should have been said at first"]


def judgment(n_clusters: int, n_labels: int, n_chains: int) -> list[str]:
    """What the numbers of a run bear out."""
    out = [f"- Clusters group turns and explain none: {n_clusters} of them need a reader or a rule."]
    out.append(f"- {n_labels} labels hold, and {n_chains} sessions show constraints that came late." if n_labels and n_chains else "- Rules and chains say too little here to advise anything.")
    return out


NO_COMMANDS, NO_CANDIDATES, NO_EVENTS, NOTHING = "- No repeated commands detected above threshold.", "No candidate patterns found.", "- 无事件", "- 无"


def page(title: str, sections: Iterable[tuple[str, Iterable[str]]], now: dt.datetime | None = None) -> Iterator[str]:
    """The lines of a report; each section ends with one blank line."""
    yield from (f"# {title}", "", f"Generated: {(now or dt.datetime.now(dt.UTC)):%Y-%m-%d %H:%M:%SZ}", "")
    for heading, lines in sections:
        yield from (f"## {heading}", "")
        last = None
        for last in lines:
            yield last
        if last != "":
            yield ""


def write_lines(lines: Iterable[str], path: str | Path) -> None:
    """The lines with one line feed each; blank lines at the end go."""
    held = 0
    with open(path, "w", encoding="utf-8") as f:
        for line in lines:
            if line.strip():
                f.write("\n" * held + line.rstrip() + "\n")
                held = 0
            else:
                held += 1


def write_rows(rows: DataFrame, path: str | Path, shape: Callable[[dict], dict] = dict) -> None:
    """A table as one JSON array, a partition in memory at a time; ``shape`` says how a row reads."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, r in enumerate(rows.toLocalIterator()):
            f.write(",\n" if i else "\n")
            f.write(json.dumps(shape(r.asDict(recursive=True)), ensure_ascii=False, default=str))
        f.write("\n]\n")


def write_results(parts: dict, files: dict[str, str], folder: str | Path, shapes: dict[str, Callable[[dict], dict]] | None = None) -> None:
    """Each named part under its file name: tables as JSON arrays (their rows by ``shapes``), documents as JSON, reports as lines."""
    home = Path(folder)
    home.mkdir(parents=True, exist_ok=True)
    for name, file in files.items():
        if name not in parts:
            continue
        value, path = parts[name], home / file
        if isinstance(value, DataFrame):
            write_rows(value, path, (shapes or {}).get(name, dict))
        elif file.endswith(".md"):
            write_lines(value, path)
        else:
            path.write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def copy_public(source: str | Path, target: str | Path, files: Iterable[str]) -> list[str]:
    """The named files that are there, copied into the public folder; their names."""
    Path(target).mkdir(parents=True, exist_ok=True)
    there = [f for f in files if (Path(source) / f).exists()]
    for f in there:
        shutil.copy2(Path(source) / f, Path(target) / f)
    return there


def publish_documents(documents: dict[str, str], run: str | Path, final: str | Path) -> None:
    """The final documents, in the run's folder and in the public one."""
    Path(run).mkdir(parents=True, exist_ok=True)
    for name, text in documents.items():
        (Path(run) / name).write_text(text, encoding="utf-8")
    copy_public(run, final, documents)


def _some(lines: Iterable[str], none: str) -> Iterator[str]:
    it = iter(lines)
    first = next(it, None)
    return iter([none]) if first is None else chain([first], it)


def _times(counts: DataFrame, name: str, k: int) -> Iterator[str]:
    """The k most frequent; ties by their ``place`` if there is one, else by name."""
    tie = "place" if "place" in counts.columns else name
    return (f"- `{r[name]}` × {r['n']}" for r in counts.orderBy(F.desc("n"), tie).limit(k).collect())


#: Lines of a candidate by its type: label, and the field that it shows.
PATTERN_LINES = {
    "hot_file_workflow": [
        ("Path: `{}`", "name"), ("Interactions: {}", "n"), ("Read count: {}", "read_count"), ("Edit count: {}", "edit_count"), ("Read→edit turns: {}", "read_edit"), ("Edit→validate turns: {}", "edit_validate"), ("Tools: {}", "tools")
    ],
    "repeated_tool_sequence": [("Sequence: `{}`", "name"), ("Count: {}", "n")],
    "repeated_command": [("Command: `{}`", "name"), ("Count: {}", "n")],
}


def pattern_lines(row: dict) -> Iterator[str]:
    """What a report says of one candidate, as from ``workflow.candidates``; what was not observed is left out."""
    held = {**row, **(row.get("observed") or {})}
    if row["type"] == "repeated_tool_sequence":
        held["name"] = row["name"].replace(">", " -> ")
    held["tools"] = None if held.get("tools") is None else ", ".join(held["tools"])
    yield from ("- " + label.format(held[f]) for label, f in PATTERN_LINES[row["type"]] if held.get(f) is not None)
    if row["evidence"]:
        yield f"- Evidence: {', '.join(row['evidence'])}"


def workflow_report(project: dict, sessions: DataFrame, tools: DataFrame, paths: DataFrame, commands: DataFrame, candidates: DataFrame, now: dt.datetime | None = None) -> Iterator[str]:
    """The report of workflow mining. ``sessions`` is as from ``session_summaries`` and shown whole; of tools, paths and commands (name, n,
    and their place among equals) ten are shown, of candidates (as from ``workflow.candidates``) twelve."""
    labels = {"cwd": "Project cwd", "session_dir": "Session dir", "session_count": "Sessions", "total_user_turns": "User turns", "total_messages": "Messages", "total_tool_calls": "Tool calls"}
    scope = [f"- {label}: `{project[k]}`" if k in ("cwd", "session_dir") else f"- {label}: {project[k]}" for k, label in labels.items() if k in project]

    def listed():
        for r in sessions.orderBy("file").toLocalIterator():
            yield f"- `{r['file']}` — {r['user_turns']} turns, {r['tool_calls']} tool calls"
            if r["first_user_preview"]:
                yield f"  - First prompt: {r['first_user_preview']}"

    def patterns():
        weight = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
        kind = F.array_position(F.array(*[F.lit(t) for t in PATTERN_LINES]), F.col("type"))
        first = [c for c in ("first", "name") if c in candidates.columns]
        for i, r in enumerate(candidates.orderBy(weight.desc(), F.desc("n"), kind, *first).limit(12).collect(), 1):
            yield from (f"### {i}. {r['type']} [{r['confidence']}]", "", *pattern_lines(r.asDict(recursive=True)), "")

    tie = "place" if "place" in commands.columns else "command"
    again = (f"- ×{r['n']} `{r['command']}`" for r in commands.where("n >= 2").orderBy(F.desc("n"), tie).limit(10).collect())
    return page(
        "Workflow report",
        [
            ("Scope", scope), ("What this run can extract", ABOUT), ("Sessions", listed()), ("Top tools", _times(tools, "tool", 10)), ("Hot files", _times(paths, "path", 10)),
            ("Repeated commands", _some(again, NO_COMMANDS)), ("Candidate patterns", _some(patterns(), NO_CANDIDATES)), ("Suggested next packaging", NEXT),
        ],
        now,
    )


def correction_report(project: str, n_sessions: int, n_events: int, types: DataFrame, reasons: DataFrame, representative: DataFrame, profiles: DataFrame, labels: dict[str, str], now: dt.datetime | None = None) -> Iterator[str]:
    """The report of correction events: types, the eight commonest missing constraints, representative events and user profiles."""
    fields = {"original_user_preview": "原始请求", "assistant_preview": "被纠偏 assistant", "evidence": "evidence", "missing_constraint": "missing_constraint", "impact": "impact", "suggestion": "suggestion", "confidence": "confidence", "assistant_tool_calls": "assistant_tool_calls", "avoidable": "avoidable"}

    def each():
        for i, r in enumerate(representative.collect(), 1):  # a top-k report
            yield f"### {i}. {r['event_type']} ({r['session_file']}#turn{r['trigger_turn']})"
            yield from (f"- {label}：{r[f]}" for f, label in fields.items())
            if r["secondary_types"]:
                yield f"- secondary_types：{', '.join(r['secondary_types'])}"
            yield ""

    kinds = (f"- `{r['event_type']}` × {r['n']} — {labels.get(r['event_type'], r['event_type'])}" for r in types.orderBy(F.desc("n"), "event_type").collect())  # at most one row per type
    traits = (f"- `{r['name']}` ({r['confidence']}) — {r['user_suggestion']}" for r in profiles.orderBy("name").collect())  # at most one row per profile
    return page(
        "Correction report",
        [
            ("范围", [f"- Project: `{project}`", f"- Sessions: {n_sessions}", f"- Events: {n_events}"]), ("事件类型统计", _some(kinds, NO_EVENTS)),
            ("Top 返工原因", _some(_times(reasons, "missing_constraint", 8), NOTHING)), ("代表性事件", _some(each(), NO_EVENTS)), ("用户画像", _some(traits, NOTHING)),
        ],
        now,
    )


def blindspot_report(project: str, n_turns: int, phrases: DataFrame, kmeans: DataFrame, dbscan: DataFrame, rules: DataFrame, chains: DataFrame, profile: DataFrame, now: dt.datetime | None = None) -> Iterator[str]:
    """The report of the phrase and rule methods: twenty phrases, six clusters of each kind with their examples, rule labels, eight chains, traits."""

    def clusters(rows: DataFrame, terms: bool, k: int):
        for r in rows.orderBy(F.desc("size"), "cluster").limit(6).collect():
            yield f"### Cluster {r['cluster']} ({r['size']})"
            if terms:
                yield f"- Top terms: {', '.join(r['top_terms'] or [])}"
            yield from (f"- `{e}`" for e in r["examples"][:k])
            yield ""

    def labels():
        for r in rules.orderBy(F.desc("n"), "label").collect():  # at most one row per rule
            yield f"### {r['label']} ({r['n']})"
            yield f"- Meaning: {r['description']}"
            yield from (f"- `{e}`" for e in r["examples"][:4])
            yield ""

    def corrected():
        for r in chains.orderBy(F.size("later_constraints").desc(), "session_file").limit(8).collect():
            yield f"### {r['session_file']}"
            yield f"- First prompt: {r['first_prompt']}"
            if r["correction_turns"]:
                yield f"- Correction turns: {list(r['correction_turns'])}"
            yield from (f"- {x}" for x in r["later_constraints"][:5])
            yield ""

    said = (f"- `{r['phrase']}` × {r['n']}" for r in phrases.orderBy("place").limit(20).collect())
    traits = (f"- `{r['trait']}` ({r['evidence_count']})" for r in profile.orderBy("trait").collect())  # at most one row per trait
    return page(
        "Phrase and rule report",
        [
            ("Scope", [f"- Project: `{project}`", f"- User turns analyzed: {n_turns}"]), ("Frequent phrases", said), ("KMeans topic clusters", clusters(kmeans, True, 3)),
            ("DBSCAN near-duplicate families", clusters(dbscan, False, 4)), ("Blindspot labels", labels()), ("Session correction chains", corrected()), ("Blindspot profile", traits),
        ],
        now,
    )


def comparison(phrases: DataFrame, kmeans: DataFrame, dbscan: DataFrame, rules: DataFrame, chains: DataFrame, now: dt.datetime | None = None) -> Iterator[str]:
    """What each method found, in numbers. ``kmeans`` and ``dbscan`` are members with their cluster (null: noise)."""
    said = ", ".join(r["phrase"] for r in phrases.orderBy("place").limit(12).collect())
    groups = lambda rows: rows.agg(F.countDistinct("cluster")).first()[0]
    found, labels, corrected = groups(kmeans) + groups(dbscan), rules.count(), chains.count()
    quick = [
        f"- 高频短语最能看到：{said}", f"- KMeans 主题簇数：{groups(kmeans)}", f"- DBSCAN 近似簇数：{groups(dbscan)}，噪声点：{dbscan.where('cluster IS NULL').count()}",
        f"- 规则命中的盲区标签数：{labels}", f"- 发现需要后置纠偏的 session 数：{corrected}",
    ]
    return page("Comparison of methods", [("Methods", METHODS), ("Quick read", quick), ("Which method is best for what", BEST_FOR), ("Judgment", judgment(found, labels, corrected))], now)
