"""The review packet: bounded selections of workflow and correction results, joined on the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import one_line

#: Assets suggested by repeated event types: candidate, kind of asset, reason, further evidence.
ASSETS = {
    "late_constraint": (
        "pre_execution_constraint_checklist", "checklist or prompt preamble", "late_constraint events repeat, suggesting important constraints often arrive after execution starts.",
        "blindspot-v2 profiles suggest asking about execution order, search budget, and boundaries earlier.",
    ),
    "verbosity_mismatch": ("response_style_preamble", "prompt snippet", "verbosity mismatch repeats often enough to justify a reusable answer-style template.", None),
    "direction_mismatch": ("scope_alignment_template", "request template or checklist", "direction mismatch recurs, indicating the need for an explicit object/scope/goal alignment step.", None),
}
COMMAND_LOOP = ("command_loop_sop", "SOP or skill", "workflow already shows repeated command loops that may be worth standardizing.")
READ_EDIT = ("read_then_edit_micro_workflow", "micro-SOP", "the route sees a repeated read->edit micro pattern that may be reusable as a code-editing habit.")


def compact_counter(counts: DataFrame, name: str, k: int = 8) -> DataFrame:
    """The k largest counts, ties by name (a top-k report)."""
    return counts.orderBy(F.desc("n"), name).limit(k)


def asset_suggestions(event_counts: DataFrame, patterns: DataFrame) -> DataFrame:
    """candidate, possible_asset, why, evidence (an array): assets that repeated events or patterns call for."""
    text = lambda x: F.lit(x).cast("string")
    about = F.create_map(*[x for k, (a, b, c, d) in ASSETS.items() for x in (F.lit(k), F.struct(text(a).alias("candidate"), text(b).alias("possible_asset"), text(c).alias("why"), text(d).alias("more")))])
    counted = F.concat(F.col("event_type"), F.lit(" x"), F.col("n").cast("string"))
    from_events = event_counts.where(F.col("event_type").isin(*ASSETS) & (F.col("n") >= 2)).select(about[F.col("event_type")].alias("a"), counted.alias("own"))
    from_events = from_events.select("a.candidate", "a.possible_asset", "a.why", F.array_compact(F.array("own", "a.more")).alias("evidence"))
    fixed = lambda x: [F.lit(v).alias(n) for v, n in zip(x, ("candidate", "possible_asset", "why"), strict=True)]
    commands = patterns.where("type = 'repeated_command'").orderBy(F.desc("n"), "first", "name").limit(3)
    command = commands.agg(F.count(F.lit(1)).alias("c"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "first", "name"))), lambda x: x["name"]).alias("names")).where("c > 0")
    loop = command.select(*fixed(COMMAND_LOOP), F.transform("names", lambda c: one_line(c, 120)).alias("evidence"))
    pair = patterns.where("type = 'repeated_tool_sequence' AND name = 'read>edit'").select(*fixed(READ_EDIT), F.array(F.concat(F.lit("read->edit x"), F.col("n").cast("string"))).alias("evidence"))
    return from_events.unionByName(loop).unionByName(pair)


def pattern_summaries(patterns: DataFrame) -> DataFrame:
    """Patterns cut to what a packet shows: four references, commands on one line."""
    name = F.when(F.col("type") == "repeated_command", one_line(F.col("name"), 160)).otherwise(F.col("name"))
    return patterns.select("type", "confidence", name.alias("name"), "n", F.slice("evidence", 1, 4).alias("evidence"))


def compact_turns(turn_rows: DataFrame) -> DataFrame:
    """Turns cut to what a packet shows: eight steps, three paths of each use, two commands."""
    paths = lambda c: F.transform(F.slice(c, 1, 3), lambda x: one_line(x, 140)).alias(c)
    return turn_rows.select("session", "turn", F.slice("sequence", 1, 8).alias("sequence"), paths("read_paths"), paths("edit_paths"), paths("write_paths"), F.transform(F.slice("commands", 1, 2), lambda x: one_line(x, 160)).alias("commands"))


def event_summaries(events: DataFrame) -> DataFrame:
    """Events without the fields that a packet leaves out."""
    return events.select(
        "session_file", "trigger_turn", "event_type", "secondary_types", "original_user_preview", "assistant_preview", "evidence", "missing_constraint", "impact",
        F.coalesce("avoidable", F.lit(False)).alias("avoidable"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "suggestion",
    )


def packet(parts: dict[str, DataFrame]) -> dict:
    """The named bounded tables as one JSON-ready document; callers pass top-k reports only."""
    return {name: [json.loads(r) for r in df.toJSON().collect()] for name, df in parts.items()}


#: The files that a reader of the packet writes, and the rules for it.
OUTPUTS = [
    {"file": "action_report.md", "purpose": "short user-facing action report focused on the few most valuable changes to make now"},
    {"file": "memory_candidates.json", "purpose": "conservative candidate memory pool with evidence and confidence"},
    {"file": "distill_shortlist.md", "purpose": "shortlist of reusable collaboration assets worth keeping, skipping, or gathering more evidence for"},
]
OUTPUT_RULES = [
    "use only evidence present in the review packet", "prefer repeated and higher-confidence signals over one-off details", "keep outputs short, specific, and reusable", "do not browse raw route outputs unless explicitly asked",
]
INPUTS = ["review_packet.json", "review_packet.md"]
#: What is shown of each list of a packet.
MOST = {"patterns": 8, "turns": 8, "events": 10, "bullets": 10, "list": 8}


def _counted(rows: list[dict], shape: str = "- `{name}` × {count}") -> list[str]:
    return [shape.format(**r) for r in rows]


def _under(row: dict, fields: dict[str, str]) -> list[str]:
    """Lines below a bullet: label and value of each field that has one."""
    return [f"  - {label}: {row[f]}" for f, label in fields.items() if row.get(f) not in (None, "")]


def _pattern(p: dict) -> list[str]:
    seen = p.get("observations") or {}
    out = [f"- {' / '.join(x for x in (p.get('type', 'pattern'), p.get('confidence')) if x)}"]
    out += [f"  - {f}: `{p[f]}`" for f in ("path", "command") if p.get(f)]
    out += [f"  - sequence: `{' -> '.join(p['sequence'])}`"] if p.get("sequence") else []
    out += _under(p, {"count": "count"}) + _under(seen, {"interactions": "interactions"})
    if "read_count" in seen or "edit_count" in seen:
        out.append(f"  - read/edit: {seen.get('read_count') or 0}/{seen.get('edit_count') or 0}")
    return out + [f"  - evidence: {e}" for e in p.get("evidence", [])[:3]]


def _turn(t: dict) -> list[str]:
    out = [f"- `{t['session_file']}#turn{t['turn_index']}` {t['user_preview']}"]
    out += [f"  - tools: {' -> '.join(t['tool_sequence'])}"] if t["tool_sequence"] else []
    out += [f"  - edit_paths: {', '.join(t['edit_paths'])}"] if t["edit_paths"] else []
    return out + [f"  - command: `{c}`" for c in t["commands"]]


def _event(e: dict) -> list[str]:
    head = f"- `{e['session_file']}#turn{e['trigger_turn']}` `{e['event_type']}` ({e['confidence']})"
    return [head, *_under(e, {"original_user_preview": "original", "assistant_preview": "assistant", "evidence": "evidence", "missing_constraint": "missing_constraint", "impact": "impact", "suggestion": "suggestion"})]


def markdown(document: dict) -> str:
    """The packet as sections of bullets."""
    w, c = document["workflow"], document["corrections"]
    each = lambda rows, shape: [line for r in rows for line in shape(r)]
    summary = w["project_summary"]
    scope = {"Project": f"`{document['project']['cwd']}`", "Source root": f"`{document['project']['source_root']}`", "Workflow sessions": summary.get("session_count", 0), "Workflow user turns": summary.get("total_user_turns", 0),
             "Workflow tool calls": summary.get("total_tool_calls", 0), "Correction events": c.get("event_count", 0)}
    stable = lambda p: [f"- `{p['pattern']}` × {p['count']} ({p['confidence']})", *_under(p, {"user_suggestion": "user_suggestion"}), *[f"  - evidence: {e}" for e in p.get("evidence_examples", [])[:2]]]
    trait = lambda p: [f"- `{p['name']}` ({p['confidence']})", *([f"  - support: {', '.join(p['support'][:4])}"] if p.get("support") else []), *_under(p, {"user_suggestion": "user_suggestion"})]
    asset = lambda a: [f"- `{a['candidate']}`", f"  - why: {a['why']}", f"  - possible_asset: {a['possible_asset']}", *[f"  - evidence: {e}" for e in a["evidence"][:3]]]
    named = lambda counts, k=None: _counted([{"name": n, "count": x} for n, x in list(counts.items())[:k]])
    sections = [
        ("## Scope", [f"- {k}: {v}" for k, v in scope.items()]), ("## Workflow distilled signals", None), ("### Top tools", _counted(w["top_tools"])), ("### Hot paths", _counted(w["top_hot_paths"])),
        ("### Repeated commands", _counted(w["top_commands"][: MOST["bullets"]], "- ×{count} `{name}`")), ("### Candidate workflow patterns", each(w["candidate_patterns"], _pattern)),
        ("### Representative workflow turns", each(w["representative_turns"], _turn)), ("## Correction signals", None), ("### Event types", named(c.get("event_types", {}))),
        ("### Top missing constraints", named(c.get("top_missing_constraints", {}), MOST["bullets"])), ("### Stable patterns", each(c.get("stable_patterns", []), stable)), ("### Profiles", each(c.get("profiles", []), trait)),
        ("### Representative events", each(c.get("representative_events", []), _event)), ("## Suggested asset candidates", each(document["suggested_asset_candidates"], asset)),
        ("## Final output contract", [f"- `{o['file']}` — {o['purpose']}" for o in document["final_output_contract"]["final_outputs"]]), ("## Rules for final synthesis", [f"- {r}" for r in document["final_output_contract"]["global_rules"]]),
    ]
    out = ["# Review packet", "", "All that the final synthesis reads is in this file.", ""]
    for heading, lines in sections:
        out += [heading, ""] + ([*lines, ""] if lines else [])
    return "\n".join(out).rstrip() + "\n"


def write_json(value, path: str) -> None:
    """UTF-8 JSON, indented, characters as they are."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
        f.write("\n")
