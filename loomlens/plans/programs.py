"""One call per program: what a run reads, and the result files that it leaves.

Results of unbounded length are streamed into their files partition by partition; what a report or a
packet shows is bounded by its top lists. Steps that several files need are checkpointed once.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import CATEGORY_LABELS, SESSION_LOGS, PatternSet
from ..functions.storage import checkpointed
from ..functions.text import display_path, one_line
from ..operators import blindspot, chunking, corrections, packet, phrases, reports, runners, workflow
from ..sources import files, sessions
from .config import Config


@dataclass(frozen=True)
class Project:
    """Whose logs are read: the folder that they are about, where they lie, and the home folder that paths are shortened by."""

    cwd: str
    session_dir: str
    home: str = str(Path.home())


def _shown(c, project: Project):
    return display_path(F.col(c) if isinstance(c, str) else c, project.cwd.rstrip("/"), project.home)


def _turn_rows(log: DataFrame, calls: DataFrame) -> DataFrame:
    """Every user turn of a log with its preview and what it did, as turns.json lists them."""
    asked = log.where("entry.type = 'message' AND entry.message.role = 'user'")
    place = F.row_number().over(sessions.Window.partitionBy("session_file").orderBy("line_no"))
    preview = one_line(sessions.text_of(F.coalesce("entry.message.content", F.array().cast(sessions._CONTENT))), 180)
    turns = asked.select("session_file", place.alias("turn_index"), preview.alias("user_preview"))
    did = workflow.turns(calls).select(F.col("session").alias("session_file"), F.col("turn").alias("turn_index"), F.col("sequence").alias("tool_sequence"), "read_paths", "edit_paths", "write_paths", "commands")
    ids = sessions.session_summaries(log).select(F.col("file").alias("session_file"), "session_id")
    out = turns.join(did, ["session_file", "turn_index"], "left").join(ids, "session_file")
    lists = ["tool_sequence", "read_paths", "edit_paths", "write_paths", "commands"]
    return out.select("session_file", "session_id", "turn_index", "user_preview", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in lists])


def candidate_shape(r: dict) -> dict:
    """A row of ``workflow.candidates`` as candidate_patterns.json has it."""
    out = {"type": r["type"], "confidence": r["confidence"]}
    if r["type"] == "hot_file_workflow":
        o = r["observed"]
        out |= {"path": r["name"], "observations": {"interactions": r["n"], "read_count": o["read_count"], "edit_count": o["edit_count"], "read_then_edit_turns": o["read_edit"], "edit_then_validate_turns": o["edit_validate"], "tools": o["tools"]}}
    elif r["type"] == "repeated_tool_sequence":
        out |= {"sequence": r["name"].split(">"), "count": r["n"]}
    else:
        out |= {"command": r["name"], "count": r["n"]}
    return out | {"evidence": r["evidence"]}


def run_workflow(log: DataFrame, project: Project, folder: str | Path, parts: DataFrame | None = None, now: dt.datetime | None = None) -> Path:
    """Workflow mining over a log: project summary, sessions, turns, counters, candidates and the report.

    ``parts`` are stored partials of the same sessions, where a route keeps them; without them they are made here.
    """
    calls = checkpointed(sessions.tool_calls_from_entries(log, project.cwd))
    parts = checkpointed(workflow.partials(calls) if parts is None else parts)
    summaries = checkpointed(sessions.session_summaries(log, project.cwd))
    final = checkpointed(workflow.finals(parts))
    top = workflow.top_counters(final).orderBy("kind", "place")
    total = summaries.agg(F.count(F.lit(1)).alias("session_count"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("message_count", "total_messages"), ("user_turns", "total_user_turns"), ("tool_calls", "total_tool_calls"))]).first()
    about = {"cwd": project.cwd, "session_dir": project.session_dir, **total.asDict()}
    # tools and models are few; of the other names twenty are kept
    tools = final.where("kind = 'tool'").orderBy(F.desc("n"), "first").collect()
    models = sessions.models(log).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("session_file", "line_no")).alias("first")).orderBy(F.desc("n"), "first").collect()
    held = {k: [r for r in top.collect() if r["kind"] == k] for k in ("path", "command", "sequence")}
    shown = {r["name"]: r["shown"] for r in top.where("kind = 'path'").select("name", _shown("name", project).alias("shown")).collect()}
    counters = {
        "tools": {r["name"]: r["n"] for r in tools}, "models": {r["model"]: r["n"] for r in models}, "paths": {shown[r["name"]]: r["n"] for r in held["path"]}, "commands": {r["name"]: r["n"] for r in held["command"]},
        "sequences": {r["name"].replace(">", " -> "): r["n"] for r in held["sequence"]},
    }
    found = workflow.candidates_of(parts)
    found = checkpointed(found.withColumn("name", F.when(F.col("type") == "hot_file_workflow", _shown("name", project)).otherwise(F.col("name"))))
    of = lambda kind, name: top.where(F.col("kind") == kind).select(F.col("name").alias(name), "n", "place")
    report = reports.workflow_report(about, summaries, of("tool", "tool"), of("path", "path").withColumn("path", _shown("path", project)), of("command", "command"), found, now)
    listed = summaries.withColumn("tools", F.map_from_entries("tools")).orderBy("file")
    parts_ = {"project": about, "sessions": listed, "turns": _turn_rows(log, calls).orderBy("session_file", "turn_index"), "counters": counters, "candidates": workflow.in_order(found), "report": report}
    reports.write_results(parts_, reports.WORKFLOW_FILES, folder, {"candidates": candidate_shape})
    return Path(folder)


def _sorted_counts(rows: DataFrame, column: str) -> dict[str, int]:
    """Counts by frequency, ties by name: few names, but for missing constraints, whose file lists them all."""
    return {r[column]: r["n"] for r in corrections.value_counts(rows, column).orderBy(F.desc("n"), column).collect()}


def run_corrections(messages: DataFrame, project: Project, folder: str | Path, patterns: PatternSet = SESSION_LOGS, now: dt.datetime | None = None) -> Path:
    """Correction events over messages: the events in order, their profile and the report."""
    events = checkpointed(corrections.events(messages, patterns))
    kinds = corrections.value_counts(events, "event_type")
    traits = corrections.user_profiles(events)
    stable = corrections.profile(events).join(kinds, "event_type").orderBy(F.desc("n"), "event_type").collect()  # at most one row per type
    profile = {
        "event_count": events.count(), "event_types": _sorted_counts(events, "event_type"), "top_missing_constraints": _sorted_counts(events, "missing_constraint"), "impact_counts": _sorted_counts(events, "impact"),
        "stable_patterns": [{"pattern": r["event_type"], "count": r["n_events"], "sessions": r["n_sessions"], "confidence": r["confidence"], "evidence_examples": r["refs"], "user_suggestion": r["suggestion"]} for r in stable],
        "profiles": [r.asDict() for r in traits.orderBy("name").collect()],  # at most one row per profile
    }
    n_sessions = messages.select("session_file").distinct().count()
    report = reports.correction_report(project.cwd, n_sessions, profile["event_count"], kinds, corrections.value_counts(events, "missing_constraint"), corrections.representative(events), traits, CATEGORY_LABELS, now)
    reports.write_results({"events": events.orderBy(*corrections.EVENT_ORDER), "profile": profile, "report": report}, reports.CORRECTION_FILES, folder)
    return Path(folder)


def _examples(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """Clusters whose examples are turns with their previews."""
    each = rows.select("*", F.posexplode("examples").alias("place", "turn")).join(turns, "turn")
    held = each.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "session_file", "turn_index", "preview"))), lambda x: F.struct(x["session_file"].alias("session_file"), x["turn_index"].alias("turn_index"), x["preview"].alias("preview"))).alias("examples"))
    return rows.drop("examples").join(held, "cluster")


def run_blindspot(messages: DataFrame, project: Project, folder: str | Path, patterns: PatternSet = SESSION_LOGS, now: dt.datetime | None = None) -> Path:
    """Phrases, clusters, rules, chains and the profile over user turns: nine files."""
    turns = checkpointed(blindspot.user_turns(messages, project.cwd).withColumn("turn", F.concat_ws("#", "session_file", F.col("turn_index").cast("string"))))
    labelled = checkpointed(blindspot.with_labels(turns, patterns))
    said = checkpointed(phrases.frequent_phrases(phrases.gram_counts(turns, ["session_file", "turn_index"])))
    nodes, members = phrases.folded(turns.select("turn", "normalized"), "turn")
    nodes = checkpointed(nodes)
    weights = phrases.tfidf_vectors(nodes, "turn", copies="copies")
    near = checkpointed(phrases.similar_clusters(nodes, members, phrases.similar_links(weights, "turn"), weights, "turn"))
    whole = checkpointed(phrases.tfidf(turns.select("turn", "normalized"), ["turn"]))
    topics = checkpointed(phrases.kmeans(whole, "turn"))
    preview = turns.select("turn", "session_file", "turn_index", "preview")
    kmeans = checkpointed(_examples(phrases.cluster_report(whole, topics, "turn"), preview))
    dbscan = checkpointed(_examples(phrases.cluster_report(weights, near, "turn", of=members), preview))
    hits = checkpointed(blindspot.rule_hits(labelled))
    rules, chains, profile = checkpointed(blindspot.rule_summary(hits)), checkpointed(blindspot.chains(labelled, patterns)), checkpointed(blindspot.profile(labelled, patterns))
    lines = lambda rows: rows.withColumn("examples", F.transform("examples", lambda e: e["preview"]))
    parts = {
        "turns": turns.select("session_file", "turn_index", "text", "preview", "normalized").orderBy("session_file", "turn_index"), "phrases": said.orderBy("place"), "kmeans": kmeans.orderBy(F.desc("size"), "cluster"),
        "dbscan": dbscan.orderBy(F.desc("size"), "cluster"), "rules": rules.orderBy(F.desc("n"), "label"), "chains": chains.orderBy("session_file"), "profile": profile.orderBy("trait"),
        "comparison": reports.comparison(said, topics, near, rules, chains, now),
        "report": reports.blindspot_report(project.cwd, turns.count(), said, lines(kmeans), lines(dbscan), rules, chains, profile, now),
    }
    reports.write_results(parts, reports.BLINDSPOT_FILES, folder)
    return Path(folder)


def run_distill(
    spark: SparkSession, compiled: str, config: Config, folder: str | Path, run_id: str, runner: runners.Runner = runners.stand_in, manifest: str | None = None, project: str = "project", policy: chunking.Policy = chunking.Policy()
) -> dict:
    """Compiled sessions to chunks, reports, a judged bundle and the final documents; what the run's manifest.json says.

    Reports that hold from an earlier run below ``folder`` are reused. With ``config.only_chunk`` or ``analysis_only`` there is no
    synthesis. Documents are published whether they passed or need a review; without a finished report the run raises.
    """
    home = Path(folder)
    records = files.session_records(spark, compiled, manifest).withColumn("project", F.lit(project))
    chunks = checkpointed(chunking.chunks_of(records, policy))
    asked = chunks.select(F.concat_ws("/", "project", "chunk_id").alias("chunk_id"), "content_hash", F.col("content").alias("text"))
    if config.only_chunk:
        asked = asked.where(F.col("chunk_id") == f"{project}/{config.only_chunk}")
    chunking.write_chunk_files(chunks, str(home / "runs" / run_id / "chunks"))
    said = checkpointed(runners.map_chunks_once(asked, runners.report_store(spark, str(home / "reports")), run_id, runner, name=config.runner, prompt_version=config.prompt_version, model=config.model, thinking=config.thinking))
    named = said.select(F.substring_index("chunk_id", "/", -1).alias("chunk_id"), "status", "report")
    path = F.concat(F.lit(f"runs/{run_id}/reports/"), "chunk_id", F.lit(".md"))
    reported = checkpointed(chunks.join(named, "chunk_id", "left").withColumn("status", F.coalesce("status", F.lit("skipped"))).withColumn("report_path", path))
    out = {"run_id": run_id, "project": project, "stats": chunking.run_stats(reported, config.only_chunk).first().asDict(), "sessions": records.count()}
    target = home / "runs" / run_id
    (target / "reports").mkdir(parents=True, exist_ok=True)
    for r in reported.where("status <> 'skipped'").select("chunk_id", "report").toLocalIterator():
        (target / "reports" / f"{r['chunk_id']}.md").write_text(r["report"], encoding="utf-8")
    if config.only_chunk or config.analysis_only:
        out |= {"status": "analysed", "skip_reason": config.skip_reason}
    else:
        packets = chunking.synthesis_input(reported)
        if packets.isEmpty():
            raise ValueError("no finished chunk report to synthesise from")
        results, tries = runners.synthesise_projects(packets, runner, config.validation_threshold, config.max_validation_retries)
        (r,) = results.collect()
        if r["status"] == "failed":
            raise RuntimeError(r["error"])
        heads = chunking.synthesis_heads(chunking.first_uses(reported)).where("rank IS NOT NULL").orderBy("kind", "rank").collect()  # at most 28 rows
        out |= {
            "status": r["status"], "score": r["score"], "attempts": [t.asDict() for t in tries.select("attempt", "status", "score").orderBy("attempt").collect()],
            **{k: [h["value"] for h in heads if h["kind"] == k] for k in ("changed", "referenced", "commands")},
        }
        (target / "bundle.md").write_text(r["bundle"], encoding="utf-8")
        reports.publish_documents(r["documents"], target, home / "final")
    packet.write_json(out, str(target / "manifest.json"))
    return out


def _top(counts: dict[str, int], k: int = packet.MOST["list"]) -> list[dict]:
    return [{"name": n, "count": c} for n, c in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]]


def _summary(p: dict) -> dict:
    """A pattern as a packet has it: four references, a command on one line."""
    out = {k: v for k, v in p.items() if k in ("type", "confidence", "path", "sequence", "count", "observations")}
    if "command" in p:
        flat = " ".join(p["command"].split())
        out["command"] = flat if len(flat) <= 160 else flat[:159].rstrip() + "…"
    return out | {"evidence": p["evidence"][:4]}


def review_packet(project: Project, workflow_folder: str | Path, corrections_folder: str | Path, turns: DataFrame, calls: DataFrame, events: DataFrame) -> dict:
    """The packet of two runs: their bounded results joined, as JSON-ready data.

    The files of both runs must be there; representative turns come from ``turns`` (as turns.json) by the ranks of
    ``calls``, representative events from ``events``, ten and eight of them at most.
    """
    w, c = Path(workflow_folder), Path(corrections_folder)
    read = lambda home, name: files.load_json(files.required(home / name))
    summary, counters, patterns, profile = read(w, "project_summary.json"), read(w, "counters.json"), read(w, "candidate_patterns.json"), read(c, "profile.json")
    for home in (w, c):
        files.required(home / "report.md")
    chosen = workflow.representative_turns(calls).withColumn("order", F.monotonically_increasing_id()).collect()  # a top-k report
    place = {(r["session"], r["turn"]): i for i, r in enumerate(chosen)}
    named = events.sparkSession.createDataFrame(list(place), "session_file string, turn_index int")
    lists = {"read_paths": 3, "edit_paths": 3, "write_paths": 3}
    compact = turns.join(F.broadcast(named), ["session_file", "turn_index"]).select(
        "session_file", "turn_index", "user_preview", F.slice("tool_sequence", 1, 8).alias("tool_sequence"), *[F.transform(F.slice(p, 1, k), lambda x: one_line(x, 140)).alias(p) for p, k in lists.items()], F.transform(F.slice("commands", 1, 2), lambda x: one_line(x, 160)).alias("commands")
    )
    shown = sorted((r.asDict() for r in compact.collect()), key=lambda t: place[t["session_file"], t["turn_index"]])
    by_type = corrections.value_counts(events, "event_type")
    assets = packet.asset_suggestions(by_type, workflow.candidates(calls)).collect()
    order = [a[0] for a in packet.ASSETS.values()] + [packet.COMMAND_LOOP[0], packet.READ_EDIT[0]]
    return {
        "project": {"cwd": project.cwd, "source_root": project.session_dir},
        "sources": {"workflow_dir": str(w), "corrections_dir": str(c), "files_read": [str(w / f) for f in reports.WORKFLOW_FILES.values() if f != "sessions.json"] + [str(c / f) for f in reports.CORRECTION_FILES.values()]},
        "workflow": {
            "project_summary": summary, "top_tools": _top(counters["tools"]), "top_hot_paths": _top(counters["paths"]), "top_commands": _top(counters["commands"]), "top_sequences": _top(counters["sequences"]),
            "candidate_patterns": [_summary(p) for p in patterns[: packet.MOST["patterns"]]], "representative_turns": shown[: packet.MOST["turns"]], "report_excerpt": files.excerpt((w / "report.md").read_text(encoding="utf-8")),
        },
        "corrections": {
            **{k: profile[k] for k in ("event_count", "event_types", "top_missing_constraints", "impact_counts")}, "stable_patterns": profile["stable_patterns"][: packet.MOST["list"]], "profiles": profile["profiles"][: packet.MOST["list"]],
            "representative_events": [r.asDict() for r in packet.event_summaries(corrections.representative(events, packet.MOST["events"])).collect()], "report_excerpt": files.excerpt((c / "report.md").read_text(encoding="utf-8")),
        },
        "suggested_asset_candidates": sorted((r.asDict() for r in assets), key=lambda a: order.index(a["candidate"])),
        "final_output_contract": {"final_prompt_inputs": packet.INPUTS, "final_outputs": packet.OUTPUTS, "global_rules": packet.OUTPUT_RULES},
    }


def run_review(log: DataFrame, messages: DataFrame, project: Project, inputs: str | Path, folder: str | Path, patterns: PatternSet = SESSION_LOGS) -> Path:
    """The review packet of a project's two runs below ``inputs``, as JSON and as Markdown."""
    calls = checkpointed(sessions.tool_calls_from_entries(log, project.cwd))
    document = review_packet(project, Path(inputs) / "workflow", Path(inputs) / "corrections", _turn_rows(log, calls), calls, checkpointed(corrections.events(messages, patterns)))
    home = Path(folder)
    home.mkdir(parents=True, exist_ok=True)
    packet.write_json(document, str(home / packet.INPUTS[0]))
    (home / packet.INPUTS[1]).write_text(packet.markdown(document), encoding="utf-8")
    return home
