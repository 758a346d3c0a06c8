"""All session-analytics queries by name over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.patterns import INVENTED_WORDS, PRIORITY, matched
from ..functions.ordering import numbered
from ..functions.storage import checkpointed, checkpoints, stored
from ..functions.text import bullets, display_path, is_validation_command, normalize, normalize_command, one_line, parse_turn_ref, project_id, stable_session_id, unique_head
from ..operators import blindspot, chunking, corrections, incremental, packet, phrases, reminders, reports, runners, workflow
from ..sources import sessions
from . import routes
from .oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

#: Chunk sizes, block headers and traces for the table of documents.
POLICY = chunking.Policy(least=4_000, soft=8_000, hard=9_000)
DOC_HEADER = r"^(The|An|Of|De|Der) "
BY_PATH = {"reads": "The|Of", "changes": "An", "commands": "De"}


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _messages(spark, sf):
    return sessions.messages_from_conversations(_read(spark, sf, "conversations"))


def _events(spark, sf):
    return corrections.events(_messages(spark, sf))


def _calls(spark, sf):
    return sessions.tool_calls_from_events(_read(spark, sf, "events"))


def _turns(spark, sf):
    return blindspot.user_turns(_messages(spark, sf))


def _labelled(spark, sf):
    return blindspot.with_labels(_turns(spark, sf))


def _joined(c: str, sep: str = ",") -> F.Column:
    return F.array_join(c, sep).alias(c)


def session_meta(spark, sf):
    m = _messages(spark, sf)
    return m.groupBy("session_file").agg(F.count(F.lit(1)).alias("message_count"), F.count_if(F.col("role") == "user").alias("user_turn_count"), F.sum(F.col("tool_calls").cast("long")).alias("tool_call_count"), F.max("line_no").alias("last_line"))


def message_ordinals(spark, sf):
    return corrections.ordinals(_messages(spark, sf)).select("session_file", "line_no", "role", "role_turn", "tool_calls")


def user_turns(spark, sf):
    return _turns(spark, sf).select("session_file", "turn_index", "preview", F.length("text").alias("n_chars"))


def one_line_preview(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", one_line(F.col("text"), 180).alias("preview"), one_line(F.col("text"), 160).alias("short"))


def normalize_text(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.sha2(normalize(F.col("text")), 256).alias("normalized_sha256"), F.length(normalize(F.col("text"))).alias("n_chars"))


def category_match(spark, sf):
    rows = _messages(spark, sf).select("session_file", "line_no", F.array_join(matched(F.col("text"), INVENTED_WORDS.categories, PRIORITY), ",").alias("categories"))
    return rows.where("categories <> ''")


def correction_events(spark, sf):
    return _events(spark, sf).withColumn("secondary_types", F.array_join("secondary_types", ","))


def _value_counts(column):
    return lambda spark, sf: corrections.value_counts(_events(spark, sf), column)


def event_profile(spark, sf):
    return corrections.profile(_events(spark, sf)).withColumn("refs", F.array_join("refs", ","))


def event_type_order(spark, sf):
    """Event types by count, ties by name."""
    return corrections.ranked(corrections.value_counts(_events(spark, sf), "event_type"), "event_type")


def user_profiles(spark, sf):
    return corrections.user_profiles(_events(spark, sf)).withColumn("support", F.array_join("support", ","))


def representative_events(spark, sf):
    return corrections.representative(_events(spark, sf)).select("session_file", "trigger_turn", "event_type", "confidence", "assistant_tool_calls")


def rule_hits(spark, sf):
    return blindspot.rule_hits(_labelled(spark, sf))


def rule_summary(spark, sf):
    return blindspot.rule_summary(blindspot.rule_hits(_labelled(spark, sf))).withColumn("examples", F.array_join("examples", ","))


def correction_chains(spark, sf):
    return blindspot.chains(_labelled(spark, sf)).select("session_file", "first_prompt", F.array_join("later_constraints", "|").alias("later_constraints"), F.array_join(F.col("correction_turns").cast("array<string>"), ",").alias("correction_turns"))


def blindspot_profile(spark, sf):
    return blindspot.profile(_labelled(spark, sf))


def tool_turns(spark, sf):
    t = workflow.turns(_calls(spark, sf))
    return t.select("session", "turn", F.array_join("sequence", ">").alias("sequence"), *[_joined(c) for c in ("read_paths", "edit_paths", "write_paths", "commands")])


def _counts(key):
    return lambda spark, sf: workflow.counts(_calls(spark, sf), key)


def tool_path_counts(spark, sf):
    return _calls(spark, sf).where("path IS NOT NULL").groupBy("tool", "path").agg(F.count(F.lit(1)).alias("n"))


def top_sequences(spark, sf):
    return workflow.top(workflow.sequences(workflow.turns(_calls(spark, sf)))).select(F.array_join("sequence", ">").alias("sequence"), "n")


def read_edit_turns(spark, sf):
    return workflow.path_stats(_calls(spark, sf)).where("read_edit > 0").select("path", "read_edit")


def edit_validate_turns(spark, sf):
    return workflow.path_stats(_calls(spark, sf)).where("edit_validate > 0").select("path", "edit_validate")


def hot_files(spark, sf):
    return workflow.hot_files(_calls(spark, sf)).select("path", "interactions", "read_count", "edit_count", "read_edit", "edit_validate", _joined("tools"), "confidence", _joined("evidence"))


def repeated_sequences(spark, sf):
    return workflow.repeated_sequences(workflow.turns(_calls(spark, sf))).select(F.array_join("sequence", ">").alias("sequence"), "n", "confidence", _joined("evidence"))


def repeated_commands(spark, sf):
    return workflow.repeated_commands(_calls(spark, sf)).select("command", "n", "confidence", _joined("evidence"))


def candidate_patterns(spark, sf):
    return workflow.candidates(_calls(spark, sf)).select("type", "name", "n", "confidence", _joined("evidence"))


def representative_turns(spark, sf):
    return workflow.representative_turns(_calls(spark, sf)).select("source", "session", "turn", "score")


def compact_counters(spark, sf):
    return packet.compact_counter(workflow.counts(_calls(spark, sf), "command"), "command")


def asset_suggestions(spark, sf):
    found = packet.asset_suggestions(corrections.value_counts(_events(spark, sf), "event_type"), workflow.candidates(_calls(spark, sf)))
    return found.withColumn("evidence", F.array_join("evidence", "; "))


def compact_turns(spark, sf):
    t = packet.compact_turns(workflow.turns(_calls(spark, sf)))
    return t.select("session", "turn", F.array_join("sequence", ">").alias("sequence"), *[_joined(c) for c in ("read_paths", "edit_paths", "write_paths", "commands")])


def pattern_summaries(spark, sf):
    return packet.pattern_summaries(workflow.candidates(_calls(spark, sf))).withColumn("evidence", F.array_join("evidence", ","))


def event_summaries(spark, sf):
    return packet.event_summaries(_events(spark, sf)).withColumn("secondary_types", F.array_join("secondary_types", ","))


def validation_commands(spark, sf):
    return _calls(spark, sf).where("command IS NOT NULL").groupBy("command").agg(F.count(F.lit(1)).alias("n")).withColumn("validates", is_validation_command(F.col("command")))


def _index(spark, sf):
    """The current index, and an earlier one in which some sessions were absent, other or since deleted."""
    now = _messages(spark, sf).groupBy("session_file").agg(F.concat_ws(":", F.sum(F.length("text")).cast("string"), F.max("line_no").cast("string")).alias("fingerprint"))
    n = F.col("session_file").cast("long")
    gone = now.where(n % 11 == 0).select(F.concat(F.lit("old-"), F.col("session_file")).alias("session_file"), "fingerprint")
    before = now.where(n % 7 != 0).select("session_file", F.when(n % 5 == 0, F.concat(F.lit("was-"), F.col("fingerprint"))).otherwise(F.col("fingerprint")).alias("fingerprint"))
    return before.unionByName(gone), now


def index_diff(spark, sf):
    return incremental.index_diff(*_index(spark, sf))


def worklist(spark, sf):
    before, now = _index(spark, sf)
    cache = now.where(F.col("session_file").cast("long") % 3 != 0)
    return incremental.worklist(incremental.index_diff(before, now), now, cache)


def partial_final_counters(spark, sf):
    return workflow.finals(workflow.partials(_calls(spark, sf))).where("kind IN ('tool', 'path', 'command')").select("kind", "name", "n", "n_sessions")


def _stored_partials(spark, sf):
    """Partials by session as a stored table, in two parts of sessions as two runs would leave them."""
    calls = _calls(spark, sf)
    early = F.col("session").cast("long") % 2 == 0
    return checkpointed(workflow.partials(calls.where(early)).unionByName(workflow.partials(calls.where(~early))))


def stored_top_counters(spark, sf):
    """The twenty most frequent tools, paths, commands, sequences and path uses, from stored partials."""
    return workflow.top_counters(workflow.finals(_stored_partials(spark, sf)))


def stored_candidates(spark, sf):
    """Candidate patterns in the order of a report, from stored partials alone."""
    rows = workflow.candidates_of(_stored_partials(spark, sf))
    order = F.row_number().over(Window.orderBy(F.desc("weight"), F.desc("n"), "type_rank", "first", "name"))  # candidates: far fewer than names
    return rows.select(order.alias("place"), "type", "name", "n", "confidence", _joined("evidence"))


def session_summaries(spark, sf):
    rows = sessions.session_summaries(_log(spark, sf))
    tools = F.array_join(F.transform("tools", lambda t: F.concat_ws(":", t["tool"], t["n"].cast("string"))), ",")
    return rows.withColumn("tools", tools).withColumn("models", F.array_join("models", ","))


def _traced(spark, sf):
    docs = _read(spark, sf, "documents").withColumn("text", F.regexp_replace("text", r"(?m)^(The|Of|An|De) (\S+).*$", '* $1 "$2"'))
    return chunking.traces(docs, **BY_PATH)


def trace_metadata(spark, sf):
    return _traced(spark, sf).select("doc_id", _joined("referenced"), _joined("changed"), _joined("commands"))


def _blocks(spark, sf):
    return chunking.blocks(_read(spark, sf, "documents"), header=DOC_HEADER)


def blocks(spark, sf):
    return _blocks(spark, sf)


def _packed(spark, sf):
    """Chunk numbers of all segments, and the segments' texts."""
    docs = _read(spark, sf, "documents")
    whole = chunking.sizes(docs)
    packed_blocks = chunking.block_segments(_blocks(spark, sf), whole, POLICY)
    cut = chunking.segments(packed_blocks, whole).join(docs.select("doc_id", "source"), "doc_id")
    rows = cut.select(F.col("source").alias("project"), F.col("doc_id").alias("session"), (F.col("doc_id") * 100_000 + F.col("segment")).alias("ord"), "segment", "n_chars", "line_start", "line_end")
    return chunking.pack(rows, POLICY), chunking.segment_texts(packed_blocks, docs.select("doc_id", "text")).withColumnRenamed("doc_id", "session")


def chunk_pack(spark, sf):
    return _packed(spark, sf)[0].select("project", "session", "segment", "n_chars", "line_start", "line_end", "chunk")


def _chunks(spark, sf):
    packed, contents = _packed(spark, sf)
    name = F.col("doc_id").cast("string")
    none = F.lit(None).cast("string")
    about = _traced(spark, sf).select(F.col("doc_id").alias("session"), name.alias("start_time"), name.alias("end_time"), F.concat(name, F.lit(".min.txt")).alias("min_path"), none.alias("txt_path"), none.alias("source_jsonl"), "referenced", "changed", "commands")
    return chunking.chunk_records(packed, contents, about)


def chunk_records(spark, sf):
    ranges = F.array_join(F.transform("source_ranges", lambda r: F.concat_ws("-", r["session"], r["line_start"].cast("string"), r["line_end"].cast("string"))), ",")
    return _chunks(spark, sf).select(
        "project", "chunk", "chunk_id", _joined("source_sessions"), _joined("source_files"), "start_time", "end_time", ranges.alias("source_ranges"), _joined("referenced"), _joined("changed"), _joined("commands"),
        "line_count", "n_chars", "tokens", "content_hash", "relevance",
    )


def _reports(spark, sf):
    """Chunks with a stand-in state of their reports."""
    status = F.when(F.col("chunk") % 4 == 0, "cached").when(F.col("chunk") % 4 == 3, "failed").otherwise("completed")
    name = F.concat(F.lit("reports/"), "project", F.lit("/"), "chunk_id", F.lit(".md"))
    return _chunks(spark, sf).select("project", "chunk", "chunk_id", "source_sessions", "referenced", "changed", "commands", "content_hash", "relevance", status.alias("status"), name.alias("report_path"), F.concat(F.lit(" # report of "), "content_hash", F.lit("\n")).alias("report"))


def chunk_reports(spark, sf):
    return runners.chunk_reports(_chunks(spark, sf)).select("project", "chunk_id", F.length("report").cast("long").alias("n_chars"), F.sha2("report", 256).alias("report_sha256"))


def synthesis_selection(spark, sf):
    return chunking.select_for_synthesis(_reports(spark, sf)).select("project", "chunk", "status", "relevance")


def synthesis_rollup(spark, sf):
    rows = chunking.synthesis_rollup(_reports(spark, sf))
    return rows.select("project", *[_joined(c) for c in ("used_chunk_ids", "used_report_paths", "ignored_chunk_ids", "ignored_report_paths")])


def synthesis_heads(spark, sf):
    """What a project's synthesis names: sessions, and the first changed and referenced paths and commands, in order."""
    return chunking.synthesis_heads(chunking.first_uses(_reports(spark, sf)))


def synthesis_input(spark, sf):
    return chunking.synthesis_input(_reports(spark, sf)).select("project", F.length("packet").cast("long").alias("n_chars"), F.sha2("packet", 256).alias("packet_sha256"))


def run_stats(spark, sf):
    return chunking.run_stats(_reports(spark, sf))


def run_stats_of_one(spark, sf):
    return chunking.run_stats(_reports(spark, sf), only_chunk="chunk_002")


def cache_hits(spark, sf):
    chunks = _reports(spark, sf).withColumn("chunk_id", F.concat_ws("/", "project", F.col("chunk").cast("string")))
    n = F.col("chunk")
    state = chunks.select(
        "chunk_id", F.when(n % 5 == 0, "stale").otherwise(F.col("content_hash")).alias("content_hash"), F.when(n % 4 == 3, "failed").otherwise("completed").alias("status"),
        F.when(n % 7 == 1, "v0").otherwise("v1").alias("prompt_version"), F.when(n % 6 == 2, "fake").otherwise("cli-json").alias("runner_type"),
        F.when(n % 9 == 4, "m2").otherwise("m1").alias("model"), F.when(n % 8 != 6, "low").alias("thinking"), F.when(n % 10 != 9, F.col("report_path")).alias("report_path"),
    )
    return incremental.cache_hits(chunks.select("chunk_id", "content_hash"), state, "v1", "cli-json", "m1", "low").select("chunk_id", "hit")


def _matches(spark, sf):
    return reminders.matches(_turns(spark, sf))


def reminder_matches(spark, sf):
    return _matches(spark, sf).select("session_file", "turn_index", "rule_id", "score", "rank")


def reminder_visible(spark, sf):
    return reminders.visible(_matches(spark, sf)).select("session_file", "turn_index", "rule_id", "place")


def reminder_cooldown(spark, sf):
    ignored = spark.createDataFrame([("length",)], "rule_id string")
    return reminders.cooled(reminders.without_ignored(_matches(spark, sf), ignored)).select("session_file", "turn_index", "rule_id")


def _gram_counts(spark, sf):
    return phrases.gram_counts(_turns(spark, sf), ["session_file", "turn_index"])


def char_ngrams(spark, sf):
    return phrases.phrase_candidates(_gram_counts(spark, sf)).select("gram", "n", "weight")


def frequent_phrases(spark, sf):
    return phrases.frequent_phrases(_gram_counts(spark, sf))


def _texts(spark, sf):
    return _turns(spark, sf).select(F.concat_ws("#", "session_file", F.col("turn_index").cast("string")).alias("turn"), "normalized")


def _weights(spark, sf):
    return phrases.tfidf(_texts(spark, sf), ["turn"])


def tfidf_weights(spark, sf):
    w = _weights(spark, sf)
    return w.groupBy("turn").agg(F.count(F.lit(1)).alias("n_grams"), F.round(F.max("w"), 6).alias("largest"), F.round(F.sum("w"), 6).alias("total"))


def _folded(spark, sf, near=False):
    """Distinct turns with their copies, all members, and the stored vectors of the distinct ones."""
    nodes, members = phrases.folded(_texts(spark, sf), "turn")
    nodes = stored(nodes)
    return nodes, members, phrases.tfidf_vectors(nodes, "turn", copies="copies", near=near)


def similar_pairs(spark, sf):
    """Pairs of different texts; the least turn stands for all with its text."""
    _, _, vectors = _folded(spark, sf)
    return phrases.similar_pairs(vectors, "turn").select("a", "b", F.round("similarity", 4).alias("similarity"))


def similar_members(spark, sf):
    """Each turn, the one that stands for its text, and how many have it."""
    nodes, members = phrases.folded(_texts(spark, sf), "turn")
    return members.join(nodes.select(F.col("turn").alias("of"), "copies"), "of").select("turn", F.col("of").alias("representative"), "copies")


def _clusters(nodes, members, vectors):
    return phrases.similar_clusters(nodes, members, phrases.similar_links(vectors, "turn"), vectors, "turn")


def dbscan_clusters(spark, sf):
    return _clusters(*_folded(spark, sf, near=True))


def dbscan_report(spark, sf):
    """The largest clusters of similar turns, with terms and examples."""
    nodes, members, vectors = _folded(spark, sf)
    rows = phrases.cluster_report(vectors, stored(_clusters(nodes, members, vectors)), "turn", of=members)
    return rows.select("cluster", "size", _joined("top_terms", "|"), _joined("examples"))


def kmeans_report(spark, sf):
    weights = checkpointed(_weights(spark, sf))
    return phrases.cluster_report(weights, phrases.kmeans(weights, "turn"), "turn")


def project_totals(spark, sf):
    return workflow.project_totals(_calls(spark, sf))


def frequent_commands(spark, sf):
    return workflow.frequent_commands(_calls(spark, sf))


def kmeans_clusters(spark, sf):
    return phrases.kmeans(checkpointed(_weights(spark, sf)), "turn")


def validation_parse(spark, sf):
    """Verdicts of which parts are missing in turn, with the conversation's text as their summary."""
    n = F.col("conv_id") * 7 + F.col("turn")
    one = lambda *names: F.array(*[F.lit(x) for x in names])
    full = F.struct(
        (n % 51).cast("double").alias("raw_score"), F.col("text").alias("summary"), F.create_map(F.lit("Signal"), (n % 9).cast("double"), F.lit("Routing"), F.lit(2.345)).alias("dimension_scores"),
        one("Coverage").alias("failed_dimensions"), one("cite", "cut").alias("must_fix"), one("chunk_001").alias("which_chunk_underrepresented"), F.create_map(F.lit("patterns.md"), one("shorter")).alias("rewrite_direction"),
    )
    payload = F.when(n % 3 == 0, F.to_json(full)).when(n % 3 == 1, F.to_json(F.struct((n % 11).cast("double").alias("normalized_score"), one("chunk_002", "chunk_003").alias("which_chunk_overweighted")))).otherwise("no verdict")
    text = F.concat(F.lit("```json\n"), payload, F.lit("\n```"))
    return _read(spark, sf, "conversations").select("conv_id", "turn", runners.parse_validation(text).alias("v")).select("conv_id", "turn", "v.score", "v.passed", "v.summary", F.sha2("v.critique", 256).alias("critique_sha256"))


def bundle_round_trip(spark, sf):
    """Documents of three texts rendered as a bundle and split again; blank ones give none."""
    three = _read(spark, sf, "conversations").groupBy("conv_id").agg(*[F.max(F.when(F.col("turn") == i, F.col("text"))).alias(f"t{i}") for i in (1, 2, 3)])
    made = three.withColumn("bundle", runners.render_bundle(F.create_map(*[x for i, n in enumerate(runners.BUNDLE, 1) for x in (F.lit(n), F.coalesce(F.col(f"t{i}"), F.lit("")))])))
    back = runners.split_bundle(F.concat(F.lit("\n"), "bundle"))
    return made.select("conv_id", F.sha2("bundle", 256).alias("bundle_sha256"), *[F.sha2(back[n], 256).alias(f"part_{i}") for i, n in enumerate(runners.BUNDLE, 1)])


def runner_event_fold(spark, sf):
    conv = _read(spark, sf, "conversations")
    delta = F.to_json(F.struct(F.lit("message_update").alias("type"), F.struct(F.lit("text_delta").alias("type"), F.col("role").alias("delta")).alias("assistantMessageEvent")))
    end = F.to_json(F.struct(F.lit("message_end").alias("type"), F.struct("role", F.concat(F.lit("m"), F.col("turn").cast("string")).alias("model"), F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))).alias("content")).alias("message")))
    line = F.when(F.col("turn") % 3 == 2, "not json").when(F.col("role") == "assistant", end).otherwise(delta)
    rows = conv.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("line_no"), line.alias("line"))
    return runners.fold_runner_events(rows)


def chunk_model_reports(spark, sf):
    texts = _read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return runners.map_chunks(texts)


def turn_refs(spark, sf):
    ref = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("s#turn1x"), F.col("conv_id").cast("string"), F.lit("#turn"), F.col("turn").cast("string"))).otherwise(F.col("role"))
    session, turn = parse_turn_ref(ref)
    return _read(spark, sf, "conversations").select("conv_id", "turn", session.alias("session"), turn.alias("turn_index"), project_id(F.concat(F.lit("/home//x y/"), F.col("role"))).alias("project_id"))


def report_patterns(spark, sf):
    """What the workflow report says of its twelve candidates, line by line (a top-k report)."""
    top = workflow.in_order(workflow.candidates_of(_stored_partials(spark, sf))).limit(12).collect()
    lines = [(i, j, line) for i, r in enumerate(top, 1) for j, line in enumerate(reports.pattern_lines(r.asDict(recursive=True)), 1)]
    return spark.createDataFrame(lines, "place int, line_no int, line string")


def _log(spark, sf):
    return sessions.log_from_conversations(_read(spark, sf, "conversations"))


def log_messages(spark, sf):
    """Messages read from log lines: text and tool calls of every one."""
    return sessions.messages_from_entries(_log(spark, sf)).select("session_file", "line_no", "role", F.sha2("text", 256).alias("text_sha256"), "tool_calls")


def log_tool_calls(spark, sf):
    """Tool calls read from log lines, in order, with their arguments."""
    calls = sessions.tool_calls_from_entries(_log(spark, sf))
    return calls.select("session", "turn", F.col("ord.line_no").alias("line_no"), F.col("ord.place").alias("place"), "tool", "path", "command")


def log_models(spark, sf):
    """The model that each message was said under."""
    return sessions.with_model(_log(spark, sf)).where("entry.type = 'message'").select("session_file", "line_no", "model")


def model_counts(spark, sf):
    return sessions.model_counts(_log(spark, sf))


def log_metadata(spark, sf):
    return sessions.session_metadata(_log(spark, sf))


def sessions_by_start(spark, sf):
    """Sessions in order of their start, then name; the start of a conversation is how long its texts are."""
    began = _messages(spark, sf).groupBy("session_file").agg(F.lpad(F.sum(F.length("text")).cast("string"), 12, "0").alias("start_time"))
    return numbered(began, ["start_time", "session_file"], "place")


def commands_and_paths(spark, sf):
    """Commands with their project as a placeholder, and paths as they are shown."""
    docs, n = _read(spark, sf, "documents"), F.col("doc_id") % 6
    command = normalize_command(F.concat(F.lit("cd /work/app  && cp /tmp/pi-hypa-backup-20260102-030405/x\n"), F.coalesce("text", F.lit(""))), "/work/app")
    path = F.when(n == 0, "/home/me").otherwise(F.concat(F.when(n == 1, "/work/app/").when(n == 2, "/home/me/").when(n == 3, "/work/apple/").when(n == 4, "/home/meg/").otherwise("/"), "source"))
    return docs.select("doc_id", F.sha2(command, 256).alias("command_sha256"), F.length(command).alias("n_chars"), display_path(path, "/work/app", "/home/me").alias("path"), stable_session_id(F.concat(F.lit("distill reduce/"), "source", F.lit("!"))).alias("session_id"))


def path_bullets(spark, sf):
    """The first five distinct paths that a turn read, as a list."""
    return workflow.turns(_calls(spark, sf)).select("session", "turn", bullets(unique_head(F.col("read_paths"), 5)).alias("bullets"))


def evidence_lines(spark, sf):
    """The first three lines of each document that hold one of some terms."""
    lines = reminders.evidence_lines(F.coalesce("text", F.lit("")), ["tion", "der"], 3)
    return _read(spark, sf, "documents").select("doc_id", F.size(lines).alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("lines_sha256"))


def rule_validity(spark, sf):
    """Rows of conversations taken for rules: which of them a rules document may hold."""
    n = F.col("conv_id") + F.col("turn")
    rows = _read(spark, sf, "conversations").select("conv_id", "turn", F.when(n % 5 != 0, F.concat(F.lit("r"), n.cast("string"))).alias("id"), F.when(n % 3 == 0, "notify").when(n % 3 == 1, "confirm").otherwise(F.col("role")).alias("mode"), F.when(n % 7 != 0, F.col("text")).otherwise("").alias("message"))
    return reminders.valid(rows).select("conv_id", "turn", "valid")


def registry_upsert(spark, sf):
    """The index of the run before with what changed since in its place, in order of names."""
    before, now = _index(spark, sf)
    changed = incremental.index_diff(before, now).where("status IN ('new', 'changed')").select("session_file")
    return numbered(incremental.upsert(before, now.join(changed, "session_file"), "session_file"), ["session_file"], "place")


def _verdicts(spark, sf):
    n = F.col("conv_id") * 7 + F.col("turn")
    points = F.create_map(F.lit("Signal"), (n % 9).cast("double"), F.lit("Routing"), (n % 5).cast("double"), F.lit("Coverage"), F.lit(2.5))
    return _read(spark, sf, "conversations").select("conv_id", "turn", F.to_json(F.struct((n % 51).cast("double").alias("raw_score"), F.when(n % 4 != 0, points).alias("dimension_scores"))).alias("text"))


def rubric_means(spark, sf):
    """The mean of the dimension scores of every verdict."""
    return _verdicts(spark, sf).select("conv_id", "turn", runners.rubric_mean(runners.parse_validation(F.col("text"))["rubric"]).alias("mean"))


def cached_model_reports(spark, sf):
    """Two runs of a model over all documents, a seventh of which changed in between: what the second run asks for again."""
    docs = _read(spark, sf, "documents").groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text")).withColumn("chunk_id", F.col("doc_id").cast("string"))
    store = runners.report_store(spark, f"{checkpoints(spark).rstrip('/')}/loomlens-{uuid.uuid4().hex}", 16)
    run = lambda rows, name: runners.map_chunks_once(rows.withColumn("content_hash", F.sha2("text", 256)), store, name)
    run(docs, "first")
    again = run(docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))), "second")
    return again.select(F.col("chunk_id").cast("long").alias("doc_id"), "content_hash", "status")


def route_sessions(spark, sf):
    """A route run twice, as sessions were before and as they are now: every session's messages, and the run that counted them."""
    before, now = _index(spark, sf)
    counts = _messages(spark, sf).groupBy("session_file").agg(F.count(F.lit(1)).alias("n_messages"))
    route = routes.Route(f"{checkpoints(spark).rstrip('/')}/loomlens-{uuid.uuid4().hex}", "p", "messages", 16)
    schema = "session_file string, n_messages long, run string"
    # a session that is gone now has the name that it had then
    was = counts.unionByName(counts.withColumn("session_file", F.concat(F.lit("old-"), "session_file")))
    compute = lambda table, name: lambda work: table.join(work, "session_file").withColumn("run", F.lit(name))
    routes.run(route, before, compute(was, "r1"), schema, "r1")
    return routes.run(route, now, compute(counts, "r2"), schema, "r2")[0]


def _scored(request: runners.Request) -> str:
    """A model whose bundles name their packet's length, and whose verdicts rise with every try."""
    if request.task == "synthesis":
        return "\n".join(f"=== {n} ===\n{len(request.text)}" for n in runners.BUNDLE)
    return runners.verdict(int(request.text.rsplit("\n", 1)[1]) % 40 + 8.0 * request.attempt)


def project_synthesis(spark, sf):
    """Every conversation as a project whose bundle is written and judged until it passes."""
    packets = _messages(spark, sf).groupBy("session_file").agg(F.max_by("text", "line_no").alias("packet"))
    results, _ = runners.synthesise_projects(packets.withColumnRenamed("session_file", "project"), _scored)
    return results.select("project", "attempt", "status", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        session_meta, message_ordinals, user_turns, one_line_preview, normalize_text, category_match, correction_events, event_profile, event_type_order, user_profiles, representative_events,
        rule_hits, rule_summary, correction_chains, blindspot_profile, tool_turns, tool_path_counts, top_sequences, read_edit_turns, edit_validate_turns, hot_files,
        repeated_sequences, repeated_commands, candidate_patterns, representative_turns, compact_counters, asset_suggestions, compact_turns, pattern_summaries, event_summaries, validation_commands, index_diff, worklist,
        partial_final_counters, stored_top_counters, stored_candidates, session_summaries, trace_metadata, blocks, chunk_pack, chunk_records, chunk_reports, synthesis_selection, synthesis_rollup, synthesis_heads, synthesis_input, run_stats, run_stats_of_one, cache_hits, reminder_matches, reminder_visible, reminder_cooldown,
        char_ngrams, frequent_phrases, tfidf_weights, similar_pairs, similar_members, dbscan_clusters, dbscan_report, kmeans_clusters, kmeans_report, project_totals, frequent_commands, validation_parse, bundle_round_trip, runner_event_fold, chunk_model_reports, turn_refs,
        report_patterns, log_messages, log_tool_calls, log_models, model_counts, log_metadata, sessions_by_start, commands_and_paths, path_bullets, evidence_lines, rule_validity, registry_upsert, rubric_means, cached_model_reports, route_sessions, project_synthesis,
    )
}
QUERIES |= {
    "event_type_counts": _value_counts("event_type"), "impact_counts": _value_counts("impact"), "missing_constraint_counts": _value_counts("missing_constraint"),
    "tool_counts": _counts("tool"), "path_counts": _counts("path"), "command_counts": _counts("command"),
}
