"""Cutting session texts into blocks, segments and size-bounded chunks."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.storage import checkpointed
from ..functions.text import estimate_tokens, relevance, trace

#: Tools whose arguments tell what a text read, changed and ran; headers of blocks.
READS, CHANGES, COMMANDS = "Read|read", "Write|write|Edit|edit", "Bash|bash"
HEADER = r"(?U)^\s*\[(user|assistant)\]"


@dataclass(frozen=True)
class Policy:
    """Sizes in characters: cut at a session from ``least`` on, never pass ``soft``, split sessions over ``hard``."""

    least: int = 160_000
    soft: int = 320_000
    hard: int = 360_000


#: Fixed value: what ends a line of a session text.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lines_of(c: Column) -> Column:
    """The lines of a text without their ends; a last line end begins no further line, and '' has none."""
    cut = F.split(F.coalesce(c, F.lit("")), LINE_END, -1)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)


def blocks(texts: DataFrame, key: str = "doc_id", header: str = HEADER) -> DataFrame:
    """Blocks of lines, 1-based: a block starts at a header line; line 1 always starts one; an empty text has none.

    A block's lines are joined by line feeds; it ends with one if it is not empty and the whole text ends so.
    """
    text = F.coalesce("text", F.lit(""))
    lines = texts.select(key, F.endswith(text, F.lit("\n")).alias("closed"), lines_of(text).alias("lines"))
    # blocks are found within the row, and no line leaves it
    at = F.transform("lines", lambda x, i: F.when((i == 0) | x.rlike(header), i))
    starts = lines.select("*", F.filter(at, lambda i: i.isNotNull()).alias("starts"))

    def block(s: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("lines"))
        joined = F.length(F.array_join(F.slice("lines", s + 1, end - s), "\n")).cast("long")
        size = joined + F.when(F.col("closed") & (joined > 0), 1).otherwise(0)
        return F.struct((k + 1).cast("long").alias("block"), (s + 1).alias("line_start"), end.alias("line_end"), size.alias("n_chars"))

    return starts.select(key, F.inline(F.transform("starts", block)))


def sizes(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Characters and lines of each whole text."""
    text = F.coalesce("text", F.lit(""))
    return texts.select(key, F.length(text).cast("long").alias("whole"), F.when(text != "", F.size(F.split(text, "\n", -1))).otherwise(0).alias("n_lines"))


def traces(texts: DataFrame, key: str = "doc_id", reads: str = READS, changes: str = CHANGES, commands: str = COMMANDS) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return texts.select(key, trace(t, reads).alias("referenced"), trace(t, changes).alias("changed"), F.transform(trace(t, commands), lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))).alias("commands"))


def _fold(rows: DataFrame, groups: list[str], step, out: str) -> DataFrame:
    """Runs an order-dependent fold over each group's rows as a stream.

    Rows are narrow, sorted within partitions (the sort spills) and never held as a group: the
    fold's state is a few numbers, whatever the size of a group.
    """
    ship(rows.sparkSession)
    cols = rows.columns
    ordered = rows.repartition(*groups).sortWithinPartitions(*groups, "ord")

    def work(batches):
        state: dict = {}
        for batch in batches:
            values = []
            for r in batch.to_pylist():
                own = tuple(r[g] for g in groups)
                if state.get("group") != own:
                    state = {"group": own}
                values.append(step(state, r))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.int64())], names=[*cols, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ordered.mapInArrow(work, f"{schema}, {out} long")


def block_segments(block_rows: DataFrame, whole: DataFrame, policy: Policy = Policy(), key: str = "doc_id") -> DataFrame:
    """Segment number of each block of the texts that pass the hard limit, packed greedily; ``whole`` is of ``sizes``."""
    long = whole.where(F.col("whole") > policy.hard).select(key)
    rows = block_rows.join(long, key, "left_semi").withColumn("ord", F.col("block"))

    def step(state, r):
        if "held" in state and state["held"] + r["n_chars"] > policy.hard:
            state["no"] = state.get("no", 0) + 1
            state["held"] = 0
        state["held"] = state.get("held", 0) + r["n_chars"]
        return state.get("no", 0)

    return _fold(rows, [key], step, "segment").drop("ord")


def segments(packed_blocks: DataFrame, whole: DataFrame, key: str = "doc_id") -> DataFrame:
    """Segments with their sizes and line ranges: a text within the hard limit is one, as are its lines."""
    cut = packed_blocks.groupBy(key, "segment").agg(F.sum("n_chars").alias("n_chars"), F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"))
    rest = whole.join(packed_blocks.select(key).distinct(), key, "left_anti")
    return cut.unionByName(rest.select(key, F.lit(0).cast("long").alias("segment"), F.col("whole").alias("n_chars"), F.lit(1).alias("line_start"), F.col("n_lines").alias("line_end")))


def segment_texts(packed_blocks: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, segment, text): the blocks' texts joined, or the whole text where it was not cut."""
    text = F.coalesce("text", F.lit(""))
    plain = texts.select(key, text.alias("text"))
    held = packed_blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", "segment", "line_start", "line_end"))).alias("blocks"))
    cut = plain.join(held, key).select(key, lines_of(F.col("text")).alias("lines"), F.endswith("text", F.lit("\n")).alias("closed"), F.explode("blocks").alias("b"))
    body = F.array_join(F.slice("lines", F.col("b.line_start"), F.col("b.line_end") - F.col("b.line_start") + 1), "\n")
    body = F.when(F.col("closed") & (body != ""), F.concat(body, F.lit("\n"))).otherwise(body)
    # a segment is within the hard limit, or one block
    parts = cut.select(key, "b.segment", F.struct("b.block", body.alias("body")).alias("part")).groupBy(key, "segment").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    joined = parts.select(key, "segment", F.array_join(F.transform("parts", lambda p: p["body"]), "").alias("text"))
    rest = plain.join(held.select(key), key, "left_anti").select(key, F.lit(0).cast("long").alias("segment"), "text")
    return joined.unionByName(rest)


#: What a run of segments makes of the open chunk that it gets: see ``_summary``.
_RUN = "part int, project string, first_session string, last_session string, n0 long, cuts0 long, held0 long, total long, steps array<struct<least:long,cuts:long,held:long>>"

_ENTRY = "part int, project string, closed long, held long, last string"


def _summary(sizes: np.ndarray, border: np.ndarray, least: int, most: int) -> dict:
    """What a run of segments does to an open chunk of any size, in a form that does not grow with the run.

    ``border`` tells the segments that begin another session than the one before. Where a chunk is cut, nothing before
    matters: from every cut on the further cuts are fixed. So a run is a staircase: a chunk that holds ``least`` or
    more is cut at that step first, after which there are ``cuts`` in all and ``held`` is open at the end. Steps end
    where an empty chunk would be cut, so they are at most the segments of one chunk. The first segment stands apart (n0, cuts0,
    held0), as whether it begins another session is known only beside the run before.
    """
    n = len(sizes)
    before = np.concatenate([[0], np.cumsum(sizes)])
    starts = np.arange(n)
    full = np.maximum(np.searchsorted(before, before[:-1] + most, side="right") - 1, starts + 1)
    edges = np.flatnonzero(border)
    edges = edges[edges > 0]
    at = np.searchsorted(edges, np.maximum(np.searchsorted(before, before[:-1] + least), starts + 1))
    turned = np.append(edges, n)[at]
    follow = np.minimum(np.minimum(full, turned), n).tolist()
    cuts, held, total = [0] * n, [0] * n, before.tolist()
    for i in range(n - 1, -1, -1):
        j = follow[i]
        cuts[i], held[i] = (0, total[n] - total[i]) if j == n else (cuts[j] + 1, held[j])
    steps, lowest = [], None
    for j in range(1, n):
        limit = most - total[j + 1] + 1
        if border[j]:
            limit = min(limit, least - total[j])
        if lowest is None or limit < lowest:
            steps.append({"least": limit, "cuts": cuts[j] + 1, "held": held[j]})
            lowest = limit
            if limit <= 0:
                break
    return {"n0": int(sizes[0]), "cuts0": cuts[0], "held0": held[0], "total": total[n], "steps": steps}


def _after(run: dict, entry: tuple[int, int, str | None], least: int, most: int) -> tuple[int, int, str | None]:
    """(chunks closed, size of the open chunk, session) after a run that got such a state; size -1 is none."""
    closed, held, session = entry
    last = run["last_session"]
    if held < 0:
        return closed + run["cuts0"], run["held0"], last
    if (run["first_session"] != session and held >= least) or held + run["n0"] > most:
        return closed + 1 + run["cuts0"], run["held0"], last
    for s in run["steps"]:
        if held >= s["least"]:
            return closed + s["cuts"], s["held"], last
    return closed, held + run["total"], last


def pack(segment_rows: DataFrame, policy: Policy = Policy(), project: str = "project", session: str = "session") -> DataFrame:
    """Chunk number of each segment within its project, in order of ``ord``.

    An open chunk is closed before a segment that begins another session if the chunk has the least
    size, and before any segment that would lift it over the soft limit (or the hard one).

    A parallel prefix: segments are dealt by ranges of (project, ord), so that a large project fills many tasks; the first
    and last run of every task are summed up as functions of the chunk that is open before them; the functions
    of a project's runs, at most two a task, are applied in turn; then each task numbers its segments from the state it gets.
    """
    spark = segment_rows.sparkSession
    ship(spark)
    least, most = policy.least, min(policy.soft, policy.hard)
    cols = segment_rows.columns
    dealt = segment_rows.repartitionByRange(project, "ord").sortWithinPartitions(project, "ord")
    dealt = checkpointed(dealt).withColumn("_part", F.spark_partition_id())
    text = lambda c: F.col(c).cast("string").alias(c)
    narrow = dealt.select(F.col("_part").alias("part"), F.col(project).cast("string").alias("project"), F.col(session).cast("string").alias("session"), F.col("n_chars").cast("long").alias("n"))

    run_schema, entry_schema = _arrow_schema(_RUN), _arrow_schema(_ENTRY)

    def runs(batches):
        # runs of one project; those between the first and the last need no other task
        held: list[tuple] = []
        first, last, part = None, None, 0

        def summed(run):
            name, sizes, sessions = run
            border = np.array([i > 0 and a != sessions[i - 1] for i, a in enumerate(sessions)])
            return {"part": part, "project": name, "first_session": sessions[0], "last_session": sessions[-1], **_summary(np.array(sizes, np.int64), border, least, most)}

        for batch in batches:
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            for name, who, size in zip(*(batch.column(c).to_pylist() for c in ("project", "session", "n")), strict=True):
                if last is None or last[0] != name:
                    if last is not None and first is None:
                        first = last
                    last = (name, [], [])
                last[1].append(size)
                last[2].append(who)
        for run in (first, last):
            if run is not None:
                held.append(summed(run))
        if held:
            yield pa.RecordBatch.from_pylist(held, run_schema)

    summaries = checkpointed(narrow.mapInArrow(runs, _RUN))

    def entries(table: pa.Table) -> pa.Table:
        state, out = (0, -1, None), []
        for run in sorted(table.to_pylist(), key=lambda r: r["part"]):
            if state[1] >= 0:
                out.append({"part": run["part"], "project": run["project"], "closed": state[0], "held": state[1], "last": state[2]})
            state = _after(run, state, least, most)
        return pa.Table.from_pylist(out, entry_schema)

    # at most one row a task: the state in which its first project enters it
    entered = summaries.groupBy("project").applyInArrow(entries, _ENTRY)
    entered = entered.select(F.col("part").alias("_part"), F.struct("project", "closed", "held", "last").alias("_entry"))
    rows = dealt.join(F.broadcast(entered), "_part", "left").select(*cols, text(project).alias("_project"), text(session).alias("_session"), "_entry")

    def number(batches):
        name, started, closed, held, last = None, False, 0, -1, None
        for batch in batches:
            values = []
            entry = batch.column("_entry")[0].as_py() if batch.num_rows and not started else None
            for own, who, size in zip(*(batch.column(c).to_pylist() for c in ("_project", "_session", "n_chars")), strict=True):
                if not started or own != name:
                    closed, held, last = (entry["closed"], entry["held"], entry["last"]) if not started and entry and entry["project"] == own else (0, -1, None)
                    name, started = own, True
                if held >= 0 and ((who != last and held >= least) or held + size > most):
                    closed, held = closed + 1, 0
                held, last = max(held, 0) + size, who
                values.append(closed)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in cols], pa.array(values, pa.int64())], names=[*cols, "chunk"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segment_rows.schema)
    return rows.mapInArrow(number, f"{schema}, chunk long")


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def chunk_id(chunk: Column) -> Column:
    return F.format_string("chunk_%03d", chunk + 1)


def chunk_body(chunk: Column, parts: Column) -> Column:
    """The text of a chunk: a heading, and for each segment its sources, its lines and its fenced text."""
    one = lambda p: F.concat(
        F.lit("### Session "), p["session"], F.lit("\n- min: `"), p["min_path"], F.lit("`\n- txt: `"), F.coalesce(p["txt_path"], F.lit("n/a")), F.lit("`\n- line_range: `"),
        p["line_start"].cast("string"), F.lit("-"), p["line_end"].cast("string"), F.lit("`\n\n```text\n"), F.regexp_replace(p["text"], "\n+\\z", ""), F.lit("\n```\n"),
    )
    return F.concat(F.lit("# "), chunk_id(chunk), F.lit("\n\n## Sources\n\n"), F.array_join(F.transform(parts, one), "\n"))


def chunk_records(packed: DataFrame, contents: DataFrame, sessions: DataFrame) -> DataFrame:
    """One row per chunk: its sources and their ranges and times, its rendered text with size and hash, and the
    distinct paths and commands of its sessions, in order.

    ``packed`` has project, session, segment, ord, line_start, line_end, chunk; ``contents`` session,
    segment and text; ``sessions`` session, start_time, end_time, min_path, txt_path, source_jsonl,
    referenced, changed, commands. A chunk is bounded by the packer, so what is gathered for it is as well.
    """
    fields = ["ord", "session", "segment", "line_start", "line_end", "text", "start_time", "end_time", "min_path", "txt_path", "source_jsonl", "referenced", "changed", "commands"]
    rows = packed.join(contents, ["session", "segment"]).join(sessions, "session").withColumn("session", F.col("session").cast("string"))
    each = rows.groupBy("project", "chunk").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("parts"))
    every = lambda c: F.transform("parts", lambda p: p[c])
    distinct = lambda c: F.array_distinct(F.filter(F.flatten(every(c)), lambda x: x != "")).alias(c)
    logs = F.filter(every("source_jsonl"), lambda x: x != "")
    out = each.select(
        "project", "chunk", chunk_id(F.col("chunk")).alias("chunk_id"), F.array_distinct(every("session")).alias("source_sessions"),
        F.array_distinct(F.when(F.size(logs) > 0, logs).otherwise(every("min_path"))).alias("source_files"),
        F.col("parts")[0]["start_time"].alias("start_time"), F.element_at("parts", -1)["end_time"].alias("end_time"),
        F.transform("parts", lambda p: F.struct(p["session"].alias("session"), p["min_path"].alias("min_path"), p["txt_path"].alias("txt_path"), p["line_start"].alias("line_start"), p["line_end"].alias("line_end"))).alias("source_ranges"),
        distinct("referenced"), distinct("changed"), distinct("commands"), chunk_body(F.col("chunk"), F.col("parts")).alias("content"),
    )
    size = F.length("content").cast("long")
    return out.select(
        "*", F.size(F.split("content", "\n", -1)).alias("line_count"), size.alias("n_chars"), estimate_tokens(size).alias("tokens"), F.sha2("content", 256).alias("content_hash"),
        relevance(F.size("referenced"), F.size("changed"), F.size("commands"), size).alias("relevance"),
    )


def chunks_of(records: DataFrame, policy: Policy = Policy(), project: str = "project") -> DataFrame:
    """Chunk records of session records (as from ``session_records``), each with the name of its ``project``.

    Sessions go by start time, then name; texts over the hard limit are cut at blocks.
    """
    order = F.struct("start_time", "session_name")
    texts = checkpointed(records.select(F.col(project).cast("string").alias("project"), F.col("session_name").alias("session"), order.alias("at"), "text"))
    docs = texts.select(F.col("session").alias("doc_id"), "text")
    whole = sizes(docs)
    packed_blocks = block_segments(blocks(docs), whole, policy)
    rows = segments(packed_blocks, whole).withColumnRenamed("doc_id", "session").join(texts.select("project", "session", "at"), "session")
    rows = rows.select("project", "session", F.struct("at", "segment").alias("ord"), "segment", "n_chars", "line_start", "line_end")
    contents = segment_texts(packed_blocks, docs).withColumnRenamed("doc_id", "session")
    about = records.select(F.col("session_name").alias("session"), "start_time", "end_time", "min_path", "txt_path", "source_jsonl", "referenced", "changed", "commands")
    return chunk_records(pack(rows, policy), contents, about)


def write_chunk_files(records: DataFrame, folder: str) -> None:
    """One Markdown file per chunk, project by project, written by the tasks that hold the chunks (``folder`` is shared)."""
    ship(records.sparkSession)

    def work(batches):
        from pathlib import Path

        for batch in batches:
            for r in batch.to_pylist():
                home = Path(folder) / str(r["project"])
                home.mkdir(parents=True, exist_ok=True)
                (home / f"{r['chunk_id']}.md").write_text(r["content"], encoding="utf-8")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    records.select("project", "chunk_id", "content").mapInArrow(work, "n long").agg(F.sum("n")).collect()


def select_for_synthesis(reports: DataFrame) -> DataFrame:
    """Finished chunks without those of low relevance, unless all are low (per project)."""
    done = reports.where("status IN ('completed', 'cached')")
    some = done.groupBy("project").agg(F.max(F.col("relevance") != "low").alias("some"))
    return done.join(some, "project").where(~F.col("some") | (F.col("relevance") != "low")).drop("some")


def run_stats(reports: DataFrame, only_chunk: str | None = None) -> DataFrame:
    """Per project: how many chunks were selected, completed, cached, failed, and skipped because another one was asked for.

    An ``only_chunk`` that no project has raises.
    """
    chosen = F.lit(True) if only_chunk is None else F.col("chunk_id") == only_chunk
    if only_chunk is not None and reports.where(chosen).isEmpty():
        raise ValueError(f"no such chunk: {only_chunk}")
    state = lambda s: F.count_if(chosen & (F.col("status") == s)).alias(s)
    return reports.groupBy("project").agg(F.count_if(chosen).alias("selected"), state("completed"), state("cached"), state("failed"), F.count_if(~chosen).alias("skipped"))


def synthesis_rollup(reports: DataFrame) -> DataFrame:
    """Per project, in order of chunks: the ids and reports of the finished chunks that are used, and of those that are ignored."""
    used = select_for_synthesis(reports).select("project", "chunk_id", F.lit(True).alias("used"))
    done = reports.where("status IN ('completed', 'cached')").join(used, ["project", "chunk_id"], "left")
    ordered = lambda c, ok: F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("chunk", F.col(c).alias("c"))))), lambda x: x["c"])
    yes = F.coalesce("used", F.lit(False))
    return done.groupBy("project").agg(*[ordered(c, ok).alias(f"{name}_{c}s") for name, ok in (("used", yes), ("ignored", ~yes)) for c in ("chunk_id", "report_path")])


#: Lists of a chunk that the synthesis reads, with the number of first values that it shows of each (None: all).
SYNTHESIS_HEADS = {"sessions": None, "changed": 10, "referenced": 10, "commands": 8}


def first_uses(reports: DataFrame) -> DataFrame:
    """project, kind, value and where it first stands (chunk, place): the distinct values of the used chunks' lists.

    The least place is a mergeable state: what two tables of it hold of a value, ``merged_uses`` makes one.
    """
    used = select_for_synthesis(reports)
    columns = {"sessions": "source_sessions", "changed": "changed", "referenced": "referenced", "commands": "commands"}
    lists = F.array(*[F.struct(F.lit(k).alias("kind"), F.transform(F.col(c), lambda v, i: F.struct(v.cast("string").alias("value"), (i + 1).alias("place"))).alias("v")) for k, c in columns.items()])
    each = used.select("project", "chunk", F.explode(lists).alias("l")).select("project", "chunk", "l.kind", F.explode("l.v").alias("v"))
    return merged_uses(each.where("v.value <> ''").select("project", "kind", "v.value", F.struct("chunk", "v.place").alias("first")))


def merged_uses(*parts: DataFrame) -> DataFrame:
    """Several tables of first uses as one."""
    return reduce(DataFrame.unionByName, parts).groupBy("project", "kind", "value").agg(F.min("first").alias("first"))


def synthesis_heads(uses: DataFrame, heads: dict[str, int | None] = SYNTHESIS_HEADS) -> DataFrame:
    """Of each project's values of a kind the first few in order, with their ``rank``; of kinds without a bound all, with a null
    rank (they are in order of ``first``). Ranks are cut before rows are shuffled, so no list is ever gathered whole."""
    bounded = [k for k, n in heads.items() if n is not None]
    limit = F.create_map(*[x for k in bounded for x in (F.lit(k), F.lit(heads[k]))])
    order = Window.partitionBy("project", "kind").orderBy("first")
    top = uses.where(F.col("kind").isin(*bounded)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(heads[k] for k in bounded)).where(F.col("rank") <= limit[F.col("kind")])
    rest = uses.where(F.col("kind").isin(*[k for k in heads if k not in bounded])).withColumn("rank", F.lit(None).cast("int"))
    return top.unionByName(rest).select("project", "kind", "value", F.col("first.chunk").alias("chunk"), F.col("first.place").alias("place"), "rank")


def synthesis_input(reports: DataFrame) -> DataFrame:
    """(project, packet): what the synthesis model reads: the used chunks with their reports, then the ignored ones."""
    used = select_for_synthesis(reports).select("project", "chunk_id", F.lit(True).alias("used"))
    done = reports.where("status IN ('completed', 'cached')").join(used, ["project", "chunk_id"], "left").withColumn("used", F.coalesce("used", F.lit(False)))
    names = F.when(F.size("source_sessions") > 0, F.array_join("source_sessions", ", ")).otherwise("none")
    path = F.coalesce("report_path", F.lit("missing"))
    full = F.concat(F.lit("### "), "chunk_id", F.lit("\n- relevance: "), "relevance", F.lit("\n- source_sessions: "), names, F.lit("\n- report_path: "), path, F.lit("\n\n"), F.regexp_replace("report", r"(?U)^\s+|\s+\z", ""), F.lit("\n\n"))
    short = F.concat(F.lit("- "), "chunk_id", F.lit(": relevance="), "relevance", F.lit(" report="), path, F.lit("\n"))
    held = lambda ok, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("chunk", text.alias("t"))))), lambda x: x["t"]), "")
    each = done.groupBy("project").agg(held(F.col("used"), full).alias("body"), held(~F.col("used"), short).alias("rest"))
    rest = F.when(F.col("rest") != "", F.col("rest")).otherwise("- none\n")
    return each.select("project", F.concat(F.lit("# Synthesis packet\n\n## Used chunk reports\n\n"), "body", F.lit("## Ignored or lower-weight chunks\n\n"), rest).alias("packet"))
