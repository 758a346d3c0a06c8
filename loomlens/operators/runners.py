"""Model steps: the pluggable runner, its deterministic stand-in, and parsers of what models return."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..functions.storage import stored
from ..functions.text import bullets, json_object, stable_session_id
from ..plans.versioned import Table, Version
from . import incremental

PAYLOAD = (
    "struct<raw_score:double,normalized_score:double,summary:string,dimension_scores:map<string,double>,failed_dimensions:array<string>,must_fix:array<string>,"
    "which_chunk_underrepresented:array<string>,which_chunk_overweighted:array<string>,rewrite_direction:map<string,array<string>>>"
)
EVENT = "struct<type:string,assistantMessageEvent:struct<type:string,delta:string>,message:struct<role:string,model:string,content:array<struct<type:string,text:string>>>,success:boolean,finalError:string,aborted:boolean,errorMessage:string>"
#: The three documents of a bundle, words for a verdict without a summary, and the rubric's dimensions with their most points.
BUNDLE = ["project_context.md", "collaboration_guide.md", "patterns.md"]
PASSED, NOT_PASSED = "通过", "未通过"
RUBRIC = {"Faithfulness": 10, "Signal": 8, "Routing": 8, "Actionability": 8, "Coverage": 6, "Concision": 5, "Structure": 5}


@dataclass(frozen=True)
class Request:
    task: str
    text: str
    attempt: int = 1
    critique: str = ""
    #: Names the conversation that the tries of one project share.
    session: str = ""


Runner = Callable[[Request], str]


def stand_in(request: Request) -> str:
    """A deterministic model: a report says how long its input is and how it begins, a bundle which chunks its packet has, and a verdict passes every bundle."""
    return stand_in_model()(request)


def stand_in_model(scores: tuple[float, ...] = (41.0,), threshold: float = 35.0) -> Runner:
    """The deterministic model with a score for each try (the last one for all further)."""

    def say(request: Request) -> str:
        if request.task == "synthesis":
            chunks = ", ".join(dict.fromkeys(re.findall(r"^### (\S+)$", request.text, re.M))) or "none"
            note = "\n- bound more tightly after the critique" if request.critique else ""
            return "\n\n".join(f"=== {n} ===\n# {n.removesuffix('.md').replace('_', ' ')}\n\n- evidence: {chunks}{note}" for n in BUNDLE) + "\n"
        if request.task == "validation":
            return verdict(scores[min(request.attempt, len(scores)) - 1], threshold)
        head = " ".join(request.text.split())[:60]
        return f"# {request.task}\n- characters: {len(request.text)}\n- begins: {head}\n"

    return say


def verdict(score: float, threshold: float = 35.0) -> str:
    """What a judge says of a bundle with such a score, as JSON: the rubric in proportion, and where it falls short."""
    short = score < threshold
    return json.dumps({
        "raw_score": round(score, 2), "passed": not short, "dimension_scores": rubric_scores(score), "failed_dimensions": ["Coverage", "Faithfulness"] if short else [],
        "must_fix": ["bind every claim to a chunk"] if short else [], "which_chunk_underrepresented": [], "which_chunk_overweighted": [], "rewrite_direction": {n: ["name the evidence"] for n in BUNDLE} if short else {},
    }, ensure_ascii=False)


def map_chunks(chunks: DataFrame, runner: Runner = stand_in, task: str = "chunk", key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Runs a model over every chunk; a failure becomes a row with its message, and the run goes on."""

    ship(chunks.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            reports, states = [], []
            for t in batch.column("text").to_pylist():
                try:
                    reports.append(runner(Request(task, t or "")))
                    states.append("completed")
                except Exception as error:  # noqa: BLE001  a model may fail in any way
                    reports.append(str(error))
                    states.append("failed")
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(states, pa.string()), pa.array(reports, pa.string())], names=["key", "status", "report"])

    rows = chunks.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(work, "key string, status string, report string").withColumnRenamed("key", key)


#: What a stored report was made with, and the report.
REPORTS = "chunk_id string, content_hash string, prompt_version string, status string, runner_type string, model string, thinking string, report_path string, report string"


def report_store(spark: SparkSession, home: str, buckets: int = 64) -> Table:
    return Table(spark, home, {"reports": REPORTS}, "chunk_id", buckets)


def map_chunks_once(
    chunks: DataFrame, store: Table, run_id: str, runner: Runner = stand_in, *, name: str = "fake", prompt_version: str = "v1", model: str | None = None, thinking: str | None = None, text: str = "text"
) -> DataFrame:
    """chunk_id, content_hash, status (cached, completed or failed) and report of every chunk; the model reads those alone whose stored report does not hold.

    ``chunks`` has chunk_id (distinct text), content_hash and the text. New reports are written, in the buckets that
    hold them, before they are used; a failed one is kept with its message and tried again by the next run. Reports of
    chunks that are not asked for stay stored.
    """
    asked = chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "content_hash", F.col(text).alias("text"))
    marks = None

    def step(version: Version) -> Version:
        nonlocal marks
        state = store.read("reports", version)
        marks = stored(incremental.cache_hits(asked, state.drop("report"), prompt_version, name, model, thinking))
        missed = marks.where(~F.col("hit")).select("chunk_id")
        touched = [r["bucket"] for r in missed.select(store.bucket().alias("bucket")).distinct().collect()]  # at most one row per bucket
        if not touched:
            return version
        new = asked.join(missed, "chunk_id", "left_semi")
        # what a model said is written once, before the buckets are, so that trying again asks no model
        said = stored(map_chunks(new, runner)).join(new.select("chunk_id", "content_hash"), "chunk_id")
        path = F.concat(F.lit(f"{run_id}/"), "chunk_id", F.lit(".md"))
        fixed = {"prompt_version": prompt_version, "runner_type": name, "model": model, "thinking": thinking}
        rows = said.select("chunk_id", "content_hash", "status", "report", path.alias("report_path"), *[F.lit(v).cast("string").alias(k) for k, v in fixed.items()])
        kept = store.read("reports", version, touched).join(missed, "chunk_id", "left_anti")
        return store.replace(version, {"reports": kept.unionByName(rows)}, touched, run_id)

    after = store.change(step)
    found = store.read("reports", after).select("chunk_id", "status", "report")
    return marks.join(found, "chunk_id").select("chunk_id", "content_hash", F.when(F.col("hit"), "cached").otherwise(F.col("status")).alias("status"), "report")


def chunk_reports(records: DataFrame) -> DataFrame:
    """The stand-in report of every chunk record: project, chunk_id and report.

    It says what a chunk covers, which paths and commands are its evidence (six of each), where the evidence
    belongs, and that one chunk alone proves no habit.
    """
    shown = lambda c: F.slice(c, 1, 6)
    named = lambda c: F.when(F.size(c) > 0, F.array_join(shown(c), ", ")).otherwise("none")
    count = lambda c: F.size(shown(c)).cast("string")
    sources = F.when(F.size("source_sessions") > 0, F.array_join("source_sessions", ", ")).otherwise("none")
    paths = F.slice(F.when(F.size("changed") > 0, F.col("changed")).otherwise(F.col("referenced")), 1, 3)
    surface = F.when(F.size(paths) > 0, F.array_join(paths, ", ")).otherwise("the paths above")
    text = F.concat(
        F.lit("# Chunk report: "), "chunk_id", F.lit("\n\n## Story\n- covers: "), "start_time", F.lit(" to "), "end_time", F.lit("; sessions: "), sources, F.lit("\n- relevance: "), "relevance",
        F.lit("\n- changed paths: "), count("changed"), F.lit("; referenced paths: "), count("referenced"), F.lit("; commands: "), count("commands"),
        F.lit("\n\n## Signals\n### 1. Paths and commands of the project\n- evidence: changed="), named("changed"), F.lit("; referenced="), named("referenced"), F.lit("; commands="), named("commands"),
        F.lit("\n- belongs to: project_context\n- scope: likely project level; other chunks must confirm it\n- priority: high\n- work goes on at: "), surface,
        F.lit("\n\n### 2. The limits of one chunk\n- evidence: sessions="), sources, F.lit("; relevance="), "relevance", F.lit("\n- belongs to: discard\n- scope: this chunk\n- priority: low\n\n## Not supported\n- lasting preferences, or patterns across projects\n"),
    )
    return records.select("project", "chunk_id", text.alias("report"))


def stand_in_bundles(heads: DataFrame, chunks: DataFrame, critique: str = "") -> DataFrame:
    """project and the bundle of three documents that the stand-in writes from the ordered ``heads`` of a synthesis and the finished ``chunks`` (project, chunk, chunk_id, used)."""
    lists = heads.where("kind <> 'sessions'").groupBy("project").pivot("kind", ["changed", "referenced", "commands"]).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]))
    said = heads.where("kind = 'sessions'").groupBy("project").agg(F.count(F.lit(1)).alias("n_sessions"))
    ids = lambda ok: F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("chunk", "chunk_id")))), lambda x: x["chunk_id"])
    sides = chunks.groupBy("project").agg(ids(F.col("used")).alias("used"), ids(~F.col("used")).alias("ignored"))
    rows = sides.join(said, "project", "left").join(lists, "project", "left")
    some = lambda c, k=None: F.coalesce(F.slice(c, 1, k) if k else F.col(c), F.array().cast("array<string>"))
    listed = lambda a: F.when(F.size(a) > 0, F.array_join(a, ", ")).otherwise("none")
    evidence, commands = listed(some("used")), some("commands")
    surface = F.when(F.size(some("changed")) > 0, some("changed")).otherwise(some("referenced"))
    note = "\n## Revision note\n- evidence was bound more tightly after the last critique" if critique else ""
    documents = {
        "project_context.md": F.concat(
            F.lit("# Project context\n\n## Overview\n- chunks: "), evidence, F.lit("\n- sessions: "), F.coalesce("n_sessions", F.lit(0)).cast("string"), F.lit("\n- chunks of low relevance: "), listed(some("ignored")), F.lit("\n- work goes on at: "), listed(F.slice(surface, 1, 5)),
            F.lit("\n\n## Files\n"), bullets(F.concat(some("changed"), some("referenced"))), F.lit("\n\n## Validation\n"), bullets(commands), F.lit(note),
        ),
        "collaboration_guide.md": F.concat(F.lit("# Collaboration guide\n\n## Start\n- agree on paths first: "), listed(F.slice(surface, 1, 3)), F.lit("\n- agree on the commands that decide: "), listed(F.slice(commands, 1, 3)), F.lit("\n\n## Evidence\n- "), evidence, F.lit(note)),
        "patterns.md": F.concat(F.lit("# Patterns\n\n## Keep the evidence of chunks, then combine\n- chunks: "), evidence, F.lit("\n- paths: "), listed(F.slice(surface, 1, 4)), F.lit("\n\n## Check the least that proves it\n- commands: "), listed(F.slice(commands, 1, 4)), F.lit(note)),
    }
    return rows.select("project", render_bundle(F.create_map(*[x for n, d in documents.items() for x in (F.lit(n), d)])).alias("bundle"))


def chunk_report(key: Column, sessions: Column, referenced: Column, commands: Column) -> Column:
    """The stand-in report of a chunk as a column, for runs without a model."""
    return F.concat(F.lit("# Chunk "), key.cast("string"), F.lit("\n## Sessions\n"), bullets(sessions), F.lit("\n## Files\n"), bullets(referenced), F.lit("\n## Commands\n"), bullets(commands))


def parse_validation(text: Column, threshold: float = 35.0) -> Column:
    """(score, passed, summary, rubric, failed_dimensions, must_fix, underrepresented, overweighted, rewrite_direction, critique).

    passed follows the score alone; a normalised score counts five times; the default is 0. The
    critique states all that the verdict holds, a line for each.
    """

    def listed(title: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.array(F.lit(f"- {title}:")), F.transform(items, lambda x: F.concat(F.lit("  - "), x)))).otherwise(F.array().cast("array<string>"))

    def whole(v: Column) -> Column:
        p = v["p"]
        score = F.bround(F.coalesce(p["raw_score"], p["normalized_score"] * 5, F.lit(0.0)), 2)
        passed = score >= threshold
        some = lambda f: F.coalesce(p[f], F.array().cast("array<string>"))
        rubric = F.transform_values(F.coalesce(p["dimension_scores"], F.create_map().cast("map<string,double>")), lambda _, x: F.bround(x, 2))
        ways = F.coalesce(p["rewrite_direction"], F.create_map().cast("map<string,array<string>>"))
        summary = F.coalesce(F.nullif(p["summary"], F.lit("")), F.when(passed, PASSED).otherwise(NOT_PASSED))
        under, over = some("which_chunk_underrepresented"), some("which_chunk_overweighted")
        to_way = lambda e: F.concat(F.array(F.concat(F.lit("  - "), e["key"], F.lit(":"))), F.transform(F.coalesce(e["value"], F.array().cast("array<string>")), lambda x: F.concat(F.lit("    - "), x)))
        lines = F.concat(
            F.array(F.concat(F.lit("# Self-validation critique (score "), score.cast("string"), F.lit("/50)")), F.lit(""), F.concat(F.lit("- summary: "), summary)),
            listed("dimension_scores", F.transform(F.map_entries(rubric), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string")))),
            listed("failed_dimensions", some("failed_dimensions")), listed("must_fix", some("must_fix")),
            listed("which_chunk_underrepresented", under), listed("which_chunk_overweighted", over),
            F.when(F.size(F.map_keys(ways)) > 0, F.concat(F.array(F.lit("- rewrite_direction:")), F.flatten(F.transform(F.map_entries(ways), to_way)))).otherwise(F.array().cast("array<string>")),
            F.array(F.lit(f"- threshold: {float(threshold)}"), F.concat(F.lit("- passed: "), F.when(passed, "True").otherwise("False"))),
        )
        return F.struct(
            score.alias("score"), passed.alias("passed"), summary.alias("summary"), rubric.alias("rubric"), some("failed_dimensions").alias("failed_dimensions"), some("must_fix").alias("must_fix"),
            under.alias("underrepresented"), over.alias("overweighted"), ways.alias("rewrite_direction"), F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("critique"),
        )

    # the payload is parsed once and bound
    return F.element_at(F.transform(F.array(F.struct(F.from_json(json_object(text), PAYLOAD).alias("p"))), whole), 1)


def rubric_mean(rubric: Column) -> Column:
    """The mean of a verdict's dimension scores, to two places; 0 without any."""
    points = F.map_values(rubric)
    return F.when(F.size(points) > 0, F.bround(F.aggregate(points, F.lit(0.0), lambda a, x: a + x) / F.size(points), 2)).otherwise(F.lit(0.0))


def render_bundle(documents: Column) -> Column:
    """The three documents (a map from name to text) behind their markers; null if any is missing or blank."""
    parts = [F.regexp_replace(documents[n], r"(?U)^\s+|\s+\z", "") for n in BUNDLE]
    ok = parts[0] != ""
    for p in parts[1:]:
        ok = ok & (p != "")
    sections = [F.concat(F.lit(f"=== {n} ===\n"), p) for n, p in zip(BUNDLE, parts, strict=True)]
    return F.when(ok, F.concat(F.concat_ws("\n\n", *sections), F.lit("\n")))


def split_bundle(text: Column) -> Column:
    """The three documents between their markers, as a map; null unless all are there, in order, and none is blank."""
    a, b, c = (n.replace(".", r"\.") for n in BUNDLE)
    pattern = rf"(?s)=== {a} ===\s*(.*?)\s*=== {b} ===\s*(.*?)\s*=== {c} ===\s*(.*)\z"
    parts = [F.regexp_replace(F.regexp_extract(text, pattern, i), r"(?U)^\s+|\s+\z", "") for i in (1, 2, 3)]
    ok = text.rlike(pattern) & (parts[0] != "") & (parts[1] != "") & (parts[2] != "")
    return F.when(ok, F.create_map(*[x for n, p in zip(BUNDLE, parts, strict=True) for x in (F.lit(n), p)]))


def render_prompt(template: str, values: dict[str, str]) -> str:
    """A prompt template with its {{KEY}} marks filled in."""
    for key, value in values.items():
        template = template.replace("{{" + key + "}}", value)
    return template


def chunk_prompt(template: str, chunk_path: str, version: str) -> str:
    return render_prompt(template, {"CHUNK_FILE": chunk_path}).rstrip() + f"\n\n---\nPrompt version: {version}\n"


def bundle_format() -> str:
    """What a bundle looks like, for prompts."""
    return "\n\n".join(f"=== {n} ===\n...markdown..." for n in BUNDLE)


def bundle_prompt(template: str, critique: str = "", first: str = "(no critique yet: write the first bundle)") -> str:
    """The prompt of a synthesis, with the critique of the try before."""
    return render_prompt(template, {"CRITIQUE_BLOCK": critique.strip() or first, "BUNDLE_FORMAT": bundle_format()})


def validation_prompt(template: str, threshold: float = 35.0, retries: int = 2) -> str:
    """The prompt by which a model judges its own bundle."""
    return render_prompt(template, {"THRESHOLD": f"{threshold:.0f}", "MAX_RETRIES": str(retries)})


def build_runner(name: str, command: Callable[[Request], str] | None = None) -> Runner:
    """The runner of a name: the deterministic one, or the caller's adapter of a model's command line."""
    if name == "fake":
        return stand_in
    if name == "cli-json" and command is not None:
        return command
    raise ValueError(f"unsupported runner: {name}")


#: Lines of a run whose deltas are joined in one piece before the pieces are.
PIECE = 4096


def fold_runner_events(lines: DataFrame, key: str = "run_id", order: str = "line_no", text: str = "line") -> DataFrame:
    """Per run: joined deltas, the last assistant text, the text that counts (that, or the deltas without one), the last model and the last error.

    Malformed lines are skipped. Deltas are joined in pieces of some thousand lines first, and of a run only its pieces meet.
    """
    e = F.from_json(text, EVENT)
    rows = lines.select(key, order, e.alias("e")).where("e.type IS NOT NULL")
    kind, message = F.col("e.type"), F.col("e.message")
    update, ended = kind == "message_update", (kind == "message_end") & (message["role"] == "assistant")
    delta = F.when(update & (F.col("e.assistantMessageEvent.type") == "text_delta"), F.col("e.assistantMessageEvent.delta"))
    parts = F.filter(message["content"], lambda p: p["type"] == "text")
    said = F.when(ended & (F.size(parts) > 0), F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""))
    failed = F.when((kind == "auto_retry_end") & ~F.coalesce("e.success", F.lit(False)), F.col("e.finalError")).when((kind == "compaction_end") & F.col("e.aborted"), F.col("e.errorMessage"))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col(order)))
    one = rows.groupBy(key).agg(last(said).alias("final_text"), last(F.when(update | ended, message["model"])).alias("model"), last(F.nullif(failed, F.lit(""))).alias("error"))
    joined = lambda at, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("o"), value.alias("d")))), lambda x: x["d"]), "")
    deltas = rows.select(key, order, delta.alias("d")).where("d IS NOT NULL")
    pieces = deltas.groupBy(key, F.floor(F.col(order) / PIECE).alias("piece")).agg(joined(order, F.col("d")).alias("d"))
    streamed = pieces.groupBy(key).agg(joined("piece", F.col("d")).alias("streamed"))
    out = one.join(streamed, key, "left").withColumn("streamed", F.coalesce("streamed", F.lit("")))
    return out.select(key, "streamed", "final_text", F.coalesce(F.nullif("final_text", F.lit("")), "streamed").alias("text"), "model", "error")


def said_by(stdout: str) -> tuple[str, str | None]:
    """The text that counts and the last error of one run's event lines, as ``fold_runner_events`` has them."""
    deltas, final, error = [], None, None
    for line in stdout.splitlines():
        try:
            event = json.loads(line)
        except ValueError:
            continue
        if not isinstance(event, dict):
            continue
        message = event.get("message") or {}
        match event.get("type"):
            case "message_update":
                update = event.get("assistantMessageEvent") or {}
                deltas += [update.get("delta") or ""] if update.get("type") == "text_delta" else []
            case "message_end" if message.get("role") == "assistant":
                parts = [p.get("text") or "" for p in message.get("content") or [] if p.get("type") == "text"]
                final = "".join(parts) if parts else final
            case "auto_retry_end" if not event.get("success"):
                error = event.get("finalError") or error
            case "compaction_end" if event.get("aborted"):
                error = event.get("errorMessage") or error
    return final or "".join(deltas), error


@dataclass(frozen=True)
class CommandRunner:
    """A model behind a command line that reads a prompt and prints one JSON event per line.

    ``command`` may hold {task}, {session} and {attempt}. The prompt goes to its standard input: the template of the task (``prompts``),
    the critique, and the text. It fails with the last error that the events tell, else with what the command says
    of it, if it ends badly, says nothing, or takes too long.
    """

    command: tuple[str, ...]
    prompts: tuple[tuple[str, str], ...] = ()
    timeout: float = 1200

    def __call__(self, request: Request) -> str:
        import subprocess

        prompt = "\n\n---\n".join(x for x in (dict(self.prompts).get(request.task, "").strip(), request.critique.strip(), request.text) if x)
        names = {"task": request.task, "session": request.session, "attempt": request.attempt}
        done = subprocess.run([c.format(**names) for c in self.command], input=prompt, capture_output=True, text=True, timeout=self.timeout, check=False)
        text, error = said_by(done.stdout)
        if done.returncode:
            raise RuntimeError(error or " ".join(done.stderr.split()) or f"the command ended with {done.returncode}")
        if not text.strip():
            raise RuntimeError(error or "the command's events hold no text")
        return text


def synthesise(packet: str, runner: Runner, judge: Callable[[str], float], threshold: float = 35.0, retries: int = 2) -> dict:
    """Generate, judge, and hand the critique to the next try, until a try passes or the tries are used up."""
    critique, best = "", {}
    for attempt in range(retries + 1):
        text = runner(Request("synthesis", packet + critique))
        score = judge(text)
        best = {"attempt": attempt + 1, "text": text, "score": score, "status": "completed" if score >= threshold else "needs_review"}
        if score >= threshold:
            break
        critique = f"\n\nThe last try scored {score:g} of {sum(RUBRIC.values())}; {threshold:g} are needed."
    return best


def _asked(rows: DataFrame, runner: Runner, task: str, text: str, attempt: int) -> DataFrame:
    """project, said and error: one call of the model per row, written before it is used."""
    ship(rows.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            said, errors = [], []
            for t, c, s in zip(*(batch.column(x).to_pylist() for x in ("text", "critique", "session")), strict=True):
                try:
                    said.append(runner(Request(task, t or "", attempt, c or "", s or "")))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001  a model may fail in any way
                    said.append(None)
                    errors.append(str(error) or type(error).__name__)
            yield pa.RecordBatch.from_arrays([batch.column("project"), pa.array(said, pa.string()), pa.array(errors, pa.string())], names=["project", "said", "error"])

    session = stable_session_id(F.concat(F.lit("distill-"), F.col("project").cast("string")))
    asked = rows.select(F.col("project").cast("string").alias("project"), F.col(text).alias("text"), "critique", session.alias("session"))
    return stored(asked.mapInArrow(work, "project string, said string, error string"))


def synthesise_projects(packets: DataFrame, runner: Runner, threshold: float = 35.0, retries: int = 2) -> tuple[DataFrame, DataFrame]:
    """Writes and judges a bundle for every project, and again for those that fail, with their critique; the results and all tries.

    ``packets`` has project (distinct) and packet. A round is two distributed steps over the open projects only:
    the bundle (the model gets the packet and the last critique), then the verdict on it. Results have project, attempt,
    status, score, bundle, documents and error: completed at the first try that passes, needs_review when the tries are used up,
    failed when the model fails, or says what is no bundle; an empty table has none. Rounds are stored tables, so a lost
    executor repeats the calls of its own rows at most.
    """
    open_ = packets.select(F.col("project").cast("string").alias("project"), "packet", F.lit("").alias("critique"))
    tries = None
    for attempt in range(1, retries + 2):
        wrote = _asked(open_, runner, "synthesis", "packet", attempt)
        bundles = wrote.select("project", F.col("said").alias("bundle"), split_bundle(F.col("said")).alias("documents"), F.coalesce("error", F.when(split_bundle(F.col("said")).isNull(), "no bundle")).alias("error"))
        good = bundles.where("error IS NULL").withColumn("critique", F.lit(""))
        judged = _asked(good, runner, "validation", "bundle", attempt).select("project", "said", F.col("error").alias("judge_error"))
        verdict = judged.select("project", "judge_error", parse_validation(F.col("said"), threshold).alias("v"))
        error = F.coalesce("error", "judge_error")
        status = F.when(error.isNotNull(), "failed").when(F.col("v.passed"), "completed").when(F.lit(attempt > retries), "needs_review").otherwise("open")
        rows = bundles.join(verdict, "project", "left").select("project", F.lit(attempt).alias("attempt"), status.alias("status"), F.when(error.isNull(), F.col("v.score")).alias("score"), "bundle", "documents", F.col("v.critique").alias("critique"), error.alias("error"))
        rows = stored(rows)
        tries = rows if tries is None else tries.unionByName(rows)
        again = rows.where("status = 'open'").select("project", "critique")
        if again.isEmpty():
            break
        open_ = open_.select("project", "packet").join(again, "project")
    return tries.where("status <> 'open'").drop("critique"), tries


def rubric_scores(score: float) -> dict[str, float]:
    """A total spread over the dimensions in proportion to their points."""
    return {k: round(v * score / sum(RUBRIC.values()), 2) for k, v in RUBRIC.items()}
