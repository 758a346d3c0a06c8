"""Sources of messages and tool calls: JSON-lines session logs and the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_command, one_line, sanitize

ENTRY = (
    "struct<type:string,id:string,timestamp:string,provider:string,modelId:string,"
    "message:struct<role:string,model:string,content:array<struct<type:string,text:string,name:string,arguments:string>>>>"
)


def session_dir_name(cwd: str) -> str:
    """The folder of a project's logs."""
    return "--" + cwd.strip("/").replace("/", "-") + "--"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """session_file, line_no (from 0) and line of all logs; files are read in splits.

    A row's place within its split follows from the rows' ids, which ascend by split and line; the
    lines of the splits before are counted in a first, narrow pass.
    """
    raw = spark.read.text(folder, pathGlobFilter="*.jsonl")
    at = raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line")
    )
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = at.groupBy("file", "split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    splits = splits.withColumn("lines", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = (F.col("lines") + F.col("id") - F.col("first")).cast("int")
    return at.join(splits, ["file", "split"]).select(F.element_at(F.split("file", "/"), -1).alias("session_file"), place.alias("line_no"), "line")


def entries(spark: SparkSession, folder: str, *, strict: bool = True) -> DataFrame:
    """One row per log line: session_file, line_no, entry. Blank lines are skipped, and counted in the numbers.

    Long files are read in splits; ``strict`` raises on a malformed line, else it has a null entry. A
    missing folder raises.
    """
    lines = _lines(spark, folder).where(F.trim("line") != "")
    entry = F.from_json("line", ENTRY, {"mode": "FAILFAST" if strict else "PERMISSIVE"})
    return lines.select("session_file", "line_no", entry.alias("entry"))


_CONTENT = "array<struct<type:string,text:string,name:string,arguments:string>>"


def text_of(content):
    """Text parts, joined by line feeds."""
    return F.array_join(F.transform(F.filter(content, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "\n")


def tool_calls_of(content):
    return F.filter(content, lambda p: p["type"] == "toolCall")


def messages_from_entries(log: DataFrame) -> DataFrame:
    """session_file, line_no, role, text, tool_calls of the messages of a log."""
    content = F.coalesce("entry.message.content", F.array().cast(_CONTENT))
    return log.where("entry.type = 'message'").select(
        "session_file", "line_no", F.col("entry.message.role").alias("role"), F.col("entry.timestamp").alias("timestamp"), text_of(content).alias("text"), F.size(tool_calls_of(content)).alias("tool_calls")
    )


def _model_name():
    return F.trim(F.concat(sanitize(F.col("entry.provider")), F.lit("/"), sanitize(F.col("entry.modelId"))), F.lit("/"))


def models(log: DataFrame) -> DataFrame:
    """session_file, line_no, model: every change of model that names one, as provider/model."""
    return log.where("entry.type = 'model_change'").select("session_file", "line_no", _model_name().alias("model")).where("model <> ''")


def model_counts(log: DataFrame) -> DataFrame:
    return models(log).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_file").alias("n_sessions"))


def with_model(log: DataFrame) -> DataFrame:
    """The log with the model that each line was said under: the last change before it in its session."""
    before = Window.partitionBy("session_file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    changed = log.join(models(log), ["session_file", "line_no"], "left")
    return changed.withColumn("model", F.last("model", ignorenulls=True).over(before))


def tool_calls_from_entries(log: DataFrame, cwd: str = "") -> DataFrame:
    """session, turn, ord, tool, path, command: tool calls after the first user message; nameless calls are left out.

    Commands are normalised, with the project's folder ``cwd`` as a placeholder, so that counts join what differs by place or time only.
    """
    by_line = Window.partitionBy("session_file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    said = log.where("entry.type = 'message' AND entry.message.role IN ('user', 'assistant')").withColumn("turn", F.sum(F.when(F.col("entry.message.role") == "user", 1).otherwise(0)).over(by_line).cast("int"))
    calls = said.where("entry.message.role = 'assistant' AND turn > 0").select("session_file", "turn", "line_no", F.posexplode(tool_calls_of(F.col("entry.message.content"))).alias("place", "call"))
    named = calls.where("call.name <> ''")
    argument = lambda f: F.nullif(F.get_json_object("call.arguments", f"$.{f}"), F.lit(""))
    return named.select(F.col("session_file").alias("session"), "turn", F.struct("line_no", "place").alias("ord"), F.col("call.name").alias("tool"), argument("path").alias("path"), F.nullif(normalize_command(argument("command"), cwd), F.lit("")).alias("command"))


def messages_from_conversations(conversations: DataFrame) -> DataFrame:
    """The table of conversations as messages. Tool calls are a stand-in: the text's length modulo 3 for assistants."""
    return conversations.select(
        F.col("conv_id").cast("string").alias("session_file"), F.col("turn").cast("int").alias("line_no"), "role", F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("role") == "assistant", F.length(F.coalesce("text", F.lit(""))) % 3).otherwise(0).cast("int").alias("tool_calls"),
    )


def tool_calls_from_events(events: DataFrame) -> DataFrame:
    """The table of events as tool calls: a session per user, a turn per active day, in order of time.

    view, purchase and signup read, edit and write the path p0 to p9; error and click run commands.
    """
    k = F.get_json_object("props", "$.k").cast("int") % 10
    tool = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "purchase", "edit").when(F.col("event_type") == "signup", "write").otherwise("bash")
    command = F.when(F.col("event_type") == "error", F.concat(F.lit("run test "), k)).otherwise(F.concat(F.lit("open "), k))
    days = Window.partitionBy("user_id").orderBy(F.to_date("ts"))
    return events.select(
        F.col("user_id").cast("string").alias("session"), F.dense_rank().over(days).cast("int").alias("turn"), F.struct("ts", "event_id").alias("ord"), tool.alias("tool"),
        F.when(tool != "bash", F.concat(F.lit("p"), k, F.when(k < 5, ".py").otherwise(""))).alias("path"), F.when(tool == "bash", command).alias("command"),
    )


def session_metadata(log: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row per session of a log: id, first and last time, counts; with ``files`` also size, time and fingerprint."""
    e = F.col("entry")
    calls = F.when(e["message"]["role"] == "assistant", F.size(tool_calls_of(e["message"]["content"]))).otherwise(0)
    at = lambda c, ok: F.max_by(F.when(ok, c), F.when(ok, F.col("line_no")))
    message = e["type"] == "message"
    out = log.groupBy("session_file").agg(
        at(e["id"], e["type"] == "session").alias("session_id"), at(e["timestamp"], e["type"] == "session").alias("started_at"), at(e["timestamp"], message).alias("last_message_at"),
        F.count_if(message).alias("message_count"), F.count_if(message & (e["message"]["role"] == "user")).alias("user_turn_count"), F.coalesce(F.sum(F.when(message, calls)), F.lit(0)).alias("tool_call_count"),
    )
    if files is None:
        return out
    stat = files.select(F.element_at(F.split("path", "/"), -1).alias("session_file"), F.col("length").alias("size_bytes"), F.unix_seconds("modificationTime").alias("mtime"))
    return out.join(stat, "session_file").withColumn("fingerprint", F.concat_ws(":", "size_bytes", "mtime"))


def session_summaries(log: DataFrame, cwd: str = "") -> DataFrame:
    """One row per session of a log, as a report lists them: file, id, start, user turns, messages, tool calls, tools with
    their counts in order of first use, every change of model in order, and the preview of the first user text that is not blank.

    Tool calls count from the first user message on; a session without messages has zeros and empty lists.
    """
    e = F.col("entry")
    last = lambda c, ok: F.max_by(F.when(ok, c), F.when(ok, F.col("line_no")))
    message = e["type"] == "message"
    asked = message & (e["message"]["role"] == "user")
    preview = F.when(asked, one_line(text_of(F.coalesce(e["message"]["content"], F.array().cast(_CONTENT))), 180))
    model = F.when(e["type"] == "model_change", _model_name())
    base = log.withColumn("_preview", F.nullif(preview, F.lit(""))).withColumn("_model", F.nullif(model, F.lit(""))).groupBy("session_file").agg(
        last(e["id"], e["type"] == "session").alias("session_id"), last(e["timestamp"], e["type"] == "session").alias("started_at"),
        F.count_if(asked).alias("user_turns"), F.count_if(message).alias("message_count"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_model").isNotNull(), F.struct("line_no", "_model")))), lambda x: x["_model"]).alias("models"),
        F.min_by("_preview", F.when(F.col("_preview").isNotNull(), F.col("line_no"))).alias("first_user_preview"),
    )
    used = tool_calls_from_entries(log, cwd).groupBy("session", "tool").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    used = used.groupBy(F.col("session").alias("session_file")).agg(F.sum("n").alias("tool_calls"), F.array_sort(F.collect_list(F.struct("first", "tool", "n"))).alias("held"))
    tools = F.transform(F.coalesce("held", F.array().cast(used.schema["held"].dataType)), lambda x: F.struct(x["tool"].alias("tool"), x["n"].alias("n")))
    out = base.join(used, "session_file", "left")
    return out.select(
        F.col("session_file").alias("file"), F.coalesce("session_id", F.lit("")).alias("session_id"), F.coalesce("started_at", F.lit("")).alias("started_at"), "user_turns", "message_count",
        F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"), tools.alias("tools"), "models", F.coalesce("first_user_preview", F.lit("")).alias("first_user_preview"),
    )


def log_from_conversations(conversations: DataFrame) -> DataFrame:
    """The table of conversations as lines of session logs, read back by their schema: session_file, line_no, entry.

    A conversation is a session; its first turn is preceded by a session line, every fourth by a change of model. An
    assistant's text has as many tool calls as its length modulo 4 says, on a path named by the turn.
    """
    n = F.length(F.coalesce("text", F.lit("")))
    name = F.concat(F.lit("f"), (F.col("turn") % 3).cast("string"), F.lit(".py"))
    part = lambda **v: F.struct(*[(x if isinstance(x, F.Column) else F.lit(x)).alias(k) for k, x in v.items()])
    tool = lambda k: F.element_at(F.array(F.lit("read"), F.lit("edit"), F.lit("bash")), (n + k) % 3 + 1)
    calls = F.when(F.col("role") == "assistant", F.transform(F.slice(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(1), n % 4), lambda k: part(type="toolCall", text=F.lit(None).cast("string"), name=tool(k), arguments=part(path=name))))
    none = F.array().cast("array<struct<type:string,text:string,name:string,arguments:struct<path:string>>>")
    said = part(type="text", text=F.col("text"), name=F.lit(None).cast("string"), arguments=F.lit(None).cast("struct<path:string>"))
    lines = F.array(
        F.when(F.col("turn") == 1, F.to_json(part(type="session", id=F.concat(F.lit("s"), F.col("conv_id").cast("string")), timestamp=F.concat(F.lit("t"), F.col("conv_id").cast("string"))))),
        F.when(F.col("turn") % 4 == 1, F.to_json(part(type="model_change", provider=F.col("role"), modelId=F.concat(F.lit("m"), (n % 5).cast("string"))))),
        F.to_json(part(type="message", message=part(role=F.col("role"), content=F.concat(F.array(said), F.coalesce(calls, none))))),
    )
    each = conversations.select(F.col("conv_id").cast("string").alias("session_file"), "turn", F.posexplode(lines).alias("i", "line")).where("line IS NOT NULL")
    return each.select("session_file", (F.col("turn") * 3 + F.col("i")).cast("int").alias("line_no"), F.from_json("line", ENTRY).alias("entry"))


def file_stats(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame:
    """Path, length and time of files; their content is never read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length", "modificationTime")


def compiled_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Compiled session texts (*.min.txt): session_name, start_time, text, min_path and the path of the full text beside it (null without one), in order of start time; an empty file is no session."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.min.txt")
    at = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    stem = lambda c, end: F.regexp_replace(F.element_at(F.split(c, "/"), -1), end, "")
    name = stem(at, r"\.min\.txt$")
    texts = raw.select(name.alias("session_name"), F.substring_index(name, "_", 1).alias("start_time"), F.col("value").alias("text"), at.alias("min_path"))
    full = file_stats(spark, folder, "*.txt").select(F.regexp_replace("path", "^file:/+", "/").alias("txt_path")).where(~F.col("txt_path").endswith(".min.txt"))
    return texts.join(full.withColumn("session_name", stem(F.col("txt_path"), r"\.txt$")), "session_name", "left").orderBy("start_time", "session_name")
