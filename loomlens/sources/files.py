"""Small files around a run: manifests, JSON documents, excerpts, and where inputs lie. All on the driver."""

from __future__ import annotations

import datetime as dt
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens
from ..operators import chunking
from .sessions import compiled_sessions


def load_json(path: str | Path, default=None):
    """The JSON document, or ``default`` where there is no such file."""
    p = Path(path)
    return json.loads(p.read_text(encoding="utf-8")) if p.exists() else default


def required(path: str | Path) -> Path:
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(f"required input is missing: {p}")
    return p


def first_existing(path: str, bases: list[Path], fallback: Path | None = None) -> Path:
    """An absolute path as it is; a relative one below the first base that has it, else below the fallback."""
    p = Path(path)
    if p.is_absolute():
        return p
    return next((b / p for b in bases if (b / p).exists()), (fallback or bases[-1]) / p)


def input_folders(root: str | Path, names: tuple[str, ...] = ("workflow", "corrections")) -> dict[str, Path]:
    """The folders of the named results below a run's root; missing ones raise."""
    return {n: required(Path(root) / n) for n in names}


def manifest_sessions(spark: SparkSession, folder: str, manifest: str | None = None) -> DataFrame:
    """Compiled sessions by the manifest's items that have a name and an existing text, else by folder; sorted by start."""
    found = load_json(manifest, None) if manifest else None
    if not found:
        return compiled_sessions(spark, folder)
    rows, beside = [], [Path(manifest).parent, Path(folder)]
    for item in found.get("items", []):
        name, outputs = item.get("name"), item.get("outputs") or {}
        if name and outputs.get("min") and (path := first_existing(outputs["min"], beside)).exists():
            full = first_existing(outputs["txt"], beside) if outputs.get("txt") else None
            rows.append((name, name.split("_", 1)[0], str(path), str(full) if full and full.exists() else None, item.get("source_jsonl")))
    listed = spark.createDataFrame(rows, "session_name string, start_time string, min_path string, txt_path string, source_jsonl string")
    if not rows:
        return listed.selectExpr("session_name", "start_time", "source_jsonl", "txt_path", "min_path", "min_path AS text")
    texts = spark.read.text([r[2] for r in rows], wholetext=True).selectExpr("value AS text", "regexp_replace(_metadata.file_path, '^file:/*', '/') AS min_path")
    return listed.join(texts, "min_path", "left").withColumn("text", F.coalesce("text", F.lit(""))).select("session_name", "start_time", "source_jsonl", "txt_path", "min_path", "text").orderBy("start_time", "session_name")


def session_records(spark: SparkSession, folder: str, manifest: str | None = None) -> DataFrame:
    """One record per compiled session: its name, times and paths, its text with sizes, and what it read, changed and ran.

    Without a manifest (or items in it that are there) the folder's texts are taken, which name no log.
    """
    found = manifest_sessions(spark, folder, manifest)
    if manifest and found.isEmpty():
        found = compiled_sessions(spark, folder)
    if "source_jsonl" not in found.columns:
        found = found.withColumn("source_jsonl", F.lit(None).cast("string"))
    size = F.length("text").cast("long")
    traced = chunking.traces(found.select(F.col("session_name").alias("doc_id"), "text")).withColumnRenamed("doc_id", "session_name")
    return found.join(traced, "session_name").select(
        "session_name", "start_time", F.col("start_time").alias("end_time"), "min_path", "txt_path", "source_jsonl", size.alias("char_count"),
        F.when(F.col("text") != "", F.size(F.split("text", "\n", -1))).otherwise(0).alias("line_count"), estimate_tokens(size).alias("estimated_tokens"), "text", "referenced", "changed", "commands",
    )


def project_root(manifest: str | Path) -> Path | None:
    """The project that a manifest names, if the folder is there."""
    named = (load_json(manifest, {}) or {}).get("project")
    return Path(named) if named and Path(named).exists() else None


def excerpt(markdown: str, most: int = 32) -> list[str]:
    """The first headings, bullets, numbered lines and the date line of a report."""
    keep = re.compile(r"^(#|- |\d+\. |Generated:)")
    return [x.rstrip() for x in markdown.splitlines() if keep.match(x.strip())][:most]


def append_once(path: str | Path, line: str) -> bool:
    """Adds a line to a file unless it is there; tells whether it did."""
    p = Path(path)
    text = p.read_text(encoding="utf-8") if p.exists() else ""
    if line in text.splitlines():
        return False
    p.write_text(text + ("" if not text or text.endswith("\n") else "\n") + line + "\n", encoding="utf-8")
    return True


def run_id(now: dt.datetime | None = None) -> str:
    """A name for a run, by UTC time; tests pass the time."""
    return (now or dt.datetime.now(dt.UTC)).strftime("%Y%m%dT%H%M%SZ")
