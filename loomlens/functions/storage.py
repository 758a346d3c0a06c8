"""Tables that cut lineage, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession) -> str:
    """The folder for checkpoints: the one that the cluster names; on a single machine a local one will do."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loomlens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(rows: DataFrame) -> DataFrame:
    """``rows`` as a reliable checkpoint; its partitions and their order stay."""
    checkpoints(rows.sparkSession)
    return rows.checkpoint()


#: Values of a column that Parquet keeps by number, in bytes: those of a vocabulary.
DICTIONARY_BYTES = 8 << 20
#: While a table is stored: Spark removes the shuffle files that led to it at the end, and not only when the driver collects
#: its garbage; and a batch for Python is bounded by its bytes, as the rows may be long.
WHILE_STORED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` written once in the shared folder, and read from there; the disk of the shuffles that led to them is freed."""
    path = f"{checkpoints(rows.sparkSession).rstrip('/')}/loomlens-{uuid.uuid4().hex}"
    conf = rows.sparkSession.conf
    before = {k: conf.get(k, None) for k in WHILE_STORED}
    try:
        for k, v in WHILE_STORED.items():
            conf.set(k, v)
        rows.write.option("parquet.dictionary.page.size", DICTIONARY_BYTES).parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Rows up to this number (some 100 bytes each as they are held) are broadcast to a join; more are shuffled.
BROADCAST_ROWS = 1 << 20


def small(table: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if its counted rows are within the bound."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
