"""Session helpers: building a session, reading tables, size-checked broadcast."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its row count is proven below this bound.
# Catalog, type and domain tables are metadata (thousands of rows at most);
# anything above the bound is joined with a shuffle instead.
BROADCAST_MAX_ROWS = 200_000
# ... and only when its rows, serialized as JSON, are proven below this size.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024

# A call's text is built of few bytes of a file and takes some 0.1 to 0.3 ms to check.
CALL_TASK_BYTES = 512 * 1024

# Gathering a text's tokens sorts a row of some 100 bytes for each: some 40 times the documents' files, 90 times what
# Spark takes for the columns' share of them. A task's rows are few enough to be sorted in memory, whatever the table's size.
TOKEN_TASK_BYTES = 1024 * 1024

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(app: str = "callscope", cpus: str | None = None) -> SparkSession:
    """A session on this machine; on a cluster, pass the functions your own.

    Shuffle partitions stay as configured: adaptive execution merges small ones.
    """
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's ``spark.checkpoint.dir``.

    Only a local master (one machine, so every folder is shared) may go without
    the setting; it gets a new folder under /tmp.  On any other master the
    executors could not read such a folder, so a missing setting is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise ValueError(
                f"spark.checkpoint.dir is unset on master {master}: set it to a folder "
                "that the driver and all executors share"
            )
        current = tempfile.mkdtemp(prefix="callscope-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(scan: DataFrame, task_bytes: int | None = None) -> DataFrame:
    """Round-robin the rows of a table scan that yields fewer splits than cores.

    Validation is CPU-bound row-local work, and a single large file with one
    row group scans as one task.  With ``task_bytes`` no task gets more than
    about so many bytes of the files' columns, however large the table: where a
    row is small and costs much, a split of the usual size is too long a task.
    Without it, a table of more splits than cores is left untouched.  For scans
    only (a table's columns at most): their splits and sizes are known from the
    files without running a job, while behind a shuffle adaptive execution would
    run the query to tell them.
    """
    target = scan.sparkSession.sparkContext.defaultParallelism
    if task_bytes:
        size = int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        target = max(target, -(-size // task_bytes))
    return scan if scan.rdd.getNumPartitions() >= target else scan.repartition(target)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                       max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast only when it is proven small.

    Two measured bounds, both computed by one partially aggregated job on the
    (metadata-sized) side itself: the row count and the bytes of its rows
    serialized as JSON.  Beyond either bound the frame is returned unhinted and
    Catalyst/AQE plan a shuffle join.
    """
    row_bytes = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))
    n, size = df.agg(F.count(F.lit(1)), F.sum(row_bytes)).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df
