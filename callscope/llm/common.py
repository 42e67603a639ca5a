"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.session import ensure_checkpoint_dir


BROADCAST_PARTITIONS = 1_000_000


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, as ``--py-files`` would; once for each application.

    Tasks import it by name, which else works only where the workers happen to
    start in its folder or have it on their path.
    """
    package = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _shipped or not package.is_dir():
        return
    path = Path(tempfile.mkdtemp()) / f"{package.name}-{uuid.uuid4().hex}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(package.rglob("*")):
            if source.suffix in (".py", ".txt"):
                out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def with_package(work: Callable) -> Callable:
    """A query or stage (its first argument is the session) whose tasks can import this package."""

    @functools.wraps(work)
    def run(spark: SparkSession, *args):
        ship_package(spark)
        return work(spark, *args)

    return run


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage: what follows reads committed files, so a lost executor costs
    its own tasks only and never repeats (or re-decides) what came before.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prefix_sums(staged: DataFrame, part: str, size: str, base: str) -> DataFrame:
    """Add to each row the total of ``size`` over all partitions before its own.

    Two passes: per-partition totals are summed (one row per partition goes to
    the driver), their running sums come back as a small table that is joined
    on the partition number.  Rows carry their own place in their partition.
    The table has a row per partition, so it is broadcast up to a million
    partitions (16 MB); beyond that Spark plans the join by its own statistics.
    """
    totals = sorted(staged.groupBy(part).agg(F.sum(size).alias("s")).collect())
    rows, at = [], 0
    for r in totals:
        rows.append((r[part], at))
        at += r["s"]
    bases = staged.sparkSession.createDataFrame(rows, f"{part} int, {base} long")
    return staged.join(F.broadcast(bases) if len(rows) <= BROADCAST_PARTITIONS else bases, part)


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that a batch's texts are not all Python strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))
