"""Incremental validation of arriving call documents (H1).

Each call is validated once, however often it is delivered.  An arriving row is
checked where it was read (a stream-static join with the broadcast function
schema, then the row-local status expression); its text is dropped, and rows are
told apart by call id in a keyed state.  A watermark on the arrival (the time of
the file) bounds that state: an id is forgotten when it arrived longer ago than
the delay.  Files are read oldest first, so no call is late, whenever it was
sent.  A copy that is delivered after its id was forgotten is written again, and
``read_results`` keeps the first.  The file sink's log records which batch wrote
which files, so a batch that is run again after a stop adds nothing; the
checkpoint holds the input files read and the state.  The batch form is C2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from callscope.functions import status as S
from callscope.operators.catalog import attach_schema

CALLS_DDL = "call_id BIGINT, function STRING, text STRING"
DELAY = "1 day"  # how long after a call its copies may arrive and be known as such
NAMELESS = "nameless_digest"


def validated_stream(spark: SparkSession, source_dir: str, catalog: DataFrame,
                     schema: str = CALLS_DDL, max_files_per_trigger: int | None = None, delay: str = DELAY) -> DataFrame:
    """call_id, function, status, nameless_digest, arrived_at of each call in the files of ``source_dir``.

    Copies of a call that arrive within ``delay`` of it are left out; of those
    that arrive together any one counts.  Calls without an id are told apart by
    the digest of function and text, which is null for the others.
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    calls = reader.parquet(source_dir)
    digest = F.when(F.col("call_id").isNull(), F.sha2(F.to_json(F.struct("function", "text")), 256))
    calls = calls.select("call_id", "function", "text", digest.alias(NAMELESS), F.col("_metadata.file_modification_time").alias("arrived_at"))
    checked = S.add_status(attach_schema(calls, catalog)).select("call_id", "function", "status", NAMELESS, "arrived_at")
    return checked.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["call_id", NAMELESS])


def validate_stream(spark: SparkSession, source_dir: str, catalog: DataFrame, sink_dir: str,
                    checkpoint_dir: str, available_now: bool = True, processing_time: str | None = None,
                    max_files_per_trigger: int | None = None, delay: str = DELAY) -> StreamingQuery:
    """H1: start the streaming validation into ``sink_dir`` (parquet, append).

    The number of state partitions is that of ``spark.sql.shuffle.partitions`` at
    the first start; with ids in the hundreds of millions within the delay,
    choose Spark's RocksDB state store.
    """
    out = validated_stream(spark, source_dir, catalog, max_files_per_trigger=max_files_per_trigger, delay=delay)
    writer = (
        out.writeStream.format("parquet")
        .option("path", sink_dir)
        .option("checkpointLocation", checkpoint_dir)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def read_results(spark: SparkSession, sink_dir: str) -> DataFrame:
    """call_id, function, status of what ``validate_stream`` wrote: one row for each call, the first that arrived."""
    first = F.min_by(F.struct("function", "status"), "arrived_at").alias("first")
    rows = spark.read.parquet(sink_dir).groupBy("call_id", NAMELESS).agg(first)
    return rows.select("call_id", F.col("first.function").alias("function"), F.col("first.status").alias("status"))
