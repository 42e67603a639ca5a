"""Positions, running sums and prefix intervals in a global order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.session import ensure_checkpoint_dir

_SHIFT = 1 << 33  # monotonically_increasing_id = partition_id * 2^33 + row index


def dense_index(df: DataFrame, *order_cols: str, out: str = "idx",
                partitions: int | None = None) -> DataFrame:
    """Attach ``out`` = position of each row in the order of ``order_cols``.

    The order columns must be unique per row.  Rows are range-partitioned and
    sorted within partitions, then reliably checkpointed so the partition
    assignment is fixed; the position is the row's index inside its partition
    plus the number of rows in all earlier partitions (one small count per
    partition, joined back by broadcast).  No step puts the whole data into one
    task; the number of ranges is the session's number of shuffle partitions.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    by_range = df.repartitionByRange(partitions, *order_cols) if partitions else df.repartitionByRange(*order_cols)
    ranged = (
        by_range.sortWithinPartitions(*order_cols)
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    pid = F.floor(F.col("_mid") / F.lit(_SHIFT)).cast("long")
    ranged = ranged.withColumn("_pid", pid)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: the window runs over as many rows.
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out_df = ranged.join(F.broadcast(offsets), "_pid")
    local = F.col("_mid") - F.col("_pid") * F.lit(_SHIFT)
    return out_df.withColumn(out, (F.col("_off") + local).cast("long")).drop("_mid", "_pid", "_off")


RUN = 1 << 16  # positions that are summed up in one window


def running_sum(df: DataFrame, position: str, value: str, out: str) -> DataFrame:
    """``position`` and the sum of ``value`` over all rows up to it; positions are unique and dense, from 0.

    Runs of positions are summed in windows of their own; the sums of the runs,
    a row for each 65,536 positions, are summed in one.
    """
    run = F.floor(F.col(position) / F.lit(RUN)).alias("_run")
    rows = df.select(position, value, run)
    totals = rows.groupBy("_run").agg(F.sum(value).alias("_total"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_run", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_run").orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("_within", F.sum(value).over(within)).join(offsets, "_run")
    return summed.select(position, (F.col("_within") + F.col("_before")).cast("long").alias(out))


def prefix_matches(prefixes: DataFrame, texts: DataFrame, prefix_col: str, text_col: str) -> DataFrame:
    """Each row of ``prefixes`` with each row of ``texts`` whose text begins with its prefix; all columns of both.

    In the order of their bytes the texts that begin with a prefix are an
    interval, so the prefixes' two ends are sorted in among the texts, and the
    ranks found there are joined.  No text is taken apart: what is shuffled are
    the texts, the ends and the answers.  Null texts and prefixes match nothing.
    """
    key = F.encode(F.col(text_col), "UTF-8")
    asked = prefixes.select(F.encode(F.col(prefix_col), "UTF-8").alias("_p")).where("_p is not null").distinct()
    end = F.concat("_p", F.lit(bytes([255])))  # no text holds this byte
    rows = texts.where(F.col(text_col).isNotNull()).select(key.alias("_key"), F.lit(1).alias("_n"), F.struct(*texts.columns).alias("_text"))
    none = F.lit(None).cast(rows.schema["_text"].dataType)
    ends = asked.select(F.explode(F.array(F.struct("_p", F.col("_p").alias("at"), F.lit(0).alias("side")),
                                          F.struct("_p", end.alias("at"), F.lit(1).alias("side")))).alias("e"))
    ends = ends.select(F.col("e.at").alias("_key"), F.lit(0).alias("_n"), none.alias("_text"), F.col("e._p").alias("_p"), F.col("e.side").alias("_side"))
    both = rows.withColumns({"_p": F.lit(None).cast("binary"), "_side": F.lit(None).cast("int")}).unionByName(ends)
    # equal texts stand behind an end there, in any order; the index tells them apart
    placed = dense_index(both, "_key", "_n", out="_at")
    ranks = running_sum(placed, "_at", "_n", "_rank")  # of texts up to here
    ranked = placed.join(ranks, "_at")
    found = ranked.where("_n = 1").select((F.col("_rank") - 1).alias("_rank"), "_text")
    interval = ranked.where("_n = 0").groupBy("_p").agg(
        F.max(F.when(F.col("_side") == 0, F.col("_rank"))).alias("_from"), F.max(F.when(F.col("_side") == 1, F.col("_rank"))).alias("_to"))
    interval = interval.where("_from < _to")
    answers = prefixes.withColumn("_p", F.encode(F.col(prefix_col), "UTF-8")).join(interval, "_p")
    answers = answers.withColumn("_rank", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1))).drop("_p", "_from", "_to")
    return answers.join(found, "_rank").select(*prefixes.columns, "_text.*")
