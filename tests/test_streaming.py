"""H1: each call is validated once, redelivered or not; a restarted stream resumes."""

import os
import pathlib
import tempfile

import pytest
from pyspark.sql import functions as F

from callscope.operators import calls as C
from callscope.sources import fixtures as FX
from callscope.streaming import validate_stream as H
from conftest import SMALL


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="callscope-stream-", dir="/tmp")


@pytest.fixture
def few_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def run(spark, root, catalog, **more):
    query = H.validate_stream(spark, f"{root}/source", catalog, f"{root}/sink", f"{root}/checkpoint", **more)
    query.awaitTermination()
    return query


def test_each_call_once_after_redelivery_and_restart(spark, root, few_partitions):
    calls = FX.v_calls(spark, SMALL).cache()
    catalog = FX.v_catalog(spark, SMALL)
    first, second = calls.where(F.col("call_id") % 2 == 0), calls.where(F.col("call_id") % 2 == 1)
    first.unionByName(first.where("call_id % 3 = 0")).repartition(3).write.parquet(f"{root}/source")
    run(spark, root, catalog, max_files_per_trigger=2)
    assert spark.read.parquet(f"{root}/sink").count() == first.count()
    second.unionByName(first).coalesce(2).write.mode("append").parquet(f"{root}/source")  # new calls and copies of the old, while stopped
    run(spark, root, catalog, max_files_per_trigger=1)
    out = spark.read.parquet(f"{root}/sink")
    assert out.count() == calls.count() and out.select("call_id").distinct().count() == calls.count()
    expected = C.call_status(calls, catalog)
    got = H.read_results(spark, f"{root}/sink")
    assert got.exceptAll(expected).count() == 0 and expected.exceptAll(got).count() == 0


def test_stop_between_writing_and_commit(spark, root, few_partitions):
    calls, catalog = FX.v_calls(spark, SMALL), FX.v_catalog(spark, SMALL)
    calls.coalesce(1).write.parquet(f"{root}/source")
    run(spark, root, catalog)
    commits = pathlib.Path(root, "checkpoint", "commits")
    last = max(int(p.name) for p in commits.iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):  # as if the driver had died before it
        (commits / name).unlink()
    calls.coalesce(1).write.mode("append").parquet(f"{root}/source")
    run(spark, root, catalog)
    out = spark.read.parquet(f"{root}/sink")
    assert out.count() == calls.count() and out.select("call_id").distinct().count() == calls.count()


def test_state_is_bounded_and_late_copies_count_once(spark, root, few_partitions):
    catalog = FX.v_catalog(spark, SMALL)

    def deliver(hour, *rows):
        before = set(pathlib.Path(root).glob("source/*.parquet"))
        spark.createDataFrame(rows, H.CALLS_DDL).coalesce(1).write.mode("append").parquet(f"{root}/source")
        for file in set(pathlib.Path(root).glob("source/*.parquet")) - before:
            os.utime(file, (1_700_000_000 + 3600 * hour,) * 2)
        return run(spark, root, catalog, delay="1 hour")

    deliver(0, (1, "click", '{"k": 1}'), (4, "click", '{"k": 1}'))
    deliver(5, (2, "click", '{"k": 1}'))
    query = deliver(6, (3, "click", '{"k": 1}'), (2, "click", "copy"))
    state = [o.numRowsTotal for p in query.recentProgress for o in p.stateOperators]
    assert state[-1] == 2  # 1 and 4 are forgotten
    deliver(7, (1, "click", "copy"), (3, "click", "copy"), (5, "click", '{"k": 1'))
    written = sorted(r["call_id"] for r in spark.read.parquet(f"{root}/sink").collect())
    assert written == [1, 1, 2, 3, 4, 5]
    got = {r["call_id"]: r["status"] for r in H.read_results(spark, f"{root}/sink").collect()}
    assert got == {1: "TERMINAL", 2: "TERMINAL", 3: "TERMINAL", 4: "TERMINAL", 5: "INCOMPLETE"}


def test_missing_ids(spark, root, few_partitions):
    rows = [(None, "click", '{"k": 1}'), (None, "click", '{"k": 1'), (None, "click", '{"k": 1}'), (None, None, None), (5, "none such", "{}")]
    spark.createDataFrame(rows, H.CALLS_DDL).repartition(2).write.parquet(f"{root}/source")
    run(spark, root, FX.v_catalog(spark, SMALL))
    got = sorted(((r["call_id"], r["status"]) for r in H.read_results(spark, f"{root}/sink").collect()), key=str)
    assert got == sorted([(None, "TERMINAL"), (None, "INCOMPLETE"), (None, None), (5, "REJECTED")], key=str)
