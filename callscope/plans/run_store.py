"""Scorer outputs that outlive a run: durable tables, one for each phase and attempt.

Asking a scorer is what a batch pays for, so its answers are written before they
are used, in parts that count once a marker says they are whole.  A run that is
started again with the same folder asks only for requests without an answer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.session import ensure_checkpoint_dir

Scorer = Callable[[DataFrame], DataFrame]

DONE = "_DONE"  # names with an underscore are no data to Spark


class RunStore:
    """Answers under ``folder``, any path that Spark can write; by default a new one in the cluster's checkpoint folder.

    ``slices`` is how many parts the open requests of an attempt are written in,
    one after another: what a stop can cost is the part that was being written.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, slices: int = 1):
        self.spark, self.slices = spark, slices
        self.folder = (folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}").rstrip("/")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def parts(self, name: str) -> list[str]:
        """The whole parts of a table; one that a stop has cut short has no marker and is never read."""
        files, table = self._files(), f"{self.folder}/{name}"
        if not files.exists(self._path(table)):
            return []
        found = [f"{table}/{status.getPath().getName()}" for status in files.listStatus(self._path(table))]
        return sorted(part for part in found if files.exists(self._path(f"{part}/{DONE}")))

    def add(self, name: str, rows: DataFrame) -> None:
        part = f"{self.folder}/{name}/part-{uuid.uuid4().hex}"
        rows.write.parquet(part)
        self._files().create(self._path(f"{part}/{DONE}")).close()

    def checked_answers(self, name: str, requests: DataFrame, scorer: Scorer, check: Scorer) -> DataFrame:
        """``answers`` with what ``check`` adds (``status`` at least), written beside them and so worked out once.

        Parts that were written without a status are checked as they are read.
        """
        bare = [part for part in self.parts(name) if "status" not in self.spark.read.parquet(part).columns]
        return self.answers(name, requests, lambda df: check(scorer(df)), lambda: self._checked(name, bare, check))

    def _checked(self, name: str, bare: list[str], check: Scorer) -> DataFrame:
        whole = [part for part in self.parts(name) if part not in bare]
        read = ([self.spark.read.parquet(*whole)] if whole else []) + ([check(self.spark.read.parquet(*bare))] if bare else [])
        return reduce(DataFrame.unionByName, read)

    def answers(self, name: str, requests: DataFrame, scorer: Scorer, read: Callable[[], DataFrame] | None = None) -> DataFrame:
        """The scorer's rows for ``requests``, asked for once each over all runs.

        Requests are told apart by prompt id and text; equal ones are asked for
        together and have as many answers as there are of them.  Answers to
        requests that this run doesn't make are left where they are.
        """
        key = F.sha2(F.to_json(F.struct("prompt_id", "text")), 256).alias("_key")
        known, todo = self.parts(name), requests
        if known:
            asked = requests.withColumn("_key", key)
            todo = asked.join(self.spark.read.parquet(*known).select(key).distinct(), "_key", "left_anti").drop("_key")
        if not known or not todo.isEmpty():
            part = F.pmod(F.xxhash64("prompt_id", "text"), F.lit(self.slices))
            for k in range(self.slices):
                self.add(name, scorer(todo.where(part == k) if self.slices > 1 else todo))
        out = read() if read else self.spark.read.parquet(*self.parts(name))
        if not known:
            return out
        return out.withColumn("_key", key).join(asked.select("_key").distinct(), "_key", "left_semi").drop("_key")
