"""Evaluation against expected calls.

``expected`` / ``actual``: ``(prompt_id, name, parameters)`` with
``parameters`` the JSON object text.  Parameters compare by their parsed
key/raw-value pairs, so whitespace and key order do not matter while ``2``
and ``2.0`` stay different (raw values are compared, not decoded numbers).

Only complete objects compare at all: a text that is cut short, goes on after
its brace or is no object matches nothing.  Every prompt of either side counts
once.  A prompt without a result is ``<missing>``, one with several results
``<repeated>`` and a result without an expected call ``<unexpected>``; none of
them is right on any measure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions import status as S
from callscope.functions.grammar import JAVA as G

MISSING = "<missing>"
REPEATED = "<repeated>"
UNEXPECTED = "<unexpected>"
ALL = "__all__"


def complete_fields(text: Column) -> Column:
    """Sorted (key, raw value) pairs of a complete parameters object; null for any other text."""
    keys, vals = S.document_items(text)
    pairs = F.array_sort(F.zip_with(keys, vals, lambda k, v: F.struct(k.alias("key"), v.alias("raw"))))
    return F.when(text.rlike(G.document) | text.rlike(G.empty_object), pairs)


def _one_per_prompt(calls: DataFrame, side: str) -> DataFrame:
    """prompt_id, ``side``_name and ``side``_fields; of a repeated prompt the name REPEATED and no fields."""
    n = F.count(F.lit(1))
    fields = complete_fields(F.col("parameters"))
    return calls.select("prompt_id", "name", fields.alias("fields")).groupBy("prompt_id").agg(
        F.when(n > 1, F.lit(REPEATED)).otherwise(F.first("name")).alias(f"{side}_name"),
        F.when(n == 1, F.first("fields")).alias(f"{side}_fields"),
    )


def compared(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row per prompt of either side, with routing_ok and params_ok."""
    j = _one_per_prompt(expected, "exp").join(_one_per_prompt(actual, "act"), "prompt_id", "full_outer")
    j = j.withColumn("exp_name", F.coalesce("exp_name", F.lit(UNEXPECTED)))
    j = j.withColumn("act_name", F.coalesce("act_name", F.lit(MISSING)))
    return j.select(
        "*",
        ((F.col("act_name") == F.col("exp_name")) & (F.col("act_name") != REPEATED)).alias("routing_ok"),
        F.coalesce(F.col("act_fields") == F.col("exp_fields"), F.lit(False)).alias("params_ok"),
    )


def accuracy_report(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """G1: per expected function and overall: routing, parameters, exact, accuracy."""
    flags = compared(expected, actual).select(
        F.col("exp_name").alias("function"), F.col("routing_ok").alias("r"), F.col("params_ok").alias("p"))
    agg = flags.rollup("function").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.count_if("r").cast("bigint").alias("routing_ok"),
        F.count_if("p").cast("bigint").alias("params_ok"),
        F.count_if(F.col("r") & F.col("p")).cast("bigint").alias("exact_ok"),
        F.grouping("function").alias("_g"),
    )
    return agg.select(
        F.when(F.col("_g") == 1, F.lit(ALL)).otherwise(F.col("function")).alias("function"),
        "n", "routing_ok", "params_ok", "exact_ok",
        F.round(F.col("exact_ok") / F.col("n"), 6).alias("accuracy"),
    )


def parameter_report(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """G1 by parameter: per expected function, key and value class, how many values were extracted."""
    j = compared(expected, actual).select(
        F.col("exp_name").alias("function"), F.explode("exp_fields").alias("e"), "act_fields")
    same = F.exists("act_fields", lambda a: (a["key"] == F.col("e.key")) & (a["raw"] == F.col("e.raw")))
    rows = j.select(
        "function", F.col("e.key").alias("key"), S.value_class(F.col("e.raw")).alias("value_class"),
        F.coalesce(same, F.lit(False)).alias("ok"))
    return rows.groupBy("function", "key", "value_class").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.count_if("ok").cast("bigint").alias("n_ok"),
    ).withColumn("accuracy", F.round(F.col("n_ok") / F.col("n"), 6))


def routing_confusion(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Counts of (expected name, produced name)."""
    return compared(expected, actual).groupBy(F.col("exp_name").alias("expected"), F.col("act_name").alias("actual")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n")
    )
