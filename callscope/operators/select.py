"""Candidate selection over score tables.

``scores(step_id, token_id, score)`` are what a scorer produced for each
decoding step; ``mask(step_id, token_id, ord)`` is the allowed set with its
enumeration order (``ord`` breaks ties: the first allowed candidate wins, as a
Python ``max`` over the allowed list does).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.grammar import ROUTER_FALLBACK
from callscope.operators.catalog import resolved
from callscope.session import broadcast_if_small

# Token budgets of the two phases and the default.
BUDGETS = {"route": 50, "extract": 300}
DEFAULT_BUDGET = 500


def apply_mask(scores: DataFrame, mask: DataFrame) -> DataFrame:
    """Scores of the allowed candidates only: an equi-join on step and token."""
    return scores.join(mask, ["step_id", "token_id"]).select("step_id", "token_id", "ord", "score")


def masked_argmax(scores: DataFrame, mask: DataFrame) -> DataFrame:
    """Highest raw score among the allowed candidates; ties -> lowest ``ord``.

    Scores and mask are dealt out by step together, in one exchange.  A step's
    rows are then in one task, so its candidates are matched by aggregation and
    the best is taken without another exchange; a step has no more rows than the
    vocabulary, twice.
    """
    kind = mask.schema["ord"].dataType
    given = scores.select("step_id", "token_id", "score", F.lit(None).cast(kind).alias("ord"), F.lit(True).alias("_given"))
    allowed = mask.select("step_id", "token_id", F.lit(None).cast(scores.schema["score"].dataType).alias("score"), "ord", F.lit(False).alias("_given"))
    dealt = given.unionByName(allowed).repartition("step_id")
    both = dealt.groupBy("step_id", "token_id").agg(
        F.max("score").alias("score"), F.min("ord").alias("ord"),
        (F.bool_or("_given") & ~F.bool_and("_given")).alias("_both")).where("_both")
    best = both.groupBy("step_id").agg(
        F.max_by(F.struct("token_id", "score"), F.struct(F.col("score"), -F.col("ord"))).alias("b")
    )
    return best.select("step_id", F.col("b.token_id").alias("token_id"), F.col("b.score").alias("score"))


def forced_choices(mask: DataFrame) -> DataFrame:
    """Steps with exactly one allowed candidate (no scoring needed)."""
    return (
        mask.groupBy("step_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("token_id").alias("token_id"))
        .where("_n = 1")
        .select("step_id", "token_id")
    )


def scoring_rows(scores: DataFrame, mask: DataFrame) -> DataFrame:
    """Rows still worth sending to a scorer: allowed, and not on a forced step."""
    forced = forced_choices(mask).select("step_id")
    return apply_mask(scores, mask).join(forced, "step_id", "left_anti")


def deadlocks(steps: DataFrame, mask: DataFrame) -> DataFrame:
    """Steps with no allowed candidate at all."""
    return steps.select("step_id").join(mask.select("step_id"), "step_id", "left_anti")


def route_calls(selected: DataFrame, catalog: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """E5: resolve the selected name; unknown or ``none`` -> ``none`` with no parameters.

    ``selected(prompt_id, selected)``; the first definition of a name wins.
    """
    names = broadcast_if_small(resolved(catalog).select(F.col("name").alias("_fn")))
    out = selected.join(names, selected["selected"] == names["_fn"], "left")
    return out.select(
        "prompt_id",
        F.coalesce(F.col("_fn"), F.lit(ROUTER_FALLBACK)).alias("name"),
        F.col("_fn").isNotNull().alias("extract"),
        *keep,
    )


def over_budget(steps: DataFrame, budgets: dict[str, int] | None = None) -> DataFrame:
    """(prompt, phase) streams longer than their token budget, with the partial text.

    ``steps(prompt_id, phase, pos, token)``.  One scan and one
    shuffle: each stream is counted and its first ``budget`` tokens gathered in
    the same partial aggregation, so a stream holding a third of all steps still
    moves at most ``budget`` tokens from each task.
    """
    budgets = budgets or BUDGETS
    b = F.lit(DEFAULT_BUDGET)
    for phase, n in budgets.items():
        b = F.when(F.col("phase") == phase, F.lit(n)).otherwise(b)
    b = b.cast("int")
    early = F.col("pos") < b
    # a task of more than a few streams sorts its rows before it gathers: a step past the budget brings its stream only
    s = steps.select("prompt_id", "phase", F.when(early, F.col("pos")).alias("pos"), F.when(early, F.col("token")).alias("token"))
    given = F.when(F.col("pos").isNotNull(), F.struct("pos", "token"))  # nulls are not collected
    out = s.groupBy("prompt_id", "phase").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_tokens"), F.collect_list(given).alias("_t"),
    ).withColumn("budget", b).where(F.col("n_tokens") > F.col("budget"))
    text = F.array_join(F.transform(F.array_sort("_t"), lambda x: x["token"]), "")
    return out.select("prompt_id", "phase", "n_tokens", "budget", text.alias("partial_text"))


def result_coverage(prompts: DataFrame, results: DataFrame, errors: DataFrame) -> DataFrame:
    """Prompts absent from the results, with the recorded cause (if any)."""
    missing = prompts.select("prompt_id").join(results.select("prompt_id"), "prompt_id", "left_anti")
    return missing.join(errors.select("prompt_id", "reason"), "prompt_id", "left").select(
        "prompt_id", F.coalesce("reason", F.lit("unknown")).alias("reason")
    )
