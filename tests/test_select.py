"""Selection goldens: masked argmax, forced choices, deadlocks, budgets, routing."""

from pyspark.sql import functions as F

from callscope.operators import select as E
from callscope.sources.fixtures import v_token_steps


def test_masked_argmax_and_ties(spark):
    scores = spark.createDataFrame(
        [(1, i, s) for i, s in enumerate([999.0, 2.0, 5.5, 10.0, -1.0])]
        + [(2, 0, 1.0), (2, 1, 1.0), (2, 2, 1.0)],
        "step_id long, token_id long, score double")
    mask = spark.createDataFrame(
        [(1, 1, 0), (1, 3, 1), (2, 2, 0), (2, 0, 1), (2, 1, 2)], "step_id long, token_id long, ord long")
    best = {r["step_id"]: r["token_id"] for r in E.masked_argmax(scores, mask).collect()}
    assert best == {1: 3, 2: 2}  # highest allowed; on a tie the first allowed wins


def test_forced_and_deadlocks(spark):
    mask = spark.createDataFrame([(1, 42, 0), (2, 1, 0), (2, 3, 1)], "step_id long, token_id long, ord long")
    steps = spark.createDataFrame([(1,), (2,), (3,)], "step_id long")
    assert [tuple(r) for r in E.forced_choices(mask).collect()] == [(1, 42)]
    assert [r["step_id"] for r in E.deadlocks(steps, mask).collect()] == [3]


def test_over_budget(spark):
    rows = [(1, "route", i, "a") for i in range(51)] + [(2, "route", i, "b") for i in range(50)]
    rows += [(3, "extract", i, str(i % 10)) for i in range(301)]
    steps = spark.createDataFrame(rows, "prompt_id long, phase string, pos int, token string")
    out = {r["prompt_id"]: r for r in E.over_budget(steps).collect()}
    assert set(out) == {1, 3}
    assert out[1]["n_tokens"] == 51 and out[1]["partial_text"] == "a" * 50
    assert len(out[3]["partial_text"]) == 300


def test_over_budget_like_plain_python(spark):
    rows = [(p, f, i, f"{i % 7}\u00e9") for p, f, n in ((1, "route", 3), (2, "route", 2), (None, "route", 5), (4, None, 4), (5, "x", 3)) for i in range(n)]
    rows += [(6, "route", i, t) for t in "ba" for i in range(3)]  # given twice: by position, then by token
    rows += [(7, "route", 0, None), (7, "route", 1, "t"), (7, "route", None, "n"), (8, "route", 5, "u"), (8, "route", 6, "v"), (8, "route", 7, "w")]
    rows += [(100 + p, "route", i, str(p)) for p in range(300) for i in range(3)]
    steps = spark.createDataFrame(rows, "prompt_id long, phase string, pos int, token string")
    streams = {}
    for p, f, i, t in rows:
        streams.setdefault((p, f), []).append((i, t))
    expected = set()
    for (p, f), steps_of in streams.items():
        budget = 2 if f == "route" else 3 if f is None else 1 if f == "x" else None
        early = sorted((i, t) for i, t in steps_of if t is not None and i is not None and i < budget)
        if len(steps_of) > budget:
            expected.add((p, f, len(steps_of), budget, "".join(t for _, t in early)))
    default, E.DEFAULT_BUDGET = E.DEFAULT_BUDGET, 3
    try:
        out = E.over_budget(steps.repartition(3), {"route": 2, "x": 1})
    finally:
        E.DEFAULT_BUDGET = default
    assert out.columns == ["prompt_id", "phase", "n_tokens", "budget", "partial_text"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_token_steps_are_read_in_small_tasks(spark, tmp_path):
    """However large the table, a task has about a megabyte of a file's texts to cut and sort, not a share of the whole."""
    cores = spark.sparkContext.defaultParallelism
    texts = (cores + 4) * 512  # of 2 KB that a file cannot make smaller
    text = F.concat(*[F.sha2(F.concat("id", F.lit(f" {i}")), 256) for i in range(32)])
    spark.range(0, texts, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    steps = v_token_steps(spark, str(tmp_path))
    assert steps.rdd.getNumPartitions() >= cores + 4
    dealt = steps.select("prompt_id", F.spark_partition_id().alias("task")).distinct().groupBy("task").count().collect()
    assert sum(r["count"] for r in dealt) == texts and max(r["count"] for r in dealt) < 1024


def test_route_calls_unknown_and_none(spark):
    catalog = spark.createDataFrame(
        [(0, "get_weather", "", [(0, "location", "string")], "string")],
        "ord long, name string, description string, params array<struct<ord:int,key:string,type:string>>, returns string")
    sel = spark.createDataFrame([(1, "get_weather"), (2, "get_sports_scores"), (3, "none")],
                                "prompt_id long, selected string")
    got = {r["prompt_id"]: (r["name"], r["extract"]) for r in E.route_calls(sel, catalog).collect()}
    assert got == {1: ("get_weather", True), 2: ("none", False), 3: ("none", False)}


def test_argmax_deals_each_input_out_once(spark):
    scores = spark.createDataFrame([(1, 1, 1.0), (1, 2, None), (2, 5, None), (3, 1, 2.0), (3, 1, 3.0)], "step_id long, token_id long, score double")
    mask = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 5, 0), (2, 5, 1), (3, 1, 4), (4, 1, 0)], "step_id long, token_id long, ord long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        best = E.masked_argmax(scores, mask)
        plan = best._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan
        assert {r["step_id"]: (r["token_id"], r["score"]) for r in best.collect()} == {1: (1, 1.0), 2: (5, None), 3: (1, 3.0)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
