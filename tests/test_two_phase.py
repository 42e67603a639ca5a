"""Every prompt ends exactly once, whatever the scorer answers."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from test_io_prompts_pipeline import catalog_df

from callscope.operators import prompts as D
from callscope.plans import two_phase as T
from callscope.session import broadcast_if_small, spread

WEATHER = {"name": "get_weather", "description": "Get the weather", "parameters": {"location": {"type": "string"}},
           "returns": {"type": "string"}}


def many(n):
    return [{"name": f"fn_{i}", "description": f"Does {i}.", "parameters": {"a": {"type": "integer"}}, "returns": {"type": "null"}}
            for i in range(n)]


def counting(spark, answer):
    """A scorer that counts the rows it is asked for, over all tasks."""
    asked = spark.sparkContext.accumulator(0)

    def run(df):
        schema = StructType([*df.schema.fields, StructField("output", StringType())])

        def batches(it):
            for pdf in it:
                asked.add(len(pdf))
                pdf["output"] = [answer(t, a) for t, a in zip(pdf["text"], pdf["attempt"])]
                yield pdf

        return df.mapInPandas(batches, schema)

    return run, asked


def prompts_df(spark, n):
    return spark.createDataFrame([(i, f"weather {i}") for i in range(n)], "prompt_id long, prompt string").repartition(4)


def test_random_scorers_lose_and_repeat_nothing(spark):
    route = lambda t, a: random.choice(['{"name": "get_weather"}', '{"name": "none"}', '{"name": "get_w', '{"name": "zzz"}', "", None])
    extract = lambda t, a: random.choice(['{"location": "x"}\n', '{"location": "x', '{"place": 1}', None])
    router, _ = counting(spark, route)
    extractor, _ = counting(spark, extract)
    results, errors = T.run_two_phase(prompts_df(spark, 500), catalog_df(spark, [WEATHER]), router, extractor)
    for _ in range(2):  # reading again gives the same rows
        ended = [r["prompt_id"] for r in results.collect()] + [r["prompt_id"] for r in errors.collect()]
        assert sorted(ended) == list(range(500))
    assert {(r["phase"], r["reason"]) for r in errors.collect()} == {
        ("route", "rejected"), ("route", "incomplete"), ("extract", "rejected"), ("extract", "incomplete")}
    assert {r["parameters"] for r in results.collect()} == {"{}", '{"location": "x"}'}


def test_each_prompt_costs_one_scoring_and_its_retries(spark):
    route = lambda t, a: '{"name": "get_weather"}' if a == 2 or "weather 1" in t else '{"name": '
    extract = lambda t, a: '{"location": "x"}' if a == 2 or "weather 2" in t else '{"location": "x'
    router, routings = counting(spark, route)
    extractor, extractions = counting(spark, extract)
    results, errors = T.run_two_phase(prompts_df(spark, 4), catalog_df(spark, [WEATHER]), router, extractor)
    assert results.count() == 4 and errors.count() == 0
    assert routings.value == 4 + 3 and extractions.value == 4 + 3


@pytest.mark.parametrize("n", [0, 5, 1200])
def test_catalog_size_changes_no_answer(spark, n):
    catalog = catalog_df(spark, many(n)) if n else catalog_df(spark, many(1)).limit(0)
    prompts = spark.createDataFrame([(7, "call FN_3 and fn_1"), (7, "fn_4!"), (8, "nothing"), (9, None)], "prompt_id long, prompt string")
    scored = T.lexical_router(catalog)(prompts.withColumn("text", F.lit("")))
    got = sorted((r["prompt_id"], r["output"]) for r in scored.collect())
    names = ["fn_1", "fn_4"] if n else ["none", "none"]
    assert got == sorted([(7, f'{{"name": "{names[0]}"}}'), (7, f'{{"name": "{names[1]}"}}'), (8, '{"name": "none"}'), (9, '{"name": "none"}')])
    text = D.build_router_prompts(prompts.limit(1), catalog).first()["text"]
    lines = [f"- fn_{i}: Does {i}." for i in range(n)]
    assert text == D.ROUTER_HEADER + "".join(x + "\n" for x in lines) + D.ROUTER_EXAMPLES + 'User: "call FN_3 and fn_1"\nOutput:'


def test_spread_runs_no_job(spark):
    scan = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    group = "spread-test"
    spark.sparkContext.setJobGroup(group, "")
    assert spread(scan).count
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_broadcast_only_below_both_bounds(spark):
    df = spark.range(100)
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_small(df))
    assert not hinted(broadcast_if_small(df, max_rows=99))
    assert not hinted(broadcast_if_small(df.selectExpr("repeat('é', 100) s"), max_bytes=20_000))


def failing(spark, answer, word):
    """A counting scorer whose tasks die at a prompt that holds the word."""
    def sudden(t, a):
        if word in t:
            raise RuntimeError("stopped")
        return answer(t, a)

    return counting(spark, sudden)


ROUTE = lambda t, a: '{"name": "none"}' if "weather 7" in t else '{"name": "get_weather"}'
EXTRACT = lambda t, a: '{"location": "x"}' if a == 2 or "weather 1" in t else '{"location": "x'


def test_stopped_batch_asks_for_nothing_twice(spark, tmp_path):
    prompts, catalog, folder = prompts_df(spark, 40), catalog_df(spark, [WEATHER]), f"{tmp_path}/run"
    router, routings = counting(spark, ROUTE)
    dying, _ = failing(spark, EXTRACT, "weather 33")
    with pytest.raises(Exception, match="stopped"):
        T.run_two_phase(prompts, catalog, router, dying, run_dir=folder)
    assert routings.value == 40
    extractor, extractions = counting(spark, EXTRACT)
    results, errors = T.run_two_phase(prompts, catalog, router, extractor, run_dir=folder)
    assert results.count() == 40 and errors.count() == 0
    assert routings.value == 40 and extractions.value == 39 + 28  # 11 prompts go through at once; the others are asked for again
    results, errors = T.run_two_phase(prompts_df(spark, 42).where("prompt_id != 5"), catalog, router, extractor, run_dir=folder)
    assert sorted(r["prompt_id"] for r in results.collect()) == sorted({*range(42)} - {5}) and errors.count() == 0
    assert routings.value == 42 and extractions.value == 39 + 28 + 4


def test_stopped_slice_is_the_only_one_asked_for_again(spark, tmp_path):
    prompts, catalog, folder = prompts_df(spark, 60), catalog_df(spark, [WEATHER]), f"{tmp_path}/run"
    dying, _ = failing(spark, ROUTE, "weather 16")  # in the fourth slice
    with pytest.raises(Exception, match="stopped"):
        T.run_two_phase(prompts, catalog, dying, run_dir=folder, slices=6)
    router, routings = counting(spark, ROUTE)
    extractor, extractions = counting(spark, lambda t, a: '{"location": "x"}')
    store = T.RunStore(spark, folder)
    held = spark.read.parquet(*store.parts("route-1")).count() if store.parts("route-1") else 0
    results, errors = T.run_two_phase(prompts, catalog, router, extractor, run_dir=folder, slices=6)
    assert sorted(r["prompt_id"] for r in results.collect()) == list(range(60)) and errors.count() == 0
    assert routings.value == 60 - held and 0 < held < 60 and extractions.value == 59


def test_unfinished_parts_are_not_read(spark, tmp_path):
    store = T.RunStore(spark, f"{tmp_path}/run")
    rows = spark.createDataFrame([(1, "a", "x")], "prompt_id long, text string, output string")
    store.add("route-1", rows)
    rows.write.parquet(f"{tmp_path}/run/route-1/part-cut-short")
    assert len(store.parts("route-1")) == 1
    asked = store.answers("route-1", rows.select("prompt_id", "text"), lambda df: df.withColumn("output", F.lit("again")))
    assert [r["output"] for r in asked.collect()] == ["x"]


def test_recorded_outputs_replay(spark):
    ddl = "prompt_id long, attempt int, output string"
    routed = spark.createDataFrame([(i, 1, '{"name": "get_weather"}') for i in range(3)] + [(3, 1, '{"na'), (3, 2, '{"name": "none"}')], ddl)
    extracted = spark.createDataFrame([(0, 1, '{"location": "a"}'), (1, 1, '{"location": "b'), (1, 2, '{"location": "b"}')], ddl)
    results, errors = T.run_two_phase(prompts_df(spark, 5), catalog_df(spark, [WEATHER]), T.table_scorer(routed), T.table_scorer(extracted))
    assert {(r["prompt_id"], r["name"], r["parameters"]) for r in results.collect()} == {
        (0, "get_weather", '{"location": "a"}'), (1, "get_weather", '{"location": "b"}'), (3, "none", "{}")}
    assert {tuple(r) for r in errors.collect()} == {(2, "extract", "incomplete"), (4, "route", "incomplete")}


def test_whole_prompt_texts(spark):
    catalog = catalog_df(spark, [WEATHER, {"name": "fn_reverse_string", "description": "Reverse.", "parameters": {"s": {"type": "string"}, "n": {"type": "integer"}},
                                           "returns": {"type": "string"}}])
    prompts = spark.createDataFrame([(1, 'Say "hi"', "get_weather"), (2, "abc", "fn_reverse_string")], "prompt_id long, prompt string, name string")
    router = {r["prompt_id"]: r["text"] for r in D.build_router_prompts(prompts, catalog).collect()}
    assert router[1] == (D.ROUTER_HEADER + "- get_weather: Get the weather\n- fn_reverse_string: Reverse.\n"
                         + D.ROUTER_EXAMPLES + 'User: "Say "hi""\nOutput:')
    texts = {r["prompt_id"]: r["text"] for r in D.build_extractor_prompts(prompts, catalog).collect()}
    tail = D.EXTRACTOR_RULES + D.EXTRACTOR_GENERIC_EXAMPLES
    assert texts[1] == (D.EXTRACTOR_HEADER + "Function: get_weather\nParameters:\n  location (string)\n\n" + tail + "\n" + D.EXTRACTOR_REMINDER
                        + 'User: "Say "hi""\nFunction: get_weather\nOutput:\n')
    _, contradiction, examples = D.FUNCTION_EXAMPLES[0]
    assert texts[2] == (D.EXTRACTOR_HEADER + "Function: fn_reverse_string\n" + contradiction + "Parameters:\n  s (string)\n  n (integer)\n\n"
                        + tail + examples + "\n" + D.EXTRACTOR_REMINDER + 'User: "abc"\nFunction: fn_reverse_string\nOutput:\n')


def test_spread_bounds_the_bytes_of_a_task(spark):
    scan = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert spread(scan).rdd.getNumPartitions() == max(cores, scan.rdd.getNumPartitions())
    size = scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    tasks = spread(scan, size // (4 * cores)).rdd.getNumPartitions()
    assert tasks >= 4 * cores and spread(scan, size // (4 * cores)).count() == 15000


def test_small_catalog_moves_no_prompt(spark):
    prompts = prompts_df(spark, 4).withColumn("text", F.lit(""))
    plan = lambda n: T.lexical_router(catalog_df(spark, many(n)))(prompts)._jdf.queryExecution().executedPlan().toString()
    outer = lambda text: text.split("Subquery")[0]
    assert "Join" not in outer(plan(5)) and "Join" in plan(1200)


def test_answers_are_checked_once(spark):
    results, errors = T.run_two_phase(prompts_df(spark, 4), catalog_df(spark, [WEATHER]))
    for df in (results, errors):
        assert "RLIKE" not in df._jdf.queryExecution().executedPlan().toString()


def test_parts_without_a_status_are_checked_as_they_are_read(spark, tmp_path):
    folder, prompts, catalog = f"{tmp_path}/run", prompts_df(spark, 4), catalog_df(spark, [WEATHER])
    router, routings = counting(spark, ROUTE)
    requests = D.build_router_prompts(prompts.where("prompt_id < 2"), catalog, keep=("prompt",)).withColumn("attempt", F.lit(1))
    T.RunStore(spark, folder).add("route-1", router(requests))
    extractor, _ = counting(spark, lambda t, a: '{"location": "x"}')
    results, errors = T.run_two_phase(prompts, catalog, router, extractor, run_dir=folder)
    assert results.count() == 4 and errors.count() == 0 and routings.value == 4
