"""A1-A3: only whole JSON lists load, and a prompt id names one prompt."""

import json

import pytest

from callscope.sources import catalog_io as A

GOOD = '[{"prompt": "a]}[{"}, {"prompt": "q\\"]"}]'
BAD = [GOOD + "]", GOOD + " trailing", GOOD + ", []", GOOD + GOOD, GOOD[:-1], "[" + GOOD, "", "x", '["a" "b"]', "[1] 2", '{"a": 1} {"b": 2}', "1 2", '"a" "b"', None]


def docs(spark, texts):
    return spark.createDataFrame([(f"s{i:02d}", t) for i, t in enumerate(texts)], "source string, text string")


def test_text_after_the_list_is_refused(spark):
    rows = A.definition_rejects(docs(spark, [GOOD, *BAD]), "prompt").collect()
    assert {(r["source"], r["reason"]) for r in rows} == {(f"s{i:02d}", "invalid_json") for i in range(1, len(BAD) + 1)}
    for text in BAD:
        with pytest.raises((json.JSONDecodeError, TypeError)):
            json.loads(text)


def test_other_roots_are_no_lists(spark):
    rows = A.definition_rejects(docs(spark, ['{"a": [1]}', " 12 ", '"[]"', "null", "true"]), "prompt").collect()
    assert [r["reason"] for r in rows] == ["root_not_list"] * 5


def test_white_space_around_a_list_is_fine(spark):
    assert A.definition_rejects(docs(spark, ["\n " + GOOD + " \n", "[]"]), "prompt").count() == 0


def test_prompt_ids_are_unique_over_documents(spark):
    got = A.parse_prompts(docs(spark, [GOOD, BAD[0], GOOD, "[]", GOOD])).orderBy("prompt_id").collect()
    assert [(r["prompt_id"], r["source"], r["prompt"]) for r in got] == [
        (i, s, p) for i, (s, p) in enumerate((s, p) for s in ("s00", "s02", "s04") for p in ("a]}[{", 'q"]'))]


def test_one_scan_and_no_join(spark, tmp_path):
    docs(spark, [GOOD, *BAD]).write.parquet(f"{tmp_path}/docs")
    stored = spark.read.parquet(f"{tmp_path}/docs")
    for df, maps in ((A.parse_function_catalog(stored), 2), (A.definition_rejects(stored), 2), (A.definition_rejects(stored, "prompt"), 1)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") == 1 and "Join" not in plan and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        # the list once, then each element once (and a function's parameters, for their order)
        assert plan.count("from_json(ArrayType") == 1 and plan.count("from_json(MapType") == maps and plan.count("get_json_object") == maps - 1
