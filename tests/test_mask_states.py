"""F5 on states of every kind, against a direct check of every token."""

from pyspark.sql import functions as F
from test_io_prompts_pipeline import catalog_df

from callscope.functions import status as S
from callscope.operators import vocab as V
from callscope.operators.catalog import attach_schema

FNS = [
    {"name": "f", "description": "", "parameters": {"s": {"type": "string"}, "n": {"type": "number"}, "b": {"type": "boolean"}}, "returns": {"type": "null"}},
    {"name": "g", "description": "", "parameters": {"i": {"type": "integer"}, "z": {"type": "null"}}, "returns": {"type": "null"}},
]
STATES = [
    "", " \n", "{", "{ ", '{"', '{"s', '{"s"', '{"s" :', '{"s": "', '{"s": "abc', '{"s": "xyz\\', '{"s": "a\\u', '{"s": "b\\u1f', '{"s": "c\\u1fAb', '{"s": "a"', '{"s": "b" \t',
    '{"s": "a",', '{"n": -', '{"n": 0', '{"n": -0', '{"n": 17', '{"n": 3.', '{"n": 3.25', '{"n": 12 ', '{"n": 12\r', '{"n": 12,', '{"b": tr', '{"b": true', '{"b": 1',
    '{"s":"a","n":1,"b":fal', '{"s":"q","b":true,"n":5', '{"s":"q","b":true,"n":5}', '{"s":"q","b":true,"n":5} \n', '{"s":"q","b":true,"n":5}x', '{"n":1,"n"', '{"i": 4',
    '{"i": 98', '{"i": 4.', '{"z": nul', '{"z": null, "i": 7', '{"z": null, "i": 7}', "x",
]
TOKENS = ['"', "{", "}", ",", ":", " ", "\n", "\r", "0", "1", "25", ".5", ".", "-", "e", "true", "t", "rue", "false", "null", "l", "n", "s", 's"', '"s": "', '"n"', '"b":', '": ', "ab",
          'c"', '",', '"}', "\\", "n\\", "u00", "1f", "1f2a", "\\u00e9", '\\"', "},", "5}", "5 }", "0,", ', "n": 1', ', "b": true}', "} ", " }", "9.75,", "i", '"i": 3', "x"]


def test_masks_equal_a_check_of_every_token(spark):
    catalog = catalog_df(spark, FNS)
    states = spark.createDataFrame([(10 * i + k, f, t) for i, t in enumerate(STATES) for k, f in enumerate(("f", "g", "none"))],
                                   "state_id long, function string, text string")
    unique = spark.createDataFrame([(t, i, i) for i, t in enumerate(TOKENS)], "text string, token_id long, first_ord long")
    got = {(r["state_id"], r["token_id"]) for r in V.allowed_tokens(states, unique, catalog).collect()}
    every = states.crossJoin(unique.select("token_id", F.col("text").alias("t"))).withColumn("text", F.concat("text", "t"))
    live = S.add_status(attach_schema(every, catalog)).where(F.col("status") != S.REJECTED)
    assert got == {(r["state_id"], r["token_id"]) for r in live.collect()} and len(got) > 300
    assert V.reduced_states(states, catalog).select("schema", "text").distinct().count() < 60
