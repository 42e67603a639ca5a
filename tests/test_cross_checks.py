"""Cross-checks between operators on the derived fixtures (sf0.001)."""

from pyspark.sql import functions as F

from callscope.functions import status as S
from callscope.operators import calls as C
from callscope.operators.catalog import attach_schema
from callscope.sources import fixtures as FX
from conftest import SMALL


def test_accept_equals_terminal(spark):
    for cat, calls in ((FX.v_catalog_wide, FX.v_calls_wide), (FX.v_catalog, FX.v_calls)):
        c, k = cat(spark, SMALL), calls(spark, SMALL)
        acc = C.validate_calls(k, c)
        st = C.call_status(k, c)
        bad = acc.join(st, ["call_id", "function"]).where(
            F.col("accepted") != (F.col("status") == S.TERMINAL))
        assert bad.count() == 0


def test_no_violation_iff_terminal(spark):
    v = C.call_violations(FX.v_calls_wide(spark, SMALL), FX.v_catalog_wide(spark, SMALL))
    bad = v.where((F.size("violations") == 0) != (F.col("status") == S.TERMINAL))
    assert bad.count() == 0


def test_prefix_closure_of_terminal_documents(spark):
    calls, cat = FX.v_calls_wide(spark, SMALL), FX.v_catalog_wide(spark, SMALL)
    term = C.call_status(calls, cat).where(F.col("status") == S.TERMINAL).select("call_id")
    docs = calls.join(term, "call_id")
    prefixes = docs.select(
        "call_id", "function", F.explode(F.sequence(F.lit(0), F.length("text"))).alias("n"), "text"
    ).select("call_id", "function", F.expr("substring(text, 1, n)").alias("text"))
    st = S.add_status(attach_schema(prefixes, cat))
    assert st.where(F.col("status") == S.REJECTED).count() == 0
    assert st.count() > 1000


def test_first_error_char_is_refused(spark):
    """The reported prefix is viable and one more character makes it REJECTED."""
    calls, cat = FX.v_calls(spark, SMALL), FX.v_catalog(spark, SMALL)
    err = C.first_error_position(calls, cat).join(calls, ["call_id", "function"])
    probe = err.select(
        "call_id", "function",
        F.expr("substring(text, 1, valid_prefix_len)").alias("ok_text"),
        F.expr("substring(text, 1, valid_prefix_len + 1)").alias("bad_text"),
    )
    a = S.add_status(attach_schema(probe.withColumnRenamed("ok_text", "text"), cat)).where(
        F.col("status") == S.REJECTED)
    b = S.add_status(attach_schema(probe.drop("text").withColumnRenamed("bad_text", "text"), cat)).where(
        F.col("status") != S.REJECTED)
    assert a.count() == 0 and b.count() == 0


def test_column_form_equals_frame_form(spark):
    calls, cat = FX.v_calls_wide(spark, SMALL), FX.v_catalog_wide(spark, SMALL)
    df = S.add_status(attach_schema(calls, cat))
    col = S.call_status(F.col("text"), F.col("keys"), F.col("types"))
    assert df.where(col != F.col("status")).count() == 0


def test_first_error_of_random_mutations_equals_all_prefixes(spark):
    """The refused character against the status of every prefix, for documents with random faults and keys that begin alike."""
    import random

    from test_io_prompts_pipeline import catalog_df

    rng = random.Random(12)
    fn = {"name": "f", "description": "", "returns": {"type": "null"}, "parameters": {
        "a": {"type": "integer"}, "ab": {"type": "number"}, "abc": {"type": "string"}, "b": {"type": "boolean"}, "c": {"type": "null"}}}
    values = {"a": ["0", "-12", "7"], "ab": ["1.50", "-0.0", "3"], "abc": ['"x\\u00e9\\\\"', '""', '"a}b,"'], "b": ["true", "false"], "c": ["null"]}
    alphabet = list('{}[]":,.-0123abctrue nul\\\t\r\n\x01é')
    texts = set()
    while len(texts) < 500:
        keys = rng.sample(list(values), 5)
        text = "{" + rng.choice([", ", ",", " ,\n"]).join(f'"{k}"{rng.choice(["", " "])}:{rng.choice(["", " "])}{rng.choice(values[k])}' for k in keys) + "}"
        chars = list(text)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(chars))
            chars[at:at + rng.randint(0, 2)] = rng.choice([[], [rng.choice(alphabet)], [rng.choice(alphabet), rng.choice(alphabet)]])
        texts.add("".join(chars))
    texts = sorted(texts)
    calls = spark.createDataFrame([(i, "f", t) for i, t in enumerate(texts)], "call_id long, function string, text string").repartition(8)
    catalog = catalog_df(spark, [fn])
    prefixes = calls.select("call_id", "function", "text", F.explode(F.sequence(F.lit(0), F.length("text"))).alias("n"))
    prefixes = prefixes.withColumn("text", F.expr("substring(text, 1, n)"))
    st = S.add_status(attach_schema(prefixes, catalog))
    live = {r["call_id"]: r["n"] for r in st.where(F.col("status") != S.REJECTED).groupBy("call_id").agg(F.max("n").alias("n")).collect()}
    got = {r["call_id"]: (r["valid_prefix_len"], r["bad_char"]) for r in C.first_error_position(calls, catalog).collect()}
    want = {i: (live[i], t[live[i]]) for i, t in enumerate(texts) if live[i] < len(t)}
    assert got == want and len(want) > 300
