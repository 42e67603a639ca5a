"""Opt-in timing checks at sf0.1 (``pytest -m benchmark``)."""

import time

import pytest

import __spark_entry__ as E

SF01 = "/root/testdata/sf0.1"


@pytest.mark.benchmark
@pytest.mark.parametrize("name,floor", [("c2_call_status_bench", 20_000), ("c1_validate_calls_bench", 20_000)])
def test_validation_throughput(spark, name, floor):
    q = E.queries()[name]
    q(spark, SF01).write.format("noop").mode("overwrite").save()  # warm-up
    t0 = time.time()
    q(spark, SF01).write.format("noop").mode("overwrite").save()
    rate = 600_000 / (time.time() - t0)
    print(f"{name}: {rate:,.0f} docs/s")
    assert rate > floor


@pytest.mark.benchmark
def test_masks_of_a_real_size_vocabulary(spark):
    """150,000 tokens, 70% of which extend an earlier one; four states; under a second for each state, twice over."""
    import random

    from test_io_prompts_pipeline import catalog_df

    from callscope.operators import vocab as V

    rng = random.Random(42)
    chars = 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789 ",:{}.-_'
    texts = {}
    while len(texts) < 150_000:
        stem = rng.choice(kept) if texts and rng.random() < 0.7 else ""
        text = (stem + "".join(rng.choice(chars) for _ in range(rng.randint(1, 5))))[:20]
        if text not in texts:
            texts[text] = len(texts)
            kept = list(texts) if len(texts) % 5000 == 1 else kept
    unique = spark.createDataFrame([(t, i, i) for t, i in texts.items()], "text string, token_id long, first_ord long").repartition(8).cache()
    nodes = V.prefix_table(unique).checkpoint()
    fn = {"name": "f", "description": "", "parameters": {"name": {"type": "string"}, "a": {"type": "number"}, "b": {"type": "number"}}, "returns": {"type": "null"}}
    states = spark.createDataFrame([(i, "f", t) for i, t in enumerate(["", "{", '{"name":"Hel', '{"name":"x","a":12'])], "state_id long, function string, text string")
    for _ in range(2):
        t0 = time.time()
        n = V.allowed_tokens(states, unique, catalog_df(spark, [fn]), nodes).count()
        took = time.time() - t0
    print(f"{n} allowed tokens in {took:.1f} s: {took / 4:.2f} s a state")
    assert took / 4 < 2
