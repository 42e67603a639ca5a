"""Trie-as-table and allowed-token goldens (prefix table, decode, F5 snapshot)."""

import random

from pyspark.sql import functions as F

from callscope.functions import ordering
from callscope.operators import vocab as V


def unique_of(spark, vocab: dict):
    df = spark.createDataFrame([(i, i, t) for t, i in vocab.items()], "token_id long, ord long, text string")
    return V.unique_text(df)


def test_prefix_table_structure(spark):
    nodes = {r["prefix"]: r for r in V.prefix_table(unique_of(spark, {"cat": 1, "car": 2})).collect()}
    assert set(nodes) == {"c", "ca", "cat", "car"}
    assert nodes["cat"]["token_id"] == 1 and nodes["car"]["token_id"] == 2
    assert nodes["ca"]["token_id"] is None and nodes["cat"]["parent"] == "ca"
    fan = {r["depth"]: r for r in V.prefix_fanout(V.prefix_table(unique_of(spark, {"cat": 1, "car": 2}))).collect()}
    assert fan[0]["max_children"] == 1 and fan[2]["max_children"] == 2


def test_empty_ignored_and_last_id_wins(spark):
    raw = spark.createDataFrame(
        [(0, 0, ""), (3, 1, "dog"), (4, 2, "dog"), (5, 3, "Ġhello")], "token_id long, ord long, raw string")
    dec = V.decoded_vocab(raw)
    assert {r["token_id"]: r["text"] for r in dec.collect()} == {3: "dog", 4: "dog", 5: " hello"}
    uniq = {r["text"]: r["token_id"] for r in V.unique_text(dec).collect()}
    assert uniq == {"dog": 4, " hello": 5}


def test_byte_level_round_trip(spark):
    df = spark.createDataFrame([("héllo wörld\n",), ("a\tb",)], "t string")
    out = df.select(V.byte_level_decode(V.byte_level_encode(F.col("t"))).alias("x"), "t").collect()
    assert all(r["x"] == r["t"] for r in out)
    lone = spark.createDataFrame([("Ã",)], "r string").select(V.byte_level_decode(F.col("r"))).first()[0]
    assert lone == "�"


SNAPSHOT_VOCAB = {
    "{": 0, "}": 1, '"name"': 2, '"a"': 3, '"b"': 4, '"xyz"': 5,
    ":": 6, ",": 7, "12": 8, "34": 9, "5": 10,
    "x": 11, "yz": 12, "Hello": 13, "true": 14, "Ġ": 15,
}
SNAPSHOT_STATES = ["", "{", '{"name":"Hel', '{"name":"x","a":12']
SNAPSHOT_EXPECTED = [[0], [2, 3, 4], [0, 1, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15], [7, 8, 9, 10]]


def test_allowed_tokens_snapshot(spark):
    catalog = spark.createDataFrame(
        [(0, "f", "", [(0, "name", "string"), (1, "a", "number"), (2, "b", "number")], "null")],
        "ord long, name string, description string, params array<struct<ord:int,key:string,type:string>>, returns string",
    )
    states = spark.createDataFrame([(i, "f", t) for i, t in enumerate(SNAPSHOT_STATES)],
                                   "state_id long, function string, text string")
    mask = V.allowed_tokens(states, unique_of(spark, SNAPSHOT_VOCAB), catalog).collect()
    got = [sorted(r["token_id"] for r in mask if r["state_id"] == i) for i in range(4)]
    assert got == SNAPSHOT_EXPECTED


def plain_trie(tokens):
    """prefix -> (first, token_id, place of its token depth-first), from a trie that is walked."""
    root = {}
    for slot, (text, token_id) in enumerate(tokens):
        node = root
        for at in range(1, len(text) + 1):
            node = node.setdefault(text[:at], {"first": slot, "kids": {}, "id": None})
            last, node = node, node["kids"]
        last["id"] = token_id
    out, place = {}, 0

    def walk(kids):
        nonlocal place
        for prefix, node in kids.items():  # in order of insertion
            out[prefix] = [node["first"], node["id"], None]
            if node["id"] is not None:
                out[prefix][2] = place
                place += 1
            walk(node["kids"])

    walk(root)
    return {k: tuple(v) for k, v in out.items()}


def random_tokens(seed, n=400):
    rng = random.Random(seed)
    texts = {"".join(rng.choice(["a", "b", " ", "é", "\U0001f600", "\uffff", "{"]) for _ in range(rng.randint(1, 7))) for _ in range(n)}
    texts = sorted(texts, key=lambda _: rng.random())
    return [(t, i) for i, t in enumerate(texts)]


def test_prefix_table_equals_a_walked_trie(spark):
    tokens = random_tokens(3)
    nodes = V.prefix_table(unique_of(spark, dict(tokens)).repartition(5))
    got = {r["prefix"]: (r["first"], r["token_id"], r["dfs_ord"]) for r in nodes.collect()}
    assert got == plain_trie(tokens)
    assert all(r["parent"] + r["char"] == r["prefix"] and r["depth"] == len(r["prefix"]) for r in nodes.collect())
    assert "collect_list" not in nodes._jdf.queryExecution().optimizedPlan().toString()


def test_prefix_search_equals_startswith(spark):
    tokens = random_tokens(4)
    rng = random.Random(5)
    asked = [""] + [rng.choice(tokens)[0][:rng.randint(1, 4)] for _ in range(80)] + ["zz", "\U0010ffff", "a\u0000", None, "", " "]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string").repartition(3)
    found = V.prefix_search(queries, unique_of(spark, dict(tokens)))
    got = sorted((r["query_id"], r["token_id"]) for r in found.collect())
    assert got == sorted((q, i) for q, prefix in enumerate(asked) if prefix is not None for text, i in tokens if text.startswith(prefix))
    assert V.prefix_search(queries.limit(0), unique_of(spark, dict(tokens))).count() == 0
    assert V.prefix_search(queries, unique_of(spark, dict(tokens)).limit(0)).count() == 0


def test_running_sum_over_several_runs(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RUN", 10)
    rows = [(i, (i * 7) % 11 - 4) for i in range(105)]
    got = ordering.running_sum(spark.createDataFrame(rows, "at long, v long").repartition(4), "at", "v", "total").collect()
    assert {r["at"]: r["total"] for r in got} == {i: sum(v for _, v in rows[:i + 1]) for i in range(105)}
