"""Broken, missing, repeated and unexpected outputs are never right."""

from callscope.operators import evaluate as V

DDL = "prompt_id long, name string, parameters string"


def report(spark, expected, actual):
    e, a = spark.createDataFrame(expected, DDL), spark.createDataFrame(actual, DDL)
    return {r["function"]: tuple(r)[1:5] for r in V.accuracy_report(e, a).collect()}, e, a


def test_broken_outputs_are_wrong(spark):
    whole = '{"k": 1, "a": 2}'
    texts = ['{"a":2 , "k":1}\n', '{"k": 1, "a": 2', whole + "x", "not json", "", None, "{}", '{"k": 1}', '{"k": 1, "a": 2, "b": 3}', '{"k": 01, "a": 2}', '{"k": 1.0, "a": 2}']
    got, e, a = report(spark, [(i, "f", whole) for i in range(len(texts))], [(i, "f", t) for i, t in enumerate(texts)])
    assert got == {"f": (11, 11, 1, 1), "__all__": (11, 11, 1, 1)}
    by_key = {(r["key"], r["value_class"]): (r["n"], r["n_ok"]) for r in V.parameter_report(e, a).collect()}
    assert by_key == {("k", "integer"): (11, 3), ("a", "integer"): (11, 3)}
    got, _, _ = report(spark, [(1, "f", "{}"), (2, "f", "not json")], [(1, "f", " { } "), (2, "f", "not json")])
    assert got["f"] == (2, 2, 1, 1)


def test_every_prompt_counts_once(spark):
    expected = [(1, "f", "{}"), (2, "f", "{}"), (3, "g", "{}"), (4, "g", "{}"), (4, "g", "{}")]
    actual = [(1, "f", "{}"), (1, "f", "{}"), (3, "f", "{}"), (4, "g", "{}"), (9, "g", "{}")]
    got, e, a = report(spark, expected, actual)
    assert got == {"f": (2, 0, 0, 0), "g": (1, 0, 1, 0), "<repeated>": (1, 0, 0, 0), "<unexpected>": (1, 0, 0, 0), "__all__": (5, 0, 1, 0)}
    pairs = {(r["expected"], r["actual"]): r["n"] for r in V.routing_confusion(e, a).collect()}
    assert pairs == {("f", "<repeated>"): 1, ("f", "<missing>"): 1, ("g", "f"): 1, ("<repeated>", "g"): 1, ("<unexpected>", "g"): 1}
