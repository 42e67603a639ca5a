"""C4-C9, C13 on malformed values: whole raw values, and items after them are still found."""

import random

import pytest
from test_io_prompts_pipeline import catalog_df

from callscope.operators import calls as C

FN = {"name": "f", "description": "", "parameters": {"k": {"type": "integer"}, "a": {"type": "string"}}, "returns": {"type": "null"}}

FIELDS = {
    '{"k": 087}': [("k", "087")],
    '{"k": 1e5, "a": "x"}': [("k", "1e5"), ("a", '"x"')],
    '{"k": truex,"a":"}, \\"q\\": 1"}': [("k", "truex"), ("a", '"}, \\"q\\": 1"')],
    '{"k": abc, "a": "x"}': [("k", "abc"), ("a", '"x"')],
    '{"k": 087, "zz": 1, "zz": 2}': [("k", "087"), ("zz", "1"), ("zz", "2")],
    '{"k": , "a": "x"}': [("k", ""), ("a", '"x"')],
    '{"k": "x"y, "a": "z"}': [("k", '"x"y'), ("a", '"z"')],
    '{"k": 1}, "a": "x"': [("k", "1")],
    '{"k": 1 "a": "x"}': [("k", "1"), ("a", '"x"')],
    '{"k": 43\r}': [("k", "43")],
    '{"k": "open': [],
    '{"k": 12': [("k", "12")],
    ' {\n"a"\t:\r\n"x" , "k":-0}': [("a", '"x"'), ("k", "-0")],
    '{}': [], "": [], '"k": 1': [], "not json": [],
    '{"a": "' + "x" * 150000 + '", "k": 1}': [("a", '"' + "x" * 150000 + '"'), ("k", "1")],
}


@pytest.fixture(scope="module")
def calls(spark):
    return spark.createDataFrame([(i, "f", t) for i, t in enumerate(FIELDS)], "call_id long, function string, text string")


def test_fields(calls):
    got = {i: [] for i in range(len(FIELDS))}
    for r in C.call_fields(calls).orderBy("call_id", "pos").collect():
        got[r["call_id"]].append((r["key"], r["raw_value"]))
    assert got == dict(enumerate(FIELDS.values()))


def test_findings_see_past_a_bad_value(spark, calls):
    catalog, texts = catalog_df(spark, [FN]), list(FIELDS)
    bad = {(texts[r["call_id"]], r["key"], r["lexical_class"]) for r in C.type_mismatches(calls, catalog).collect()}
    assert {('{"k": 087}', "k", "invalid"), ('{"k": 1e5, "a": "x"}', "k", "invalid"), ('{"k": abc, "a": "x"}', "k", "invalid")} <= bad
    missing = {(texts[r["call_id"]], r["key"]) for r in C.missing_keys(calls, catalog).collect()}
    assert ('{"k": 087}', "a") in missing and not any(t == '{"k": abc, "a": "x"}' for t, _ in missing)
    assert {(r["key"], r["n"]) for r in C.duplicate_keys(calls, catalog).collect()} == {("zz", 2)}
    assert {r["key"] for r in C.unknown_keys(calls, catalog).collect()} == {"zz"}
    found = {texts[r["call_id"]]: r["violations"] for r in C.call_violations(calls, catalog).collect()}
    assert found['{"k": 087}'] == ["missing", "type"] and found['{"k": 1e5, "a": "x"}'] == ["type"]
    profile = {r["key"]: r for r in C.param_type_profile(calls).collect()}
    assert profile["k"]["n_invalid"] == 7 and profile["k"]["inferred_type"] == "mixed"


NESTED = {
    '{"k": "C:\\dir", "a": "x"}': [("k", '"C:\\dir"'), ("a", '"x"')],
    '{"k": "two\nlines", "a": "x"}': [("k", '"two\nlines"'), ("a", '"x"')],
    '{"k": {"x": 1}, "a": "x"}': [("k", '{"x": 1}'), ("a", '"x"')],
    '{"k": [{"x": "}]"}, [2, 3]], "a": "x"}': [("k", '[{"x": "}]"}, [2, 3]]'), ("a", '"x"')],
    '{"k": {"a": {"k": [1, {}]}}, "a": "x"}, "zz": 1': [("k", '{"a": {"k": [1, {}]}}'), ("a", '"x"')],
    '{"k": [1, "a": "x"}': [("k", "[1"), ("a", '"x"')],
    '{"k": "' + "\\d\n" * 50000 + '", "a": "x"}': [("k", '"' + "\\d\n" * 50000 + '"'), ("a", '"x"')],
}


def test_items_behind_bad_strings_and_nested_values(spark):
    texts = list(NESTED)
    calls = spark.createDataFrame([(i, "f", t) for i, t in enumerate(texts)], "call_id long, function string, text string")
    got = {i: [] for i in range(len(texts))}
    for r in C.call_fields(calls).orderBy("call_id", "pos").collect():
        got[r["call_id"]].append((r["key"], r["raw_value"]))
    assert got == dict(enumerate(NESTED.values()))
    catalog = catalog_df(spark, [FN])
    assert C.missing_keys(calls, catalog).count() == 0
    assert {(r["call_id"], r["key"], r["lexical_class"]) for r in C.type_mismatches(calls, catalog).collect()} == {(i, "k", "invalid") for i in range(len(texts))}


DEEP = '{"k": ' + '{"x": ["k", {"a": ' * 100 + "1" + "}]}" * 100 + ', "a": "x"}'
ODD = {
    '{"k\\"q": 1, "a": "x"}': [('k\\"q', '"k\\"q": 1'), ("a", '"x"')],
    '{"k" 1, "a": "x"}': [("k", '"k" 1'), ("a", '"x"')],
    '{"k", "a": "x"}': [("k", '"k"'), ("a", '"x"')],
    '{"k": , "a": }': [("k", ""), ("a", "")],
    '{"k": {"x": 1, "a": "x"': [], '{"k": [1, "a"': [], '{"k"': [], '{"k":': [], '{"k": "x", "a': [("k", '"x"')],
    '{"k": [{"x": 1], "a": "x"}': [("k", '[{"x": 1]'), ("a", '"x"')],
    '{"k": 1], "a": "x"}': [("k", "1]"), ("a", '"x"')],
    '{k: 1, "a": "x"}': [("a", '"x"')], '{{"k": 1}, "a": "x"}': [("a", '"x"')], '{5: {"k": 1}, "a": "x"}': [("a", '"x"')],
    '{"k": {"x": 1}y, "a": "x"}': [("k", '{"x": 1}y'), ("a", '"x"')],
    '{"k"  :{"x":[]} "a":"x"}': [("k", '{"x":[]}'), ("a", '"x"')],
    DEEP: [("k", DEEP[6:DEEP.rindex(", ")]), ("a", '"x"')],
    '{"k": ' + "[" * 3000 + "]" * 3000 + "}": [("k", "[" * 3000 + "]" * 3000)],
    '{"k": é, "ü": "ß\u2028", "a": "x"}': [("k", "é"), ("ü", '"ß\u2028"'), ("a", '"x"')],
}


def fields_of(spark, texts):
    calls = spark.createDataFrame([(i, "f", t) for i, t in enumerate(texts)], "call_id long, function string, text string")
    got = [[] for _ in texts]
    for r in C.call_fields(calls).orderBy("call_id", "pos").collect():
        got[r["call_id"]].append((r["key"], r["raw_value"]))
    return calls, got


def test_odd_items_and_depth(spark):
    calls, got = fields_of(spark, list(ODD))
    assert got == list(ODD.values())
    catalog, texts = catalog_df(spark, [FN]), list(ODD)
    bad = {(texts[r["call_id"]], r["key"], r["lexical_class"]) for r in C.type_mismatches(calls, catalog).collect()}
    assert {('{"k" 1, "a": "x"}', "k", "invalid"), ('{"k": , "a": }', "k", "invalid"), (DEEP, "k", "invalid")} <= bad
    missing = {(texts[r["call_id"]], r["key"]) for r in C.missing_keys(calls, catalog).collect()}
    assert ('{"k\\"q": 1, "a": "x"}', "k") in missing and not {m for m in missing if m[0] in ('{"k": , "a": }', DEEP)}
    unknown = {(texts[r["call_id"]], r["key"]) for r in C.unknown_keys(calls, catalog).collect()}
    assert ('{"k\\"q": 1, "a": "x"}', 'k\\"q') in unknown and not {u for u in unknown if u[0] == DEEP}
    assert C.duplicate_keys(calls, catalog).count() == 0
    classes = {r["key"]: r["n_invalid"] for r in C.param_type_profile(calls).collect()}
    assert classes['k\\"q'] == 1


def test_items_known_by_construction(spark):
    """Random objects put together from items whose keys and raw values are known."""
    rng = random.Random(21)
    blank = lambda: rng.choice(["", "", " ", "\n  ", "\t\r\n"])

    def nested(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(['"}"', '"a\\"]"', "1", "", "null", '"k": 2', "{}", "[]", '"x" : [ ]'])
        inner = (rng.choice([",", ", ", ":", " "])).join(nested(depth - 1) for _ in range(rng.randrange(1, 4)))
        return ("{%s}" if rng.random() < 0.5 else "[%s]") % inner

    texts, known = [], []
    for _ in range(400):
        items = []
        for _ in range(rng.randrange(0, 6)):
            key = rng.choice(["k", "a", "", "é", "x{", ",", "}"])
            raw = rng.choice(["1", "-0.5", '"s"', '"\\""', '"a,}"', "087", "true", "{%s}" % nested(rng.randrange(12)), "[%s]" % nested(rng.randrange(12)), '"bad\\q"', '"x"y'])
            shape = rng.random()
            if shape < 0.7:
                items.append((key, raw, f'"{key}"{blank()}:{blank()}{raw}'))
            elif shape < 0.8:
                items.append((key, "", f'"{key}"{blank()}:{blank()}'))
            elif shape < 0.9:
                items.append((key, f'"{key}"{raw}', f'"{key}"{raw}'))
            else:
                items.append((f'\\"{key}', f'"\\"{key}": {raw}', f'"\\"{key}": {raw}'))
        body = "".join(f"{blank()}{text}{blank()}," for *_, text in items)
        texts.append(blank() + "{" + (body[:-1] if rng.random() < 0.8 else body) + "}" + rng.choice(["", " ", "x", ', "zz": 1', "}"]))
        known.append([(key, raw) for key, raw, _ in items])
    assert fields_of(spark, texts)[1] == known


def test_only_what_follows_the_complete_items_is_scanned(spark):
    from callscope.functions.items import with_head, with_items

    many = "".join(f'"k{i}": {i}, ' for i in range(300))
    texts = {"{" + many + '"a": {"x": 1}}': ('"a": {"x": 1}}', [*((f"k{i}", f"{i}") for i in range(300)), ("a", '{"x": 1}')]),
             "{" + many + "}": ("}", [(f"k{i}", f"{i}") for i in range(300)]),
             '{"a": "é, ",\n "k": 1}': ('"k": 1}', [("a", '"é, "'), ("k", "1")]),
             'no {"k": 1, "a": 2}': ('no {"k": 1, "a": 2}', [])}
    split = with_head(spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string"))
    assert {r["text"]: r["_tail"] for r in split.collect()} == {None: None} | {t: tail for t, (tail, _) in texts.items()}
    got = {r["text"]: r["fkeys"] and list(zip(r["fkeys"], r["fvals"], strict=True)) for r in with_items(split).collect()}
    assert got.pop(None) is None and {t: f or [] for t, f in got.items()} == {t: f for t, (_, f) in texts.items()}


def test_typed_parameters_look_for_no_other_calls_fields(spark, calls):
    df = C.typed_parameters(calls, catalog_df(spark, [FN]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("aggregate(") < plan.index("explode(CASE WHEN")  # a plan's later lines are worked out first
    assert plan.count("regexp_extract_all(") < 6  # no stage is worked out twice
    assert {(r["key"], r["raw_value"]) for r in df.collect()} >= {("a", '"x"'), ("k", "-0")}


def test_repeats_are_counted_in_calls_that_have_some(spark, calls):
    plan = C.duplicate_keys(calls, catalog_df(spark, [FN]))._jdf.queryExecution().executedPlan().toString()
    assert "size(array_distinct(" in plan
