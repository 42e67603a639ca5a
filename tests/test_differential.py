"""Status of random texts whose status is known from how they are made."""

import json
import random

from conftest import statuses

SCHEMA = {"name": "string", "n": "integer", "x": "number", "ok": "boolean", "z": "null"}
VALUES = {
    "string": ['"Madrid"', '"a\\"b"', '"é\\\\n"', '""', '"x y"', '"\\u00e9"', '"}, {"', json.dumps("é\n", ensure_ascii=True)],
    "integer": ["0", "-0", "7", "-42", "1234"],
    "number": ["0", "3.14", "-0.5", "10", "2.0"],
    "boolean": ["true", "false"],
    "null": ["null"],
}
WRONG = {
    "string": ["1", "true", "null", "'a'", '"a\\q"', '"a\tb"', '"\\u12g4"'],
    "integer": ["1.5", "01", "-", "+1", "1e5", '"1"', "--1", "true", "."],
    "number": ["5.", ".5", "007", "-00", "1.2.3", "-.", "1e5", '"1"', "null", "0x1"],
    "boolean": ["True", "yes", "1", '"true"', "tru", "truee"],
    "null": ["nul", "NULL", "none", '""', "0"],
}


def items(rng, schema):
    keys = list(schema)
    rng.shuffle(keys)
    return [(k, rng.choice(VALUES[schema[k]])) for k in keys]


def written(rng, pairs, end="}"):
    sep, colon = rng.choice([", ", ",", ",\n  ", " ,"]), rng.choice([": ", ":", " : ", ":\r\n"])
    return rng.choice(["", " ", "\n"]) + "{" + rng.choice(["", " "]) + sep.join(f'"{k}"{colon}{v}' for k, v in pairs) + end


def broken(rng, schema):
    """A text with one fault at a known place."""
    pairs = items(rng, schema)
    i = rng.randrange(len(pairs))
    k, v = pairs[i]
    fault = rng.choice(["value", "unknown", "twice", "missing", "comma", "after", "colon", "no comma", "brace", "quote", "case", "carriage"])
    if fault == "value":
        pairs[i] = (k, rng.choice(WRONG[schema[k]]))
        return written(rng, pairs)
    if fault == "unknown":
        pairs[i] = (k + "_", v)
    elif fault == "twice":
        pairs.append((k, v))
    elif fault == "missing":
        del pairs[i]
    elif fault == "case":
        pairs[i] = (k.upper(), v)
    elif fault == "carriage":
        key = rng.choice([a for a, t in schema.items() if t in ("integer", "number")])
        pairs = [(a, b + "\r") if a == key else (a, b) for a, b in pairs]
    text = written(rng, pairs)
    if fault == "comma":
        return text[:-1] + ",}"
    if fault == "after":
        return text + rng.choice(["x", "{", "}", ",", '"'])
    if fault == "colon":
        return text.replace(f'"{k}"', f'"{k}";', 1)
    if fault == "no comma":
        return written(rng, pairs[:1], "") + " " + written(rng, pairs[1:]).lstrip()[1:]
    if fault == "brace":
        return rng.choice(["[", "x", "}"]) + text.lstrip()[1:]
    if fault == "quote":
        return text.replace(f'"{k}"', f"'{k}'", 1)
    return text


def test_random_texts(spark):
    rng = random.Random(20261202)
    cases = []
    for _ in range(300):
        text = written(rng, items(rng, SCHEMA))
        cases.append((text + rng.choice(["", " ", "\n\r\t"]), "TERMINAL"))
        cases += [(text[:rng.randint(0, len(text) - 1)], "INCOMPLETE") for _ in range(4)]
        cases += [(broken(rng, SCHEMA), "REJECTED") for _ in range(6)]
    got, acc = statuses(spark, [t for t, _ in cases], list(SCHEMA.items()))
    bad = [(t, w, g) for (t, w), g in zip(cases, got) if w != g]
    assert not bad, bad[:10]
    assert all(a == (g == "TERMINAL") for a, g in zip(acc, got))


def test_what_follows_a_fault_changes_nothing(spark):
    rng = random.Random(3)
    texts = [broken(rng, SCHEMA) + rng.choice(["", " ", "}", '"', "1", "null}", ', "z": null}']) for _ in range(600)]
    assert set(statuses(spark, texts, list(SCHEMA.items()))[0]) == {"REJECTED"}


def test_prefix_keys_and_empty_schema(spark):
    schema = {"a": "integer", "ab": "string", "b": "boolean"}
    base = ['{"a": 1, "ab": "q", "b": true}', '{"ab":"","b":false,"a":-3}', ' {"b" : true , "a" : 0 , "ab" : "\\u00e9"}']
    texts = [d[:i] for d in base for i in range(len(d))]
    assert set(statuses(spark, texts, list(schema.items()))[0]) == {"INCOMPLETE"}
    wrong = ['{"abc', '{"a"a', '{"a": 1, "a"', '{"ab": "x", "ab', '{"ab": "x", "a": 1, "b": true,', '{"b": true}', '{"b": "', "{}", '{"a" "']
    assert set(statuses(spark, wrong, list(schema.items()))[0]) == {"REJECTED"}
    got, _ = statuses(spark, ["", " ", "{", "{ ", " {\n", "{}", '{"', " { } ", "x"], [])
    assert got == ["INCOMPLETE"] * 5 + ["REJECTED"] * 4
