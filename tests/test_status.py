"""Goldens for the call-document grammar (three-way status, C1 == C2 TERMINAL)."""

from conftest import statuses

LOC_DAYS = [("location", "string"), ("days", "number")]


def check(spark, cases, schema):
    texts = [t for t, _ in cases]
    got, acc = statuses(spark, texts, schema)
    for (t, want), g, a in zip(cases, got, acc):
        assert g == want, (t[:60], want, g)
        assert a == (want == "TERMINAL"), (t[:60], a)


def test_structural_documents(spark):
    check(spark, [
        ('{\n "location": "Madrid", \n "days": 5\n}', "TERMINAL"),
        ('{"hallucination": "fake_data"}', "REJECTED"),
        ('{"location": "Madrid"}', "REJECTED"),
        ('{"location": "Madrid", "days": "five"}', "REJECTED"),
        ('{"days": 5, "location": "x"}', "TERMINAL"),
        ('{"days":5,"days":6}', "REJECTED"),
        ('{"days":5,', "INCOMPLETE"),
        ('{"days":5,"location":"a"}x', "REJECTED"),
        ('{"days":5,"location":"a"} \n\t\r', "TERMINAL"),
        ('  {"days":5,"location":"a"}', "TERMINAL"),
    ], LOC_DAYS)


def test_prefixes_and_partial_tokens(spark):
    check(spark, [
        ("", "INCOMPLETE"), ("  \n", "INCOMPLETE"), ("{", "INCOMPLETE"), ('{"', "INCOMPLETE"),
        ('{"loc', "INCOMPLETE"), ('{"location"', "INCOMPLETE"), ('{"location" :', "INCOMPLETE"),
        ('{"location": "Ma', "INCOMPLETE"), ('{"location": "a\\', "INCOMPLETE"),
        ('{"location": "a\\u00', "INCOMPLETE"), ('{"location": "a\\u00"', "REJECTED"),
        ('{"location": "a\\x', "REJECTED"), ('{"x', "REJECTED"), ("x", "REJECTED"),
        ('{"days": -', "INCOMPLETE"), ('{"days": 5.', "INCOMPLETE"), ('{"days": 5.}', "REJECTED"),
    ], LOC_DAYS)


def test_survey_traps(spark):
    k_int = [("k", "integer")]
    check(spark, [
        ('{"k": 87\r}', "REJECTED"),          # CR may not follow a number
        ('{"k": 87 \r}', "TERMINAL"),         # ... but may follow a space after it
        ("{}", "REJECTED"),
        ('{"k": 1e5}', "REJECTED"),           # no exponent
        ('{"\\u006b": 1}', "REJECTED"),       # keys compare as raw text
        ('{"k": 087}', "REJECTED"),
        ('{"k": 8.5}', "REJECTED"),           # integer refuses a fraction
        ('{"k": "8"}', "REJECTED"),
        ('{"k": 87}x', "REJECTED"),
        ('{"k": 87', "INCOMPLETE"),
    ], k_int)
    # a function with no parameters can never be completed
    check(spark, [("{", "INCOMPLETE"), ("{}", "REJECTED"), ('{"', "REJECTED")], [])


def test_numbers(spark):
    a = [("a", "number")]
    invalid = ["-", "5.", "00", "007", "-00", ".", "-.", "", "1.2.3"]
    valid = ["0", "123", "-42", "3.14", "-0.5", "0.123", "100", "-100", "-0", "0.0", "-0.0"]
    cases = [('{"a": ' + n + "}", "REJECTED") for n in invalid]
    cases += [('{"a":' + n + "}", "TERMINAL") for n in valid]
    check(spark, cases, a)


def test_types(spark):
    schema = [("name", "string"), ("a", "float"), ("b", "boolean"), ("n", "null")]
    check(spark, [
        ('{"name": "x", "a": 2, "b": true, "n": null}', "TERMINAL"),
        ('{"n": null, "b": false, "a": -2.5, "name": "\\"q\\" \\/ \\b\\f\\n\\r\\t \\u00e9 é"}', "TERMINAL"),
        ('{"name": "x", "a": 2, "b": tru', "INCOMPLETE"),
        ('{"name": "x", "a": 2, "b": trux', "REJECTED"),
        ('{"name": "x", "a": 2, "b": true, "n": nul', "INCOMPLETE"),
        ('{"name": "x", "a": 2, "b": true, "n": 0}', "REJECTED"),
        ('{"name": "a\tb", "a": 2, "b": true, "n": null}', "REJECTED"),  # raw control char
    ], schema)


def test_long_string_does_not_overflow(spark):
    s = "x\\\"" * 100_000
    check(spark, [('{"location": "' + s + '", "days": 1}', "TERMINAL"),
                  ('{"location": "' + "y" * 200_000, "INCOMPLETE")], LOC_DAYS)


def test_invariant_prefixes_are_viable(spark):
    """Every prefix of the reference's invariant walk is not REJECTED."""
    schema = [("name", "string"), ("a", "number"), ("b", "boolean")]
    prefixes = [
        "", "{", '{"na', '{"name"', '{"name":', '{"name":"Hel', '{"name":"a\\', '{"name":"x"',
        '{"name":"x",', '{"name":"x","a":', '{"name":"x","a":12', '{"name":"x","a":1.',
        '{"name":"x","a":12,', '{"name":"x","a":12,"b":tru', '{"name":"x","a":12,"b":true}',
    ]
    got, _ = statuses(spark, prefixes, schema)
    assert all(g != "REJECTED" for g in got)
    assert got[-1] == "TERMINAL"
