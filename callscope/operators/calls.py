"""Bulk validation and profiling of call documents.

Input ``calls(call_id, function, text)`` with mixed functions in one table.
Each call is joined once with its function's schema (a size-checked broadcast
of catalog metadata), after which every check is a row-local expression:
parsing, key bookkeeping and typing run inside the scan stage with no shuffle.
Only the reports (C9, C13, C14) aggregate, and they do so with partial
(map-side) aggregation so a function holding a third of all calls costs one
pre-aggregated row per task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions import status as S
from callscope.functions.grammar import JAVA as G
from callscope.functions.items import with_head, with_items
from callscope.functions.ordering import prefix_matches
from callscope.operators.catalog import attach_schema
from callscope.session import broadcast_if_small

STATUS_VALUES = (S.TERMINAL, S.INCOMPLETE, S.REJECTED)


# --------------------------------------------------------------------------
# Row-local parsing helpers
# --------------------------------------------------------------------------

def with_parse(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Calls + schema + status + fields, all computed row-locally."""
    return S.add_status(attach_schema(calls, catalog), with_fields=True)


def _explode_fields(df: DataFrame, *extra: str) -> DataFrame:
    z = F.arrays_zip(F.col("fkeys").alias("key"), F.col("fvals").alias("raw_value"))
    return df.select(*extra, F.posexplode(z).alias("pos", "f")).select(
        *extra, F.col("pos").cast("int").alias("pos"), F.col("f.key").alias("key"),
        F.col("f.raw_value").alias("raw_value"),
    )


# --------------------------------------------------------------------------
# C1, C2, C3
# --------------------------------------------------------------------------

def validate_calls(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """``accepted`` iff the document is TERMINAL for its function."""
    accepted = F.coalesce(F.col("status") == S.TERMINAL, F.lit(False))
    return call_status(calls, catalog).select("call_id", "function", accepted.alias("accepted"))


def call_status(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """TERMINAL / INCOMPLETE / REJECTED per call."""
    df = attach_schema(calls, catalog)
    return S.add_status(df).select("call_id", "function", "status")


def first_error_position(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Code points consumed before the first refused one, and that char.

    Only REJECTED rows.  The head is already split into complete
    ``key: value ,`` units; the first unit that breaks a rule (key not
    declared or already used, value of the wrong type, comma with no key
    left) is found with array functions.  The refused character lies inside
    that unit -- or, if every unit is legal, inside the tail -- where the item
    is read forward once, part by part, as far as each is live.  A text that
    does not open an object is refused right after its leading whitespace.
    """
    df = S.add_status(attach_schema(calls, catalog), keep_head=True).where(F.col("status") == S.REJECTED)
    text, keys, types = F.col("text"), F.col("keys"), F.col("types")
    start = F.length(F.regexp_extract(text, G.object_start, 0))
    head = F.col("_head")
    df = df.select(
        "call_id", "function", "text", "keys", "types",
        start.alias("_start"), F.length(head).alias("_hlen"),
        F.regexp_extract_all(head, F.lit(G.unit), 0).alias("_u"),
        F.col("_hk").alias("_k"), F.col("_hv").alias("_v"),
    )
    n = F.size(keys)
    unit_ok = F.transform(
        "_k",
        lambda k, i: ~F.array_contains(F.slice("_k", F.lit(1), i), k)
        & S.admits(F.element_at(types, k), S.value_class(F.element_at("_v", i + 1)))
        & (i + 1 < n),
    )
    bad = F.array_position(unit_ok, False).cast("int")  # 1-based, 0 = all legal
    lens = F.transform("_u", lambda u: F.length(u))
    before = F.aggregate(F.slice(lens, F.lit(1), F.greatest(bad - 1, F.lit(0))), F.lit(0), lambda a, x: a + x)
    df = df.select(
        "call_id", "function", "text", "keys", "types", "_hlen",
        F.when(bad > 0, F.col("_start") + before).otherwise(F.col("_hlen")).alias("_anchor"),
        F.when(bad > 0, F.element_at(lens, bad)).otherwise(F.length(text) - F.col("_hlen")).alias("_seglen"),
        F.when(bad > 0, F.array_except(keys, F.slice("_k", F.lit(1), F.greatest(bad - 1, F.lit(0)))))
        .otherwise(F.array_except(keys, F.col("_k"))).alias("_rem"),
    )
    df = S.add_live_length(df.withColumn("_seg", F.col("text").substr(F.col("_anchor") + 1, F.col("_seglen"))), "_seg", "_rem", "_live")
    lead = F.length(F.regexp_extract(text, G.leading_ws, 0))
    pos = F.when(F.col("_hlen") == 0, lead).otherwise(F.col("_anchor") + F.col("_live"))
    return df.select(
        "call_id", "function",
        pos.cast("int").alias("valid_prefix_len"),
        F.col("text").substr(pos + 1, F.lit(1)).alias("bad_char"),
    )


# --------------------------------------------------------------------------
# Fields and per-field findings
# --------------------------------------------------------------------------

def call_fields(calls: DataFrame) -> DataFrame:
    """C4: key/value pairs in document order, raw text (needs no catalog)."""
    return _explode_fields(with_items(with_head(calls.select("call_id", "function", "text"))), "call_id", "function")


def unknown_keys(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Keys used in a call but not declared for its function."""
    df = with_parse(calls, catalog)
    fields = _explode_fields(df, "call_id", "function", "keys", "status")
    return fields.where(~F.array_contains("keys", F.col("key"))).select(
        "call_id", "function", "pos", "key", "status"
    )


def missing_keys(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Declared keys absent from a call (row-local ``array_except``)."""
    df = with_parse(calls, catalog)
    return df.select(
        "call_id", "function", "status", F.explode(F.array_except("keys", "fkeys")).alias("key")
    ).select("call_id", "function", "key", "status")


def duplicate_keys(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Keys used more than once in a call, with their use count."""
    df = with_parse(calls, catalog)
    counted = F.transform(
        F.array_distinct("fkeys"),
        lambda k: F.struct(k.alias("key"), F.size(F.filter("fkeys", lambda x: x == k)).alias("n")),
    )
    return (
        df.where(F.size("fkeys") > F.size(F.array_distinct("fkeys")))  # few calls have any
        .select("call_id", "function", "status", F.explode(counted).alias("d"))
        .where("d.n > 1")
        .select("call_id", "function", F.col("d.key").alias("key"),
                F.col("d.n").cast("bigint").alias("n"), "status")
    )


def type_mismatches(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Declared keys whose value's lexical form the declared type refuses."""
    df = with_parse(calls, catalog)
    fields = _explode_fields(df, "call_id", "function", "types", "status")
    t = F.element_at("types", F.col("key"))
    cls = S.lexical_class(F.col("raw_value"))
    return fields.where(t.isNotNull() & ~S.admits(t, cls)).select(
        "call_id", "function", "key", t.alias("type"), "raw_value",
        cls.alias("lexical_class"), "status",
    )


# --------------------------------------------------------------------------
# C9, C10, C11, C12
# --------------------------------------------------------------------------

def param_type_profile(calls: DataFrame) -> DataFrame:
    """Lexical-class census per (function, key) and the narrowest type.

    ``inferred_type`` is the narrowest declared type that admits every value:
    integer < number; string, boolean, null stand alone; ``mixed`` otherwise.
    """
    fields = call_fields(calls).withColumn("cls", S.lexical_class(F.col("raw_value")))
    counts = {c: F.count_if(F.col("cls") == c).cast("bigint").alias(f"n_{c}")
              for c in ("integer", "number", "string", "boolean", "null", "invalid")}
    agg = fields.groupBy("function", "key").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), *counts.values()
    )
    n = F.col("n")
    inferred = (
        F.when(F.col("n_integer") == n, "integer")
        .when(F.col("n_integer") + F.col("n_number") == n, "number")
        .when(F.col("n_string") == n, "string")
        .when(F.col("n_boolean") == n, "boolean")
        .when(F.col("n_null") == n, "null")
        .otherwise("mixed")
    )
    return agg.withColumn("inferred_type", inferred)


def enum_completions(partials: DataFrame, domain: DataFrame) -> DataFrame:
    """Candidates still possible for a partial quoted value.

    In the sorted domain a partial's candidates are an interval of ranks, found
    by sorting its two ends in among them (no candidate is taken apart, no
    nested-loop join).  Completions are computed once per distinct partial text
    and joined back, so a hot partial costs nothing extra.
    """
    quoted = domain.select(F.concat(F.lit('"'), F.col("candidate"), F.lit('"')).alias("cand"))
    matched = prefix_matches(partials.select("partial").distinct(), quoted, "partial", "cand")
    per_text = matched.groupBy("partial").agg(
        F.count_distinct("cand").cast("bigint").alias("n_candidates"),
        F.array_join(F.array_sort(F.collect_set("cand")), "|").alias("candidates"),
        F.array_join(
            F.array_sort(F.collect_set(F.expr("substring(cand, length(partial) + 1, 1)"))), ""
        ).alias("next_chars"),
        F.max((F.col("cand") == F.col("partial")).cast("int")).cast("boolean").alias("complete"),
    )
    per_text = broadcast_if_small(per_text)
    out = partials.join(per_text, "partial", "left")
    return out.select(
        "partial_id", "partial",
        F.coalesce("n_candidates", F.lit(0).cast("bigint")).alias("n_candidates"),
        F.coalesce("candidates", F.lit("")).alias("candidates"),
        F.coalesce("next_chars", F.lit("")).alias("next_chars"),
        (F.coalesce("n_candidates", F.lit(0)) == 1).alias("forced"),
        F.coalesce("complete", F.lit(False)).alias("complete"),
    )


def typed_parameters(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """C11: decoded values of TERMINAL calls only."""
    # a TERMINAL call's items are those of its head and the last one: no other call's are looked for
    df = S.add_status(attach_schema(calls, catalog), with_fields=True, only=S.TERMINAL)
    fields = _explode_fields(df, "call_id", "function", "types")
    t = F.element_at("types", F.col("key"))
    raw = F.col("raw_value")
    is_num = t.isin("integer", "number")
    return fields.select(
        "call_id", "function", "key", t.alias("type"), "raw_value",
        F.when(t == "integer", raw.try_cast("bigint")).alias("as_bigint"),
        F.when(is_num, raw.try_cast("double")).alias("as_double"),
        F.when(t == "string", F.expr("try_variant_get(try_parse_json(raw_value), '$', 'string')")).alias("as_string"),
        F.when(t == "boolean", raw == "true").alias("as_bool"),
    )


def keys_left_trace(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """After each consumed key, how many declared keys remain."""
    df = with_parse(calls, catalog)
    n = F.size("keys")
    left = F.transform(
        "fkeys",
        lambda k, i: n - F.size(F.array_intersect(F.slice("fkeys", F.lit(1), i + 1), F.col("keys"))),
    )
    z = F.arrays_zip(F.col("fkeys").alias("key"), left.alias("keys_left"))
    return df.select("call_id", "function", F.posexplode(z).alias("pos", "t")).select(
        "call_id", "function", F.col("pos").cast("int").alias("pos"),
        F.col("t.key").alias("key"), F.col("t.keys_left").cast("int").alias("keys_left"),
    )


# --------------------------------------------------------------------------
# Reports and router documents
# --------------------------------------------------------------------------

VIOLATIONS = ("not_object", "unknown", "missing", "duplicate", "type", "truncated", "trailing", "syntax")


def call_violations(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per call, the array of violation classes (empty for TERMINAL calls)."""
    df = with_parse(calls, catalog)
    text, st = F.col("text"), F.col("status")
    declared = F.transform("fkeys", lambda k: F.element_at("types", k))
    typed = F.zip_with(declared, "fvals", lambda t, v: t.isNotNull() & ~S.admits(t, S.lexical_class(v)))
    # what several classes need is worked out once, in a stage of its own
    df = df.select(
        "call_id", "function", "status", "keys", "fkeys", F.length(text).alias("_length"),
        text.rlike(G.opened).alias("_opened"), F.regexp_extract(text, G.closed_object, 0).alias("_closed"), typed.alias("_typed"),
    )
    opened, closed = F.col("_opened"), F.col("_closed")
    flags = [
        (~opened & (st == S.REJECTED), "not_object"),
        (F.exists("fkeys", lambda k: ~F.array_contains("keys", k)), "unknown"),
        (opened & (st != S.INCOMPLETE) & (F.size(F.array_except("keys", "fkeys")) > 0), "missing"),
        (F.size("fkeys") > F.size(F.array_distinct("fkeys")), "duplicate"),
        (F.exists("_typed", lambda b: b), "type"),
        (st == S.INCOMPLETE, "truncated"),
        ((closed != "") & (F.length(closed) < F.col("_length")), "trailing"),
    ]
    found = F.when((st == S.REJECTED) & (F.size("_found") == 0), F.array(F.lit("syntax"))).otherwise(F.col("_found"))
    return df.withColumn("_found", F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in flags]))).select("call_id", "function", "status", found.alias("violations"))


def violation_report(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Calls per (function, violation) and their share of the function's calls.

    One pass: every call contributes a marker row besides its violations, so
    the per-function call count and the per-violation counts come out of the
    same partial aggregation; the share is computed on the small result.
    """
    v = call_violations(calls, catalog)
    marker = "(calls)"  # no violation's name
    rows = v.select("function", F.explode(F.concat("violations", F.array(F.lit(marker)))).alias("violation"))
    agg = rows.groupBy("function", "violation").agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    w = Window.partitionBy("function")
    calls_n = F.max(F.when(F.col("violation") == marker, F.col("n"))).over(w)
    out = agg.withColumn("_calls", calls_n).where(F.col("violation") != marker)
    return out.select(
        "function", "violation", "n", F.round(F.col("n") / F.col("_calls"), 6).alias("share")
    )


def conformance_report(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """C14: the "valid JSON" metric per function at dataset scale."""
    st = call_status(calls, catalog)
    agg = st.groupBy("function").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.count_if(F.col("status") == S.TERMINAL).cast("bigint").alias("n_terminal"),
        F.count_if(F.col("status") == S.INCOMPLETE).cast("bigint").alias("n_incomplete"),
        F.count_if(F.col("status") == S.REJECTED).cast("bigint").alias("n_rejected"),
    )
    return agg.withColumn("accept_rate", F.round(F.col("n_terminal") / F.col("n"), 6))


def router_documents(calls: DataFrame, domain: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Router grammar -- the single key ``name`` with a value in the domain."""
    cand = broadcast_if_small(
        domain.select(F.concat(F.lit('"'), F.col("candidate"), F.lit('"')).alias("_q"),
                      F.col("candidate").alias("_sel")).distinct()
    )
    raw = F.regexp_extract("text", G.router, 1)
    parsed = calls.select("call_id", "text", *keep, F.when(F.col("text").rlike(G.router), raw).alias("_raw"))
    out = parsed.join(cand, parsed["_raw"] == cand["_q"], "left")
    return out.select(
        "call_id",
        F.col("_sel").isNotNull().alias("accepted"),
        F.col("_sel").alias("selected"),
        *keep,
    )
