"""Registered queries: one per operator ID, each with its DuckDB oracle.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame computed over the
whole of the tables it reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from callscope.operators import calls as C
from callscope.operators import catalog as B
from callscope.plans import oracle as O
from callscope.session import ensure_checkpoint_dir
from callscope.sources import fixtures as FX

Query = Callable[[SparkSession, str], DataFrame]

_FIXTURES = {
    "events": (FX.v_catalog, FX.v_calls),
    "wide": (FX.v_catalog_wide, FX.v_calls_wide),
    "bench": (FX.v_catalog_bench, FX.v_calls_bench),
}


def _fx(name: str, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    cat, calls = _FIXTURES[name]
    return cat(spark, sf_dir), calls(spark, sf_dir)


def _calls_query(op, fixture: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog, calls = _fx(fixture, spark, sf_dir)
        return op(calls, catalog)

    return run


QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


for _fixture, _suffix in (("events", ""), ("wide", "_wide"), ("bench", "_bench")):
    register(f"c1_validate_calls{_suffix}", _calls_query(C.validate_calls, _fixture), O.accepted_sql(_fixture))
    register(f"c2_call_status{_suffix}", _calls_query(C.call_status, _fixture), O.status_sql(_fixture))
    register(f"c14_conformance{_suffix}", _calls_query(C.conformance_report, _fixture), O.conformance_sql(_fixture))


def _fields_query(op, fixture: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _, calls = _fx(fixture, spark, sf_dir)
        return op(calls)

    return run


for _fixture, _suffix in (("events", ""), ("wide", "_wide")):
    register(f"c3_first_error{_suffix}", _calls_query(C.first_error_position, _fixture), O.first_error_sql(_fixture))
    register(f"c5_unknown_keys{_suffix}", _calls_query(C.unknown_keys, _fixture), O.unknown_keys_sql(_fixture))
    register(f"c6_missing_keys{_suffix}", _calls_query(C.missing_keys, _fixture), O.missing_keys_sql(_fixture))
    register(f"c7_duplicate_keys{_suffix}", _calls_query(C.duplicate_keys, _fixture), O.duplicate_keys_sql(_fixture))
    register(f"c8_type_mismatches{_suffix}", _calls_query(C.type_mismatches, _fixture), O.type_mismatches_sql(_fixture))
    register(f"c13_violation_report{_suffix}", _calls_query(C.violation_report, _fixture), O.violation_report_sql(_fixture))

register("c4_call_fields", _fields_query(C.call_fields, "events"), O.call_fields_sql("events"))
register("c9_param_type_profile", _fields_query(C.param_type_profile, "events"), O.param_profile_sql("events"))
register("c4_call_fields_wide", _fields_query(C.call_fields, "wide"), O.call_fields_sql("wide"))
register("c9_param_type_profile_wide", _fields_query(C.param_type_profile, "wide"), O.param_profile_sql("wide"))
register("c11_typed_parameters_wide", _calls_query(C.typed_parameters, "wide"), O.typed_parameters_sql("wide"))
register("c12_keys_left_trace_wide", _calls_query(C.keys_left_trace, "wide"), O.keys_left_sql("wide"))


def _enum_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = B.routing_domain(FX.v_catalog(spark, sf_dir))
    return C.enum_completions(FX.v_partials(spark, sf_dir), domain)


def _router_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    domain = B.routing_domain(FX.v_catalog(spark, sf_dir))
    return C.router_documents(FX.v_router_calls(spark, sf_dir), domain)


register("c10_enum_completions", _enum_completions, O.enum_completions_sql())
register("c15_router_documents", _router_documents, O.router_sql())

# -- B: catalog and schema as tables ------------------------------------------
register("b1_param_specs", lambda s, d: B.param_specs(FX.v_catalog_all(s, d)), O.param_specs_sql())
register("b2_routing_domain", lambda s, d: B.routing_domain(FX.v_catalog(s, d)), O.routing_domain_sql())
register("b3_merged_param_dictionary", lambda s, d: B.merged_param_dictionary(FX.v_catalog_all(s, d)),
         O.merged_dictionary_sql())
register("b4_resolve_types", lambda s, d: B.resolve_types(B.param_specs(FX.v_catalog_all(s, d))),
         O.resolve_types_sql())


def _resolve_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.resolve_function(FX.v_names(spark, sf_dir), FX.v_catalog(spark, sf_dir))
    return out.select("name_id", "name", "fn_ord", "description", "returns",
                      F.size("params").alias("n_params"))


register("b5_resolve_function", _resolve_function, O.resolve_function_sql())
register("b6_param_key_conflicts", lambda s, d: B.param_key_conflicts(FX.v_catalog_all(s, d)),
         O.key_conflicts_sql())


# -- F: vocabulary and token masks ---------------------------------------------
from callscope.operators import vocab as V  # noqa: E402


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.unique_text(V.decoded_vocab(FX.v_raw_vocab(spark, sf_dir)))


def _allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.allowed_tokens(FX.v_states(spark, sf_dir), _unique(spark, sf_dir), FX.v_catalog(spark, sf_dir))


def _mask_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    uniq = _unique(spark, sf_dir).checkpoint(eager=True)
    states = FX.v_states(spark, sf_dir)
    mask = V.allowed_tokens(states, uniq, FX.v_catalog(spark, sf_dir))
    return V.mask_size_report(states, mask, uniq.count())


register("f1_decoded_vocab", lambda s, d: V.decoded_vocab(FX.v_raw_vocab(s, d)), O.decoded_vocab_sql())
register("f1_unique_text", _unique, O.unique_text_sql())
register("f2_prefix_table", lambda s, d: V.prefix_table(_unique(s, d)), O.prefix_table_sql())
register("f3_prefix_fanout", lambda s, d: V.prefix_fanout(V.prefix_table(_unique(s, d))), O.prefix_fanout_sql())
register("f4_prefix_search", lambda s, d: V.prefix_search(FX.v_queries(s, d), _unique(s, d)), O.prefix_search_sql())
register("f5_allowed_tokens", _allowed, O.allowed_tokens_sql())
register("f6_mask_size_report", _mask_size, O.mask_size_sql())
register("f7_charset_audit", lambda s, d: V.charset_audit(FX.v_raw_vocab(s, d)), O.charset_audit_sql())


# -- E: selection -----------------------------------------------------------------
from callscope.operators import select as E  # noqa: E402

register("e1_apply_mask", lambda s, d: E.apply_mask(FX.v_scores(s, d), FX.v_mask(s, d)), O.apply_mask_sql())
register("e2_masked_argmax", lambda s, d: E.masked_argmax(FX.v_scores(s, d), FX.v_mask(s, d)), O.masked_argmax_sql())
register("e3_forced_choices", lambda s, d: E.forced_choices(FX.v_mask(s, d)), O.forced_choices_sql())
register("e3_scoring_rows", lambda s, d: E.scoring_rows(FX.v_scores(s, d), FX.v_mask(s, d)), O.scoring_rows_sql())
register("e4_deadlocks", lambda s, d: E.deadlocks(FX.v_steps(s, d), FX.v_mask(s, d)), O.deadlocks_sql())


def _route_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = FX.v_catalog(spark, sf_dir)
    docs = C.router_documents(FX.v_router_calls(spark, sf_dir), B.routing_domain(catalog))
    selected = docs.where("accepted").select(F.col("call_id").alias("prompt_id"), "selected")
    return E.route_calls(selected, catalog)


register("e5_route_calls", _route_calls, O.route_calls_sql())
register("e8_over_budget", lambda s, d: E.over_budget(FX.v_token_steps(s, d)), O.over_budget_sql())


# -- D: prompt construction; E6/E7/E9: the two-phase batch ------------------------
from callscope.operators import prompts as D  # noqa: E402
from callscope.plans import two_phase as T  # noqa: E402


def _extractor_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ep = FX.v_event_prompts(spark, sf_dir).select("prompt_id", "prompt", F.col("event_type").alias("name"))
    return D.build_extractor_prompts(ep, FX.v_catalog(spark, sf_dir), FX.v_examples(spark, sf_dir))


def _attach_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = FX.v_examples(spark, sf_dir).unionByName(D.example_table(spark))
    return D.attach_examples(FX.v_names(spark, sf_dir), examples).select(
        "name_id", "name", "contradiction", "counter_examples")


def _two_phase(part: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prompts = FX.v_event_prompts(spark, sf_dir).select("prompt_id", "prompt")
        return T.run_two_phase(prompts, FX.v_catalog(spark, sf_dir))[part]

    return run


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = FX.v_event_prompts(spark, sf_dir).select("prompt_id", "prompt")
    results, errors = T.run_two_phase(prompts, FX.v_catalog(spark, sf_dir))
    return T.result_coverage(prompts, results, errors)


register("d1_router_prompts", lambda s, d: D.build_router_prompts(FX.v_prompts(s, d), FX.v_catalog(s, d)),
         O.router_prompts_sql())
register("d2_extractor_prompts", _extractor_prompts, O.extractor_prompts_sql())
register("d3_attach_examples", _attach_examples, O.attach_examples_sql())
register("e6_two_phase_results", _two_phase(0), O.two_phase_results_sql())
register("e6_two_phase_errors", _two_phase(1), O.two_phase_errors_sql())
register("e9_result_coverage", _coverage, O.result_coverage_sql())


# -- G: evaluation; H: streaming; A: sources and sinks ---------------------------
import uuid  # noqa: E402

from callscope.operators import evaluate as GV  # noqa: E402
from callscope.sources import catalog_io as A  # noqa: E402
from callscope.streaming import validate_stream as H  # noqa: E402

register("g1_accuracy_report", lambda s, d: GV.accuracy_report(FX.v_expected(s, d), FX.v_actual(s, d)),
         O.accuracy_report_sql())
register("g1_parameter_report", lambda s, d: GV.parameter_report(FX.v_expected(s, d), FX.v_actual(s, d)),
         O.parameter_report_sql())
register("g2_routing_confusion", lambda s, d: GV.routing_confusion(FX.v_expected(s, d), FX.v_actual(s, d)),
         O.routing_confusion_sql())


def _work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root (never a node-local path)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _validate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 over calls of which many are delivered again: in the same file, in a later one, and after a restart."""
    root = _work_dir(spark, "h1")
    calls, catalog = FX.v_calls(spark, sf_dir), FX.v_catalog(spark, sf_dir)
    again = calls.where("call_id % 3 = 0")
    calls.unionByName(again).write.parquet(f"{root}/source")
    start = lambda: H.validate_stream(spark, f"{root}/source", catalog, f"{root}/sink", f"{root}/checkpoint")
    start().awaitTermination()
    again.unionByName(calls.where("call_id % 5 = 0")).write.mode("append").parquet(f"{root}/source")
    start().awaitTermination()
    return H.read_results(spark, f"{root}/sink")


def _catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.parse_function_catalog(FX.v_catalog_docs(spark, sf_dir))
    return c.select("source", "ord", "name", "description",
                    F.array_join(F.transform("params", lambda p: F.concat(p["key"], F.lit(":"), p["type"])), ",")
                    .alias("params"), "returns")


def _written_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = FX.v_event_prompts(spark, sf_dir).select("prompt_id", "prompt")
    results, _ = T.run_two_phase(prompts, FX.v_catalog(spark, sf_dir))
    out = _work_dir(spark, "a4")
    A.write_call_results(results, out)
    back = spark.read.text(out)
    return back.select(F.get_json_object("value", "$.prompt").alias("prompt"),
                       F.get_json_object("value", "$.name").alias("name"),
                       F.get_json_object("value", "$.parameters").alias("parameters"))


register("h1_validate_stream", _validate_stream, O.status_sql("events"))
register("a1_parse_function_catalog", _catalog_rows, O.parse_catalog_sql())
register("a2_parse_prompts", lambda s, d: A.parse_prompts(FX.v_prompt_docs(s, d)), O.parse_prompts_sql())
register("a3_definition_rejects", lambda s, d: A.definition_rejects(FX.v_catalog_docs(s, d)),
         O.definition_rejects_sql("function"))
register("a3_prompt_rejects", lambda s, d: A.definition_rejects(FX.v_prompt_docs(s, d), "prompt"),
         O.definition_rejects_sql("prompt"))
register("a4_write_call_results", _written_results, O.written_results_sql())


def _retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INCOMPLETE outputs are re-scored once; a second attempt closes the object."""
    calls = FX.v_calls(spark, sf_dir)
    scored = calls.select(F.col("call_id").alias("prompt_id"), F.col("function").alias("name"),
                          F.lit("").alias("prompt"), F.col("text"), F.col("text").alias("output"))

    def completing_scorer(df: DataFrame) -> DataFrame:
        return df.select("*", F.concat("text", F.lit("}")).alias("output"))

    out = T.retry_incomplete(scored, completing_scorer, FX.v_catalog(spark, sf_dir))
    return out.select("prompt_id", F.col("name").alias("function"), "output")


register("e7_retry_incomplete", _retry, O.retry_sql())


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14 on the events calls: the minimum end-to-end slice."""
    return QUERIES["c14_conformance"](spark, sf_dir)
