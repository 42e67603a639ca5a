"""Two-phase batch: route each prompt to a function, extract its parameters.

Scorers are pluggable: a scorer is any ``DataFrame -> DataFrame`` that takes
``(prompt_id, prompt, text[, name], attempt)`` -- ``text`` being the built
prompt -- and returns the same rows with an ``output`` column added (so the
batch never has to join scorer output back to its requests).  A model-backed scorer would be
a ``mapInPandas`` that loads the model once per executor; the lexical scorers
below are built from Spark expressions only and make the plan testable
without a model.

Flow (every step a DataFrame job, all prompts at once)::

    D1 router prompts -> scorer -> C15 router document -> E5 route
       -> 'none' rows are final
       -> D2 extractor prompts -> scorer (+E7 retry of INCOMPLETE) -> C2 status
       -> TERMINAL rows are results, the rest are errors
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from callscope.functions import status as S
from callscope.functions.grammar import ROUTER_FALLBACK
from callscope.functions.text import strip
from callscope.operators import calls as C
from callscope.operators import prompts as D
from callscope.operators import select as E
from callscope.operators.catalog import attach_schema, resolved, routing_domain
from callscope.plans.run_store import RunStore
from callscope.session import broadcast_if_small

Scorer = Callable[[DataFrame], DataFrame]

ROW_NAMES = 100  # so many names are held against the words of each prompt; more are joined

NUMBER_IN_TEXT = "-?[0-9]+(?:\\.[0-9]+)?"


# --------------------------------------------------------------------------
# Lexical scorers (deterministic, expression-only)
# --------------------------------------------------------------------------

def lexical_router(catalog: DataFrame) -> Scorer:
    """Pick the first catalog function whose name occurs as a word of the prompt.

    The names of a small catalog are one value that every prompt's words are
    held against, so no prompt is moved.  With more names the output, which
    depends on the prompt's text alone, is worked out once per distinct text: its
    words are joined with the names, and the choice is joined back on the text.
    """
    fns = resolved(catalog)
    names = fns.select(F.lower("name").alias("_w"), F.col("name").alias("_name"), F.col("ord").alias("_ord"))
    few = len(names.limit(ROW_NAMES + 1).collect()) <= ROW_NAMES
    in_order = names.where("_ord is not null").agg(F.array_sort(F.collect_list(F.struct("_ord", "_w", "_name"))))

    def score(df: DataFrame) -> DataFrame:
        words = F.array_distinct(F.regexp_extract_all(F.lower("prompt"), F.lit("[\\p{L}0-9_]+"), 0))
        if few:
            row = df.withColumns({"_words": words, "_names": in_order.scalar()})
            hits = F.filter("_names", lambda n: F.array_contains("_words", n["_w"]))
            name = F.try_element_at(hits, F.lit(1))["_name"]
            return row.select(*df.columns, F.concat(F.lit('{"name": "'), F.coalesce(name, F.lit(ROUTER_FALLBACK)), F.lit('"}')).alias("output"))
        by_word = df.select("prompt").distinct().select("prompt", F.explode(words).alias("_w"))
        hits = by_word.join(broadcast_if_small(names), "_w").groupBy("prompt").agg(F.min_by("_name", "_ord").alias("_name"))
        output = F.concat(F.lit('{"name": "'), F.coalesce("_name", F.lit(ROUTER_FALLBACK)), F.lit('"}'))
        return df.join(hits, "prompt", "left").select(*df.columns, output.alias("output"))

    return score


def _json_string(s):
    quoted = F.to_json(F.array(s))
    return quoted.substr(F.lit(2), F.length(quoted) - 2)


def lexical_extractor(catalog: DataFrame) -> Scorer:
    """Fill each declared key from the prompt: numbers in order of appearance
    for integer/number keys, quoted texts (else the last word) for strings,
    yes/true for booleans, null for null."""

    def score(df: DataFrame) -> DataFrame:
        x = attach_schema(df.withColumnRenamed("name", "function"), catalog)
        p = F.col("prompt")
        nums = F.regexp_extract_all(p, F.lit(NUMBER_IN_TEXT), 0)
        quoted = F.transform(
            F.regexp_extract_all(p, F.lit("'[^']*'|\"[^\"]*\""), 0), lambda q: q.substr(F.lit(2), F.length(q) - 2)
        )
        last_word = F.regexp_extract(p, "([\\p{L}0-9_]+)[^\\p{L}0-9_]*\\z", 1)
        truthy = p.rlike("(?i)\\b(yes|true)\\b")
        tarr = F.transform("keys", lambda k: F.element_at("types", k))

        def value(k, i):
            t = F.element_at("types", k)
            before = F.slice(tarr, F.lit(1), i)
            n_idx = F.size(F.filter(before, lambda u: u.isin("integer", "number"))) + 1
            s_idx = F.size(F.filter(before, lambda u: u == "string")) + 1
            return (
                F.when(t.isin("integer", "number"), F.coalesce(F.try_element_at(nums, n_idx), F.lit("")))
                .when(t == "string", _json_string(F.coalesce(F.try_element_at(quoted, s_idx), last_word)))
                .when(t == "boolean", F.when(truthy, F.lit("true")).otherwise(F.lit("false")))
                .otherwise(F.lit("null"))
            )

        items = F.transform("keys", lambda k, i: F.concat(F.lit('"'), k, F.lit('": '), value(k, i)))
        doc = F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))
        return x.select(*[c for c in df.columns if c != "name"], F.col("function").alias("name"),
                        doc.alias("output"))

    return score


# --------------------------------------------------------------------------
# Retry only INCOMPLETE outputs
# --------------------------------------------------------------------------

def _attempts(first: DataFrame, again: Callable[[int, DataFrame], DataFrame], request: list[str], max_attempts: int) -> DataFrame:
    """Score the INCOMPLETE rows again; each row ends up here exactly once.

    ``first`` and what ``again`` returns are written tables of checked answers,
    with ``status``: a scorer may answer differently each time it is asked (only
    then does a retry help), so its output must not be worked out again by each
    reader, and an answer's check, read by several jobs, is worked out once.
    """
    current = first
    ended = []
    for attempt in range(2, max_attempts + 1):
        unfinished = F.col("status") == S.INCOMPLETE
        ended.append(current.where(~unfinished))
        redo = current.where(unfinished).select(*request).withColumn("attempt", F.lit(attempt))
        current = again(attempt, redo)
    for part in ended:
        current = part.unionByName(current, allowMissingColumns=True)
    return current


def retry_incomplete(scored: DataFrame, scorer: Scorer, catalog: DataFrame,
                     max_attempts: int = 2) -> DataFrame:
    """Re-score the rows whose output is INCOMPLETE, up to ``max_attempts``.

    ``scored(prompt_id, name, prompt, text, output)`` -- the scorer's own
    output rows, request columns included; a null output counts as empty.  Every
    attempt's output is written before it is split by status, so each row is
    scored once per attempt and comes out once.  Adds ``status``.
    """
    store = RunStore(scored.sparkSession)
    check = _extraction_check(catalog)
    store.add("scored", check(scored))
    first = store.spark.read.parquet(*store.parts("scored"))
    return _extracted(first, scorer, check, store, scored.columns, max_attempts)


def _extraction_check(catalog: DataFrame) -> Scorer:
    def check(df: DataFrame) -> DataFrame:
        doc = df.withColumnRenamed("text", "_request").select(
            "*", F.col("name").alias("function"), strip(F.coalesce("output", F.lit(""))).alias("text"))
        out = S.add_status(attach_schema(doc, catalog))
        return out.drop("keys", "types", "function", "text").withColumnRenamed("_request", "text")

    return check


def _extracted(first: DataFrame, scorer: Scorer, check: Scorer, store: RunStore, columns: list[str], max_attempts: int) -> DataFrame:
    request = [c for c in columns if c not in ("output", "status")]
    return _attempts(first, lambda n, redo: store.checked_answers(f"extract-{n}", redo, scorer, check), request, max_attempts)


def route_prompts(requests: DataFrame, scorer: Scorer, catalog: DataFrame, max_attempts: int = 2,
                  store: RunStore | None = None) -> DataFrame:
    """The routing phase: the scorer's rows with ``status`` and ``selected`` (null unless TERMINAL).

    A document cut short is INCOMPLETE and scored again, as in extraction; a
    complete one whose name is no candidate is REJECTED.  Answers are kept in
    ``store`` and taken from there.
    """
    domain = routing_domain(catalog)
    store = store or RunStore(requests.sparkSession)

    def check(df: DataFrame) -> DataFrame:
        doc = df.withColumnRenamed("text", "_request").select(
            "*", F.col("prompt_id").alias("call_id"), strip(F.coalesce("output", F.lit(""))).alias("text"),
            F.array(F.lit("name")).alias("keys"), F.create_map(F.lit("name"), F.lit("string")).alias("types"))
        doc = S.add_status(doc, out="_status").drop("keys", "types")
        kept = [c for c in doc.columns if c not in ("call_id", "text")]
        out = C.router_documents(doc, domain, keep=tuple(kept))
        status = F.when(F.col("accepted"), F.lit(S.TERMINAL)).when(F.col("_status") == S.INCOMPLETE, F.lit(S.INCOMPLETE))
        out = out.withColumn("status", status.otherwise(F.lit(S.REJECTED)))
        return out.drop("call_id", "accepted", "_status").withColumnRenamed("_request", "text")

    first = store.checked_answers("route-1", requests, scorer, check)
    return _attempts(first, lambda n, redo: store.checked_answers(f"route-{n}", redo, scorer, check), requests.columns, max_attempts)


# --------------------------------------------------------------------------
# The batch
# --------------------------------------------------------------------------

def run_two_phase(prompts: DataFrame, catalog: DataFrame, router_scorer: Scorer | None = None,
                  extractor_scorer: Scorer | None = None, examples: DataFrame | None = None,
                  max_attempts: int = 2, run_dir: str | None = None, slices: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(results, errors)``.

    ``results(prompt_id, prompt, name, parameters)`` -- ``parameters`` is the
    validated JSON object text (``{}`` for ``none``); ``errors(prompt_id,
    phase, reason)`` lists prompts that produced no result, with the reason
    ``incomplete`` or ``rejected``.  Every prompt ends in exactly one of the two.
    The prompt text rides along every step, so no step joins back to the prompt
    table; both phases retry outputs that were cut short.

    Every answer of a scorer is kept under ``run_dir``, by phase and attempt.  A
    batch that was stopped is taken up by calling this again with the same
    folder: only prompts without an answer are asked for, also if some are new.
    With ``slices`` an attempt is written in so many parts, and a stop costs no
    more than one.  Without a folder the batch gets a new one, so it starts
    afresh.  Another scorer or catalog needs another folder.
    """
    store = RunStore(prompts.sparkSession, run_dir, slices)
    router_scorer = router_scorer or lexical_router(catalog)
    extractor_scorer = extractor_scorer or lexical_extractor(catalog)

    rp = D.build_router_prompts(prompts, catalog, keep=("prompt",)).withColumn("attempt", F.lit(1))
    routed_docs = route_prompts(rp, router_scorer, catalog, max_attempts, store)
    router_errors = _errors(routed_docs, "route")
    routed = E.route_calls(
        routed_docs.where(F.col("status") == S.TERMINAL).select("prompt_id", "selected", "prompt"),
        catalog, keep=("prompt",),
    )
    none_results = routed.where(~F.col("extract")).select(
        "prompt_id", "prompt", "name", F.lit("{}").alias("parameters")
    )

    to_extract = routed.where("extract").select("prompt_id", "prompt", "name")
    ep = D.build_extractor_prompts(to_extract, catalog, examples, keep=("prompt",)).withColumn("attempt", F.lit(1))
    check = _extraction_check(catalog)
    first = store.checked_answers("extract-1", ep, extractor_scorer, check)
    checked = _extracted(first, extractor_scorer, check, store, ep.columns, max_attempts)
    extracted = checked.where(F.col("status") == S.TERMINAL).select(
        "prompt_id", "prompt", "name", strip(F.col("output")).alias("parameters")
    )
    return none_results.unionByName(extracted), router_errors.unionByName(_errors(checked, "extract"))


def _errors(checked: DataFrame, phase: str) -> DataFrame:
    return checked.where(F.col("status") != S.TERMINAL).select(
        "prompt_id", F.lit(phase).alias("phase"), F.lower("status").alias("reason")
    )


def result_coverage(prompts: DataFrame, results: DataFrame, errors: DataFrame) -> DataFrame:
    """E9 over a batch: the prompts missing from the results and why."""
    errs = errors.select("prompt_id", F.concat_ws("_", "phase", "reason").alias("reason"))
    return E.result_coverage(prompts, results, errs)


def table_scorer(recorded: DataFrame) -> Scorer:
    """Replay recorded outputs: ``recorded(prompt_id, attempt, output)``, one row for each id and attempt.

    A request without a recorded output gets a null one, which counts as empty.
    """
    given = recorded.select(F.col("prompt_id"), F.col("attempt").cast("int").alias("attempt"), "output")

    def run(df: DataFrame) -> DataFrame:
        return df.join(given, ["prompt_id", "attempt"], "left").select(*df.columns, "output")

    return run


# --------------------------------------------------------------------------
# Model-backed scorers: Arrow batches through mapInPandas
# --------------------------------------------------------------------------

def pandas_scorer(generate: Callable[[list[str]], list[str]]) -> Scorer:
    """Wrap a batch function ``texts -> outputs`` (e.g. a model's constrained
    generate) as a scorer.

    Rows travel to the Python workers as Arrow batches via ``mapInPandas``;
    ``generate`` sees one batch of built prompts at a time, so a model is
    loaded once per worker (cache it in the function's closure or a module
    global) and never per row.  Only this step leaves the JVM.
    """

    def run(df: DataFrame) -> DataFrame:
        schema = StructType(list(df.schema.fields) + [StructField("output", StringType())])

        def batches(it):
            for pdf in it:
                pdf = pdf.copy()
                pdf["output"] = list(generate(pdf["text"].tolist()))
                yield pdf

        return df.mapInPandas(batches, schema)

    return run
