"""Sources and sinks for catalogs, prompts and call results (A1-A4).

Input files are JSON lists.  Each file is read whole as one row (a JSON list
is one document); at scale the catalog or prompt set is split into many such
files, or stored as Parquet with explicit ids, and every file is parsed in
parallel.  Validation is strict in the reference's sense -- required fields,
no extra fields, closed type names -- and reported as rows
``(source, ord, reason, field)``; ``strict=True`` raises on the first one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.functions.grammar import TYPE_NAMES
from callscope.functions.ordering import dense_index
from callscope.session import ensure_checkpoint_dir

FUNCTION_FIELDS = ("name", "description", "parameters", "returns")
PROMPT_FIELDS = ("prompt",)
REASONS = ("invalid_json", "root_not_list", "not_object", "missing_field", "extra_field",
           "bad_type", "not_string", "unsupported_identifier")

# Names and keys are spliced into the grammar and prompts as raw text.
BAD_IDENTIFIER = '["\\\\\\x00-\\x1f]'


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(source, text)``: one row per file, the whole file as text."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("source"), F.col("value").alias("text")
    )


def well_formed(text: Column) -> Column:
    """The text is one JSON value with nothing after it.

    Spark's parsers stop at the end of the first value.  With strings taken out,
    a document's brackets show where its root closes: it must be at the end.
    """
    bare = F.regexp_replace(text, '"(?:[^"\\\\]|\\\\.)*+"', "s")
    brackets = F.split(F.regexp_replace(bare, "[^\\[\\]{}]", ""), "")
    opens = F.filter(brackets, lambda c: c != "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("closed"))

    def step(at: Column, c: Column) -> Column:
        depth = at["depth"] + F.when(c.isin("[", "{"), 1).otherwise(-1)
        return F.struct(depth.alias("depth"), (at["closed"] + (depth <= 0).cast("int")).alias("closed"))

    end = F.aggregate(opens, start, step)
    nested = (end["depth"] == 0) & (end["closed"] == 1) & bare.rlike("\\A\\s*[\\[{]") & bare.rlike("[\\]}]\\s*\\z")
    scalar = (F.size(opens) == 0) & bare.rlike("\\A\\s*\\S+\\s*\\z")
    return F.expr("try_parse_json(text)").isNotNull() & (nested | scalar)


NO_REJECTS = "array<struct<reason:string,field:string>>"


def _reject(cond: Column, reason: str, field: Column | str) -> Column:
    f = field if isinstance(field, Column) else F.lit(field)
    found = F.array(F.struct(F.lit(reason).alias("reason"), f.alias("field")))
    return F.when(cond, found).otherwise(F.array().cast(NO_REJECTS))


def _fields_of(value: Column) -> Column:
    """The fields of an object as a map of variants; null if the value is none."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def _type_field_rejects(value: Column, path: Column) -> Column:
    """Rejects of a ``{"type": <name>}`` object found at ``path``."""
    keys = F.map_keys(_fields_of(value))
    t = F.try_variant_get(value, "$.type", "string")
    return F.concat(
        _reject(keys.isNull(), "not_object", path),
        _reject(keys.isNotNull() & ~F.array_contains(keys, "type"), "missing_field", F.concat(path, F.lit(".type"))),
        F.transform(
            F.coalesce(F.array_except(keys, F.array(F.lit("type"))), F.array().cast("array<string>")),
            lambda k: F.struct(F.lit("extra_field").alias("reason"), F.concat(path, F.lit("."), k).alias("field")),
        ),
        _reject(F.array_contains(keys, "type") & ~F.coalesce(t.isin(*TYPE_NAMES), F.lit(False)),
                "bad_type", F.concat(path, F.lit(".type"))),
    )


def _parsed(e: Column, kind: str) -> Column:
    """An element's fields, each a variant; of a function also its parameters, which keep their order only if read from the text."""
    fields = F.from_json(e, "map<string,variant>")
    if kind != "function":
        return F.struct(fields.alias("fields"))
    params = F.from_json(F.get_json_object(e, "$.parameters"), "map<string,variant>")
    return F.struct(fields.alias("fields"), params.alias("params"))


def _checked(parsed: Column, kind: str) -> Column:
    """``rejects`` of an element and the values that its row needs."""
    fields = FUNCTION_FIELDS if kind == "function" else PROMPT_FIELDS
    found = parsed["fields"]
    is_object = found.isNotNull()
    allowed = F.array(*[F.lit(f) for f in fields])
    present = F.coalesce(F.map_keys(found), F.array().cast("array<string>"))
    value = lambda f: F.try_element_at(found, F.lit(f))
    text = lambda f: F.try_variant_get(value(f), "$", "string")
    is_text = lambda f: F.coalesce(F.schema_of_variant(value(f)) == "STRING", F.lit(False))
    parts = [
        _reject(~is_object, "not_object", ""),
        F.transform(
            F.when(is_object, F.array_except(allowed, present)).otherwise(F.array().cast("array<string>")),
            lambda f: F.struct(F.lit("missing_field").alias("reason"), f.alias("field")),
        ),
        F.transform(F.array_except(present, allowed),
                    lambda f: F.struct(F.lit("extra_field").alias("reason"), f.alias("field"))),
    ]
    for f in ("name", "description") if kind == "function" else ("prompt",):
        parts.append(_reject(F.array_contains(present, f) & ~is_text(f), "not_string", f))
    if kind != "function":
        return F.struct(F.concat(*parts).alias("rejects"), text("prompt").alias("prompt"))
    parts.append(_reject(is_text("name") & F.coalesce(text("name").rlike(BAD_IDENTIFIER), F.lit(False)), "unsupported_identifier", "name"))
    parts.append(_reject(F.array_contains(present, "parameters") & _fields_of(value("parameters")).isNull(), "not_object", "parameters"))
    entries = F.coalesce(F.map_entries(parsed["params"]), F.array().cast("array<struct<key:string,value:variant>>"))
    parts.append(F.flatten(F.transform(
        entries,
        lambda kv: F.concat(
            _reject(kv["key"].rlike(BAD_IDENTIFIER), "unsupported_identifier", F.concat(F.lit("parameters."), kv["key"])),
            _type_field_rejects(kv["value"], F.concat(F.lit("parameters."), kv["key"])),
        ),
    )))
    parts.append(F.when(F.array_contains(present, "returns"), _type_field_rejects(value("returns"), F.lit("returns")))
                 .otherwise(F.array().cast(NO_REJECTS)))
    params = F.transform(
        entries,
        lambda kv, i: F.struct(i.alias("ord"), kv["key"].alias("key"), F.try_variant_get(kv["value"], "$.type", "string").alias("type")),
    )
    return F.struct(
        F.concat(*parts).alias("rejects"), text("name").alias("name"), text("description").alias("description"),
        params.alias("params"), F.try_variant_get(value("returns"), "$.type", "string").alias("returns"))


def checked_documents(docs: DataFrame, kind: str) -> DataFrame:
    """``(source, document, elements)``: what is wrong with each document as a whole, and its elements with what is wrong with them.

    One projection over one scan: every element is parsed once, and its rejects
    and its values stay side by side in the document's row.
    """
    staged = docs.select("source", "text", well_formed(F.col("text")).alias("_whole"))
    is_list = F.ltrim("text", F.lit(" \t\n\r")).startswith("[")
    staged = staged.select(
        "source",
        F.when(~F.coalesce("_whole", F.lit(False)), "invalid_json").when(~is_list, "root_not_list").alias("document"),
        F.transform(F.when(F.col("_whole"), F.from_json("text", "array<string>")), lambda e: _parsed(e, kind)).alias("_parsed"))
    # one row each: a generator keeps filters on the result from being worked out again below
    elements = F.transform("_parsed", lambda p: _checked(p, kind))
    out = staged.select("source", "document", F.explode(F.array(F.struct(elements.alias("all")))).alias("_e"))
    return out.select("source", "document", F.col("_e.all").alias("elements"))


def _rejects(checked: DataFrame) -> DataFrame:
    of_document = F.when(F.col("document").isNotNull(), F.array(F.struct(
        F.lit(None).cast("bigint").alias("ord"), F.col("document").alias("reason"), F.lit("").alias("field")))).otherwise(F.array())
    of_elements = F.flatten(F.transform("elements", lambda e, i: F.transform(
        e["rejects"], lambda r: F.struct(i.cast("bigint").alias("ord"), r["reason"].alias("reason"), r["field"].alias("field")))))
    every = F.concat(of_document, F.coalesce(of_elements, F.array()))
    return checked.select("source", F.explode(every).alias("r")).select("source", "r.ord", "r.reason", "r.field")


def definition_rejects(docs: DataFrame, kind: str = "function") -> DataFrame:
    """A3: ``(source, ord, reason, field)`` for every rule a document breaks."""
    return _rejects(checked_documents(docs, kind))


def _clean_rows(docs: DataFrame, kind: str, strict: bool) -> DataFrame:
    """``(source, ord, e)`` of the documents that break no rule; ``strict`` raises at the first one that does."""
    checked = checked_documents(docs, kind)
    if strict:
        first = _rejects(checked).orderBy("source", "ord").first()
        if first is not None:
            raise ValueError(
                f"Validation failed for {kind} at index {first['ord']} in {first['source']}: "
                f"{first['reason']} {first['field']}"
            )
    clean = checked.where(F.col("document").isNull() & ~F.exists("elements", lambda e: F.size(e["rejects"]) > 0))
    return clean.select("source", F.posexplode("elements").alias("ord", "e")).withColumn("ord", F.col("ord").cast("bigint"))


def parse_function_catalog(docs: DataFrame, strict: bool = False) -> DataFrame:
    """A1: catalog rows of every document that breaks no rule.

    As in the reference, loading is all-or-nothing per document: one bad
    definition rejects its whole file.  ``strict=True`` raises instead, naming
    the first rule broken.
    """
    rows = _clean_rows(docs, "function", strict)
    return rows.select("source", "ord", "e.name", "e.description", "e.params", "e.returns")


def read_function_catalog(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A1 from files: JSON-list catalog files -> catalog rows."""
    return parse_function_catalog(read_json_documents(spark, path), strict=strict)


def parse_prompts(docs: DataFrame, strict: bool = False) -> DataFrame:
    """A2: ``(source, prompt_id, prompt)``.

    ``prompt_id`` is the prompt's position over all documents, in the order of
    their sources, so it names one prompt however many documents there are.
    """
    prompts = _clean_rows(docs, "prompt", strict).select("source", "ord", "e.prompt")
    return dense_index(prompts, "source", "ord", out="prompt_id").select("source", "prompt_id", "prompt")


def read_prompts_jsonl(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A2 for JSON lines: one ``{"prompt": ...}`` object per line, split freely.

    Every line is checked with the same rules as a list element (each line is
    its own one-element document, named ``file#id``).  ``prompt_id`` is
    unique and increases with the position inside each file split; when
    global input positions matter, store prompts as Parquet with explicit ids.
    """
    ensure_checkpoint_dir(spark)
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(
        F.monotonically_increasing_id().alias("prompt_id"), F.input_file_name().alias("_file"), "value"
    )
    docs = lines.select(
        F.concat("_file", F.lit("#"), F.col("prompt_id").cast("string")).alias("source"),
        F.concat(F.lit("["), F.col("value"), F.lit("]")).alias("text"), "prompt_id",
    ).checkpoint(eager=True)  # ids are fixed once, before validation reads the lines again
    checked = checked_documents(docs.select(F.struct("source", "prompt_id").alias("source"), "text"), "prompt")
    if strict:
        first = _rejects(checked).orderBy("source").first()
        if first is not None:
            raise ValueError(f"Validation failed for prompt {first['source']['source']}: {first['reason']} {first['field']}")
    clean = checked.where(F.col("document").isNull() & ~F.exists("elements", lambda e: F.size(e["rejects"]) > 0))
    return clean.select("source.prompt_id", F.explode("elements").alias("e")).select("prompt_id", "e.prompt")


def read_prompts(spark: SparkSession, path: str, fmt: str = "json", strict: bool = True) -> DataFrame:
    """A2 from files: JSON lists, JSON lines, or Parquet ``(prompt_id, prompt)`` for scale."""
    if fmt == "parquet":
        return spark.read.parquet(path).select("prompt_id", "prompt")
    if fmt == "jsonl":
        return read_prompts_jsonl(spark, path, strict=strict)
    return parse_prompts(read_json_documents(spark, path), strict=strict)


def write_call_results(results: DataFrame, path: str, fmt: str = "json") -> None:
    """A4: overwrite ``path`` with ``{prompt, name, parameters}`` records in prompt order.

    ``parameters`` is already validated JSON object text, so it is written as
    an object, not as a string.  Rows are range-partitioned and sorted by
    ``prompt_id``: part files in name order hold the results in input order.
    """
    ordered = results.repartitionByRange("prompt_id").sortWithinPartitions("prompt_id")
    if fmt == "parquet":
        ordered.select("prompt_id", "prompt", "name", "parameters").write.mode("overwrite").parquet(path)
        return
    line = F.concat(
        F.lit('{"prompt": '), F.to_json(F.array("prompt")).substr(F.lit(2), F.length(F.to_json(F.array("prompt"))) - 2),
        F.lit(', "name": '), F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2),
        F.lit(', "parameters": '), F.col("parameters"), F.lit("}"),
    )
    ordered.select(line.alias("value")).write.mode("overwrite").text(path)
