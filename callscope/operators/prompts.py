"""Prompt dataset construction.

Prompts are built with ``concat`` over columns.  The catalog block of the
router prompt is the same for every prompt, so it is aggregated once from the
catalog and enters the plan as a scalar subquery; the per-function parts of the extractor prompt are aggregated per function and
joined by function name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators.catalog import resolved
from callscope.session import broadcast_if_small

# --------------------------------------------------------------------------
# Prompt texts that must equal the reference's word for word.
# --------------------------------------------------------------------------
ROUTER_HEADER = (
    "Task: You are a function selector. Given a user request, "
    "output the name of the best matching function "
    "as a JSON object.\n\n"
    "Available functions:\n"
)
ROUTER_EXAMPLES = (
    "\n"
    "Examples:\n"
    'User: "Add 2 and 3"\n'
    'Output: {"name": "fn_add_numbers"}\n\n'
    'User: "Greet Alice"\n'
    'Output: {"name": "fn_greet"}\n\n'
    'User: "Reverse \'opencode\'"\n'
    'Output: {"name": "fn_reverse_string"}\n\n'
    'User: "Square root of 25"\n'
    'Output: {"name": "fn_get_square_root"}\n\n'
    'User: "Replace \'a\' with \'b\'"\n'
    'Output: {"name": "fn_substitute_string_with_regex"}\n\n'
    'User: "What\'s the weather?"\n'
    'Output: {"name": "none"}\n\n'
)
EXTRACTOR_HEADER = (
    "Task: You are a parameter extractor. "
    "Do NOT solve the problem or calculate the answer. "
    "Only extract the arguments from the user request.\n\n"
)
EXTRACTOR_RULES = (
    "For regex parameters, generate a generic pattern:\n"
    "- Class-based (numbers, digits, vowels, whitespace) \u2192 "
    "[0-9]+, [aeiouAEIOU], \\s+\n"
    "- Specific quoted word (e.g. 'cat') \u2192 use that word "
    "literally\n\n"
)
EXTRACTOR_GENERIC_EXAMPLES = (
    "Examples:\n"
    "User: sum of 2 and 3\n"
    "Function: fn_add_numbers\n"
    'Output: {"a": 2, "b": 3}\n'
    "\n"
    "User: Replace all numbers in 'A1 B2 C3' with X\n"
    "Function: fn_substitute_string_with_regex\n"
    'Output: {"source_string": "A1 B2 C3", "regex": "[0-9]+", '
    '"replacement": "X"}\n'
    "\n"
    "User: Replace all vowels in 'hello' with *\n"
    "Function: fn_substitute_string_with_regex\n"
    'Output: {"source_string": "hello", "regex": "[aeiouAEIOU]", '
    '"replacement": "*"}\n'
    "\n"
    "User: Substitute 'apple' with 'orange' in 'The apple fell'\n"
    "Function: fn_substitute_string_with_regex\n"
    'Output: {"source_string": "The apple fell", "regex": "apple", '
    '"replacement": "orange"}\n'
)
EXTRACTOR_REMINDER = (
    "Reminder: Extract the value exactly as written "
    "\u2014 do NOT transform it.\n\n"
)
# Function-specific additions: (function, contradiction line, counter-examples).
FUNCTION_EXAMPLES = (
    (
        "fn_reverse_string",
        "Despite the function name, do NOT reverse the string \u2014 extract it verbatim.\n",
        "\n"
        "User: Reverse the string 'book'\n"
        "Function: fn_reverse_string\n"
        'Output: {"s": "book"}\n'
        "\n"
        "User: Reverse 'abc'\n"
        "Function: fn_reverse_string\n"
        'Output: {"s": "abc"}\n'
        "\n"
        "User: Reverse 'xyz'\n"
        "Function: fn_reverse_string\n"
        'Output: {"s": "xyz"}\n',
    ),
    (
        "fn_get_square_root",
        "",
        "\n"
        "User: Square root of 25\n"
        "Function: fn_get_square_root\n"
        'Output: {"a": 25}\n'
        "\n"
        "User: What is the square root of 49\n"
        "Function: fn_get_square_root\n"
        'Output: {"a": 49}\n'
        "\n"
        "User: Square root of 9\n"
        "Function: fn_get_square_root\n"
        'Output: {"a": 9}\n'
        "\n"
        "User: Square root of 100\n"
        "Function: fn_get_square_root\n"
        'Output: {"a": 100}\n',
    ),
)


def example_table(spark: SparkSession) -> DataFrame:
    """D3 input: per-function contradiction line and counter-examples (fixed)."""
    return spark.createDataFrame(
        list(FUNCTION_EXAMPLES), "function string, contradiction string, counter_examples string"
    )


def catalog_block(catalog: DataFrame) -> DataFrame:
    """One row, one column: ``- name: description`` lines in catalog order (all definitions, as listed)."""
    line = F.concat(F.lit("- "), "name", F.lit(": "), F.coalesce("description", F.lit("")), F.lit("\n"))
    lines = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    return catalog.agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("block"))


def build_router_prompts(prompts: DataFrame, catalog: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(prompt_id, text, *keep)``; the user prompt is inserted unescaped.

    The catalog block is the same for every prompt: a scalar subquery, worked
    out once by the cluster, of any number of definitions.
    """
    text = F.concat(
        F.lit(ROUTER_HEADER), catalog_block(catalog).scalar(), F.lit(ROUTER_EXAMPLES + 'User: "'),
        F.col("prompt"), F.lit('"\nOutput:'),
    )
    return prompts.select("prompt_id", text.alias("text"), *keep)


def function_spec_lines(catalog: DataFrame) -> DataFrame:
    """Per resolved function: ``  key (type)`` lines in declaration order."""
    return resolved(catalog).select(
        F.col("name").alias("function"),
        F.array_join(
            F.transform("params", lambda p: F.concat(F.lit("  "), p["key"], F.lit(" ("), p["type"], F.lit(")"))),
            "\n",
        ).alias("spec_lines"),
    )


def attach_examples(routed: DataFrame, examples: DataFrame, name_col: str = "name") -> DataFrame:
    """D3: add the function's contradiction line and counter-examples ('' if none)."""
    ex = broadcast_if_small(examples.withColumnRenamed("function", "_ex_fn"))
    out = routed.join(ex, routed[name_col] == ex["_ex_fn"], "left").drop("_ex_fn")
    return out.withColumn("contradiction", F.coalesce("contradiction", F.lit(""))).withColumn(
        "counter_examples", F.coalesce("counter_examples", F.lit(""))
    )


def build_extractor_prompts(routed: DataFrame, catalog: DataFrame,
                            examples: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(prompt_id, name, text, *keep)`` for prompts routed to a known function.

    ``routed(prompt_id, prompt, name)``.
    """
    spark = routed.sparkSession
    specs = broadcast_if_small(function_spec_lines(catalog))
    df = routed.join(specs, routed["name"] == specs["function"], "inner").drop("function")
    df = attach_examples(df, examples if examples is not None else example_table(spark))
    name = F.col("name")
    text = F.concat(
        F.lit(EXTRACTOR_HEADER),
        F.lit("Function: "), name, F.lit("\n"),
        F.col("contradiction"),
        F.lit("Parameters:\n"), F.col("spec_lines"), F.lit("\n\n"),
        F.lit(EXTRACTOR_RULES),
        F.lit(EXTRACTOR_GENERIC_EXAMPLES),
        F.col("counter_examples"), F.lit("\n"),
        F.lit(EXTRACTOR_REMINDER),
        F.lit('User: "'), F.col("prompt"), F.lit('"\n'),
        F.lit("Function: "), name, F.lit("\n"),
        F.lit("Output:\n"),
    )
    return df.select("prompt_id", "name", text.alias("text"), *keep)
