"""Catalog and schema as tables.

A catalog is a DataFrame ``(ord, name, description, params, returns)`` with
``params: array<struct<ord, key, type>>`` in declaration order.  Catalogs are
metadata (functions number in the thousands at most); calls are the data.
Everything here is row-local or grouped by function/key, and the outputs that
are joined against calls are broadcast only behind a row-count check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.functions.grammar import CANONICAL, ROUTER_FALLBACK
from callscope.session import broadcast_if_small


def canonical_type(type_col: Column) -> Column:
    """Declared type -> grammar type (``float`` folds into ``number``); null if unknown.

    The reference lower-cases the type before matching, so ``STRING`` maps too.
    """
    t = F.lower(type_col)
    expr = None
    for declared, canon in CANONICAL.items():
        expr = F.when(t == declared, F.lit(canon)) if expr is None else expr.when(t == declared, F.lit(canon))
    return expr


def resolved(catalog: DataFrame) -> DataFrame:
    """B5 helper: first definition of each name wins (lowest ``ord``)."""
    w = Window.partitionBy("name").orderBy("ord")
    return catalog.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def param_specs(catalog: DataFrame) -> DataFrame:
    """B1: one row per declared parameter of the resolved definition."""
    return resolved(catalog).select(
        F.col("name").alias("function"), F.explode("params").alias("p")
    ).select(
        "function",
        F.col("p.ord").cast("int").alias("ord"),
        F.col("p.key").alias("key"),
        F.col("p.type").alias("type"),
    )


def routing_domain(catalog: DataFrame) -> DataFrame:
    """B2: function names in catalog order, then ``none``; empty stays empty."""
    names = catalog.select(F.col("ord").cast("bigint").alias("ord"), F.col("name").alias("candidate"))
    fallback = catalog.agg(
        (F.max("ord") + 1).cast("bigint").alias("ord"), F.count(F.lit(1)).alias("_n")
    ).where("_n > 0").select("ord", F.lit(ROUTER_FALLBACK).alias("candidate"))
    return names.unionByName(fallback)


def merged_param_dictionary(catalog: DataFrame) -> DataFrame:
    """One global key -> type table; the last declaring function wins.

    ``name`` is replaced by the function-name enumeration (type ``enum``,
    function null) when the catalog is non-empty.
    """
    decl = catalog.select("ord", F.col("name").alias("function"), F.explode("params").alias("p")).select(
        F.col("ord").alias("fn_ord"), "function", F.col("p.ord").alias("p_ord"),
        F.col("p.key").alias("key"), F.col("p.type").alias("type"),
    )
    w = Window.partitionBy("key").orderBy(F.desc("fn_ord"), F.desc("p_ord"))
    last = (
        decl.withColumn("_rn", F.row_number().over(w))
        .where("_rn = 1")
        .where(F.col("key") != "name")
        .select("key", "type", "function")
    )
    name_row = catalog.agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").select(
        F.lit("name").alias("key"), F.lit("enum").alias("type"), F.lit(None).cast("string").alias("function")
    )
    return last.unionByName(name_row)


def type_dimension(spark: SparkSession) -> DataFrame:
    """The six declared type names and their grammar type (fixed, 6 rows)."""
    return spark.createDataFrame(
        [(t, c) for t, c in CANONICAL.items()], "type_name string, canonical string"
    )


def resolve_types(specs: DataFrame) -> DataFrame:
    """Attach the grammar type; unsupported types become error rows."""
    dim = F.broadcast(type_dimension(specs.sparkSession))  # fixed 6-row table
    out = specs.join(dim, F.lower(specs["type"]) == dim["type_name"], "left")
    return out.select(
        *[specs[c] for c in specs.columns],
        dim["canonical"].alias("canonical_type"),
        F.when(dim["canonical"].isNull(), F.lit("unsupported_type")).alias("error"),
    )


def resolve_function(names: DataFrame, catalog: DataFrame, name_col: str = "name") -> DataFrame:
    """Attach the first definition of each requested name (null if none)."""
    cat = resolved(catalog).select(
        F.col("name").alias("_fn"), F.col("ord").alias("fn_ord"), "description", "params", "returns"
    )
    cat = broadcast_if_small(cat)
    return names.join(cat, names[name_col] == cat["_fn"], "left").drop("_fn")


def param_key_conflicts(catalog: DataFrame) -> DataFrame:
    """Keys declared with different grammar types by different functions."""
    decl = catalog.select(F.col("name").alias("function"), F.explode("params").alias("p")).select(
        "function", F.col("p.key").alias("key"), canonical_type(F.col("p.type")).alias("type")
    )
    return (
        decl.groupBy("key")
        .agg(
            F.count_distinct("type").cast("bigint").alias("n_types"),
            F.array_join(F.array_sort(F.collect_set("function")), ",").alias("functions"),
            F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"),
        )
        .where("n_types > 1")
    )


def function_schema(catalog: DataFrame) -> DataFrame:
    """Per function: ordered keys, key -> grammar type map, and key count.

    Built straight from ``params`` so functions with zero parameters keep a row
    (with an empty key list) -- such functions can never be completed.
    """
    r = resolved(catalog)
    return r.select(
        F.col("name").alias("function"),
        F.transform("params", lambda p: p["key"]).alias("keys"),
        F.map_from_entries(
            F.transform("params", lambda p: F.struct(p["key"], canonical_type(p["type"])))
        ).alias("types"),
    )


def attach_schema(calls: DataFrame, catalog: DataFrame) -> DataFrame:
    """Join calls with their function's schema (broadcast when provably small).

    Calls of unknown functions get an empty schema and can never be accepted.
    """
    schema = broadcast_if_small(function_schema(catalog))
    joined = calls.join(schema, "function", "left")
    return joined.withColumn(
        "keys", F.coalesce("keys", F.array().cast("array<string>"))
    ).withColumn(
        "types", F.coalesce("types", F.create_map().cast("map<string,string>"))
    )
