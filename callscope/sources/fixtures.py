"""Test views derived from the driver's parquet tables.

Every view is a deterministic function of the given tables, so its size grows
with the scale factor and DuckDB can rebuild the same rows from the same
parquet files (see ``callscope.plans.oracle``).

Catalog shape used everywhere::

    ord BIGINT, name STRING, description STRING,
    params ARRAY<STRUCT<ord INT, key STRING, type STRING>>, returns STRING
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callscope.session import CALL_TASK_BYTES, TOKEN_TASK_BYTES, spread, table

CATALOG_DDL = (
    "ord BIGINT, name STRING, description STRING, "
    "params ARRAY<STRUCT<ord: INT, key: STRING, type: STRING>>, returns STRING"
)


def _params(*pairs: tuple[str, str | Column]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(k).alias("key"),
                (t if isinstance(t, Column) else F.lit(t)).alias("type"),
            )
            for i, (k, t) in enumerate(pairs)
        ]
    )


def _catalog_from_names(names: DataFrame, description: Column, params: Column,
                        returns: str) -> DataFrame:
    """One function per distinct name; ``ord`` is the name's rank (0-based).

    ``names`` holds the distinct function names only (a handful of rows), so
    the un-partitioned rank window runs over metadata, not data.
    """
    w = Window.orderBy("name")
    # A catalog is metadata read by several joins of one query: keep it cached
    # so deriving it (a scan of a large table here) happens once.
    return names.select(
        (F.dense_rank().over(w) - 1).cast("bigint").alias("ord"),
        "name",
        description.alias("description"),
        params.alias("params"),
        F.lit(returns).alias("returns"),
    ).cache()


# --------------------------------------------------------------------------
# events -> v_catalog, v_calls
# --------------------------------------------------------------------------

def v_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    return _catalog_from_names(
        names,
        F.concat(F.lit("Record a "), F.col("name"), F.lit(" event.")),
        _params(("k", "integer")),
        "null",
    )


def v_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spread(table(spark, sf_dir, "events").select("event_id", "event_type", "props"), CALL_TASK_BYTES)
    k = F.regexp_extract("props", "-?[0-9]+", 0)
    r = F.col("event_id") % 17
    cr, lf = F.lit("\r"), F.lit("\n")

    def obj(*parts):
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    text = (
        F.when(r <= 5, F.col("props"))
        .when(r == 6, obj('{"k":', k, "}"))
        .when(r == 7, obj(' { "k" : ', k, " ", cr, lf, "} "))
        .when(r == 8, obj('{"k": ', k))
        .when(r == 9, obj(F.col("props"), "x"))
        .when(r == 10, obj('{"k": "', k, '"}'))
        .when(r == 11, obj('{"k": ', k, ".5}"))
        .when(r == 12, obj('{"kk": ', k, "}"))
        .when(r == 13, F.lit("{}"))
        .when(r == 14, obj('{"k": 0', k, "}"))
        .when(r == 15, obj('{"k": ', k, ',"k": 1}'))
        .otherwise(obj('{"k": ', k, cr, "}"))
    )
    return ev.select(
        F.col("event_id").alias("call_id"),
        F.col("event_type").alias("function"),
        text.alias("text"),
    )


# --------------------------------------------------------------------------
# orders -> v_catalog_wide, v_calls_wide
# --------------------------------------------------------------------------

WIDE_KEYS = ("o_orderkey", "o_totalprice", "o_orderstatus", "urgent", "note")


def v_catalog_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (
        table(spark, sf_dir, "orders")
        .select(F.concat(F.lit("order_"), F.lower("o_orderstatus")).alias("name"))
        .distinct()
    )
    price_type = F.when(F.col("name") == "order_f", F.lit("number")).otherwise(F.lit("float"))
    note_type = F.when(F.col("name") == "order_p", F.lit("string")).otherwise(F.lit("null"))
    return _catalog_from_names(
        names,
        F.concat(F.lit("Store an order in state "), F.upper(F.substring("name", 7, 1)), F.lit(".")),
        _params(
            ("o_orderkey", "integer"),
            ("o_totalprice", price_type),
            ("o_orderstatus", "string"),
            ("urgent", "boolean"),
            ("note", note_type),
        ),
        "boolean",
    )


def v_calls_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"
    ), CALL_TASK_BYTES)
    d = F.col("o_orderkey") % 7
    r = (F.col("o_orderkey") % 5).cast("int")
    price = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", "true").otherwise("false")
    items = F.array(
        F.concat(F.lit('"o_orderkey": '), F.col("o_orderkey").cast("string")),
        F.concat(F.lit('"o_totalprice": '), price),
        F.concat(F.lit('"o_orderstatus": "'), F.col("o_orderstatus"), F.lit('"')),
        F.when(d == 3, F.lit('"urgent": "yes"')).otherwise(F.concat(F.lit('"urgent": '), urgent)),
        F.when(d == 4, F.lit('"notes": null')).otherwise(F.lit('"note": null')),
    )
    rotated = F.concat(F.slice(items, r + 1, 5), F.slice(items, F.lit(1), r))
    kept = F.when(d == 5, F.filter(rotated, lambda x: ~x.startswith('"note"'))).otherwise(rotated)
    # some complete objects have a note nested many levels deep, one that is empty or lacks its colon, or a key with an escape
    odd = F.when(d == 0, F.col("o_orderkey") % 11).otherwise(-1)
    level = ((F.col("o_orderkey") % 60) + 1).cast("int")
    deep = F.concat(F.repeat(F.lit('{"note": ['), level), F.lit("1"), F.repeat(F.lit("]}"), level))
    note = F.when(odd == 5, F.concat(F.lit('"note": '), deep)).when(odd == 8, '"note": ').when(odd == 9, '"note" null')
    kept = F.transform(kept, lambda x: F.when(x.startswith('"note"') & note.isNotNull(), note).otherwise(x))
    kept = F.when(odd == 7, F.concat(kept, F.array(F.lit('"o\\"status": 1')))).otherwise(kept)
    # some complete objects name a key twice
    kept = F.when((d == 0) & (F.col("o_orderkey") % 11 == 3), F.concat(kept, F.array(F.lit('"o_orderkey": 0')))).otherwise(kept)
    o = o.withColumn("kept", kept)  # made once
    body = F.array_join("kept", ", ")
    text = (
        F.when(d == 1, F.concat(F.lit("{\n  "), F.array_join("kept", ",\n  "), F.lit("\n}")))
        .when(d == 2, F.concat(F.lit("{"), body))
        .when(d == 6, F.concat(F.lit("{"), body, F.lit(",}")))
        .otherwise(F.concat(F.lit("{"), body, F.lit("}")))
    )
    return o.select(
        F.col("o_orderkey").alias("call_id"),
        F.concat(F.lit("order_"), F.lower("o_orderstatus")).alias("function"),
        text.alias("text"),
    )


# --------------------------------------------------------------------------
# lineitem -> v_catalog_bench, v_calls_bench
# --------------------------------------------------------------------------

def v_catalog_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (
        table(spark, sf_dir, "lineitem")
        .select(F.concat(F.lit("line_"), F.lower("l_linestatus")).alias("name"))
        .distinct()
    )
    return _catalog_from_names(
        names,
        F.concat(F.lit("Book a line item with status "), F.col("name"), F.lit(".")),
        _params(("l_orderkey", "integer"), ("l_quantity", "number"), ("l_returnflag", "STRING")),
        "null",
    )


def v_calls_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"
    ), CALL_TASK_BYTES)
    ln = F.col("l_linenumber")
    ok = F.col("l_orderkey").cast("string")
    q = F.col("l_quantity").cast("decimal(12,2)").cast("string")
    rf = F.col("l_returnflag")

    def c(*parts):
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    text = (
        F.when(ln == 2, c('{\n "l_returnflag": "', rf, '",\n "l_orderkey": ', ok,
                          ',\n "l_quantity": ', q, "\n}"))
        .when(ln == 3, c('{"l_orderkey": ', ok, ', "l_quantity": "', q, '", "l_returnflag": "', rf, '"}'))
        .when(ln == 4, c('{"l_orderkey": ', ok, ', "l_quantity": ', q, ', "l_returnflag": "', rf))
        .when(ln == 6, c('{"l_orderkey": ', ok, ', "l_quantity": ', q, ', "l_returnflag": "', rf,
                         '", "l_comment": "x"}'))
        .otherwise(c('{"l_orderkey": ', ok, ', "l_quantity": ', q, ', "l_returnflag": "', rf, '"}'))
    )
    return li.select(
        (F.col("l_orderkey") * 8 + ln).alias("call_id"),
        F.concat(F.lit("line_"), F.lower("l_linestatus")).alias("function"),
        text.alias("text"),
    )


# --------------------------------------------------------------------------
# Combined catalog, router documents, enum partials, names to resolve
# --------------------------------------------------------------------------

def v_catalog_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three catalogs in one, ``ord`` offset by source (0, 100, 200)."""
    parts = [(v_catalog, 0), (v_catalog_wide, 100), (v_catalog_bench, 200)]
    out = None
    for build, offset in parts:
        c = build(spark, sf_dir).withColumn("ord", F.col("ord") + offset)
        out = c if out is None else out.unionByName(c)
    return out


def v_router_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    r = F.col("event_id") % 6
    et = F.col("event_type")
    text = (
        F.when(r == 1, F.lit('{"name":"none"}'))
        .when(r == 2, F.concat(F.lit(' {"name" : "'), F.upper(et), F.lit('" } ')))
        .when(r == 3, F.concat(F.lit('{"name": "'), et, F.lit('", "k": 1}')))
        .when(r == 5, F.concat(F.lit('{"name": "'), et))
        .otherwise(F.concat(F.lit('{"name": "'), et, F.lit('"}')))
    )
    return ev.select(F.col("event_id").alias("call_id"), text.alias("text"))


def v_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial quoted values: every cut of a quoted event type, plus misses."""
    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    quoted = F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))
    cut = (F.col("event_id") % (F.length("event_type") + 3)).cast("int")
    miss = F.concat(F.lit('"'), F.upper(F.substring("event_type", 1, 2)))
    partial = F.when(F.col("event_id") % 10 == 9, miss).otherwise(quoted.substr(F.lit(1), cut))
    return ev.select(F.col("event_id").alias("partial_id"), partial.alias("partial"))


def v_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "event_type")
    name = F.when(F.col("event_id") % 4 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    return ev.select(F.col("event_id").alias("name_id"), name.alias("name"))


# --------------------------------------------------------------------------
# Vocabulary views: benchmark + conversation turns + event props pieces
# --------------------------------------------------------------------------

# One token = an optional leading space and a run of letters, or of digits,
# or one other character; or a run of spaces.
PIECE_PATTERN = " ?\\p{L}+| ?[0-9]+| ?[^\\p{L}0-9 ]| +"


def vocab_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = table(spark, sf_dir, "benchmark").select("text")
    conv = table(spark, sf_dir, "conversations").select("text")
    props = table(spark, sf_dir, "events").select(F.col("props").alias("text"))
    return bench.unionByName(conv).unionByName(props)


def v_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pieces ordered by text; ``token_id = ord`` = rank (0-based)."""
    from callscope.functions.ordering import dense_index

    pieces = spread(vocab_texts(spark, sf_dir)).select(
        F.explode(F.regexp_extract_all("text", F.lit(PIECE_PATTERN), 0)).alias("text")
    ).distinct()
    ranked = dense_index(pieces, "text", out="token_id")
    return ranked.select("token_id", F.col("token_id").alias("ord"), "text")


def v_raw_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_vocab`` in byte-level form, plus one token per distinct single byte
    of every non-ASCII character.

    A lone byte of a multi-byte character is not a whole character: it decodes
    to U+FFFD, so these extra tokens all share one decoded text (the duplicate
    case, where the last id wins).
    """
    from callscope.operators.vocab import byte_level_encode

    vocab = v_vocab(spark, sf_dir)
    base = vocab.select("token_id", "ord", byte_level_encode(F.col("text")).alias("raw"))
    n = vocab.count()  # one number on the driver: the id offset of the extra tokens
    chars = vocab.select(F.explode(F.split("text", "")).alias("c")).where(F.ascii("c") > 127)
    leads = chars.select(
        F.explode(F.split(byte_level_encode(F.col("c")), "")).alias("raw")
    ).where(F.length("raw") == 1).distinct()
    w = Window.orderBy("raw")  # over distinct single bytes only (< 256 rows)
    extra = leads.select(
        (F.lit(n) + F.row_number().over(w) - 1).cast("long").alias("token_id"), "raw"
    ).select("token_id", F.col("token_id").alias("ord"), "raw")
    return base.unionByName(extra)


def v_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial documents: every ``v_calls`` text, complete or not, and every prefix of it.

    Texts that went wrong are among them; no token may follow those.  ``state_id`` is the rank of (function, text).
    """
    from callscope.functions.ordering import dense_index

    pref = v_calls(spark, sf_dir).select(
        "function", "text", F.explode(F.sequence(F.lit(0), F.length("text"))).alias("n")
    ).select("function", F.expr("substring(text, 1, n)").alias("text")).distinct()
    return dense_index(pref, "function", "text", out="state_id").select("state_id", "function", "text")


def _terminal_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``v_calls`` rows whose status is TERMINAL (selected by the grammar)."""
    from callscope.functions import status as S
    from callscope.operators.catalog import attach_schema

    checked = S.add_status(attach_schema(v_calls(spark, sf_dir), v_catalog(spark, sf_dir)))
    return checked.where(F.col("status") == S.TERMINAL).select("call_id", "function", "text")


def v_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix queries: the first one to three characters of each benchmark word."""
    words = table(spark, sf_dir, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit("\\p{L}+"), 0)).alias("w")
    )
    q = words.select(F.explode(F.array(
        F.substring("w", 1, 1), F.substring("w", 1, 2), F.substring("w", 1, 3))).alias("query")
    ).distinct()
    from callscope.functions.ordering import dense_index

    return dense_index(q, "query", out="query_id").select("query_id", "query")


# --------------------------------------------------------------------------
# Score / mask / step views (embeddings, documents)
# --------------------------------------------------------------------------

def v_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decoding step per embedding row; the vector holds the token scores."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return e.select(F.col("vec_id").alias("step_id"), F.posexplode("embedding").alias("pos", "v")).select(
        "step_id", F.col("pos").cast("long").alias("token_id"), F.col("v").cast("double").alias("score")
    )


def v_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("step_id"))


def v_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed tokens per step: every 7th position; a single one on every 11th
    step; none on every 13th.  ``ord`` (the enumeration order) is a permutation
    of the positions, so ties are not broken by token id."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("n"))
    v = F.col("vec_id")
    positions = (
        F.when(v % 13 == 0, F.array().cast("array<int>"))
        .when(v % 11 == 0, F.array((v % F.col("n")).cast("int")))
        .otherwise(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda p: (v + p) % 7 == 0))
    )
    return e.select("vec_id", F.explode(positions).alias("pos")).select(
        F.col("vec_id").alias("step_id"),
        F.col("pos").cast("long").alias("token_id"),
        ((F.col("pos") * 5) % 64).cast("long").alias("ord"),
    )


def v_token_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token streams: each document cut into pieces, phase by document id."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKEN_TASK_BYTES)
    phase = (
        F.when(F.col("doc_id") % 3 == 0, "route").when(F.col("doc_id") % 3 == 1, "extract").otherwise("other")
    )
    return d.select(
        F.col("doc_id").alias("prompt_id"), phase.alias("phase"),
        F.posexplode(F.regexp_extract_all("text", F.lit(PIECE_PATTERN), 0)).alias("pos", "token"),
    ).select("prompt_id", "phase", F.col("pos").cast("int").alias("pos"), "token")


# --------------------------------------------------------------------------
# Prompt views
# --------------------------------------------------------------------------

def v_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns of the conversations; ``prompt_id = conv_id * 1000 + turn``."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), F.col("text").alias("prompt"))


def v_event_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests phrased from events: routable with a number, routable without
    one, unroutable, and upper-cased with two numbers."""
    ev = spread(table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props"), CALL_TASK_BYTES)
    k = F.regexp_extract("props", "-?[0-9]+", 0)
    r = F.col("event_id") % 4
    et = F.col("event_type")
    prompt = (
        F.when(r == 0, F.concat(F.lit("Record a "), et, F.lit(" event with k "), k))
        .when(r == 1, F.concat(F.lit("Please log this "), et, F.lit(" now")))
        .when(r == 2, F.lit("What is the weather like today?"))
        .otherwise(F.concat(F.upper(et), F.lit(" happened, k="), k, F.lit(" (value "),
                            F.col("value").cast("decimal(10,2)").cast("string"), F.lit(")")))
    )
    return ev.select(F.col("event_id").alias("prompt_id"), prompt.alias("prompt"), et.alias("event_type"))


def v_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of the functions in use whose name begins before ``q``; the others have none."""
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("function")).distinct().where("function < 'q'")
    return names.select(
        "function", F.concat(F.lit("Do not count the "), "function", F.lit(" event.\n")).alias("contradiction"),
        F.concat(F.lit("\nUser: Record a "), "function", F.lit(" event with k 5\nFunction: "), "function",
                 F.lit('\nOutput: {"k": 5}\n')).alias("counter_examples"))


# --------------------------------------------------------------------------
# JSON-list documents (catalog files from `part`, prompt files from conversations)
# --------------------------------------------------------------------------

def json_string(s: Column) -> Column:
    """A string as a JSON string literal (escaped)."""
    j = F.to_json(F.array(s))
    return j.substr(F.lit(2), F.length(j) - 2)


def v_catalog_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog documents of four parts each; some definitions break one rule
    (by ``p_partkey % 101``), some documents are not lists or not JSON, or go on
    after their end."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    pk = F.col("p_partkey")
    d = pk % 101
    name = F.when(d == 6, json_string(F.concat(F.lit('part"'), pk.cast("string")))).otherwise(
        json_string(F.concat(F.lit("part_"), pk.cast("string"))))
    desc = F.when(d == 5, F.col("p_size").cast("string")).otherwise(json_string(F.col("p_name")))
    params = F.concat(
        F.lit('{"size": {"type": "integer"'), F.when(d == 4, F.lit(', "min": 0')).otherwise(F.lit("")),
        F.lit('}, "price": {"type": "'), F.when(d == 3, F.lit("decimal")).otherwise(F.lit("number")),
        F.lit('"}, "brand": {"type": "string"}}'),
    )
    returns = F.concat(F.lit('{"type": "'), F.when(d == 7, F.lit("Integer")).otherwise(F.lit("boolean")), F.lit('"}'))
    elem = F.concat(
        F.lit("{"), F.when(d == 1, F.lit("")).otherwise(F.concat(F.lit('"name": '), name, F.lit(", "))),
        F.lit('"description": '), desc, F.lit(', "parameters": '), params, F.lit(', "returns": '), returns,
        F.when(d == 2, F.lit(', "version": 1')).otherwise(F.lit("")), F.lit("}"),
    )
    grp = F.floor(pk / 4).cast("long")
    docs = p.select(grp.alias("g"), pk.alias("pk"), elem.alias("elem")).groupBy("g").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pk", "elem"))), lambda x: x["elem"]), ", ")
        .alias("body")
    )
    g = F.col("g")
    text = (
        F.when(g % 50 == 7, F.concat(F.lit('{"functions": ['), F.col("body"), F.lit("]}")))
        .when(g % 50 == 13, F.concat(F.lit("["), F.col("body")))
        .when(g % 50 == 21, F.concat(F.lit("["), F.col("body"), F.lit("]]")))
        .when(g % 50 == 29, F.concat(F.lit("["), F.col("body"), F.lit("] trailing")))
        .when(g % 50 == 37, F.concat(F.lit("["), F.col("body"), F.lit("], ["), F.col("body"), F.lit("]")))
        .otherwise(F.concat(F.lit("["), F.col("body"), F.lit("]")))
    )
    return docs.select(F.concat(F.lit("catalog_"), F.lpad(g.cast("string"), 6, "0")).alias("source"),
                       text.alias("text"))


def v_prompt_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt lists of at most 64 user turns of one conversation (document size
    is bounded whatever a conversation's length); the first element of some
    documents has a renamed or an extra field, and some documents have a bracket
    or a text too many.  A prompt is a user turn: other turns are left out."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user").select(
        "conv_id", "turn", "text", F.floor(F.col("turn") / 64).cast("long").alias("chunk"))
    cid = F.col("conv_id")
    first = F.col("turn") == F.min("turn").over(Window.partitionBy("conv_id", "chunk"))
    field = F.when((cid % 9 == 4) & first, F.lit("question")).otherwise(F.lit("prompt"))
    extra = F.when((cid % 9 == 7) & first, F.lit(', "role": "user"')).otherwise(F.lit(""))
    elem = F.concat(F.lit('{"'), field, F.lit('": '), json_string(F.col("text")), extra, F.lit("}"))
    docs = c.select("conv_id", "chunk", "turn", elem.alias("elem")).groupBy("conv_id", "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "elem"))), lambda x: x["elem"]), ", ")
        .alias("body")
    )
    source = F.concat(F.lit("prompts_"), F.lpad(cid.cast("string"), 6, "0"), F.lit("_"),
                      F.lpad(F.col("chunk").cast("string"), 4, "0"))
    after = F.when(cid % 31 == 5, "]").when(cid % 31 == 9, " x").otherwise("")
    return docs.select(source.alias("source"), F.concat(F.lit("["), F.col("body"), F.lit("]"), after).alias("text"))


# --------------------------------------------------------------------------
# Expected / actual calls for evaluation
# --------------------------------------------------------------------------

def v_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The complete, valid calls of ``v_calls`` as the expected outputs."""
    c = _terminal_calls(spark, sf_dir)
    return c.select(F.col("call_id").alias("prompt_id"), F.col("function").alias("name"),
                    F.col("text").alias("parameters"))


def v_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Produced outputs of the expected prompts: right, routed to none, wrong
    value, missing, reformatted (by ``prompt_id % 5``); some of them cut short,
    running on or no JSON (by ``% 11``), some given twice (by ``% 17``), and
    outputs of prompts that nobody expected (by ``% 13``)."""
    e = v_expected(spark, sf_dir)
    pid = F.col("prompt_id")
    m, w = pid % 5, pid % 11
    k = F.regexp_extract("parameters", "-?[0-9]+", 0)
    params = (
        F.when(m == 1, F.lit("{}"))
        .when(m == 2, F.concat(F.lit('{"k": '), (k.cast("bigint") + 1).cast("string"), F.lit("}")))
        .when(m == 4, F.concat(F.lit('{"k":'), k, F.lit("}")))
        .otherwise(F.rtrim("parameters"))
    )
    params = (
        F.when(w == 3, params.substr(F.lit(1), F.length(params) - 1))
        .when(w == 5, F.concat(params, F.lit("x")))
        .when(w == 7, F.lit("not json"))
        .otherwise(params)
    )
    name = F.when(m == 1, F.lit("none")).otherwise(F.col("name"))
    given = e.where(m != 3).select("prompt_id", name.alias("name"), params.alias("parameters"))
    extra = e.where(pid % 13 == 0).select((-pid - 1).alias("prompt_id"), "name", "parameters")
    return given.unionByName(given.where(pid % 17 == 2)).unionByName(extra)
