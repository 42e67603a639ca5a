"""Vocabulary and token-mask tables.

The single-machine trie and its depth-first search become tables:

* ``prefix_table`` -- one row per trie node (every distinct non-empty prefix of
  a decoded token), with the token that ends there and the depth-first order in
  which the reference's search would emit it;
* ``allowed_tokens`` -- the search itself, once per distinct reduced state, as a
  level-synchronous walk: the frontier of (state, node) pairs is equi-joined with the edges one level
  down, every new (state, prefix) text is checked against the grammar, and
  only live branches continue.  Each level is checkpointed, so lineage stays
  short and a lost executor recomputes one level, not the whole walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions import status as S
from callscope.functions.ordering import dense_index, prefix_matches, running_sum
from callscope.operators.catalog import attach_schema
from callscope.functions.grammar import JAVA as G
from callscope.session import BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS, broadcast_if_small, ensure_checkpoint_dir


# --------------------------------------------------------------------------
# Byte-level alphabet (GPT-2 style), built from its rule
# --------------------------------------------------------------------------

def _byte_level_pairs() -> tuple[str, str]:
    """(latin-1 chars, byte-level chars) for the bytes that are remapped.

    Bytes 33-126, 161-172 and 174-255 stand for themselves; every other byte,
    in increasing order, is shown as the code point 256, 257, ...
    """
    keep = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    latin, shown = [], []
    extra = 0
    for b in range(256):
        if b not in keep:
            latin.append(chr(b))
            shown.append(chr(256 + extra))
            extra += 1
    return "".join(latin), "".join(shown)


LATIN_REMAPPED, BYTE_LEVEL_REMAPPED = _byte_level_pairs()


def byte_level_encode(text):
    """Decoded text -> byte-level token string (UTF-8 bytes shown as chars)."""
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.translate(latin, LATIN_REMAPPED, BYTE_LEVEL_REMAPPED)


def byte_level_decode(raw):
    """Byte-level token string -> text; broken UTF-8 becomes U+FFFD."""
    latin = F.translate(raw, BYTE_LEVEL_REMAPPED, LATIN_REMAPPED)
    return F.make_valid_utf8(F.encode(latin, "ISO-8859-1").cast("string"))


# --------------------------------------------------------------------------
# decoded vocabulary
# --------------------------------------------------------------------------

def decoded_vocab(raw_vocab: DataFrame) -> DataFrame:
    """``(token_id, ord, raw, text)`` for every token whose text is non-empty."""
    return raw_vocab.select(
        "token_id", "ord", "raw", byte_level_decode(F.col("raw")).alias("text")
    ).where(F.length("text") > 0)


def unique_text(decoded: DataFrame) -> DataFrame:
    """Text -> token: the *last* id wins, the first occurrence fixes the position.

    Mirrors a dict that is overwritten in vocabulary order: the value is the
    last id seen, the key keeps its first insertion slot.
    """
    return decoded.groupBy("text").agg(
        F.max_by("token_id", "ord").alias("token_id"),
        F.min("ord").alias("first_ord"),
    )


# --------------------------------------------------------------------------
# Prefix table, fan-out, prefix search
# --------------------------------------------------------------------------

def prefix_table(unique: DataFrame) -> DataFrame:
    """every trie node ``(prefix, parent, depth, char, token_id, first, dfs_ord)``.

    ``first`` is the insertion slot that created the node (smallest
    ``first_ord`` below it); children of a node are visited in that order, a
    node's own token before its children -- ``dfs_ord`` is that preorder rank.

    In the order of their texts the tokens below a node are an interval of
    ranks.  A token's place is the sum of what each node above it puts before
    it: the tokens below the node's earlier siblings, and the node's own token.
    Each node adds that to its interval as a step up and a step down, and one
    running sum over the ranks gives all places.
    """
    ensure_checkpoint_dir(unique.sparkSession)
    ranked = dense_index(unique.select("text", "token_id", "first_ord"), "text", out="rank")
    below = ranked.select(
        "rank", "first_ord", "token_id", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("depth"),
    ).select(F.expr("substring(text, 1, depth)").alias("prefix"), "rank", "first_ord", F.when(F.col("depth") == F.length("text"), F.col("token_id")).alias("token_id"))
    # combined before the shuffle, so that a hot prefix (say " t") is a row of each task
    nodes = below.groupBy("prefix").agg(
        F.min("first_ord").alias("first"), F.min("rank").alias("low"), F.count(F.lit(1)).alias("n"), F.max("token_id").alias("token_id"))
    nodes = nodes.withColumn("depth", F.length("prefix")).withColumn("parent", F.expr("substring(prefix, 1, depth - 1)"))
    earlier = Window.partitionBy("parent").orderBy("first", "prefix").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).checkpoint(eager=True)

    step = lambda at, by: F.struct(at.alias("rank"), by.cast("long").alias("by"))
    high, own = F.col("low") + F.col("n"), F.col("token_id").isNotNull()
    steps = F.concat(
        F.when(F.col("before") > 0, F.array(step(F.col("low"), F.col("before")), step(high, -F.col("before")))).otherwise(F.array()),
        F.when(own & (F.col("n") > 1), F.array(step(F.col("low") + 1, F.lit(1)), step(high, F.lit(-1)))).otherwise(F.array()))
    moved = nodes.select(F.explode(steps).alias("s")).groupBy(F.col("s.rank").alias("rank")).agg(F.sum("s.by").alias("by"))
    by_rank = ranked.select("rank").join(moved, "rank", "left").select("rank", F.coalesce("by", F.lit(0).cast("long")).alias("by"))
    places = running_sum(by_rank, "rank", "by", "dfs_ord")
    nodes = nodes.join(places, (F.col("low") == F.col("rank")) & own, "left")
    return nodes.select(
        "prefix", "parent", "depth",
        F.expr("substring(prefix, depth, 1)").alias("char"),
        "token_id", "first", "dfs_ord",
    )


def prefix_fanout(nodes: DataFrame) -> DataFrame:
    """per depth, node count, terminal count and children per node."""
    root = nodes.sparkSession.createDataFrame([("", 0, None)], "prefix string, depth int, token_id long")
    allnodes = nodes.select("prefix", "depth", "token_id").unionByName(root)
    kids = nodes.groupBy(F.col("parent").alias("prefix")).agg(F.count(F.lit(1)).alias("children"))
    per = allnodes.join(kids, "prefix", "left").withColumn("children", F.coalesce("children", F.lit(0)))
    return per.groupBy("depth").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_nodes"),
        F.count("token_id").cast("bigint").alias("n_terminal"),
        F.round(F.avg("children"), 6).alias("avg_children"),
        F.max("children").cast("bigint").alias("max_children"),
    )


def prefix_search(queries: DataFrame, unique: DataFrame) -> DataFrame:
    """tokens under each query prefix: the interval of ranks that the prefix spans in the sorted vocabulary."""
    return prefix_matches(queries, unique.select("text", "token_id"), "query", "text").select("query_id", "query", "token_id")


# --------------------------------------------------------------------------
# Allowed tokens, mask sizes, charset audit
# --------------------------------------------------------------------------

def reduced_states(states: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(state_id, schema, text, escape)``: each live state as the shortest text that the same tokens may follow.

    What may follow a state depends on the keys that are left and on the place
    in the current item, not on the values so far: the head is dropped with its
    keys, a string keeps its quote and an unfinished escape, a number its form,
    runs of white space one space.  ``schema`` lists the (key, type) left, in
    the order of the keys.  ``escape`` is the unfinished escape of a state within
    a string value (mostly empty), null for others.  REJECTED states are left out.
    """
    df = S.add_status(attach_schema(states, catalog), keep_head=True, keep_tail=True).where(F.col("status") != S.REJECTED)
    rest = F.col("_rest")
    escape = F.regexp_extract(rest, G.open_string, 1)
    after = F.regexp_extract(rest, G.closed_string, 1)
    number = F.regexp_replace(F.regexp_replace(rest, "\\A-?[1-9][0-9]*", "1"), "\\A-?0", "0")
    number = F.regexp_replace(number, "\\A[01]\\.[0-9]+", "1.5")

    def spaced(c):
        return F.regexp_replace(c, "[ \\t\\n\\r]+", " ")

    value = (
        F.when(rest.rlike(G.open_string), F.concat(F.lit('"'), escape))
        .when(rest.rlike(G.closed_string), F.concat(F.lit('""'), spaced(after)))
        .otherwise(spaced(number))
    )
    item = F.concat(F.lit('"'), "_tk", F.lit('"'), F.when(F.col("_colon") == ":", F.concat(F.lit(":"), value)).otherwise(""))
    text = F.when(F.col("_head") == "", F.lit("")).otherwise(
        F.concat(F.lit("{"), F.when(F.col("_isti"), item).otherwise(F.col("_tail"))))
    left = F.transform(F.array_sort("_rem"), lambda k: F.struct(k.alias("key"), F.element_at("types", k).alias("type")))
    within = F.col("_isti") & (F.col("_colon") == ":") & rest.rlike(G.open_string)
    return df.select("state_id", left.alias("schema"), text.alias("text"), F.when(within, escape).alias("escape"))


def tokens_in_strings(searched: DataFrame, nodes: DataFrame) -> list[DataFrame]:
    """``(rid, token_id, ord)`` of reduced states (rid, schema, text, escape) within a string value, in two parts.

    What a token does to an open string depends on the unfinished escape only, so
    it is worked out once for each token and escape that occurs: it stays within
    the string, or it closes it and leaves a rest.  Tokens that stay are one set
    for all states with the escape.  A rest must go on from the closed string;
    that is checked once for each state and distinct rest, and the tokens with a
    rest are found by equality.
    """
    escapes = [r["escape"] for r in searched.select("escape").distinct().collect()]  # a backslash, u and three hex digits at most
    if not escapes:
        return []
    asked = broadcast_if_small(searched)
    tokens = nodes.where(F.col("token_id").isNotNull()).select("prefix", "token_id", F.col("dfs_ord").alias("ord"))
    each = F.explode(F.array(*map(F.lit, escapes))).alias("escape")
    opened = F.concat(F.lit('"'), F.col("escape"), F.col("prefix"))
    stay = tokens.select("*", each).where(opened.rlike(G.open_string)).join(asked.select("rid", "escape"), "escape").select("rid", "token_id", "ord")

    closed = F.regexp_extract(opened, "\\A" + G.string, 0)
    closing = tokens.where(F.col("prefix").contains('"')).select("*", each).withColumn("_closed", closed).where("_closed != ''").select(
        "escape", "token_id", "ord", opened.substr(F.length("_closed") + 1, F.length(opened)).alias("rest"))
    # behind a closed string only these go on
    closing = closing.where(F.col("rest").rlike("\\A(?:[ \\t\\n\\r,}]|\\z)"))
    before = F.col("text").substr(F.lit(1), F.length("text") - F.length("escape") - 1)  # up to the string's quote
    goes_on = asked.join(closing.select("escape", "rest").distinct(), "escape").select(
        "rid", "escape", "rest", F.transform("schema", lambda x: x["key"]).alias("keys"), F.map_from_entries("schema").alias("types"),
        F.concat(before, F.lit('""'), "rest").alias("text"))
    live = S.add_status(goes_on).where(F.col("status") != S.REJECTED).select("rid", "escape", "rest")
    close = closing.join(live, ["escape", "rest"]).select("rid", "token_id", "ord")
    return [stay, close]


def allowed_tokens(states: DataFrame, unique: DataFrame, catalog: DataFrame,
                   nodes: DataFrame | None = None, walk_depth: int = 3) -> DataFrame:
    """``(state_id, token_id, ord)`` -- token allowed iff ``state || token`` is not REJECTED.

    ``states(state_id, function, text)``; ``ord`` is the depth-first rank of the
    token (the order in which the reference's search lists it).

    Only distinct reduced states are searched; the result is joined back to all
    states that reduce to them.  The first ``walk_depth`` trie levels are walked
    level by level (where pruning removes most branches); every (state, node)
    pair still alive at that depth is then equi-joined with all longer tokens
    below that node and each candidate gets one full grammar check.  Exact,
    because viability is prefix-closed; the job count is ``walk_depth + 1``
    whatever the token length.

    States within a string value, where most tokens may follow, are not walked:
    ``tokens_in_strings`` looks their tokens up by what each does to a string.
    """
    spark = states.sparkSession
    ensure_checkpoint_dir(spark)
    nodes = nodes if nodes is not None else prefix_table(unique).checkpoint(eager=True)
    # nodes and bytes of each depth, measured in one job: which levels' edges may be broadcast
    row_bytes = F.octet_length("parent") + F.octet_length("prefix") + 64
    sizes = {r["depth"]: (r["n"], r["size"]) for r in nodes.groupBy("depth").agg(
        F.count(F.lit(1)).alias("n"), F.sum(row_bytes).alias("size")).collect()}
    max_depth = max(sizes, default=0)
    reduced = reduced_states(states, catalog).checkpoint(eager=True)
    searched = reduced.select("schema", "text", "escape").distinct().withColumn("rid", F.monotonically_increasing_id()).checkpoint(eager=True)
    of_state = reduced.join(searched.drop("escape"), ["schema", "text"]).select("state_id", "rid")
    frontier = searched.where(F.col("escape").isNull()).select(
        "rid", F.col("text").alias("state_text"), F.transform("schema", lambda x: x["key"]).alias("keys"),
        F.map_from_entries("schema").alias("types"), F.lit("").alias("node"),
    )
    outputs = tokens_in_strings(searched.where(F.col("escape").isNotNull()), nodes)
    walk = min(walk_depth, max_depth)
    for depth in range(1, walk + 1):
        edges = nodes.where(F.col("depth") == depth).select("parent", "prefix", "token_id", "dfs_ord")
        n, size = sizes[depth]
        if n <= BROADCAST_MAX_ROWS and size <= BROADCAST_MAX_BYTES:
            edges = F.broadcast(edges)
        cand = frontier.join(edges, frontier["node"] == edges["parent"]).select(
            "rid", "state_text", "keys", "types", "prefix", "token_id", "dfs_ord",
            F.concat("state_text", "prefix").alias("text"),
        )
        live = (
            S.add_status(cand)
            .where(F.col("status") != S.REJECTED)
            .select("rid", "state_text", "keys", "types", F.col("prefix").alias("node"),
                    "token_id", "dfs_ord")
            .checkpoint(eager=True)
        )
        outputs.append(live.where(F.col("token_id").isNotNull()).select("rid", "token_id", F.col("dfs_ord").alias("ord")))
        frontier = live.select("rid", "state_text", "keys", "types", "node")
    if max_depth > walk:
        # every longer token, keyed by its prefix at the walk depth.  The few live
        # (state, node) pairs are the small side: the vocabulary stays partitioned
        longer = nodes.where(F.col("token_id").isNotNull() & (F.col("depth") > walk)).select(
            F.expr(f"substring(prefix, 1, {walk})").alias("_node"), F.col("prefix").alias("_tok"),
            "token_id", "dfs_ord",
        )
        live = broadcast_if_small(frontier)
        cand = longer.join(live, longer["_node"] == live["node"]).select(
            "rid", "keys", "types", "token_id", "dfs_ord",
            F.concat("state_text", "_tok").alias("text"),
        )
        outputs.append(
            S.add_status(cand).where(F.col("status") != S.REJECTED)
            .select("rid", "token_id", F.col("dfs_ord").alias("ord"))
        )
    if not outputs:
        return spark.createDataFrame([], "state_id long, token_id long, ord long")
    out = outputs[0]
    for o in outputs[1:]:
        out = out.unionByName(o)
    return of_state.join(out, "rid").select("state_id", "token_id", "ord")


def mask_size_report(states: DataFrame, mask: DataFrame, vocab_size: int) -> DataFrame:
    """allowed count per state (zero included) and its share of the vocabulary."""
    n = mask.groupBy("state_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_allowed"))
    out = states.select("state_id").join(n, "state_id", "left")
    n_allowed = F.coalesce("n_allowed", F.lit(0).cast("bigint"))
    return out.select(
        "state_id", n_allowed.alias("n_allowed"),
        F.round(n_allowed / F.lit(max(vocab_size, 1)), 6).alias("share"),
    )


AUDIT_CLASSES = ("raw_differs", "space_prefixed", "whitespace_only", "control_inside", "empty", "duplicate_text")


def charset_audit(raw_vocab: DataFrame) -> DataFrame:
    """token counts per charset class (a token may be in several)."""
    dec = raw_vocab.select("token_id", "raw", byte_level_decode(F.col("raw")).alias("text"))
    dups = (
        dec.where(F.length("text") > 0).groupBy("text").agg(F.count(F.lit(1)).alias("_c"))
        .where("_c > 1").select("text", F.lit(True).alias("_dup"))
    )
    flagged = dec.join(dups, "text", "left")
    t = F.col("text")
    exprs = [
        F.count_if(F.col("raw") != t),
        F.count_if(t.startswith(" ")),
        F.count_if(t.rlike("\\A[ \\t\\n\\r\\f\\x0B]+\\z")),
        F.count_if(t.rlike("[\\x00-\\x1f\\x7f]") & ~t.rlike("\\A[ \\t\\n\\r\\f\\x0B]+\\z")),
        F.count_if(F.length(t) == 0),
        F.count_if(F.coalesce(F.col("_dup"), F.lit(False))),
    ]
    wide = flagged.agg(*[e.cast("bigint").alias(c) for c, e in zip(AUDIT_CLASSES, exprs)])
    stack = "stack({}, {}) as (class, n)".format(
        len(AUDIT_CLASSES), ", ".join(f"'{c}', {c}" for c in AUDIT_CLASSES)
    )
    return wide.selectExpr(stack)
