"""Column expressions that decide the status of call documents.

Every function here takes Columns and returns a Column built only from
built-in Spark SQL expressions (regex with literal patterns, array and
higher-order functions).  Nothing runs in Python per row.

Inputs used throughout:

* ``text``  -- the call document;
* ``keys``  -- ``array<string>``, the declared keys of the call's function;
* ``types`` -- ``map<string,string>``, declared key -> canonical type
  (``float`` already folded into ``number``).

Statuses: ``TERMINAL`` (complete, closed document), ``INCOMPLETE`` (every
character consumed, object not closed -- includes the empty text) and
``REJECTED`` (some character refused).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callscope.functions.grammar import ADMITS, JAVA, LEXICAL_CLASSES
from callscope.functions.items import with_head, with_items

G = JAVA

TERMINAL = "TERMINAL"
INCOMPLETE = "INCOMPLETE"
REJECTED = "REJECTED"

_CANONICAL_TYPES = ("string", "integer", "number", "boolean", "null")


def lexical_class(raw: Column) -> Column:
    """Lexical class of a raw JSON value text; ``invalid`` when none fits."""
    expr = F.when(raw.rlike(G.lexical("integer")), F.lit("integer"))
    for cls in ("number", "string", "boolean", "null"):
        expr = expr.when(raw.rlike(G.lexical(cls)), F.lit(cls))
    return expr.otherwise(F.lit(LEXICAL_CLASSES[-1]))


def admits(type_name: Column, cls: Column) -> Column:
    """True when a declared type admits a lexical class (null type -> false)."""
    cond = F.lit(False)
    for t, classes in ADMITS.items():
        cond = cond | ((type_name == F.lit(t)) & cls.isin(*classes))
    return F.coalesce(cond, F.lit(False))


def strip_value(value_with_ws: Column) -> Column:
    """Drop the structural whitespace that follows a value (values never end in it)."""
    return F.rtrim(value_with_ws, F.lit(" \t\n\r"))


def _per_type(type_name: Column, pattern_of, subject: Column) -> Column:
    """``subject rlike pattern_of(type)`` with one literal pattern per type."""
    expr = None
    for t in _CANONICAL_TYPES:
        branch = subject.rlike(pattern_of(t))
        expr = F.when(type_name == t, branch) if expr is None else expr.when(type_name == t, branch)
    return F.coalesce(expr.otherwise(F.lit(False)), F.lit(False))


def value_class(value: Column) -> Column:
    """Lexical class of a value already matched by the generic value pattern.

    Such a value is lexically valid, so its first character decides the class
    (and a dot separates number from integer) -- no second regex pass.
    """
    first = F.substring(value, 1, 1)
    return (
        F.when(first == '"', F.lit("string"))
        .when(first.isin("t", "f"), F.lit("boolean"))
        .when(first == "n", F.lit("null"))
        .when(F.instr(value, ".") > 0, F.lit("number"))
        .otherwise(F.lit("integer"))
    )


def _items(text: Column, pattern: str):
    keys = F.regexp_extract_all(text, F.lit(pattern), 1)
    vals = F.transform(F.regexp_extract_all(text, F.lit(pattern), 2), strip_value)
    return keys, vals


def document_items(text: Column) -> tuple[Column, Column]:
    """Keys and raw values of a complete document."""
    return _items(text, G.item)


def typed_ok(keys: Column, vals: Column, types: Column) -> Column:
    """Every extracted key is declared and its value's class fits the type."""
    declared = F.transform(keys, lambda k: F.element_at(types, k))  # looked up once for each key
    checks = F.zip_with(declared, vals, lambda t, v: admits(t, value_class(v)))
    return F.forall(checks, lambda b: b)



def accepted(text: Column, keys: Column, types: Column) -> Column:
    """The document is complete and conforms to the declared parameters."""
    n = F.size(keys)
    dkeys, dvals = _items(text, G.item)
    return F.coalesce(
        text.rlike(G.document)
        & (F.size(dkeys) == n)
        & (F.size(F.array_distinct(dkeys)) == n)
        & typed_ok(dkeys, dvals, types),
        F.lit(False),
    )


def call_status(text: Column, keys: Column, types: Column) -> Column:
    """TERMINAL / INCOMPLETE / REJECTED of a (partial) call document.

    The text is split into a *head* -- ``ws { ws`` followed by every complete
    ``key: value ,`` item -- and a *tail*.  The head is legal when its keys are
    distinct, declared, typed right and every comma still had a key left.  The
    tail is then one of: nothing, an unfinished key that some remaining key
    starts with, or a remaining key followed by an optional colon and a value
    that is still growing, complete, or complete and closing the object.
    """
    n = F.size(keys)
    head = F.regexp_extract(text, G.head, 0)
    hkeys, hvals = _items(head, G.item_comma)
    m = F.size(hkeys)
    head_ok = (
        (F.size(F.array_distinct(hkeys)) == m)
        & ((m == 0) | (m < n))
        & typed_ok(hkeys, hvals, types)
    )
    tail = text.substr(F.length(head) + 1, F.length(text) + 1)
    rem = F.array_except(keys, hkeys)

    partial_key = F.regexp_extract(tail, G.open_key, 1)
    key_prefix_ok = tail.rlike(G.open_key) & F.exists(
        rem, lambda k: k.startswith(partial_key)
    )

    tkey = F.regexp_extract(tail, G.tail_item, 1)
    colon = F.regexp_extract(tail, G.tail_item, 2)
    rest = F.regexp_extract(tail, G.tail_item, 3)
    tkey_ok = tail.rlike(G.tail_item) & F.array_contains(rem, tkey)
    ttype = F.element_at(types, tkey)
    item_viable = tkey_ok & ((colon == "") | _per_type(ttype, G.viable_value, rest))
    item_closes = (
        tkey_ok
        & (colon == ":")
        & (F.size(rem) == 1)
        & _per_type(ttype, G.closing_value, rest)
    )

    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(
            ~text.rlike(G.opened),
            F.when(text.rlike(G.blank), F.lit(INCOMPLETE)).otherwise(F.lit(REJECTED)),
        )
        .when(~F.coalesce(head_ok, F.lit(False)), F.lit(REJECTED))
        .when(F.coalesce(item_closes, F.lit(False)), F.lit(TERMINAL))
        .when(
            F.coalesce((tail == "") | key_prefix_ok | item_viable, F.lit(False)),
            F.lit(INCOMPLETE),
        )
        .otherwise(F.lit(REJECTED))
    )


def add_status(df, text: str = "text", keys: str = "keys", types: str = "types",
               out: str = "status", with_fields: bool = False, keep_head: bool = False, keep_tail: bool = False,
               only: str | None = None):
    """Frame form of :func:`call_status`, staged so each regex runs once per row.

    Each stage is a separate projection; Catalyst keeps them apart because the
    staged values are expensive and referenced several times.  With ``only``
    rows of another status are left out before their fields are looked for.
    """
    t, k, ty = F.col(text), F.col(keys), F.col(types)
    s2 = with_head(df, text)
    m = F.size("_hk")
    tail = F.col("_tail")
    s3 = s2.select(
        "*",
        (
            (F.size(F.array_distinct("_hk")) == m)
            & ((m == 0) | (m < F.size(k)))
            & typed_ok(F.col("_hk"), F.col("_hv"), ty)
        ).alias("_hok"),
        F.array_except(k, F.col("_hk")).alias("_rem"),
        tail.rlike(G.tail_item).alias("_isti"),
        F.regexp_extract(tail, G.tail_item, 1).alias("_tk"),
        F.regexp_extract(tail, G.tail_item, 2).alias("_colon"),
        F.regexp_extract(tail, G.tail_item, 3).alias("_rest"),
        tail.rlike(G.open_key).alias("_ispk"),
        F.regexp_extract(tail, G.open_key, 1).alias("_pk"),
    )
    rem, tk = F.col("_rem"), F.col("_tk")
    tkey_ok = F.col("_isti") & F.array_contains(rem, tk)
    ttype = F.element_at(ty, tk)
    closes = tkey_ok & (F.col("_colon") == ":") & (F.size(rem) == 1) & _per_type(ttype, G.closing_value, F.col("_rest"))
    viable = tkey_ok & ((F.col("_colon") == "") | _per_type(ttype, G.viable_value, F.col("_rest")))
    pk_ok = F.col("_ispk") & F.exists(rem, lambda x: x.startswith(F.col("_pk")))
    status = (
        F.when(t.isNull(), F.lit(None).cast("string"))
        .when(F.col("_head") == "",
              F.when(t.rlike(G.blank), F.lit(INCOMPLETE)).otherwise(F.lit(REJECTED)))
        .when(~F.coalesce(F.col("_hok"), F.lit(False)), F.lit(REJECTED))
        .when(F.coalesce(closes, F.lit(False)), F.lit(TERMINAL))
        .when(F.coalesce((tail == "") | pk_ok | viable, F.lit(False)), F.lit(INCOMPLETE))
        .otherwise(F.lit(REJECTED))
    )
    temps = ["_hok", "_ispk", "_pk"]
    if not keep_tail:  # keep_tail leaves the tail's parts and the keys left (_rem)
        temps += ["_rem", "_isti", "_tk", "_colon", "_rest"] + ([] if with_fields else ["_tail"])
    if not keep_head and not with_fields:  # keep_head leaves _head, _hk (keys), _hv (values) for the caller
        temps = ["_head", "_hk", "_hv"] + temps
    done = s3.select("*", status.alias(out)).drop(*temps)
    if only is not None:
        # a filter would be worked out below every stage, and all of them again above it; a generator isn't
        done = done.select("*", F.explode(F.when(F.col(out) == only, F.array(F.lit(0)))).alias("_only")).drop("_only")
    return with_items(done) if with_fields else done


def add_live_length(df, text: str, rem: str, out: str, types: str = "types"):
    """How many characters of a refused item are consumed before the one that is refused.

    ``text`` follows a legal head whose remaining keys are ``rem``: an item that
    breaks a rule, or all that the text still holds.  It is read forward: the
    quoted key as far as a remaining key begins like it, the colon, the value as
    far as its type's pattern goes, what may stand behind the value, and the
    brace if no other key is left.  Each part is one anchored pattern.
    """
    seg, left = F.col(text), F.col(rem)
    quoted = '\\A"(' + G.key_chars + ')"' + G.ws
    length = F.length

    def of_type(pattern_of, subject: Column) -> Column:
        expr = None
        for t in _CANONICAL_TYPES:
            found = F.regexp_extract(subject, "\\A(?:" + pattern_of(t) + ")", 0)
            expr = F.when(F.col("_type") == t, found) if expr is None else expr.when(F.col("_type") == t, found)
        return F.coalesce(expr, F.lit(""))

    staged = df.withColumns({"_key": F.regexp_extract(seg, quoted, 0), "_name": F.regexp_extract(seg, quoted, 1), "_opened": seg.substr(F.lit(2), length(seg))})
    known = (F.col("_key") != "") & F.array_contains(left, F.col("_name"))
    alike = F.array_max(F.transform(left, lambda k: F.size(F.filter(
        F.sequence(F.lit(0), length(k)), lambda n: F.col("_opened").startswith(F.substring(k, F.lit(1), n))))))  # their common beginning, and one
    staged = staged.withColumns({
        "_known": known, "_alike": F.when(~known & (F.size(left) > 0), alike),
        "_colon": F.regexp_extract(seg.substr(length("_key") + 1, length(seg)), "\\A:" + G.ws, 0),
        "_type": F.when(known, F.element_at(types, F.col("_name")))})
    staged = staged.withColumn("_value", seg.substr(length("_key") + length("_colon") + 1, length(seg)))
    staged = staged.withColumns({"_begun": of_type(G.prefix, F.col("_value")), "_whole": of_type(G.value, F.col("_value"))})
    staged = staged.withColumn("_behind", F.col("_value").substr(length("_whole") + 1, length(seg)))
    staged = staged.withColumn("_blank", of_type(G.after, F.col("_behind")))
    staged = staged.withColumn("_closing", F.col("_behind").substr(length("_blank") + 1, length(seg)))
    up_to_value = length("_key") + length("_colon")
    complete = (F.col("_whole") != "") & (length("_whole") >= length("_begun"))  # a number may end in a dot that needs digits
    up_to_end = up_to_value + length("_whole") + length("_blank")
    closes = F.col("_closing").startswith("}") & (F.size(left) == 1)
    live = (
        F.when((F.size(left) == 0) | ~seg.startswith('"'), 0)
        .when(~F.col("_known"), F.col("_alike"))
        .when(F.col("_colon") == "", length("_key"))
        .when(~complete, up_to_value + length("_begun"))
        .when(closes, up_to_end + length(F.regexp_extract("_closing", "\\A\\}" + G.ws, 0)))
        .otherwise(up_to_end)
    )
    return staged.withColumn(out, live).drop("_key", "_name", "_opened", "_known", "_alike", "_colon", "_type", "_value", "_begun", "_whole", "_behind", "_blank", "_closing")
