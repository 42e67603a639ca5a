"""The items of an object of any form, found by one scan that counts depth.

The complete flat items that a text begins with are found by one pattern.  Only
what follows them is split into strings, brackets, commas and what stands
between; one aggregate carries a stack of open brackets over these tokens.  Keys
count at level 1 only, values may be nested to any depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.functions.grammar import JAVA

_WS = "[ \\t\\n\\r]"
_STRING = JAVA.loose_string
_PLAIN = '[^",{}\\[\\] \\t\\n\\r]'
_HEAD = '"' + JAVA.key_chars + '"' + JAVA.ws + ":" + JAVA.ws
# a key with its colon and, unless it is nested, its value; a string; a comma or
# bracket; white space; anything else; a string that never ends
TOKEN = (
    _HEAD + "(?:(?:" + _STRING + "|" + _PLAIN + ")" + _PLAIN + "*+)?+"
    + "|" + _STRING + "|[,{}\\[\\]]|" + _WS + "++|" + _PLAIN + "++|\"[\\s\\S]*+"
)
_WHOLE_HEAD, _BEGINS_HEAD, _WHOLE_STRING = "\\A" + _HEAD + "\\z", "\\A" + _HEAD, "\\A" + _STRING + "\\z"
_QUOTED = "\\A" + _STRING

# Where the scan stands at level 1: before an item, behind a key's colon, in a
# value, in an item that has no proper key and colon, in text without a key.
_BETWEEN, _COLON, _VALUE, _ODD, _LOOSE, _OPEN_STRING = range(6)

_STATE = "struct<pos:int,stack:string,opens:array<int>,broken:array<int>,mode:int,start:int,items:array<struct<begin:int,end:int>>,done:boolean>"


def tokens(body: Column) -> Column:
    """size (bytes) and kind of each token of a text that stands behind an opening brace, before an item.

    Kinds: K key and colon, I whole item, S string, U string without an end, W
    white space, T other text, and the commas and brackets as they are.
    """
    def kind(t: Column) -> Column:
        first = F.substring(t, 1, 1)
        quoted = F.when(t.rlike(_WHOLE_HEAD), "K").when(t.rlike(_BEGINS_HEAD), "I").when(t.rlike(_WHOLE_STRING), "S").otherwise("U")
        return (
            F.when(first == '"', quoted).when(first.isin(",", "{", "}", "[", "]"), first)
            .when(first.isin(" ", "\t", "\n", "\r"), "W").otherwise("T"))

    return F.transform(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0)), lambda t: F.struct(F.octet_length(t).alias("n"), kind(t).alias("kind")))


def scan(found: Column, broken: Column) -> Column:
    """Begin and end of each item (bytes of the tokens' text), and the brackets that nothing closes in their turn.

    A closing bracket closes the innermost open one of its kind; those opened
    within are broken.  ``broken`` are the places of brackets to read as text.
    """
    no_ints, no_items = F.array().cast("array<int>"), F.array().cast("array<struct<begin:int,end:int>>")
    zero = F.struct(
        F.lit(0).alias("pos"), F.lit("{").alias("stack"), no_ints.alias("opens"), no_ints.alias("broken"),
        F.lit(_BETWEEN).alias("mode"), F.lit(0).alias("start"), no_items.alias("items"), F.lit(False).alias("done")).cast(_STATE)

    def state(acc: Column, t: Column, **changed: Column) -> Column:
        changed["pos"] = acc["pos"] + t["n"]
        names = ("pos", "stack", "opens", "broken", "mode", "start", "items", "done")
        return F.struct(*[changed.get(name, acc[name]).alias(name) for name in names]).cast(_STATE)

    def push(acc: Column) -> Column:
        return F.concat(acc["items"], F.array(F.struct(acc["start"].alias("begin"), acc["pos"].alias("end"))))

    def as_text(mode: Column) -> Column:
        """The mode behind text or a bracket at level 1."""
        return F.when(mode == _COLON, _VALUE).when(mode == _BETWEEN, _LOOSE).otherwise(mode)

    def opened(acc: Column, t: Column) -> Column:
        mode = F.when(F.length(acc["stack"]) == 1, as_text(acc["mode"])).otherwise(acc["mode"])
        return state(acc, t, stack=F.concat(acc["stack"], t["kind"]), opens=F.concat(acc["opens"], F.array(acc["pos"])), mode=mode)

    def closed(acc: Column, t: Column, up: Column) -> Column:
        """``up`` levels are closed."""
        left = F.length(acc["stack"]) - up
        ends = left == 0
        return state(
            acc, t, stack=F.substring(acc["stack"], F.lit(1), left),
            opens=F.slice(acc["opens"], F.lit(1), F.greatest(left - 1, F.lit(0))),
            broken=F.when(up > 1, F.concat(acc["broken"], F.slice(acc["opens"], left + 1, up - 1))).otherwise(acc["broken"]),
            items=F.when(ends & (up == 1) & acc["mode"].isin(_COLON, _VALUE, _ODD), push(acc)).otherwise(acc["items"]), done=ends)

    def passed(acc: Column, t: Column) -> Column:
        """At level 1, a token that neither opens nor closes a bracket ends the item before it, begins one or goes on."""
        kind, mode = t["kind"], acc["mode"]
        begins = kind.isin("I", "K")
        pushes = ((begins | (kind == "W")) & (mode == _VALUE)) | (begins & (mode == _ODD)) | ((kind == ",") & mode.isin(_COLON, _VALUE, _ODD))
        on_top = (
            F.when(kind == "I", _VALUE).when(kind == "K", _COLON).when(kind == "U", _OPEN_STRING).when(kind == ",", _BETWEEN)
            .when(kind == "W", F.when(mode == _VALUE, _BETWEEN).otherwise(mode))
            .when((kind == "S") & (mode == _BETWEEN), _ODD)
            .otherwise(as_text(mode)))
        return state(
            acc, t, mode=on_top, start=F.when(begins | ((kind == "S") & (mode == _BETWEEN)), acc["pos"]).otherwise(acc["start"]),
            items=F.when(pushes, push(acc)).otherwise(acc["items"]))

    def step(acc: Column, t: Column) -> Column:
        kind, stack = t["kind"], acc["stack"]
        text = (F.size(broken) > 0) & F.array_contains(broken, acc["pos"])  # a bracket that is read as text
        up = F.instr(F.reverse(stack), F.when(kind == "}", "{").otherwise("["))  # levels that a closing bracket closes; 0 if stray
        return (
            F.when(acc["done"], acc)
            .when(kind.isin("{", "[") & ~text, opened(acc, t))
            .when(kind.isin("}", "]") & ~text & (up > 0), closed(acc, t, up))
            .when(F.length(stack) == 1, passed(acc, t))
            .otherwise(state(acc, t)))

    def finish(acc: Column) -> Column:
        """A value that the text's end cuts short is kept, unless a string or bracket in it is open."""
        cut = ~acc["done"] & (acc["mode"] == _VALUE) & (F.length(acc["stack"]) == 1)
        last = F.array(F.struct(acc["start"].alias("begin"), acc["pos"].alias("end")))
        return F.struct(F.when(cut, F.concat(acc["items"], last)).otherwise(acc["items"]).alias("items"), acc["broken"].alias("broken"))

    return F.aggregate(found, zero, step, finish)


def with_head(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the head of each text, the keys and raw values of the head's items, and the tail behind it.

    The head (``_head``, empty if the text opens no object) is the brace and
    every complete flat item with its comma; ``_hk``, ``_hv``, ``_tail``.
    """
    t = F.col(text)
    split = df.select("*", F.regexp_extract(t, JAVA.head, 0).alias("_head"))
    return split.select(
        "*", F.regexp_extract_all("_head", F.lit(JAVA.item_comma), 1).alias("_hk"),
        F.transform(F.regexp_extract_all("_head", F.lit(JAVA.item_comma), 2), lambda v: F.rtrim(v, F.lit(" \t\n\r"))).alias("_hv"),
        t.substr(F.length("_head") + 1, F.length(t) + 1).alias("_tail"),
    )


def with_items(df: DataFrame, keys: str = "fkeys", values: str = "fvals") -> DataFrame:
    """``df``, which has the columns of ``with_head``, with the keys and raw values of each text's items, in order, in place of them.

    A raw value is a string with what clings to it, a whole object or array, or
    anything else up to a comma or white space.  A key without a value has the
    empty one.  An item whose quoted key has no colon or is no plain string
    (escapes, control characters) has what its quotes hold as key and itself
    whole as value; that is no JSON value, so its class is ``invalid``.  Text
    without a quoted key is no item, nor is what the text's end cuts off before
    its value, a string or a bracket ends.  Texts that open no object have none.
    """
    kept = [c for c in df.columns if c not in ("_head", "_hk", "_hv", "_tail")]
    # the tail of a complete flat object is its last item; only other tails are scanned
    last = "\\A" + JAVA.item + "\\}" + _WS + "*+\\z"
    tail = F.when(F.col("_head") != "", F.col("_tail")).otherwise(F.substring("_tail", 1, 0))
    staged = df.select(*kept, "_head", "_hk", "_hv", tail.alias("_tail"))
    staged = staged.withColumn("_flat", F.col("_tail").rlike(last))
    staged = staged.withColumn("_tokens", F.when(~F.col("_flat"), tokens(F.col("_tail"))))
    staged = staged.withColumn("_scan", scan(F.col("_tokens"), F.array().cast("array<int>")))
    again = scan(F.col("_tokens"), F.col("_scan.broken"))
    places = F.when(F.size("_scan.broken") > 0, again["items"]).otherwise(F.col("_scan.items"))
    staged = staged.withColumn("_places", places).withColumn("_bytes", F.col("_tail").cast("binary"))

    def item(p: Column) -> Column:
        part = F.substring(F.col("_bytes"), p["begin"] + 1, p["end"] - p["begin"]).cast("string")
        return F.rtrim(part, F.lit(" \t\n\r"))

    def split(x: Column) -> Column:
        head = F.regexp_extract(x, _BEGINS_HEAD, 0)
        whole = F.regexp_extract(x, _QUOTED, 0)
        key = F.when(head != "", F.regexp_extract(head, '\\A"(' + JAVA.key_chars + ')"', 1)).otherwise(F.substring(whole, F.lit(2), F.length(whole) - 2))
        return F.struct(key.alias("key"), F.when(head != "", x.substr(F.length(head) + 1, F.length(x))).otherwise(x).alias("value"))

    staged = staged.withColumn("_items", F.transform(F.transform("_places", item), split))
    last_key, last_value = F.regexp_extract("_tail", last, 1), F.rtrim(F.regexp_extract("_tail", last, 2), F.lit(" \t\n\r"))
    found = F.struct(
        F.concat("_hk", F.when(F.col("_flat"), F.array(last_key)).otherwise(F.col("_items.key"))).alias("k"),
        F.concat("_hv", F.when(F.col("_flat"), F.array(last_value)).otherwise(F.col("_items.value"))).alias("v"))
    # one row each: a generator keeps filters on the items from being worked out again below every stage
    out = staged.select(*kept, F.explode(F.array(found)).alias("_found"))
    return out.select(*kept, F.col("_found.k").alias(keys), F.col("_found.v").alias(values))
