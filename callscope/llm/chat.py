"""Chat formatting as a prefix tree.

Turns are formatted one by one, so conversations that begin with the same turns
begin with the same formatted text.  They are merged into prefix trees whose
nodes are turns; each node's text is emitted once, depth-first, with position
ids (its place in its conversations) and the intervals of the output that its
tokens may attend to: those of its ancestors, beside its own text causally.

No tree is gathered in one place.  A node is known by the hash of all turns up
to it and owned by the smallest conversation that passes through it, so a
conversation owns a run of turns at its end and borrows the others in runs.
Depth-first order is then the order of the conversations' lists of
(branching turn, deepest first; owner), and starts are running sums over that
order: partition totals first, then offsets.

Tokens are code points here; a turn's text is never cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from callscope.llm.common import prefix_sums, stage, utf8

# The template: a turn is HEAD role MIDDLE text TAIL.
HEAD, MIDDLE, TAIL = "### ", ": ", " </turn>\n"
SEGMENT = re.compile(r"### ((?:[^\\:#]|\\.)*): (.*) </turn>\n", re.DOTALL)


def escape(text: str) -> str:
    """Reversible; the result holds no ``##`` and no ``</turn>``, so no control string."""
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The segment, and where in it the text begins and ends."""
    head = HEAD + escape(role).replace(":", "\\:") + MIDDLE
    body = escape(text)
    return head + body + TAIL, len(head), len(head) + len(body)


def read_turn(segment: str, begin: int, end: int) -> tuple[str, str]:
    role, body = SEGMENT.fullmatch(segment).groups()
    assert segment[begin:end] == body, "the text's place doesn't fit the segment"
    return unescape(role), unescape(body)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _streamed(df: DataFrame, order: list[str], work: Callable[[Iterator[tuple]], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """Run ``work`` over each partition's rows in order, conversations whole and one after another, a batch in memory at a time."""
    arrow = to_arrow_schema(schema)
    ordered = df.repartition("key").sortWithinPartitions("key", *order)
    return ordered.mapInArrow(lambda b: _batches(work(_rows(b)), arrow), schema)


def _turns(rows: Iterator[tuple]) -> Iterator[tuple]:
    """key, conv_id, turn, role, text -> key, conv_id, pos, node, position, role, segment, begin, end."""
    current, pos, at, node = None, 0, 0, b""
    for key, conv_id, _, role, text in rows:
        if key != current:
            current, pos, at, node = key, 0, 0, b""
        said = role.encode()
        node = hashlib.blake2b(node + len(said).to_bytes(8, "little") + said + text.encode(), digest_size=16).digest()
        segment, begin, end = format_turn(role, text)
        yield key, conv_id, pos, node, at, role, segment, begin, end
        pos, at = pos + 1, at + len(segment)


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
    """key, owner, pos, position, length -> key, runs of (owner, first turn, its position, position after the run)."""
    current, runs = None, []
    for key, owner, pos, position, length in rows:
        if key != current:
            if runs:
                yield current, runs
            current, runs = key, []
        if not runs or runs[-1]["owner"] != owner:
            runs.append({"owner": owner, "turn": pos, "begin": position})
        runs[-1]["end"] = position + length
    if runs:
        yield current, runs


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, size -> part, start in the part, key, size; rows stay in order."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        starts = []
        for size in batch.column(1).to_pylist():
            starts.append(at)
            at += size
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(starts, pa.int64()), *batch.columns],
                                         names=["part", "start", "key", "size"])


def prefix_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Format conversations (conv_id, turn, role, text) and merge them into prefix trees.

    Returns two tables.  nodes, the output: key (of the owner) and pos name a
    node; segment is its formatted text; start its place in the output stream,
    tree the place where its tree begins; position the position id of its first
    token; loss_begin and loss_end the part of the segment under the loss mask
    (assistant texts; empty otherwise); text_begin and text_end that of the
    text; attends the (begin, end) intervals of its ancestors in the stream, in
    order.  members: conv_id, key, pos and owner, one row per turn; the owner's
    node at pos is the turn's.

    Turns are ordered by turn (null first), then role, then text; null roles and
    texts count as empty; repeated rows are turns of their own; rows with a null
    conv_id form one conversation.  Equal conversations share all nodes.  An
    empty table gives two empty ones; other columns are ignored.
    """
    key = F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n"))
    source = conversations.select(key.alias("key"), "conv_id", "turn", utf8(F.col("role")).alias("role"), utf8(F.col("text")).alias("text"))
    fields = T.StructType([
        T.StructField("key", T.StringType()), source.schema["conv_id"], T.StructField("pos", T.LongType()), T.StructField("node", T.BinaryType()),
        T.StructField("position", T.LongType()), T.StructField("role", T.StringType()), T.StructField("segment", T.StringType()), T.StructField("text_begin", T.LongType()), T.StructField("text_end", T.LongType()),
    ])
    turns = stage(_streamed(source, ["turn", "role", "text"], _turns, fields), "turns")

    # written first: a node of a third of all conversations is then a join side that Spark can split
    owners = stage(turns.groupBy("node").agg(F.min("key").alias("owner")), "owners")
    owned = stage(turns.join(owners, "node").drop("node").withColumn("length", F.length("segment").cast("long")), "owned-turns")

    run = "array<struct<owner: string, turn: long, begin: long, end: long>>"
    paths = _streamed(owned.select("key", "owner", "pos", "position", "length"), ["pos"], _conversations,
                      T.StructType.fromDDL(f"key string, runs {run}"))
    paths = stage(paths.withColumn("last", F.element_at("runs", -1)), "paths")
    chains = paths.filter("last.owner = key").select(
        "key", (F.col("last.end") - F.col("last.begin")).alias("size"),
        F.transform("runs", lambda r: F.struct((-r["turn"]).alias("turn"), r["owner"].alias("owner"))).alias("order"))
    chains = chains.orderBy("order").select("key", "size").mapInArrow(_summed, "part int, start long, key string, size long")
    placed = prefix_sums(stage(chains, "chains"), "part", "size", "base")
    placed = stage(placed.select(F.col("key").alias("owner"), (F.col("base") + F.col("start")).alias("chain_start")), "chain-starts")

    # the intervals of a chain: what its conversation borrows, then its own part
    runs = paths.filter("last.owner = key").select("key", F.explode("runs").alias("r")).select("key", "r.*").join(placed, "owner")
    interval = F.struct("begin", F.col("chain_start").alias("at"), (F.col("chain_start") + F.col("end") - F.col("begin")).alias("to"))
    starts = runs.groupBy("key").agg(F.array_sort(F.collect_list(interval)).alias("intervals"))
    starts = stage(starts, "chain-intervals")

    own = F.element_at("intervals", -1)
    nodes = owned.filter("owner = key").join(starts, "key").withColumn("start", own["at"] + F.col("position") - own["begin"])
    borrowed = F.transform(F.slice("intervals", F.lit(1), F.size("intervals") - 1), lambda i: F.struct(i["at"].alias("begin"), i["to"].alias("end")))
    own_part = F.array(F.struct(own["at"].alias("begin"), F.col("start").alias("end")))
    attends = F.filter(F.concat(borrowed, own_part), lambda i: i["begin"] < i["end"])
    learnt = F.col("role") == "assistant"
    nodes = nodes.select(
        "key", "pos", "role", "segment", F.element_at("intervals", 1)["at"].alias("tree"), "start", "position", attends.alias("attends"),
        "text_begin", "text_end", F.when(learnt, F.col("text_begin")).otherwise(0).alias("loss_begin"),
        F.when(learnt, F.col("text_end")).otherwise(0).alias("loss_end"))
    return stage(nodes, "nodes"), owned.select("conv_id", "key", "pos", "owner")


def _read_back(rows: Iterator[tuple]) -> Iterator[tuple]:
    """key, conv_id, pos, segment, text_begin, text_end, loss_begin, loss_end -> one digest row per conversation."""
    current = None
    for key, conv_id, pos, segment, begin, end, loss_begin, loss_end in rows:
        if current is None or key != current[0]:
            if current is not None:
                yield current[1], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars
            current, n, chars, loss_chars, turns, loss = (key, conv_id), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        role, text = read_turn(segment, begin, end)
        n, chars = n + 1, chars + len(segment)
        turns.update(f"{role}\n{text}\n".encode())
        under_mask = unescape(segment[loss_begin:loss_end])
        loss_chars += len(under_mask)
        loss.update(under_mask.encode())
    if current is not None:
        yield current[1], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars


def read_back(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Take each conversation from the output again.

    conv_id, n_turns, turns_sha256 (of role, line end, text, line end per turn),
    loss_chars and loss_sha256 (of the text under the loss mask, unescaped, with
    nothing between) and formatted_chars.
    """
    emitted = nodes.select(F.col("key").alias("owner"), "pos", "segment", "text_begin", "text_end", "loss_begin", "loss_end")
    held = members.join(emitted, ["owner", "pos"]).select(
        "key", "conv_id", "pos", "segment", "text_begin", "text_end", "loss_begin", "loss_end")
    schema = T.StructType([
        members.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    return _streamed(held, ["pos"], _read_back, schema)
