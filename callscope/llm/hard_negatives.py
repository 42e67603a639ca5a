"""Hard negatives by length buckets and coordinate pruning (the COORD search of LEMP), as Spark joins.

Rows are sorted by label and vector length and cut into buckets of bounded size.
A bucket holds its vectors and, for each coordinate, the order of the normalised
vectors by it: the sorted coordinate lists.

A query (a distinct anchor vector with its label) looks for scores of at least
some floor.  A bucket whose longest vector is l can hold one only if the cosine
t = floor / (|q| l) is at most 1.  If it is, the angle between the query and a
result is at most arccos(t), so each coordinate of the result's direction lies
in a range around the query's: between the cosines of (angle of the coordinate
+- arccos(t)).  The ranges of the query's few largest coordinates, its focus,
are looked up in the sorted lists, the candidate sets are intersected, and only
what is left is verified by exact inner products.

A query meets the bucket of the longest vectors first; the scores found there
raise its floor before it meets the others that can still hold a result.  The
same search finds the positives (same label) and the negatives (other labels,
scores within a window below each positive's score).

Rows that share vector and label count with their smallest ids only, as many
as a result may hold, so a vector that a third of all rows share is few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callscope.llm.common import stage
from callscope.llm.knn import quantised

BUCKET, QUERIES = 2048, 128  # rows in a bucket, queries in a block
FOCUS = 3  # coordinates whose ranges are intersected
SLACK = 1e-9  # for bounds computed in floating point, relative to a cosine of 1
LEAST, MOST = -(2**63), 2**63 - 1

BUCKET_SCHEMA = "bucket long, dim int, low long, high long, longest double, ids binary, labels binary, vectors binary, sorted binary"
BLOCK_SCHEMA = "block long, dim int, asked array<long>, labels array<long>, vectors binary, floors array<array<long>>, tops array<array<long>>, firsts array<long>"


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m.astype("f8") ** 2).sum(axis=1))


def _numbered(names: list[str], rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(names), schema)], names=names)


def _chunks(batches: Iterator[pa.RecordBatch], size: int, cut) -> Iterator[list[tuple]]:
    """Runs of at most ``size`` rows; ``cut(held, row)`` tells where one must end before."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (len(held) == size or cut(held, row)):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def length_buckets(rows: DataFrame, size: int = BUCKET) -> DataFrame:
    """Buckets of ``rows`` (id, label, v): vectors of one dimension, of one label or, where labels have few rows, of several; longest first."""
    schema = pa.schema([("bucket", pa.int64()), ("dim", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("longest", pa.float64()),
                        ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("sorted", pa.binary())])

    def cut(held, row):
        return len(held[0][2]) != len(row[2]) or (held[-1][1] != row[1] and 4 * len(held) >= size)

    def build(batches):
        part = TaskContext.get().partitionId()
        for n, chunk in enumerate(_chunks(batches, size, cut)):
            ids, labels, vectors = zip(*chunk)
            m = np.array(vectors, "<i8").reshape(len(chunk), -1)
            norm = _norms(m)
            unit = m / np.where(norm > 0, norm, 1)[:, None]
            lists = np.argsort(unit, axis=0, kind="stable").T.astype("<i4")
            yield _numbered(schema.names, [(part << 33 | n, m.shape[1], min(labels), max(labels), float(norm.max(initial=0)), np.array(ids, "<i8").tobytes(),
                                            np.array(labels, "<i8").tobytes(), m.tobytes(), np.ascontiguousarray(lists).tobytes())], schema)

    order = [F.size("v"), F.col("label"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x).desc()]
    dealt = rows.select("id", "label", "v").repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(dealt.mapInArrow(build, BUCKET_SCHEMA), "buckets")


def query_blocks(queries: DataFrame, size: int = QUERIES) -> DataFrame:
    """Blocks of ``queries`` (q, label, v, floors, tops, first), like ones together."""
    schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("asked", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("vectors", pa.binary()),
                        ("floors", pa.list_(pa.list_(pa.int64()))), ("tops", pa.list_(pa.list_(pa.int64()))), ("firsts", pa.list_(pa.int64()))])

    def build(batches):
        part = TaskContext.get().partitionId()
        for n, chunk in enumerate(_chunks(batches, size, lambda held, row: len(held[0][2]) != len(row[2]))):
            q, labels, vectors, floors, tops, firsts = map(list, zip(*chunk))
            yield _numbered(schema.names, [(part << 33 | n, len(vectors[0]), q, labels, np.array(vectors, "<i8").tobytes(), floors, tops, firsts)], schema)

    # those with the same label and like floors, relative to their length, need the same buckets
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    order = [F.size("v"), F.col("label"), F.array_min("floors") / F.greatest(length, F.lit(1.0))]
    dealt = queries.select("q", "label", "v", "floors", "tops", "first").repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(dealt.mapInArrow(build, BLOCK_SCHEMA), "query-blocks")


def eligible(low: np.ndarray, high: np.ndarray, label: int, same: bool) -> np.ndarray:
    """Which buckets hold rows of the label, or of another."""
    return (low <= label) & (label <= high) if same else (low != label) | (high != label)


def cosine_floor(floor: int, length: float, longest: np.ndarray | float):
    """The least cosine with which a vector of a bucket may reach a floor; -1 if there is no bound."""
    if floor <= 0 or length <= 0:
        return np.full(np.shape(longest), -1.0)
    return floor / (length * np.maximum(longest, 1e-300)) * (1 - SLACK) - SLACK


def feasible_range(coordinate: float, cosine: float) -> tuple[float, float]:
    """Where a coordinate of a direction lies whose cosine with the query is at least ``cosine``, given the query's coordinate."""
    own, most = np.arccos(np.clip(coordinate, -1, 1)), np.arccos(np.clip(cosine, -1, 1))
    return np.cos(min(np.pi, own + most)) - SLACK, np.cos(max(0.0, own - most)) + SLACK


def candidates(query: np.ndarray, cosine: float, unit: np.ndarray, lists: np.ndarray, focus: int = FOCUS) -> np.ndarray | None:
    """Rows of a bucket whose focus coordinates all lie in their feasible ranges; None for all rows."""
    if cosine <= -1:
        return None
    direction = query / np.sqrt((query.astype("f8") ** 2).sum())
    ranges, n = [], len(unit)
    for f in np.argsort(-np.abs(direction), kind="stable")[:focus]:
        low, high = feasible_range(direction[f], cosine)
        column = unit[lists[f], f]
        begin, end = np.searchsorted(column, low, "left"), np.searchsorted(column, high, "right")
        if end - begin < n:
            ranges.append((end - begin, f, begin, end, low, high))
    if not ranges:
        return None
    (_, f, begin, end, *_), *others = sorted(ranges)
    found = lists[f][begin:end]
    for _, f, _, _, low, high in others:
        values = unit[found, f]
        found = found[(low <= values) & (values <= high)]
    return found


def exact_scores(vectors: np.ndarray, query: np.ndarray, top: float) -> np.ndarray:
    """Integer inner products, in doubles where those hold them exactly; ``top`` bounds the vectors' components."""
    if top * float(np.abs(query).max(initial=0)) * max(1, len(query)) < 2.0**53:
        return (vectors.astype("f8") @ query.astype("f8")).astype("i8")
    return vectors @ query


def solve_pair(bucket: dict, block: dict, same: bool, keep: int, only_first: bool) -> Iterator[tuple[int, int, int, int]]:
    """q, window, -score, id: of each query's windows the ``keep`` best rows of the bucket."""
    ids, labels = np.frombuffer(bucket["ids"], "<i8"), np.frombuffer(bucket["labels"], "<i8")
    n, dim = len(ids), bucket["dim"]
    vectors = np.frombuffer(bucket["vectors"], "<i8").reshape(n, dim)
    lists = np.frombuffer(bucket["sorted"], "<i4").reshape(dim, n)
    norm = _norms(vectors)
    unit = vectors / np.where(norm > 0, norm, 1)[:, None]
    top = float(np.abs(vectors).max(initial=0))
    asked = np.frombuffer(block["asked_vectors"], "<i8").reshape(len(block["asked"]), dim)
    for q, label, query, length, floors, tops, first in zip(block["asked"], block["asked_labels"], asked, _norms(asked), block["floors"], block["tops"], block["firsts"]):
        if (first == bucket["bucket"]) != only_first or not eligible(np.int64(bucket["low"]), np.int64(bucket["high"]), label, same):
            continue
        cosine = float(cosine_floor(min(floors), length, bucket["longest"]))
        if cosine > 1:
            continue
        rows = candidates(query, cosine, unit, lists)
        rows = np.arange(n) if rows is None else rows
        rows = rows[(labels[rows] == label) == same]
        scores = exact_scores(vectors[rows], query, top)
        for window, (low, high) in enumerate(zip(floors, tops)):
            held = np.flatnonzero((scores >= low) & (scores <= high))
            if len(held) > keep:  # none below the keep-th score
                held = held[scores[held] >= np.partition(scores[held], len(held) - keep)[len(held) - keep]]
            for k in held[np.lexsort((ids[rows[held]], -scores[held]))][:keep].tolist():
                yield q, window, -int(scores[k]), int(ids[rows[k]])


def needed_pairs(blocks: DataFrame, summary: dict[int, tuple[np.ndarray, ...]], same: bool, only_first: bool) -> DataFrame:
    """bucket, block: each block of queries with every bucket that one of them must look into."""
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64())])

    def pair(batches):
        for batch in batches:
            out = []
            for block, dim, labels, vectors, floors, firsts in zip(*(c.to_pylist() for c in batch.columns)):
                bucket, low, high, longest = summary.get(dim, [np.zeros(0, "i8")] * 4)
                needs = np.zeros(len(bucket), bool)
                for label, length, floor, first in zip(labels, _norms(np.frombuffer(vectors, "<i8").reshape(len(labels), dim)), floors, firsts):
                    if only_first:
                        needs |= bucket == first
                    else:
                        needs |= eligible(low, high, label, same) & (cosine_floor(min(floor), length, longest) <= 1) & (bucket != first)
                out += [(b, block) for b in bucket[needs].tolist()]
            yield _numbered(schema.names, out, schema)

    return blocks.select("block", "dim", "labels", "vectors", "floors", "firsts").mapInArrow(pair, "bucket long, block long")


def search(queries: DataFrame, buckets: DataFrame, summary: dict[int, tuple[np.ndarray, ...]], same: bool, keep: int) -> DataFrame:
    """q, window, place (from 1), lost (the score, negated), id: the best rows of each window of each query.

    ``queries`` has q, label, v and, for each window, its least (floors) and its
    highest score (tops), both included; one window at least.
    """

    def with_first(batches):
        """The bucket of the longest vectors that a query may look into, if there is one."""
        for batch in batches:
            out = []
            for dim, label in zip(batch.column("dim").to_pylist(), batch.column("label").to_pylist()):
                bucket, low, high, longest = summary.get(dim, [np.zeros(0, "i8")] * 4)
                may = np.flatnonzero(eligible(low, high, label, same))
                out.append(int(bucket[may[longest[may].argmax()]]) if len(may) else -1)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(out, pa.int64())], names=[*batch.schema.names[2:], "first"])

    kinds = dict(queries.dtypes)
    columns = ["q", "label", "v", "floors", "tops"]
    dims = queries.select(F.size("v").alias("dim"), "label", *columns)
    # one column twice: as the bucket's label for the task, and as the query's own
    dims = dims.toDF("dim", "label", "q", "own", "v", "floors", "tops")
    placed = dims.mapInArrow(with_first, f"q long, own long, v {kinds['v']}, floors array<long>, tops array<long>, first long")
    placed = stage(placed.withColumnRenamed("own", "label"), "queries")

    def solved(queries: DataFrame, only_first: bool) -> DataFrame:
        blocks = query_blocks(queries)
        pairs = needed_pairs(blocks, summary, same, only_first)
        asked = blocks.select("block", "asked", F.col("labels").alias("asked_labels"), F.col("vectors").alias("asked_vectors"), "floors", "tops", "firsts")
        # the blocks go to the buckets, so a bucket that many blocks need is a side of many rows, which Spark may split
        units = pairs.join(asked, "block").join(buckets, "bucket")
        schema = pa.schema([("q", pa.int64()), ("window", pa.int32()), ("lost", pa.int64()), ("id", pa.int64())])

        def solve(batches):
            for batch in batches:
                for k in range(batch.num_rows):  # one pair in memory as objects
                    row = batch.slice(k, 1).to_pylist()[0]
                    yield _numbered(schema.names, list(solve_pair(row, row, same, keep, only_first)), schema)

        return units.mapInArrow(solve, "q long, window int, lost long, id long")

    def best(found: DataFrame) -> DataFrame:
        # the bound is taken in each task before the shuffle
        order = W.partitionBy("q", "window").orderBy("lost", "id")
        return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)

    early = stage(best(solved(placed, True)), "first-results")
    reached = early.filter(F.col("place") == keep).groupBy("q").agg(F.collect_list(F.struct("window", (-F.col("lost")).alias("floor"))).alias("reached"))
    raised = F.transform("floors", lambda floor, i: F.greatest(
        floor, F.array_max(F.transform(F.filter("reached", lambda r: r["window"] == i), lambda r: r["floor"]))))
    later = placed.join(reached, "q", "left").withColumn("floors", F.when(F.col("reached").isNull(), F.col("floors")).otherwise(raised)).drop("reached")
    return stage(best(early.drop("place").unionByName(solved(later, False))), "results")


def mine(embeddings: DataFrame, is_anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100),
         id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor (a row for which ``is_anchor`` holds) and each of its
    ``positives`` best other rows of the same label, the ``negatives`` best rows
    of other labels whose score is between ``window`` percent of the positive's
    score; fewer where there are fewer, no row where there is none.  Scores are
    inner products of vectors scaled and rounded down (they must fit in 64
    bits); higher ones come first, ties by smaller id; vectors of different
    lengths don't meet.  Rows with a null id, label or vector or a null or
    non-finite component take no part; labels are integers; repeated rows count
    once; an empty table gives no rows; other columns are ignored.
    """
    rows = embeddings.withColumn("__anchor", F.coalesce(is_anchor, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), quantised(F.col(vec_col), scale).alias("v"),
        F.col("__anchor").alias("anchor"))
    rows = stage(rows.dropna(subset=["id", "label", "v"]).distinct(), "vectors")
    keep = max(positives + 1, negatives)
    same_row = W.partitionBy("v", "label").orderBy("id")
    few = rows.select("id", "label", "v").distinct().withColumn("r", F.dense_rank().over(same_row)).filter(F.col("r") <= keep)
    buckets = length_buckets(few)
    summary: dict[int, tuple[np.ndarray, ...]] = {}  # five numbers for each bucket
    by_dim: dict[int, list] = {}
    for r in buckets.select("dim", "bucket", "low", "high", "longest").collect():
        by_dim.setdefault(r[0], []).append(r[1:])
    for dim, of in by_dim.items():
        bucket, low, high, longest = zip(*of)
        summary[dim] = (np.array(bucket, "i8"), np.array(low, "i8"), np.array(high, "i8"), np.array(longest, "f8"))

    anchors = rows.filter("anchor").select("id", "label", "v")
    asked = stage(anchors.select("label", "v").distinct().withColumn("q", F.monotonically_increasing_id()), "distinct-anchors")
    whole = asked.withColumns({"floors": F.array(F.lit(LEAST)), "tops": F.array(F.lit(MOST))})
    near = search(whole, buckets, summary, same=True, keep=positives + 1)
    near = near.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("lost", "id"))).alias("near"))  # positives + 1 at most
    near = stage(asked.join(near, "q"), "positives")

    # what a negative's score must lie between, for each positive score
    def percent(part: int, score: Column) -> Column:
        """floor(part * score / 100) in integers."""
        rest = F.pmod(score, F.lit(100).cast("long"))
        return part * F.call_function("div", score - rest, F.lit(100).cast("long")) + F.floor(part * rest / 100)

    scores = F.array_distinct(F.transform("near", lambda p: -p["lost"]))
    windows = F.transform(scores, lambda s: F.struct((-percent(window[0], -s)).alias("low"), percent(window[1], s).alias("high"), s.alias("score")))
    open_windows = near.withColumn("windows", F.filter(windows, lambda w: w["low"] <= w["high"])).filter(F.size("windows") > 0)
    wanted = open_windows.withColumns({"floors": F.col("windows.low"), "tops": F.col("windows.high")})
    hard = search(wanted.select("q", "label", "v", "floors", "tops"), buckets, summary, same=False, keep=negatives)
    hard = hard.join(open_windows.select("q", "windows"), "q").select(
        "q", F.get("windows", F.col("window"))["score"].alias("positive_score"), F.col("place").alias("rank"), F.col("id").alias("negative_id"), (-F.col("lost")).alias("negative_score"))

    own = F.slice(F.filter("near", lambda p: p["id"] != F.col("anchor_id")), 1, positives)
    pairs = anchors.withColumnRenamed("id", "anchor_id").join(near, ["label", "v"]).select("anchor_id", "q", F.explode(own).alias("p"))
    pairs = pairs.select("anchor_id", "q", F.col("p.id").alias("positive_id"), (-F.col("p.lost")).alias("positive_score"))
    return pairs.join(hard, ["q", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
