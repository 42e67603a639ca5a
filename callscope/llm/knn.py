"""Exact top-k search by inner product: a Voronoi join.

Data vectors and queries are grouped by their nearest pivot; there are about as
many pivots as the root of the number of vectors.  A cell is cut into blocks by
distance from its pivot, so a block is a ring, and of each block only a summary
(the ring's radii, the largest norm) is known to all tasks.  It bounds a query's
scores: with pivot p, radii a to b and largest norm m no score exceeds
q.p + |q| b, nor |q| m, nor (|q|^2 + m^2 - d^2) / 2, where d is how far the
query lies outside of the ring.

A query meets the block with the highest bound first.  The k-th best score that
it finds there, or among a bounded set of witnesses, is one that its result
reaches; it is then replicated only to the blocks that this lets hold a result.
Blocks of data and of queries are solved locally, and the lists merged.

Equal vectors are one vector with its k + 1 smallest ids, which is all that can
appear in a result, so a vector that a third of the rows share is one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callscope.llm.common import in_slices, stage

LEAST_PIVOTS, PIVOT_SHARE = 16, 0.25  # pivots: this share of the root of the number of vectors, but at least so many
WITNESSES = 1024  # data vectors known to every task, or as many as the pivots; the first of them are the pivots
DATA_BLOCK, QUERY_BLOCK = 2048, 512
REPLICAS = 8192  # queries replicated to blocks that a worker holds at once, however many blocks there are
SLACK = 1e-6  # relative, for bounds computed in floating point
CELL_BITS = 32  # of a cell's number: the pivot, below the vectors' length
NO_PIVOT = (1 << CELL_BITS) - 1


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as double; null if the vector or a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(finite, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(column) -> np.ndarray:
    """Vectors of one length, packed, as integers."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), "<i8").reshape(len(data), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, in doubles where those hold them exactly."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2.0 ** 53:
        return (a.astype("f8") @ b.astype("f8").T).astype("i8")
    return a @ b.T


def _best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the ``keep`` highest scores, ties to smaller ids, in order."""
    order = np.lexsort((ids, -scores, rows))
    rows, scores, ids = rows[order], scores[order], ids[order]
    first = np.searchsorted(rows, rows)
    good = np.arange(len(rows)) - first < keep
    return rows[good], scores[good], ids[good]


def top_k(embeddings: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k best rows.

    Queries are the rows for which ``is_query`` holds; a query's candidates are
    all rows with another id and a vector of the same length.  Scores are inner
    products of quantised vectors (they must fit in 64 bits); ties go to the
    smaller id.  Null vectors, vectors with null or non-finite components and
    null ids take no part; repeated rows of the same id and vector count once;
    fewer than k candidates give fewer rows; other columns are ignored.
    """
    rows = embeddings.withColumn("query", F.coalesce(is_query, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), quantised(F.col(vec_col), scale).alias("v"), "query")
    rows = stage(rows.filter("id is not null and v is not null").distinct(), "vectors")

    # dense_rank with a bound is taken in each task before the shuffle
    ranked = rows.withColumn("r", F.dense_rank().over(W.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    data = stage(ranked.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")), "distinct-vectors")
    queries = rows.filter("query").select("id", "v")
    asked = stage(queries.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "distinct-queries")

    data_count = data.count()
    pivots = max(LEAST_PIVOTS, math.ceil(PIVOT_SHARE * math.sqrt(data_count)))
    witnesses = _smallest_hashes(data, data_count, max(WITNESSES, pivots))
    known: dict[int, np.ndarray] = {}
    for w in witnesses:
        known.setdefault(len(w["v"]), []).append(w["v"])
    known = {n: np.array(vs, "i8").reshape(len(vs), n) for n, vs in known.items()}
    weight = {n: np.array([len(w["ids"]) for w in witnesses if len(w["v"]) == n]) for n in known}

    def nearest(batches):
        """The cell (by length and pivot) of each vector, its distance from the pivot and its norm."""
        for batch in batches:
            vectors, others = batch.column(0), batch.columns[1:]
            lengths = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
            cell, far, norm = np.zeros(len(lengths), "i8"), np.zeros(len(lengths)), np.zeros(len(lengths))
            packed = [b""] * len(lengths)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                m = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(len(at), int(n))
                norm[at] = np.sqrt((m.astype("f8") ** 2).sum(axis=1))
                cell[at], far[at] = int(n) << CELL_BITS | NO_PIVOT, np.inf  # a length without pivots is one cell without rings
                if n in known:
                    p = known[n][:pivots].astype("f8")
                    d2 = norm[at, None] ** 2 - 2 * (m.astype("f8") @ p.T) + (p ** 2).sum(axis=1)
                    best = d2.argmin(axis=1)
                    cell[at] = int(n) << CELL_BITS | best
                    far[at] = np.sqrt(((m - p[best]) ** 2).sum(axis=1))
                for i, row in zip(at.tolist(), m):
                    packed[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*others, pa.array(packed, pa.binary()), pa.array(cell), pa.array(far), pa.array(norm)],
                                             names=[*batch.schema.names[1:], "v", "cell", "far", "norm"])

    placed = data.select("v", "ids").mapInArrow(nearest, "ids array<long>, v binary, cell long, far double, norm double")
    data_blocks = stage(_rings(placed), "data-blocks")
    summary = data_blocks.select("block", "cell", "low", "high", "largest").collect()  # five numbers for each 2048 vectors
    rings: dict[int, np.ndarray] = {}
    for n in {r["cell"] >> CELL_BITS for r in summary}:
        rings[n] = np.array([(r["block"], r["cell"] & NO_PIVOT, r["low"], r["high"], r["largest"]) for r in summary if r["cell"] >> CELL_BITS == n], object)

    def reached(m: np.ndarray) -> np.ndarray:
        """For each query a score that its result reaches: the (k + 1)-th best witness', as the query itself may be one."""
        floor, n = np.full(len(m), np.iinfo("i8").min), m.shape[1]
        if n in known:
            scores = _products(m, known[n])
            order = np.argsort(-scores, axis=1, kind="stable")
            enough = np.cumsum(weight[n][order], axis=1) > k
            some = enough.any(axis=1)
            floor[some] = np.take_along_axis(scores, order, axis=1)[np.arange(len(m)), enough.argmax(axis=1)][some]
        return floor

    def bounds(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The blocks of vectors as long as these queries, and what no score of a query with a vector in a block exceeds."""
        of = rings.get(m.shape[1], np.zeros((0, 5), object))
        block = of[:, 0].astype("i8")
        if m.shape[1] not in known:  # as many as one length's vectors without a pivot make
            return block, np.full((len(m), len(block)), np.inf)
        pivot, low, high, largest = of[:, 1].astype("i8"), *(of[:, i].astype("f8") for i in (2, 3, 4))
        p, q = known[m.shape[1]][:pivots].astype("f8"), m.astype("f8")
        norm = np.sqrt((q ** 2).sum(axis=1))[:, None]
        product = q @ p.T
        gap = np.sqrt(np.maximum(norm ** 2 - 2 * product + (p ** 2).sum(axis=1), 0))[:, pivot]
        outside = np.maximum(np.maximum(gap - high, low - gap), 0)
        # distances are rounded, so what they take off is taken a little smaller
        outside = np.maximum(outside - SLACK * (1 + gap + high), 0)
        most = np.minimum(np.minimum(product[:, pivot] + norm * high, norm * largest), (norm ** 2 + largest ** 2 - outside ** 2) / 2)
        return block, most + SLACK * (1 + np.abs(most) + norm * largest)

    def replicate(first: bool):
        """Each query for each block that may hold one of its results, with its floor; at first only for the one with the highest bound."""
        def run(batches):
            for batch in in_slices(batches):
                q_ids, data, own = batch.column(0), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
                given = batch.column(3).to_numpy(zero_copy_only=False)
                out = [(np.zeros(0, "i8"),) * 3]
                for n in np.unique(own >> CELL_BITS):
                    at = np.flatnonzero(own >> CELL_BITS == n)
                    m = _matrix(data.take(pa.array(at))).reshape(len(at), int(n))
                    block, most = bounds(m)
                    floor = np.maximum(reached(m), given[at])
                    if not len(block):
                        continue
                    best = most.argmax(axis=1)
                    needed = most >= floor[:, None]
                    is_best = np.zeros(needed.shape, bool)
                    is_best[np.arange(len(at)), best] = True
                    row, col = np.nonzero(is_best if first else needed & ~is_best)
                    out.append((at[row], block[col], floor[row]))
                every = [np.concatenate(c) for c in zip(*out)]
                for start in range(0, len(every[0]), REPLICAS):
                    rows, block, floor = (c[start:start + REPLICAS] for c in every)
                    take = pa.array(rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(own[rows], pa.int64()), q_ids.take(take), data.take(take), pa.array(floor, pa.int64())],
                                                     names=["block", "own", "q", "v", "floor"])
        return run

    def solve(batches):
        """A block of data against a block of queries: each query's k + 1 best, none below its floor."""
        for batch in in_slices(batches, 1):  # one pair of blocks in memory
            vectors, n, ids, asked_v, q, floor = batch.columns
            ids, q, floors = ids.flatten(), q.flatten(), floor.flatten().to_numpy()
            a, b = np.frombuffer(asked_v[0].as_py(), "<i8").reshape(len(q), -1), np.frombuffer(vectors[0].as_py(), "<i8").reshape(n[0].as_py(), -1)
            scores = _products(a, b)
            if len(b) > k + 1:
                floors = np.maximum(floors, np.partition(scores, len(b) - k - 1, axis=1)[:, len(b) - k - 1])
            row, col = np.nonzero(scores >= floors[:, None])
            sizes, flat = pa.compute.list_value_length(ids).to_numpy().astype("i8"), ids.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            times = sizes[col]
            inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            rows, best, found = _best(np.repeat(row, times), np.repeat(scores[row, col], times), flat[np.repeat(starts[col], times) + inner], k + 1)
            some, first_of = np.unique(rows, return_index=True)
            listed = pa.StructArray.from_arrays([pa.array(-best, pa.int64()), pa.array(found, pa.int64())], ["lost", "id"])
            yield pa.RecordBatch.from_arrays([q.take(pa.array(some, pa.int64())), pa.ListArray.from_arrays(pa.array([*first_of, len(rows)], pa.int32()), listed)], names=["q", "best"])

    def solved(queries: DataFrame, first: bool) -> DataFrame:
        needed = queries.mapInArrow(replicate(first), "block long, own long, q long, v binary, floor long")
        # a join's left side streams past the right one's rows of a key, here a single block of data
        units = _merge_join(_query_blocks(needed), data_blocks, "block").select("vectors", "n", "ids", "asked", "q", "floor")
        found = units.mapInArrow(solve, "q long, best array<struct<lost: long, id: long>>")
        return stage(found, "first-found" if first else "found")

    def merged(found: DataFrame) -> DataFrame:
        return found.groupBy("q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))

    grouped = stage(asked.select("v", "q").mapInArrow(nearest, "q long, v binary, cell long, far double, norm double"), "grouped-queries")
    no_floor = F.lit(int(np.iinfo("i8").min)).alias("floor")
    early = solved(grouped.select("q", "v", "cell", no_floor), True)
    full = merged(early).filter(F.size("best") > k).select("q", (-F.element_at("best", -1)["lost"]).alias("floor"))
    raised = _merge_join(grouped, full, "q", "left").select("q", "v", "cell", F.coalesce("floor", no_floor).alias("floor"))
    late = solved(raised, False)
    answers = stage(_merge_join(asked, merged(early.unionByName(late)), "q").select("v", "best"), "answers")
    others = F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k)
    return (
        _merge_join(queries.withColumnRenamed("id", "query_id").distinct(), answers, "v")
        .select("query_id", F.posexplode(others).alias("at", "b"))
        .select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias("vec_id"), (-F.col("b.lost")).alias("score"))
    )


def _merge_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by shuffle, whatever the sides' sizes are taken for.

    Spark takes a stage's output for as large as its compressed files, and what
    Python makes of it for as many rows as it was given.  Queries replicated to
    all blocks so pass for a few MB, and would be sent to the driver whole.
    """
    return left.join(right.hint("merge"), on, how)


def _smallest_hashes(data: DataFrame, count: int, n: int) -> list:
    """The ``n`` of ``count`` vectors with the smallest hashes, in order.

    Each task sends as many as it has of them, up to ``n``, to the driver.  Of a
    large table only those with a hash that about twice as many have are sorted,
    and the whole only if they turn out too few.
    """
    if count > 4 * n:
        bound = (1 << 65) * n // count - (1 << 63)
        found = data.filter(F.xxhash64("v") < bound).orderBy(F.xxhash64("v"), "v").limit(n).collect()
        if len(found) == n:
            return found
    return data.orderBy(F.xxhash64("v"), "v").limit(n).collect()


def _runs(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    """Rows with the same first value, at most ``size`` at a time."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (len(held) == size or held[0][0] != row[0]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _rings(placed: DataFrame) -> DataFrame:
    """block, cell, low, high, largest, vectors, n, ids: each cell's vectors by distance from the pivot, so many at a time."""

    def cut(batches):
        part = TaskContext.get().partitionId()
        for number, rows in enumerate(_runs(batches, DATA_BLOCK)):
            cell, far, norm, v, ids = zip(*rows)
            yield pa.RecordBatch.from_pylist(
                [{"block": part << 33 | number, "cell": cell[0], "low": min(far), "high": max(far), "largest": max(norm), "vectors": b"".join(v), "n": len(v), "ids": list(ids)}],
                schema=pa.schema([("block", pa.int64()), ("cell", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("largest", pa.float64()),
                                  ("vectors", pa.binary()), ("n", pa.int64()), ("ids", pa.list_(pa.list_(pa.int64())))]))

    dealt = placed.select("cell", "far", "norm", "v", "ids").repartitionByRange("cell", "far").sortWithinPartitions("cell", "far")
    return dealt.mapInArrow(cut, "block long, cell long, low double, high double, largest double, vectors binary, n long, ids array<array<long>>")


def _query_blocks(needed: DataFrame) -> DataFrame:
    """block, asked, q, floor: the queries that a block of data needs, like ones together, so many at a time."""

    def cut(batches):
        for rows in _runs(batches, QUERY_BLOCK):
            block, _, q, v, floor = zip(*rows)
            yield pa.RecordBatch.from_pylist(
                [{"block": block[0], "asked": b"".join(v), "q": list(q), "floor": list(floor)}],
                schema=pa.schema([("block", pa.int64()), ("asked", pa.binary()), ("q", pa.list_(pa.int64())), ("floor", pa.list_(pa.int64()))]))

    # by block and own cell: a block that all queries need is dealt over several tasks
    dealt = needed.repartitionByRange("block", "own", "q").sortWithinPartitions("block", "own", "q")
    return dealt.mapInArrow(cut, "block long, asked binary, q array<long>, floor array<long>")
