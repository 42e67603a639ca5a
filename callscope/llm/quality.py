"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled good; the rest of the web text is not
labelled.  A logistic scorer g minimises the non-negative unbiased risk

    prior * mean_P[l(g)] + max(0, mean_U[l(-g)] - prior * mean_P[l(-g)])

with the logistic loss l, so no label of bad text is needed.  The class prior is
estimated first: a scorer of positives against unlabelled rows is fitted, and
over its thresholds the smallest ratio of the shares that pass, unlabelled to
positive, bounds the share of good rows among the unlabelled ones.

Features are bounded statistics of the whole text: how often each class of
character follows each other, repetition of words and lines, lengths.  They are
computed once for every row and written (about 220 bytes a row); each step of
the optimiser reads that table and adds up gradients and curvature in Spark.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import in_slices, stage, utf8

THRESHOLD = 0.7
POSITIVE, UNLABELLED = 1, 2
CLASSES = 10
BINS = 1000  # of the score histograms for the class prior
PULL = 1e-3  # weight of the squared norm, beside that of a few rows
PULL_ROWS = 4
STEPS = 8
_class = np.full(256, 8, "u1")  # beyond ASCII
for _i, _of in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\t\n\v\f\r", b".,;:?'\"()-", b"!")):
    _class[list(_of)] = _i
for _b in range(128):
    if _class[_b] == 8:
        _class[_b] = 9 if _b < 32 or _b == 127 else 7
WIDTH = CLASSES * CLASSES + 8


def features(text: str) -> np.ndarray:
    data = text.encode()
    out = np.zeros(WIDTH, "f4")
    kinds = _class[np.frombuffer(data, "u1")].astype("i2")
    if len(kinds) > 1:
        out[:100] = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=100) / (len(kinds) - 1)
        out[:100] = np.log1p(1000 * out[:100]) / 7
    words = data.split()
    n = len(words)
    if n:
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        lines = [x for x in data.split(b"\n") if x]
        out[100:] = (
            np.log1p(n) / 10,
            np.log1p(len(data) / n) / 5,
            len(counts) / n,
            min(1.0, len(counts) / n ** 0.75),
            max(counts.values()) / n,
            sum(a == b for a, b in zip(words, words[1:])) / n,
            len(set(lines)) / max(1, len(lines)),
            np.log1p(n / max(1, len(lines))) / 10,
        )
    return out


def _table(column) -> np.ndarray:
    """Packed rows as a matrix, with a column of ones."""
    data = column.to_pylist()
    x = np.frombuffer(b"".join(data), "<f2").reshape(len(data), -1).astype("f8")
    return np.hstack([x, np.ones((len(data), 1))])


@dataclass
class Model:
    """A linear scorer of scaled features and the class prior it was fitted with."""

    weights: np.ndarray | None
    prior: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:  # no trusted positives: nothing to tell rows apart by
            return np.ones(len(x))
        return _sigmoid(np.clip((x - self.mean) / self.spread, -5, 5) @ self.weights)


def held_out(doc_id: Column) -> Column:
    """The fold kept for testing; labels of its rows are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def feature_table(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, part (POSITIVE, UNLABELLED or null), fold (halves for the class prior), f; staged.

    A trusted positive has labels that all say 1 and lies outside the held-out
    fold; a row without a label is unlabelled; other labelled rows take no part.
    """

    def compute(batches):
        for batch in in_slices(batches):
            f = [features(t).astype("<f2").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.binary())], names=["doc_id", "f"])

    source = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    computed = source.mapInArrow(compute, T.StructType([source.schema["doc_id"], T.StructField("f", T.BinaryType())]))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality"))
    marks = marks.withColumn("labelled", F.lit(True))
    part = F.when(F.col("labelled").isNull(), UNLABELLED).when((F.col("quality") == 1) & ~F.col("held_out"), POSITIVE)
    joined = computed.join(marks, "doc_id", "left").withColumn("held_out", held_out(F.col("doc_id")))
    fold = F.pmod(F.xxhash64("doc_id", "f"), F.lit(2)).cast("int")
    return stage(joined.select("doc_id", "held_out", part.alias("part"), fold.alias("fold"), "f"), "quality-features")


def _summed(rows: DataFrame, work) -> np.ndarray:
    """The sum over all rows of ``work(part, x)``: added up in each task, then in groups, then here.

    There are as many groups as the root of the number of tasks, each of at most
    twice as many, so neither a group nor the driver holds more than that.
    """

    def partly(batches):
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                total = total + work(batch.column(0).to_numpy(zero_copy_only=False), _table(batch.column(1)))
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array([math.isqrt(TaskContext.get().partitionId())]), pa.array([total.tobytes()], pa.binary())], names=["g", "s"])

    def together(key, table):
        total = sum(np.frombuffer(s) for s in table["s"].to_pylist())
        return pa.table({"s": pa.array([total.tobytes()], pa.binary())})

    got = rows.select("part", "f").mapInArrow(partly, "g long, s binary").groupBy("g").applyInArrow(together, "s binary").collect()
    return sum((np.frombuffer(r["s"]) for r in got), np.zeros(1))


def _log1pexp(g: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, g)


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def _curved(part, x, w, use):
    """Sums of gradient and curvature of log(1 + exp(g)) over the rows of ``use``."""
    x = x[part == use]
    p = _sigmoid(x @ w)
    return p @ x, (x * (p * (1 - p))[:, None]).T @ x


def fit(table: DataFrame, steps: int = STEPS) -> Model:
    """Estimate the class prior and minimise the non-negative risk over the rows of a feature table."""
    rows = table.filter("part is not null")
    d = WIDTH + 1

    def moments(part, x):
        return np.concatenate([[(part == POSITIVE).sum(), (part == UNLABELLED).sum()], x[part == POSITIVE].sum(axis=0), x.sum(axis=0), (x * x).sum(axis=0)])

    m = _summed(rows, moments)
    if len(m) == 1 or min(m[:2]) < 2:
        return Model(None)
    n_p, n_u = m[:2]
    mean_p, mean = m[2:2 + d] / n_p, m[2 + d:2 + 2 * d] / (n_p + n_u)
    spread = np.sqrt(np.maximum(m[2 + 2 * d:] / (n_p + n_u) - mean ** 2, 1e-6))
    mean[-1], spread[-1] = 0, 1
    scaled = lambda x: np.clip((x - mean) / spread, -5, 5)

    def sums(w, rows=rows):
        def work(part, x):
            x = scaled(x)
            g = x @ w
            grad_u, curve_u = _curved(part, x, w, UNLABELLED)
            grad_p, curve_p = _curved(part, x, w, POSITIVE)
            loss = [_log1pexp(g[part == UNLABELLED]).sum(), _log1pexp(g[part == POSITIVE]).sum(), _log1pexp(-g[part == POSITIVE]).sum()]
            counts = [(part == POSITIVE).sum(), (part == UNLABELLED).sum()]
            return np.concatenate([counts, loss, x[part == POSITIVE].sum(axis=0), grad_u, grad_p, curve_u.ravel(), curve_p.ravel()])

        n_p, n_u, *s = np.split(_summed(rows, work), np.cumsum([1, 1, 3, d, d, d, d * d]))
        loss, x_p, grad_u, grad_p, curve_u, curve_p = s
        loss = loss / np.concatenate([n_u, n_p, n_p])
        return loss, x_p / n_p, grad_u / n_u, grad_p / n_p, curve_u.reshape(d, d) / n_u, curve_p.reshape(d, d) / n_p

    pull = PULL + PULL_ROWS / n_p
    ridge = pull * np.eye(d)
    # positives against unlabelled rows, both with half the weight; fitted on one half, looked at on the other
    w = np.zeros(d)
    for _ in range(max(2, steps // 2)):
        _, x_p, grad_u, grad_p, curve_u, curve_p = sums(w, rows.filter("fold = 0"))
        grad = 0.5 * grad_u + 0.5 * (grad_p - x_p) + pull * w
        w = w - np.linalg.solve(0.5 * (curve_u + curve_p) + ridge, grad)

    def histogram(part, x):
        bins = np.minimum((BINS * _sigmoid(scaled(x) @ w)).astype(int), BINS - 1)
        return np.concatenate([np.bincount(bins[part == k], minlength=BINS) for k in (POSITIVE, UNLABELLED)]).astype("f8")

    prior = class_prior(*np.split(_summed(rows.filter("fold = 1"), histogram), 2))

    best, least, w = np.zeros(d), np.inf, np.zeros(d)
    for _ in range(steps):
        loss, x_p, grad_u, grad_p, curve_u, curve_p = sums(w)
        negative = loss[0] - prior * loss[1]  # the risk of the bad class, which can't be below 0
        risk = prior * loss[2] + max(0.0, negative) + pull / 2 * w @ w
        if risk < least:
            best, least = w, risk
        if negative >= 0:
            w = w - np.linalg.solve(curve_u + ridge, grad_u - prior * x_p + pull * w)
        else:  # overfitted: step back along the negative part
            w = w + 0.5 * np.linalg.solve(curve_u + prior * curve_p + ridge, grad_u - prior * grad_p)
    return Model(best, prior, mean, spread)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled rows, from both histograms of a score that rises with the positive class.

    At each threshold the share of unlabelled rows above it, over that of
    positives, is at least the prior; the threshold is taken where the ratio
    with its margin of error is least.
    """
    n_p, n_u = positive.sum(), unlabelled.sum()
    above_p, above_u = np.cumsum(positive[::-1]) / n_p, np.cumsum(unlabelled[::-1]) / n_u
    error = np.sqrt(np.log(4 / delta) / 2) * (n_p ** -0.5 + n_u ** -0.5)
    usable = above_p > 0
    ratio = above_u[usable] / above_p[usable]
    at = np.argmin(ratio + error / above_p[usable])
    return float(np.clip(ratio[at], 0.01, 0.99))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from ``threshold`` on) of every row.

    Scores depend on the text alone.  Null texts count as empty; repeated rows
    and null ids are kept; several labels of a document must all be 1 to make it
    a positive, null labels are 0, labels without a document are ignored; other
    columns are ignored; an empty table gives no rows.  Without positives or
    without unlabelled rows there is nothing to learn from, and every score is 1.
    """
    table = feature_table(docs, labels, id_col, text_col)
    model = fit(table)

    def score(batches):
        for batch in batches:
            s = model.scores(_table(batch.column(2))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype("i4"))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    schema = T.StructType([table.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
                           T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return table.select("doc_id", "held_out", "f").mapInArrow(score, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold; learnt from ``docs`` and ``labels``.

    Null texts count as empty; repeated rows stay or go together; without two
    trusted positives and two unlabelled rows all stay; an empty table gives no rows.
    """
    model = fit(feature_table(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def keep(batches):
        for batch in in_slices(batches):
            f = [features(t or "").astype("<f2").tobytes() for t in batch.column(at).to_pylist()]
            if f:
                yield batch.filter(pa.array(model.scores(_table(pa.array(f, pa.binary()))) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
