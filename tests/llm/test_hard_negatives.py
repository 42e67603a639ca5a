"""Hard negatives against brute force, and that lengths and coordinates prune."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callscope.llm import hard_negatives as H


def brute_force(rows, is_anchor, positives=5, negatives=5, low=80, high=100):
    vectors = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, v, label in rows
               if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, label, mine in vectors:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(mine, v)), i, other) for i, other, v in vectors if len(v) == len(mine))
        best = [(i, -s) for s, i, other in scored if i != a and other == label][:positives]
        for p, score in best:
            hard = [(i, -s) for s, i, other in scored if other != label and low * score <= -100 * s <= high * score][:negatives]
            out += [(a, p, r + 1, n, score, s) for r, (n, s) in enumerate(hard)]
    return sorted(out)


def mined(spark, rows, every=3, **more):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, anchor string")
    out = H.mine(df, F.col("vec_id") % every == 0, **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def single(rows):
    """Components as the table holds them, single precision."""
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def odd_rows(rng):
    rows = [(i, [rng.gauss(0.05, 0.2) for _ in range(6)], rng.randrange(4)) for i in range(150)]
    rows += [(i, [0.25] * 6, rng.randrange(3)) for i in range(150, 230)]  # one vector many times, under several labels
    rows += [(300, None, 1), (303, [0.1] * 5 + [None], 1), (306, [float("nan")] * 6, 1), (309, [float("inf")] * 6, 1), (312, [0.3] * 6, None), (None, [0.3] * 6, 1)]
    rows += [(315, [0.5] * 3, 1), (318, [0.5] * 3, 1), (321, [0.45] * 3, 2), (324, [], 1), (327, [], 1), (330, [], 2), (333, [0.0] * 6, 1), (336, [-0.5] * 6, 9)]
    rows += [rows[3], rows[160], (3, [0.9] * 6, 2), (339, [1e6] * 6, 1), (342, [9e5] * 6, 2), (345, [1e6] * 6, 1)]
    return single(rows)


def test_equals_brute_force(spark):
    rows = odd_rows(random.Random(13))
    assert mined(spark, rows) == brute_force(rows, lambda i: i % 3 == 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_over_many_buckets(spark, monkeypatch, seed):
    monkeypatch.setattr(H.length_buckets, "__defaults__", (8,))
    monkeypatch.setattr(H.query_blocks, "__defaults__", (4,))
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(6)]
    rows = single([(i, [x * rng.choice([0.2, 1, 1.2]) + rng.gauss(0, 0.1) for x in rng.choice(centres)], rng.randrange(3)) for i in range(300)])
    got = mined(spark, rows, every=5, positives=4, negatives=3, window=(50, 95))
    assert got == brute_force(rows, lambda i: i % 5 == 0, 4, 3, 50, 95) and got


def test_labels_with_few_rows(spark):
    rng = random.Random(5)
    rows = single([(i, [rng.gauss(0.3, 0.2) for _ in range(4)], i // 2) for i in range(200)])
    assert mined(spark, rows, every=4) == brute_force(rows, lambda i: i % 4 == 0)


def test_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(3, [0.5], 1)]) == [] and mined(spark, [(1, [0.5], 1), (2, [0.5], 2)]) == []


def test_ranges_hold_all_that_reach_the_floor():
    rng = np.random.default_rng(3)
    for _ in range(300):
        vectors = rng.integers(-50, 50, (60, 5))
        norm = H._norms(vectors)
        unit = vectors / np.where(norm > 0, norm, 1)[:, None]
        lists = np.argsort(unit, axis=0, kind="stable").T
        query, floor = rng.integers(-50, 50, 5), int(rng.integers(1, 9000))
        cosine = float(H.cosine_floor(floor, float(np.sqrt((query**2).sum())), norm.max()))
        good = set(np.flatnonzero(vectors @ query >= floor).tolist())
        if cosine > 1:
            assert not good
            continue
        found = H.candidates(query, cosine, unit, lists)
        assert found is None or good <= set(found.tolist())


def test_clusters_are_pruned(spark):
    """Of clustered vectors most (query, bucket) pairs fall away by length, and most rows of the others by coordinates."""
    rng = np.random.default_rng(8)
    unit = rng.normal(size=(20, 16))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    long = np.repeat(unit, 20, axis=0) + rng.normal(0, 0.02, (400, 16))
    vectors = np.rint(np.vstack([long, *(long / s for s in (4, 8, 16))]) * 256).astype("i8")
    norm = H._norms(vectors)
    order = np.argsort(-norm)
    vectors, norm = vectors[order], norm[order]
    pairs = kept_pairs = kept_rows = 0
    for query in vectors[:100]:
        floor = int(np.sort(vectors @ query)[-15])
        for at in range(0, len(vectors), 100):
            part, longest = vectors[at:at + 100], norm[at:at + 100].max()
            cosine = float(H.cosine_floor(floor, float(H._norms(query[None])[0]), longest))
            pairs += 1
            if cosine <= 1:
                kept_pairs += 1
                direction = part / H._norms(part)[:, None]
                found = H.candidates(query, cosine, direction, np.argsort(direction, axis=0, kind="stable").T)
                kept_rows += len(part) if found is None else len(found)
    assert kept_pairs < 0.3 * pairs and kept_rows < 0.2 * kept_pairs * 100
