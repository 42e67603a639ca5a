"""Top-k search and URL filters against plain readings."""

import math
import random

from pyspark.sql import functions as F

from callscope.llm import knn, queries, url_filter


def brute_force(rows, is_query, k):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors.setdefault(i, set()).add(tuple(math.floor(64 * x) for x in v))
    out = set()
    for q, asked in vectors.items():
        if is_query(q):
            for mine in asked:
                best = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, vs in vectors.items() if i != q for v in vs if len(v) == len(mine))
                out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best[:k])}
    return out


def test_top_k_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], "clash") for i in range(300)]
    rows += [(i, [0.25] * 8, "clash") for i in range(300, 420)]  # one vector many times: ties go to small ids
    rows += [(500, None, "x"), (505, [0.1] * 7 + [None], "x"), (510, [float("nan")] * 8, "x"), (515, [float("inf")] * 8, "x"), (None, [0.1] * 8, "x")]
    rows += [(520, [0.5] * 3, "x"), (525, [0.25, -1.0, 2.0], "x"), (530, [], "x"), (535, [], "x"), (540, [1e6] * 8, "x"), rows[5], rows[305]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, query string")
    got = knn.top_k(df, F.col("vec_id") % 5 == 0, k=6)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    exact = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    assert {tuple(r) for r in got.collect()} == brute_force(exact, lambda i: i % 5 == 0, 6)


def test_top_k_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "DATA_BLOCK", 16)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 8)
    monkeypatch.setattr(knn, "LEAST_PIVOTS", 4)
    monkeypatch.setattr(knn, "WITNESSES", 12)
    rng = random.Random(4)
    rows = [(i, [rng.choice([-2.0, 2.0]) + rng.gauss(0, 0.05) for _ in range(4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in knn.top_k(df, F.col("vec_id") % 3 == 0, k=5).collect()} == brute_force(rows, lambda i: i % 3 == 0, 5)


def test_clusters_are_pruned(spark, monkeypatch):
    """Of clustered vectors few (query, block) pairs survive, and the rows stay exact."""
    monkeypatch.setattr(knn, "DATA_BLOCK", 32)
    monkeypatch.setattr(knn, "LEAST_PIVOTS", 64)
    monkeypatch.setattr(knn, "WITNESSES", 64)
    rng = random.Random(6)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(24)]
    rows = [(i, [x + rng.gauss(0, 0.02) for x in centres[i % 24]]) for i in range(2000)]
    blocks, pairs = [], []
    rings, query_blocks = knn._rings, knn._query_blocks
    monkeypatch.setattr(knn, "_rings", lambda placed: blocks.append(rings(placed)) or blocks[0])
    monkeypatch.setattr(knn, "_query_blocks", lambda needed: pairs.append(needed) or query_blocks(needed))
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, k=10)
    assert {tuple(r) for r in got.collect()} == brute_force(rows, lambda i: i % 10 == 0, 10)
    survive, every = sum(p.count() for p in pairs), 200 * blocks[0].count()
    print(survive, every)
    assert survive < 0.2 * every


def test_top_k_broadcasts_nothing(spark, monkeypatch):
    """However small Spark takes a side for, no join sends it to the driver: it can't tell how often a query is replicated."""
    plans, stage = [], knn.stage
    monkeypatch.setattr(knn, "stage", lambda df, name: plans.append((name, df._jdf.queryExecution().toString())) or stage(df, name))
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(4)]) for i in range(200)]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 4 == 0, k=5)
    plans.append(("result", got._jdf.queryExecution().toString()))
    assert {tuple(r) for r in got.collect()} == brute_force(rows, lambda i: i % 4 == 0, 5)
    assert [name for name, plan in plans if "Broadcast" in plan] == []
    assert {name for name, plan in plans if "SortMergeJoin" in plan} == {"first-found", "found", "answers", "result"}


def test_queries_are_replicated_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(knn, "DATA_BLOCK", 8)
    monkeypatch.setattr(knn, "REPLICAS", 7)
    rng = random.Random(10)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(4)]) for i in range(160)] + [(i, [0.25] * 4) for i in range(160, 200)]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 4 == 0, k=5)
    assert {tuple(r) for r in got.collect()} == brute_force(rows, lambda i: i % 4 == 0, 5)


def test_witnesses_are_the_smallest_hashes(spark):
    rng = random.Random(9)
    data = spark.createDataFrame([([rng.randrange(-10 ** 6, 10 ** 6) for _ in range(4)], [i]) for i in range(500)], "v array<long>, ids array<long>")
    want = data.orderBy(F.xxhash64("v"), "v").collect()
    assert knn._smallest_hashes(data, 500, 20) == want[:20]
    assert knn._smallest_hashes(data, 10 ** 9, 20) == want[:20]  # none has a hash as small as that
    assert knn._smallest_hashes(data, 500, 600) == want


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert knn.top_k(df, F.col("vec_id") % 5 == 0).count() == 0


URLS = [
    (0, None), (1, ""), (2, "no scheme/en/"), (3, "http://www.Example.COM/en/a?x#y"), (4, "http://example.com/en/"), (5, "https://a.b.example.com/en/1"),
    (6, "http://x.net/es/1"), (7, "http://net/fr/"), (8, "http://x.net/en/"), (9, "http://example.com"), (10, "http://example.com?a=/en/"),
    (11, "http://notexample.com/en/"), (12, "http://example.org/en/"), (13, "://com/"), (14, "http://example.com:80/en/"), (15, "a://b://c.net/es/"),
    (16, "http://" + "a." * 3000 + "example.com/en/" + "x/" * 3000), (17, "http://example.com/EN/"), (None, "http://x.com/"), (3, "http://x.com/"), (3, "http://x.com/"),
    (18, "http://com."), (19, "http://.net/es/"), (20, "http://ÉX.com/é"),
]


def plain_verdict(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = rest[:min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))]
    path = rest[len(host):]
    path = path[:min((path.find(c) for c in "?#" if c in path), default=len(path))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")


def test_url_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in URLS], "page_id long, url string, rule string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = sorted(map(str, (tuple(r) for r in url_filter.judge_urls(pages, rules).collect())))
    assert got == sorted(str((i, *plain_verdict(u))) for i, u in URLS)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_block_wins_over_an_equal_rule_and_hosts_are_needed(spark):
    rules = spark.createDataFrame([("a.com", "/", "allow"), ("A.com", "/", "block"), (None, "/", "block"), ("", "/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/"), (2, "http://b.com/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, rules).collect()} == {1: "block", 2: "allow"}


def test_url_plan_has_no_python(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    plan = url_filter.judge_urls(spark.createDataFrame(URLS, "page_id long, url string"), rules)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
