"""SimHash near-dedup and connected components against brute force."""

import random
import re

import xxhash

from callscope.llm import simhash
from callscope.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)] + ["É", "ÀB", "\u00a0x", "\x1cy"]
    base = [[rng.choice(words) for _ in range(rng.randint(60, 250))] for _ in range(25)]
    out = [None, "", " \t\n", "one", "Two words", "two WORDS", " ".join(["rep"] * 3000)]
    for b in base:
        out.append(" ".join(b))
        for _ in range(4):
            c = list(b)
            for _ in range(rng.randint(0, 2)):
                c[rng.randrange(len(c))] = rng.choice(words)
            out.append("\n".join(c).upper() if rng.random() < 0.2 else " ".join(c))
    return out + ["same text here today"] * 40


def test_components_equal_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())] + [(5, "another row of id five", "clash"), (None, "no id", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = simhash.near_duplicates(docs).collect()
    prints = [(r[0], plain_fingerprint(r[1])) for r in rows]
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == sorted((str(i), f"{f:016x}") for i, f in prints)
    fps = sorted({f for _, f in prints})
    links = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4]
    assert links
    root = roots(fps, links)
    smallest = {}
    for i, f in prints:
        if i is not None:
            smallest[root[f]] = min(smallest.get(root[f], i), i)
    want = sorted((str(i), str(smallest.get(root[f]))) for i, f in prints)
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({root[f] for _, f in prints})


def test_links_over_several_chunks_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 40)
    monkeypatch.setattr(simhash, "RANGE_BITS", 24)
    rng = random.Random(9)
    fps = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(8):
            fps.add(x)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 4 for r in got)
    linked = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    assert roots(signed, [(r["a"], r["b"]) for r in got]) == roots(signed, linked)


def test_packed_lists_round_trip():
    import numpy as np

    for n in (1, 2, 1000):
        values = np.sort(np.random.default_rng(n).integers(0, 2**31, n).astype("u4"))
        assert (simhash.unpacked(simhash.packed(values), n) == values).all()


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (300, 299), (300, 299)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == roots(nodes, [(a, b) for a, b in edges if a != b])


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).count() == 0
