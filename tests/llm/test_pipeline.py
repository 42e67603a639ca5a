"""The corpus pipeline: each stage's decisions, on a small table with planted cases."""

import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from callscope.llm import decontaminate, pii, quality, simhash
from callscope.llm.common import stage
from test_near_dedup import plain_fingerprint, roots
from test_texts import plain_alignment

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, work in corpus_pipeline.STAGES:
        tables.append(stage(work(spark, tables[-1], SF), "test"))
        if name != "packing":
            assert tables[-1].columns == columns
    first, good, single, clean, redacted, packed = tables
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    scores = quality.score_quality(first, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(good) == ids(scores.filter("predicted = 1"))
    groups = simhash.near_duplicates(good)
    assert ids(single) == {r["component_id"] for r in groups.collect()} and single.count() == len(ids(single))
    leaks = decontaminate.find_leaks(single, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(clean) == ids(single) - ids(leaks) and ids(leaks)
    assert ids(redacted) == ids(clean)
    assert not any(pii.pattern_spans(r["text"]) for r in redacted.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in redacted.collect())
    pieces = packed.groupBy("doc_id", "doc_tokens").sum("length").collect()
    assert len(pieces) == redacted.count() and all(r["doc_tokens"] == r["sum(length)"] for r in pieces)


def test_run_writes_what_the_stages_give(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_queries_have_sql_where_it_can_express_them():
    from callscope.llm import queries

    assert sorted(queries.ORACLE) == ["op12_warc", "op13_hard_negatives", "op6_topk", "op7_license_scan", "op9_url_filter"]
    assert sorted(q.split("_")[0] for q in queries.QUERIES) == sorted(f"op{n}" for n in range(1, 14))


# ---- run() against plain Python ----------------------------------------------

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string"
BENCH = ["Which river flows through the old town before it meets the northern sea, and who built its first bridge?",
         "Name the seven colours that a prism shows when white light falls through it at noon.", None, "", "two words"]


def planted_documents():
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(rng.randint(40, 300)) for _ in range(30)]
    near = texts[3].split()
    near[7] = "changed"
    first = BENCH[0].split()
    edited = " ".join(w if k % 4 else rng.choice(words) for k, w in enumerate(first, 1))
    texts += [texts[0], texts[0].upper(), " ".join(near), texts[1] + " " + BENCH[0], prose(60) + " " + edited + " " + prose(30), prose(20) + " " + BENCH[1].lower() + " " + prose(9)]
    texts += ["Write to jo.doe@mail.example.org or call +1 (437) 555-0689 now. " + prose(50), "Host 10.0.0.255, not 10.0.0.256! " + prose(45), "Card 4111 1111 1111 1111 " + prose(40)]
    texts += [None, "", " \n", prose(9000), "é👍 " + prose(30), "same short text", "same short text"]
    rows = [(i, t, "en", "web", None if t is None else len(t), "clash") for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "a text without an id, " + prose(30), None, None, 5, None)]


def plainly_single(rows):
    prints = [(plain_fingerprint(r[1]), r) for r in rows]
    values = sorted({f for f, _ in prints})
    root = roots(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4])
    groups = {}
    for f, r in prints:
        groups.setdefault(root[f], []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def plainly_clean(rows):
    items = [re.findall(r"\w+", (t or "").lower()) for t in BENCH]
    leaked = lambda words, item: bool(item) and plain_alignment(words, item) >= max(len(item), 2 * min(len(item), 4))
    return [r for r in rows if not any(leaked(re.findall(r"\w+", (r[1] or "").lower()), item) for item in items)]


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def plainly_redacted(text):
    if text is None:
        return None
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = [("EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
             ("IP", r"[0-9]+(?:\.[0-9]+){3}", lambda m: all(int(p) <= 255 for p in m.split("."))),
             ("CARD", r"[0-9](?:[\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("PHONE", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15)]
    spans = sorted((m.start(), -m.end(), kind) for kind, pattern, good in kinds for m in re.finditer(pattern, text) if good(m[0]))
    out, at = "", 0
    for begin, end, kind in spans:
        if begin >= at:
            out, at = out + text[at:begin] + f"[{kind}]", -end
    return out + text[at:]


def write_tables(spark, folder, rows):
    spark.createDataFrame(rows, EXTRA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(BENCH)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_run_equals_plain_python(spark, tmp_path):
    """Without trusted positives the classifier rejects nothing; the other stages decide as plain readings of them do."""
    rows = planted_documents()
    write_tables(spark, tmp_path, rows)
    kept = plainly_clean(plainly_single(rows))
    assert len(kept) < len(plainly_single(rows)) < len(rows)
    want = {str(r[0]): plainly_redacted(r[1]) for r in kept}
    assert any("[EMAIL]" in (t or "") for t in want.values()) and any("[CARD]" in (t or "") for t in want.values())
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    ids = {d: encode(t or "", add_special_tokens=False).ids + [1] for d, t in want.items()}
    pieces, filled = {}, {}
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(str(p["doc_id"]), []).append(p)
        filled.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert set(pieces) == set(ids)
    for d, of in pieces.items():
        at = 0
        for p in sorted(of, key=lambda p: p["start"]):
            cut = ids[d][at:at + p["length"]]
            assert (p["start"], p["doc_tokens"]) == (at, len(ids[d]))
            assert p["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(cut)}I", *cut))
            at += p["length"]
        assert at == len(ids[d])
    for n, of in filled.items():
        ends = [0, *(o + length for o, length in sorted(of))]
        assert [o for o, _ in sorted(of)] == ends[:-1] and (ends[-1] == 2048 or n == max(filled))


def test_stages_on_empty_tables(spark, tmp_path):
    write_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def plain_loss(scores):
    return sum(math.log1p(math.exp(-abs(v))) + max(v, 0.0) for v in scores)


def test_risk_by_its_definition(spark):
    """The non-negative risk, row by row: the fit takes it far below where it began."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    table = quality.feature_table(docs, labels)
    model = quality.fit(table)
    rows = table.filter("part is not null").select("part", "f").collect()
    x = np.array([[*np.frombuffer(r["f"], "<f2").astype("f8"), 1.0] for r in rows])
    x = np.clip((x - model.mean) / model.spread, -5, 5)
    positive = np.array([r["part"] == quality.POSITIVE for r in rows])
    pull = quality.PULL + quality.PULL_ROWS / positive.sum()

    def parts(w):
        scores = x @ w
        return (model.prior * plain_loss(-scores[positive]) / positive.sum(),
                plain_loss(scores[~positive]) / (~positive).sum() - model.prior * plain_loss(scores[positive]) / positive.sum())

    def risk(w):
        good, bad = parts(w)
        return good + max(0.0, bad) + pull / 2 * w @ w

    assert abs(risk(0 * model.weights) - math.log(2)) < 1e-9
    assert risk(model.weights) < 0.5 * math.log(2)
    assert 0.01 <= model.prior <= 0.99


def test_gradient_and_curvature_by_differences():
    rng = np.random.default_rng(4)
    x, w, part = rng.normal(size=(60, 5)), rng.normal(size=5), np.array([quality.POSITIVE, quality.UNLABELLED] * 30)
    for use in (quality.POSITIVE, quality.UNLABELLED):
        grad, curve = quality._curved(part, x, w, use)
        for k in range(5):
            step = 1e-5 * np.eye(5)[k]
            assert abs((plain_loss(x[part == use] @ (w + step)) - plain_loss(x[part == use] @ (w - step))) / 2e-5 - grad[k]) < 1e-5
            slope = lambda v: quality._curved(part, x, v, use)[0]
            assert np.allclose((slope(w + step) - slope(w - step)) / 2e-5, curve[k], atol=1e-5)
