"""Packing and token counts, held against the library's own encoding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from callscope.llm import packing, token_counts
from callscope.llm.tokens import MergeCounter, WordEncoder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "It's  we'll\n\n\tDON'T  ", "ééÀÉ ǅ İstanbul ΣΑΣ x²½ \u00ad\u2028z \x1c y", "<|endoftext|>a<|endoftext|> <|startoftext|>",
    "日本語 テキスト 한국어", "e\u0301 n\u0303 ﬁ", "x" * 5000, "word " * 6000, "!!!???... ###$$$", "\u00a0a\u00a0 \u3000b", "12 345,678.90 ١٢٣",
    "tab\tand\r\nline \x0b\x0c end", "naïve café ÇA Œuvre", "👍🏽 emoji 👨‍👩‍👧", "_a_b__ c-d", "  lead and trail  ",
]


def rows(texts):
    return [(i, t, "clash") for i, t in enumerate(texts)]


def expected(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def random_texts(n=400):
    rng = random.Random(5)
    alphabet = "aAbé ÀñßzZ  \n\t'srelvd.,!_-09²½İΣ’—\u00a0"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_encoder_and_counter_equal_the_library():
    encode, count = WordEncoder(WORD), MergeCounter(BYTE)
    words, pieces = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    for text in [t for t in TEXTS if t] + random_texts():
        assert np.frombuffer(encode(text), encode.dtype).tolist() == words.encode(text, add_special_tokens=False).ids, text
        assert count(text) == len(pieces.encode(text, add_special_tokens=False).ids), text


def test_pack_holds_each_id_once(spark):
    docs = spark.createDataFrame(rows(TEXTS) + [(3, "a", "clash"), (None, "no id", "clash")], "doc_id long, text string, ids string").repartition(4)
    got = packing.pack(docs, WORD, seq_len=256, with_ids=True)
    pieces = sorted(got.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    place = 0
    for r in pieces:  # gapless over all sequences
        assert (r["sequence_id"], r["offset"]) == divmod(place, 256)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        assert r["continued"] == (r["start"] > 0) and r["continues"] == (r["start"] + r["length"] < r["doc_tokens"])
        place += r["length"]
    docs_in_order, held = [], []
    for r in pieces:
        if r["start"] == 0:
            held = []
            docs_in_order.append((r["doc_id"], held))
        assert r["start"] == len(held)
        held.extend(r["ids"])
    want = [(i, expected(WORD, t) + [1]) for i, t in enumerate(TEXTS)] + [(3, expected(WORD, "a") + [1]), (None, expected(WORD, "no id") + [1])]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(docs_in_order, key=key) == sorted(want, key=key)
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(got).collect()}
    assert sorted(map(len, whole.values()))[1:] == [256] * (len(whole) - 1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, WORD).count() == 0
    assert token_counts.count_tokens(none, BYTE).count() == 0


def test_counts(spark):
    docs = spark.createDataFrame(rows(TEXTS) + [(3, "a", "clash"), (None, "no id", "clash")], "doc_id long, text string, n_tokens string")
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(docs, BYTE).collect()}
    want = set()
    for i, t in [*enumerate(TEXTS), (3, "a"), (None, "no id")]:
        n = len(expected(BYTE, t))
        want.add((i, len((t or "").encode()), n, n > 1024))
    assert got == want


@pytest.mark.parametrize("text", ["ab" * 4000, "a" * 4097, "<|endoftext|>" * 50])
def test_long_pieces_merge_as_the_library_does(text):
    assert MergeCounter(BYTE)(text) == len(expected(BYTE, text))
