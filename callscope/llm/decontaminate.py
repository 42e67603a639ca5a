"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Seeds are word n-grams, contiguous and spaced: the words of a place that one
   of a few patterns picks, in order.  A seed is known by its words alone, so one
   that is contiguous here meets one that is spaced there, and a copy whose words
   were replaced, left out or added now and then still shares seeds.
2. Every test item's seeds are hashed; a Bloom filter of fixed size marks the
   hashes.  Each text is scanned against it whole.  Hits that lie close together
   form a passage, cut out with a margin that an item's alignment can't exceed.
3. The hits are joined with the items' rare seeds by hash.  A seed is rare if its
   words' frequencies in all documents make it unlikely by chance.  That takes no
   note of where the seed itself occurs, and copies of an item, even thousands,
   don't make four of its words common.  Where all words are, the rarest seeds of
   each stretch of an item count as rare, so every part of it keeps some.
4. Each passage is aligned locally, word by word, with the items whose rare
   seeds it holds.  An item is leaked if the alignment reaches a share of the
   score of an exact copy, so edited and paraphrased copies are found too.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callscope.llm.common import in_slices, stage, utf8
from callscope.llm.tokens import WordTable, loaded

# The words of a seed: four in a row, and four of five.  A copy with every third or fourth word replaced keeps the second kind.
PATTERNS = ((0, 1, 2, 3), (0, 1, 3, 4), (0, 1, 2, 4), (0, 2, 3, 4))
SEED_WORDS = 4
BITS = 24  # of the filter's addresses: 2 MB
MATCH, MISMATCH, GAP = 2, -1, -1
RARE = 1e-7  # chance with which a rare seed's words stand at a place
STRETCH, KEPT = 16, 16  # places of a stretch of an item, and how many of its seeds are rare in any case
LEAK = 0.5  # share of an exact copy's score ...
LONG_ITEM = 64  # ... or of that of so many words, if the item is longer
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class WordHashes:
    """64-bit hashes of words, looked up in a bounded table."""

    def __init__(self, _: str):
        self.of = WordTable(lambda w: xxhash.xxh64_intdigest(w.encode()))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.array(list(map(loaded(WordHashes, "").of.__getitem__, words)), "u8")


def patterns_of(words: int) -> tuple[tuple[int, ...], ...]:
    """The patterns of an item's seeds; one of fewer words than a seed is one seed."""
    return PATTERNS if words >= SEED_WORDS else (tuple(range(words)),) if words else ()


def seed_hashes(h: np.ndarray, pattern: tuple[int, ...]) -> np.ndarray:
    """A signed 64-bit hash of the pattern's words at each place, from the words' hashes."""
    places = len(h) - pattern[-1]
    if places <= 0:
        return np.zeros(0, "i8")
    out = np.zeros(places, "u8")
    for k in pattern:
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + places]
        out ^= out >> np.uint64(29)
    return out.view("i8")


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a hash in the filter."""
    h = h.view("u8")
    return (h >> np.uint64(64 - BITS)).astype("i8"), (h >> np.uint64(40 - BITS) & np.uint64((1 << BITS) - 1)).astype("i8")


def _marked(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Where both of a hash's places are set."""
    def are_set(slots):
        return bits[slots >> 3] >> (7 - (slots & 7)).astype("u1") & 1 == 1

    first, second = _slots(h)
    at = np.flatnonzero(are_set(first))
    return at[are_set(second[at])]


def item_seeds(items: DataFrame) -> DataFrame:
    """item_id, words, seeds (struct of a seed's hash h, its words' hashes and the stretch of its first place); staged.  Items without words have none."""
    seed = pa.struct([("h", pa.int64()), ("words", pa.list_(pa.int64())), ("stretch", pa.int64())])

    def hash_items(batches):
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            seeds = []
            for w in words:
                h = word_hashes(w)
                grams = {}
                for pattern in patterns_of(len(w)):
                    for k, s in enumerate(seed_hashes(h, pattern).tolist()):
                        grams.setdefault(s, {"h": s, "words": h[[k + o for o in pattern]].view("i8").tolist(), "stretch": k // STRETCH})
                seeds.append(list(grams.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.list_(pa.string())), pa.array(seeds, pa.list_(seed))], names=["item_id", "words", "seeds"])

    kind = items.schema["item_id"].dataType.simpleString()
    return stage(items.mapInArrow(hash_items, f"item_id {kind}, words array<string>, seeds array<struct<h: long, words: array<long>, stretch: long>>"), "items")


def bitmap(seeds: DataFrame) -> np.ndarray:
    """Bits of all seeds: made in each task, joined in at most 16 groups, then here."""

    def mark(batches):
        bits = np.zeros(1 << BITS, bool)
        for batch in batches:
            for slots in _slots(batch.column(0).to_numpy(zero_copy_only=False)):
                bits[slots] = True
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16]), pa.array([np.packbits(bits).tobytes()])], names=["g", "bits"])

    def together(key, table):
        out = np.zeros(1 << (BITS - 3), "u1")
        for b in table["bits"].to_pylist():
            out |= np.frombuffer(b, "u1")
        return pa.table({"bits": pa.array([out.tobytes()])})

    out = np.zeros(1 << (BITS - 3), "u1")
    for r in seeds.mapInArrow(mark, "g long, bits binary").groupBy("g").applyInArrow(together, "bits binary").collect():
        out |= np.frombuffer(r["bits"], "u1")
    return out


def passages(docs: DataFrame, seed_bits: np.ndarray, word_bits: np.ndarray, patterns: list[tuple[int, ...]], margin: int) -> DataFrame:
    """pid, doc_id, text_hash, begin, words, hits: the passages of each text around hits of the seeds' filter; staged.

    Hits closer than two margins share a passage.  Rows without a pid count the
    words that the words' filter marks: hits are their hashes, counts their
    numbers in one task, and begin is the number of all words there.
    """

    def scan(batches):
        part, seq, counts, total = TaskContext.get().partitionId(), 0, {}, 0
        names = ["pid", "doc_id", "text_hash", "begin", "words", "hits", "counts"]
        for batch in in_slices(batches):
            of, rows, seen = [], [], [np.zeros(0, "u8")]
            for k, text in enumerate(batch.column(2).to_pylist()):
                words = words_of(text)
                of_words = word_hashes(words)
                total += len(words)
                seen.append(of_words[_marked(of_words, word_bits)])
                places, found = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
                for pattern in patterns:
                    h = seed_hashes(of_words, pattern)
                    places.append(_marked(h, seed_bits))
                    found.append(h[places[-1]])
                at, h = np.concatenate(places), np.concatenate(found)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                for group in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * margin) + 1):
                    begin, end = max(0, int(at[group[0]]) - margin), int(at[group[-1]]) + SEED_WORDS + 1 + margin
                    rows.append((part << 33 | seq, begin, words[begin:end], np.unique(h[group]).tolist()))
                    of.append(k)
                    seq += 1
            for w, c in zip(*np.unique(np.concatenate(seen).view("i8"), return_counts=True)):
                counts[w] = counts.get(w, 0) + int(c)
            pid, begin, held, hits = zip(*rows) if rows else ((),) * 4
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(pid, pa.int64()), batch.column(0).take(take), batch.column(1).take(take), pa.array(begin, pa.int64()),
                 pa.array(held, pa.list_(pa.string())), pa.array(hits, pa.list_(pa.int64())), pa.nulls(len(of), pa.list_(pa.int64()))], names=names)
        if total:
            lists = [pa.array([list(x)], pa.list_(pa.int64())) for x in (counts, counts.values())]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, batch.schema.types[0]), pa.nulls(1, pa.int64()), pa.array([total]), pa.nulls(1, pa.list_(pa.string())), *lists], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stage(docs.mapInArrow(scan, f"pid long, doc_id {kind}, text_hash long, begin long, words array<string>, hits array<long>, counts array<long>"), "passages")


def align(words: list[str], item: list[str]) -> tuple[int, int, int]:
    """Best local alignment of two word lists: score, and where it begins and ends in the first."""

    def run(p: np.ndarray, q: np.ndarray) -> tuple[int, int]:
        slope = -GAP * np.arange(len(p) + 1)
        above, best, end = np.zeros(len(p) + 1, "i8"), 0, 0
        for x in q:
            row = np.zeros(len(p) + 1, "i8")
            row[1:] = np.maximum(above[:-1] + np.where(p == x, MATCH, MISMATCH), above[1:] + GAP)
            row = np.maximum.accumulate(np.maximum(row, 0) + slope) - slope  # gaps in the item
            top = int(row.argmax())
            if row[top] > best:
                best, end = int(row[top]), top
            above = row
        return best, end

    code = {w: i for i, w in enumerate(dict.fromkeys(item))}
    p, q = np.array([code.get(w, -1) for w in words], "i8"), np.array([code[w] for w in item], "i8")
    score, end = run(p, q)
    _, back = run(p[:end][::-1], q[::-1])  # the same alignment from its end
    return score, end - back, end


def least_score(words: int, leak: float) -> float:
    """The alignment score from which an item of so many words is leaked: ``leak`` of an exact copy's, and that of four words, or of all, at least."""
    return max(leak * MATCH * min(words, LONG_ITEM), MATCH * min(words, SEED_WORDS))


def find_leaks(docs: DataFrame, benchmark: DataFrame, leak: float = LEAK,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, item_id, score, word_begin, word_end of the best alignment of each leaked item in each document.

    score is the share of an exact copy's alignment score (of an item of over
    64 words: of what 64 words score, 1 at most), at least ``leak``; four words
    must match, or all of a shorter item.  Word places count the words of the
    lower-cased text.  Null texts and items count as empty and leak nothing;
    repeated rows (same id and text) are one document, null ids are kept; empty
    tables give no rows; other columns are ignored.
    """
    text = utf8(F.col(text_col))
    docs = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    items = item_seeds(benchmark.select("item_id", utf8(F.col("text")).alias("text")))
    items = items.filter(F.size("seeds") > 0).withColumn("row", F.xxhash64("words"))
    lengths = [r["n"] for r in items.select(F.least(F.size("words"), F.lit(SEED_WORDS)).alias("n")).distinct().collect()]  # four at most
    patterns = sorted({p for n in lengths for p in patterns_of(n)})
    # an alignment of n words with score s holds at most 2n - s words that the item hasn't
    longest = items.agg(F.max(F.size("words"))).first()[0] or 0
    margin = math.ceil(3 * longest - least_score(longest, leak))
    seeds = items.select("row", F.explode("seeds").alias("s")).select("row", "s.h", "s.words", "s.stretch").distinct()
    vocabulary = seeds.select(F.explode("words").alias("w"))
    scanned = passages(docs, bitmap(seeds.select("h")), bitmap(vocabulary), patterns, margin)
    found = scanned.filter("pid is not null").drop("counts")

    tallies = scanned.filter("pid is null")
    total = tallies.agg(F.sum("begin")).first()[0] or 1
    counted = tallies.select(F.explode(F.arrays_zip("hits", "counts")).alias("c")).select("c.hits", "c.counts")
    counted = counted.groupBy(F.col("hits").alias("w")).agg(F.sum("counts").alias("n"))
    by_word = seeds.select("row", "h", "stretch", F.explode("words").alias("w")).join(counted, "w", "left")
    chance = F.sum(F.log2(F.coalesce("n", F.lit(1)) / F.lit(float(total)))).alias("chance")
    common = stage(by_word.groupBy("row", "h", "stretch").agg(chance), "seed-chances")
    rank = F.row_number().over(W.partitionBy("row", "stretch").orderBy("chance", "h"))  # of some 64 seeds
    rare = common.withColumn("rank", rank).filter((F.col("chance") <= math.log2(RARE)) | (F.col("rank") <= KEPT)).select("row", "h")
    rare = stage(rare, "rare-seeds")
    hits = found.select("pid", F.explode("hits").alias("h"))
    pairs = stage(hits.join(rare, "h").select("pid", "row").distinct(), "pairs")
    of_items = items.select("row", "item_id", F.col("words").alias("item"))
    aligned = pairs.join(found.drop("hits"), "pid").join(of_items, "row").select("doc_id", "text_hash", "item_id", "begin", "words", "item")

    def score(batches):
        for batch in in_slices(batches):
            keep, out = [], []
            for k, (begin, words, item) in enumerate(zip(*(batch.column(c).to_pylist() for c in (3, 4, 5)))):
                s, lo, hi = align(words, item)
                if s >= least_score(len(item), leak):
                    keep.append(k)
                    out.append((min(1.0, s / (MATCH * min(len(item), LONG_ITEM))), begin + lo, begin + hi))
            s, lo, hi = zip(*out) if out else ((),) * 3
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(3)), pa.array(s, pa.float64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())],
                                             names=["doc_id", "text_hash", "item_id", "score", "word_begin", "word_end"])

    kinds = dict(aligned.dtypes)
    scored = aligned.mapInArrow(score, f"doc_id {kinds['doc_id']}, text_hash long, item_id {kinds['item_id']}, score double, word_begin long, word_end long")
    best = F.max(F.struct("score", (-F.col("word_begin")).alias("first"), "word_end")).alias("b")
    return scored.groupBy("doc_id", "text_hash", "item_id").agg(best).select(
        "doc_id", "text_hash", "item_id", F.col("b.score").alias("score"), (-F.col("b.first")).alias("word_begin"), F.col("b.word_end").alias("word_end"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, leak: float = LEAK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that leak no item.

    Rows with null or empty texts stay, as do those with null ids; repeated rows
    stay or go together; an empty table or benchmark drops nothing.
    """
    leaking = stage(find_leaks(docs, benchmark, leak, id_col=id_col, text_col=text_col).select("doc_id", "text_hash").distinct(), "leaking")
    same = docs[id_col].eqNullSafe(leaking["doc_id"]) & (F.xxhash64(utf8(docs[text_col])) == leaking["text_hash"])
    return docs.join(leaking, same, "left_anti")
