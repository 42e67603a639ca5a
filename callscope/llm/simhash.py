"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most ``2 h`` bits apart have a common variant within ``h``
bits of both.  So every distinct fingerprint emits all variants within ``h``
bits, variants are shuffled, and fingerprints that meet at a variant are linked.

For 64 bits and h = 2 that is 2,081 variants each, nearly all of which meet
nothing.  They are therefore shuffled in two passes.  The first sends only
hashes of the variants, cut to a few bits more than their number needs, as
sorted and packed lists: about two bytes a variant.  A task that receives a
range of hashes tells the senders which of theirs turned up again.  The second
pass makes the variants anew and shuffles just those, whole and with their
fingerprint; the pairs that meet there are verified bit by bit.

At most 2,081 distinct fingerprints can meet at a variant, so no group is
unbounded, and each variant links its fingerprints to the smallest one instead
of all to all: any two of them are within the radius by way of the variant.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import in_slices, stage, utf8
from callscope.llm.components import components

CHUNK = 2048  # fingerprints whose variants a task holds at a time
RANGE_BITS = 31  # bits of a hash within its range
SPARE_BITS = 8  # hash bits beyond the number of variants: about 1 in 256 meets by chance
SEED = 42


# ---- fingerprints ----------------------------------------------------------

def fingerprint(text: str, shingle: int) -> int:
    """Signed 64-bit SimHash of a text's word shingles, repeats included."""
    words = text.encode().lower().split()  # bytes: A-Z only, white space is \x20 and \x09-\x0D
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    k = min(shingle, len(words))
    begins = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    hashes = [xxhash.xxh64_intdigest(joined[b:e], SEED) for b, e in zip(begins, ends[k - 1:].tolist())]
    counts = np.zeros(64, "i8")
    for at in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[at:at + (1 << 14)], "<u8").view("u1").reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and fp (signed 64 bits) of every row; row-local."""

    def compute(batches):
        for batch in in_slices(batches):
            fps = [fingerprint(t, shingle) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["doc_id", "text_hash", "fp"])

    text = utf8(F.col(text_col))
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return source.mapInArrow(compute, T.StructType([*source.schema.fields[:2], T.StructField("fp", T.LongType())]))


# ---- variants and their hashes ---------------------------------------------

def flips(half: int) -> np.ndarray:
    """Every mask of at most ``half`` of 64 bits."""
    return np.array([sum(1 << b for b in bits) for k in range(half + 1) for bits in itertools.combinations(range(64), k)], "u8")


def variants(fps: np.ndarray, masks: np.ndarray) -> np.ndarray:
    return (fps[:, None] ^ masks[None, :]).ravel()


def hashed(z: np.ndarray, bits: int) -> np.ndarray:
    k = z * np.uint64(0x9E3779B97F4A7C15)
    k ^= k >> np.uint64(32)
    k *= np.uint64(0xD6E8FEB86659FD93)
    k >>= np.uint64(64 - bits)
    return k


def packed(values: np.ndarray) -> bytes:
    """Sorted 32-bit values as differences, byte by byte, compressed."""
    planes = np.diff(values, prepend=np.uint32(0)).view("u1").reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), "u1").reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype="u4")


def _as_u8(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype("i8").view("u8")


# ---- links -----------------------------------------------------------------

def links(fps: DataFrame, max_distance: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp), a != b and at most ``max_distance`` bits apart.

    Not every such pair is an edge, but any such pair is connected by edges.
    """
    spark = fps.sparkSession
    masks = flips((max_distance + 1) // 2)
    distinct = stage(fps.select("fp").distinct(), "fingerprints")
    n = distinct.count()
    chunks = max(1, math.ceil(n / CHUNK))
    # hash bits: as many as the variants need, a few spare; the first of them are the range's
    range_bits = max(0, math.ceil(math.log2(max(1, n * len(masks)))) + SPARE_BITS - RANGE_BITS)
    bits = range_bits + RANGE_BITS
    chunked = distinct.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.lit(chunks)).cast("int"))
    chunked = chunked.repartitionByRange(chunks, "chunk")

    def send(key, table):
        k = hashed(variants(_as_u8(table["fp"]), masks), bits)
        k.sort()
        bounds = np.searchsorted(k, np.arange((1 << range_bits) + 1, dtype="u8") << np.uint64(RANGE_BITS)) if range_bits else [0, len(k)]
        low = (k & np.uint64((1 << RANGE_BITS) - 1)).astype("u4")
        rows = [(r, hi - lo, packed(low[lo:hi])) for r, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])) if hi > lo]
        r, sizes, data = zip(*rows)
        return pa.table({"range": pa.array(r, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(r), pa.int32()),
                         "n": pa.array(sizes, pa.int32()), "hashes": pa.array(data, pa.binary())})

    def met(key, table):
        """Of each sender's hashes in this range, those that occur again."""
        found = []
        for chunk, n_hashes, data in zip(*(table[c].to_pylist() for c in ("chunk", "n", "hashes"))):
            found.append(unpacked(data, n_hashes).astype("u8") << np.uint64(32) | np.uint64(chunk))
        every = np.concatenate(found)
        del found
        every.sort()
        value = (every >> np.uint64(32)).astype("u4")
        same = value[1:] == value[:-1]
        again = every[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        senders = (again & np.uint64(0xFFFFFFFF)).astype("i4")
        order = np.argsort(senders, kind="stable")
        ids, starts = np.unique(senders[order], return_index=True)
        lists = np.split((again >> np.uint64(32)).astype("<u4")[order], starts[1:]) if len(ids) else []
        return pa.table({"chunk": pa.array(ids, pa.int32()), "range": pa.array([key[0].as_py()] * len(ids), pa.int32()),
                         "hashes": pa.array([x.tobytes() for x in lists], pa.binary())})

    def meet(key, chunk, again):
        """The chunk's variants whose hash occurred again, each with its smallest fingerprint, and links inside the chunk."""
        empty = pa.table({"z": pa.array([], pa.int64()), "fp": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        if not again.num_rows or not chunk.num_rows:
            return empty
        wanted = [np.frombuffer(h, "<u4").astype("u8") | np.uint64(r) << np.uint64(RANGE_BITS)
                  for r, h in zip(again["range"].to_pylist(), again["hashes"].to_pylist())]
        wanted = np.unique(np.concatenate(wanted))
        slots = np.uint64((1 << 22) - 1)
        likely = np.zeros(1 << 22, bool)
        likely[wanted & slots] = True
        fp = np.sort(_as_u8(chunk["fp"]).view("i8")).view("u8")
        z = variants(fp, masks)
        k = hashed(z, bits)
        maybe = np.flatnonzero(likely[k & slots])
        k = k[maybe]
        at = np.minimum(np.searchsorted(wanted, k), len(wanted) - 1)
        maybe = maybe[wanted[at] == k]
        z, who = z[maybe], maybe // len(masks)
        order = np.lexsort((who, z))
        z, who = z[order], who[order]
        first = np.concatenate(([True], z[1:] != z[:-1])) if len(z) else np.zeros(0, bool)
        smallest = who[np.flatnonzero(first)][np.cumsum(first) - 1] if len(z) else who
        inner = np.unique(smallest[~first] * len(fp) + who[~first])
        a, b = fp[inner // len(fp)].view("i8"), fp[inner % len(fp)].view("i8")
        none = pa.nulls(int(first.sum()), pa.int64())
        return pa.concat_tables([
            pa.table({"z": pa.array(z[first].view("i8")), "fp": pa.array(fp[who[first]].view("i8")), "other": none}),
            pa.table({"z": pa.nulls(len(a), pa.int64()), "fp": pa.array(a), "other": pa.array(b)}),
        ])

    sent = chunked.groupBy("chunk").applyInArrow(send, "range int, chunk int, n int, hashes binary")
    again = stage(sent.groupBy("range").applyInArrow(met, "chunk int, range int, hashes binary"), "met")
    pairs = chunked.groupBy("chunk").cogroup(again.repartitionByRange(chunks, "chunk").groupBy("chunk"))
    meetings = stage(pairs.applyInArrow(meet, "z long, fp long, other long"), "meetings")
    at_variant = meetings.filter("z is not null").groupBy("z").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all"))
    across = at_variant.filter(F.size("all") > 1).select("a", F.explode("all").alias("b"))
    edges = across.union(meetings.filter("z is null").select(F.col("fp").alias("a"), F.col("other").alias("b")))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    return edges.filter("a != b").distinct().filter(near)


def grouped(docs: DataFrame, shingle: int, max_distance: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, fp and root (a fingerprint that names the group) of every row; staged."""
    fps = stage(fingerprints(docs, shingle, id_col, text_col), "document-fingerprints")
    roots = stage(components(links(fps, max_distance)).withColumnRenamed("node", "fp"), "roots")
    # rows of a hot fingerprint or group are the large side of joins that Spark can split
    return stage(fps.join(roots, "fp", "left").select("doc_id", "text_hash", "fp", F.coalesce("root", "fp").alias("root")), "groups")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by links) of every row.

    Null texts and texts without words have fingerprint zero and link like any
    other; repeated rows are kept and share their component; null ids are kept
    and name no component that has another id; an empty table gives no rows;
    other columns are ignored.
    """
    groups = grouped(docs, shingle, max_distance, id_col, text_col)
    smallest = stage(groups.groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    return groups.join(smallest, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of near duplicates one row of ``docs``, all columns: that of the smallest id, nulls last, then text hash.

    Repeated rows (same id and text) are one; null texts count as empty, and
    texts without words are near duplicates of each other; an empty table gives
    no rows.
    """
    groups = grouped(docs, shingle, max_distance, id_col, text_col)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("best")
    chosen = stage(groups.groupBy("root").agg(best).select("best.doc_id", "best.text_hash"), "chosen")
    hashed = docs.withColumn("__text_hash", F.xxhash64(utf8(F.col(text_col))))
    same = hashed[id_col].eqNullSafe(chosen["doc_id"]) & (hashed["__text_hash"] == chosen["text_hash"])
    return hashed.join(chosen, same, "left_semi").dropDuplicates([id_col, "__text_hash"]).drop("__text_hash")
