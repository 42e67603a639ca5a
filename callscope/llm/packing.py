"""Packing: concatenate and cut.

All documents' ids, each followed by an end id, form one long sequence that is
cut every ``seq_len`` ids, so only the last sequence is shorter.  A first pass
tokenizes each document once, writes its ids with its start inside its
partition, and adds up partition totals; their running sums turn starts into
global offsets.  A second pass is row-local: it cuts each document at the
windows and writes a record for each piece (boundary records where a document
goes on in the next window).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import in_slices, prefix_sums, stage, utf8
from callscope.llm.tokens import WordEncoder, loaded


def token_table(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass one: part, start (in the part), doc_id, n, ids (packed) of every document, staged."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = loaded(WordEncoder, tokenizer)
        width, end = np.dtype(encode.dtype).itemsize, np.array([end_id], encode.dtype).tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for batch in in_slices(batches):
            ids = [encode(t) + end for t in batch.column(1).to_pylist()]
            n = np.array([len(x) // width for x in ids], "i8")
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), pa.array(starts), batch.column(0), pa.array(n), pa.array(ids, pa.binary())],
                names=["part", "start", "doc_id", "n", "ids"],
            )

    source = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), source.schema["doc_id"],
        T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    return stage(source.mapInArrow(tokenize, schema), "packing-ids")


def pack(docs: DataFrame, tokenizer: str, seq_len: int = 2048, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of a document.

    Columns: doc_id, start (ids of the document before it), length, ids_crc32
    (of its ids as little-endian unsigned 32-bit integers), doc_tokens (with the
    end id), sequence_id, offset (in the sequence), continued and continues
    (the document's ids reach over the sequence's begin or end); ``with_ids``
    adds the ids themselves as array<int>.

    Null texts count as empty: such a document is its end id alone.  Null ids
    and repeated rows are kept; each row is a document of its own.  Other
    columns are ignored, an empty table gives no rows.
    """
    width = {"u2": 2, "u4": 4}
    wide = loaded(WordEncoder, tokenizer).dtype
    staged = token_table(docs, tokenizer, end_id, id_col, text_col)
    placed = prefix_sums(staged, "part", "n", "base").select(
        "doc_id", (F.col("base") + F.col("start")).alias("place"), "n", "ids")
    fields = [staged.schema["doc_id"]]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    fields += [T.StructField(c, T.BooleanType()) for c in ("continued", "continues")]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    step = width[wide[1:]]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows, of, ids_out = [], [], []
            for k, (place, n, ids) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                at = 0
                while at < n:
                    sequence, offset = divmod(place + at, seq_len)
                    length = min(n - at, seq_len - offset)
                    piece = np.frombuffer(ids, wide, length, at * step).astype("<u4")
                    rows.append((at, length, zlib.crc32(piece), n, sequence, offset, at > 0, at + length < n))
                    of.append(k)
                    if with_ids:
                        ids_out.append(piece.astype("i4"))
                    at += length
            columns = list(zip(*rows)) or [()] * 8
            arrays = [batch.column(0).take(pa.array(of, pa.int64()))]
            arrays += [pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(c, pa.bool_()) for c in columns[6:]]
            if with_ids:
                arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return placed.mapInArrow(cut, T.StructType(fields))


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids; at most ``seq_len`` ids each.

    Takes ``pack(..., with_ids=True)``; pieces lie gapless, so order by offset.
    Nulls and repeated rows are pieces like others there; no pieces, no rows.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
