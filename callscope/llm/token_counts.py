"""Token counts by heap-and-linked-list byte-pair merging (see tokens.MergeCounter)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.llm.common import in_slices, utf8
from callscope.llm.tokens import MergeCounter, loaded


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of each row's whole text.

    Row-local: no shuffle, and no ids are made or kept.  Null texts count as
    empty (0 bytes, 0 tokens); repeated rows and null ids are kept, an empty
    table gives no rows, other columns are ignored.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(MergeCounter, tokenizer)
        for batch in in_slices(batches):
            n = [counter(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    text = utf8(F.col(text_col))
    source = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    schema = T.StructType([*source.schema.fields[:2], T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return source.mapInArrow(count, schema)
