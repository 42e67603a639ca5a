"""From raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns a DataFrame; each is written as Parquet in the shared folder
and read again as the next one's docs.  All but the last return the columns of
documents, whatever other columns there are; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from callscope.llm import decontaminate, packing, pii, quality, simhash
from callscope.llm.common import stage, with_package
from callscope.session import table


@with_package
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are scored like others; repeated rows stay or go
    together; without trusted positives among ``labels`` all stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@with_package
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near duplicates: that of the smallest id, nulls last.

    Repeated rows are one document; null and empty texts have fingerprint zero
    and are near duplicates of each other.
    """
    return simhash.keep_one(docs, shingle=4, max_distance=4)


@with_package
def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, edited or not; those with null or empty texts stay, empty items are not looked for."""
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


@with_package
def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the new text; null texts stay null."""
    return pii.redact(docs, length_col="n_chars")


@with_package
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; a null or empty text is its end id alone, repeated rows are documents of their own."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", no_benchmark),
    ("personal data", no_personal_data),
    ("packing", packed),
]

# the stages are learnt or made of texts and tokens; tests/llm/test_pipeline.py holds run() against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
