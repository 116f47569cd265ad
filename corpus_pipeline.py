"""The corpus pipeline: quality filter, exact dedup, near dedup, repeated passages, packing.

Each stage gets what its predecessor kept and returns the columns of documents; the last returns packed pieces with their ids. run()
writes each stage's rows to the shared folder as Parquet and reads them again as the next one's docs.

In every stage a null text counts as empty, a text of any length is treated whole, repeated rows are rows like others, columns besides doc_id and text
may have any name, and an empty table gives an empty result. Each stage says what else it does with ties and null ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import exact_dedup, near_copies, packing, quality, suffix_array
from tidegauge.llm.common import BATCH, BATCH_SETTING, materialise, read
from tidegauge.llm.queries import quality_model, tokenizer_path

#: Rows that score less are rejected.
KEEP_FROM = 0.7
#: Bytes of a passage that the repeats stage looks for: what some 50 words take at least. op10's 400 bytes bind that query; here passages of over
#: 50 words are to go, and 51 words of four letters with their spaces are 255 bytes. A multiple of 16, as the operator needs.
PASSAGE = 240


def _lean(spark: SparkSession) -> None:
    """Small Arrow batches for what a stage returns, which its caller runs: the session's setting, as it is read then."""
    spark.conf.set(BATCH_SETTING, str(BATCH))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it is fitted on the training folds of labels, with the texts in docs.

    Equal texts score the same, so ties stay or go together, and so do rows with a null id. Without labels of both kinds the share of label 1 decides.
    """
    _lean(spark)
    model = quality_model(docs, read(spark, sf_dir, "labels"))
    score = "score"
    while score in (c.lower() for c in docs.columns):
        score += "_"
    return quality.predict(docs, model, out=score).where(F.col(score) >= KEEP_FROM).select(*(F.col(f"`{c}`") for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; rows with a null id go before others, and stay among themselves."""
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a likeness of 0.8 or more on 5-word shingles, the document with the smallest id; rows with a null id stay."""
    return near_copies.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of any string of PASSAGE bytes that starts more than once; every document stays, null ids and all."""
    _lean(spark)
    return suffix_array.drop_repeats(docs, PASSAGE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 4096-token sequences, with ids; a null id is carried along."""
    _lean(spark)
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality_filter), ("exact_dedup", exact), ("near_dedup", near), ("repeats", repeats), ("packing", pack)]

#: No SQL expresses the classifier, the fingerprint links or the packing; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
