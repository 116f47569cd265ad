"""The subpackage's queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import lang_id, quality, toxicity
from tidegauge.llm.common import held_out, ranked, read
from tidegauge.llm.exact_dedup import exact_dedup
from tidegauge.llm.packing import pack
from tidegauge.llm.simhash import simhash_components
from tidegauge.llm.subword_sample import sample_segmentations
from tidegauge.llm.suffix_array import repeat_report
from tidegauge.llm.warc import warc_round_trip
from tidegauge.llm.winnow import edited_report


def tokenizer_path(name: str) -> str:
    """The public vocabulary file of that name, where it is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = lang_id.fit(docs, ~held_out(F.col("doc_id")))
    return lang_id.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Fitted on the labelled documents of the training folds."""
    known = labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return quality.fit(ranked(docs.select(F.col("doc_id").alias("id"), "text")).join(known, "id"))


def _verdicts(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return _verdicts(quality.predict(docs.select("doc_id", "text"), quality_model(docs, read(spark, sf_dir, "labels"))), 0.7)


def op3_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    known = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic")
    train = ranked(docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text")).join(known, "id", "left")
    model = toxicity.fit(train.withColumns({"positive": F.coalesce(F.col("toxic") == 1, F.lit(False)), "known": F.col("toxic").isNotNull()}))
    return _verdicts(toxicity.predict(docs, model), 0.3)


def op4_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False)


def op5_subword_sample(spark, sf_dir):
    return sample_segmentations(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_simhash_near_dedup(spark, sf_dir):
    return simhash_components(read(spark, sf_dir, "documents"))


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup(read(spark, sf_dir, "documents"))


def op8_winnowing(spark, sf_dir):
    return edited_report(read(spark, sf_dir, "documents"))


def op9_warc(spark, sf_dir):
    return warc_round_trip(read(spark, sf_dir, "pages"))


def op10_suffix_array_dedup(spark, sf_dir):
    return repeat_report(read(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir).drop("ids")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_quality, op3_toxicity, op4_packing, op5_subword_sample, op6_simhash_near_dedup, op7_exact_dedup, op8_winnowing, op9_warc, op10_suffix_array_dedup, pipeline)}

ORACLE_SQL = {
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op9_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS low FROM p)
        SELECT page_id, payload_bytes, payload_digest,
          CASE WHEN payload_bytes >= 100 AND page_id <> low THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN payload_bytes >= 100 AND page_id <> low THEN low END AS refers_to
        FROM f""",
}
