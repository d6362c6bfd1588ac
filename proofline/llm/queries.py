"""The operators as registered queries, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from proofline.llm import oracles
from proofline.llm.centroids import clusters
from proofline.llm.common import PIECE_MODEL, remainder_of_id, small_batches, table
from proofline.llm.decontaminate import contamination
from proofline.llm.exact_dedup import mark_repeats
from proofline.llm.html_extract import extract_text, learn_extractor
from proofline.llm.language import learn_filters, predict_language
from proofline.llm.lexical import ranked_search
from proofline.llm.near_dedup import mark_near_copies
from proofline.llm.pieces import PieceModel, encode
from proofline.llm.quality import fit_rules, score_quality
from proofline.llm.sharding import shard_plan
from proofline.llm.toxicity import fit_toxicity, score_toxicity
from proofline.llm.url_filter import Rule, url_verdicts
from proofline.llm.warc import archive_and_read

SHARDS = 40
URL_RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("items")


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").where(remainder_of_id("doc_id", 5) != 0)
    scored = score_quality(docs, fit_rules(docs, labels))
    return scored.select("doc_id", (remainder_of_id("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_rendezvous_shards(spark: SparkSession, sf: str) -> DataFrame:
    return shard_plan(table(spark, sf, "documents"), SHARDS)


def op4_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    small_batches(spark)
    model = PieceModel(PIECE_MODEL)
    both = encode(table(spark, sf, "documents").select("doc_id", "text"), model, decoded="decoded")
    return both.select(
        "doc_id",
        F.size("pieces").cast("bigint").alias("n_pieces"),
        F.xxhash64("pieces").alias("pieces_hash"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("same_text"),
    )


def op5_warc(spark: SparkSession, sf: str) -> DataFrame:
    return archive_and_read(table(spark, sf, "pages"))


def op6_main_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return extract_text(pages.select("page_id", "url", "html"), learn_extractor(pages))


def op7_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    filters = learn_filters(docs.where(remainder_of_id("doc_id", 3) != 1))
    # Text is read, but not written on.
    said = predict_language(docs.select("doc_id", "text"), filters)
    return said.select("doc_id", (remainder_of_id("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return mark_near_copies(table(spark, sf, "documents"))


def op9_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return mark_repeats(table(spark, sf, "documents"))


def op10_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_verdicts(table(spark, sf, "pages"), URL_RULES)


def op11_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    small_batches(spark)
    return ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return clusters(table(spark, sf, "embeddings"))


def op13_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    net = fit_toxicity(docs, table(spark, sf, "labels").where(remainder_of_id("doc_id", 3) != 1))
    scored = score_toxicity(docs, net)
    return scored.select("doc_id", (remainder_of_id("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_rules": op2_quality_rules,
    "op3_rendezvous_shards": op3_rendezvous_shards,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_warc": op5_warc,
    "op6_main_text": op6_main_text,
    "op7_language": op7_language,
    "op8_near_dedup": op8_near_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_lexical_search": op11_lexical_search,
    "op12_centroids": op12_centroids,
    "op13_toxicity": op13_toxicity,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op1_decontamination": oracles.OP1,
    "op3_rendezvous_shards": oracles.OP3,
    "op5_warc": oracles.OP5,
    "op9_exact_dedup": oracles.OP9,
    "op10_url_filter": oracles.OP10,
    "op11_lexical_search": oracles.OP11,
    "op12_centroids": oracles.OP12,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
