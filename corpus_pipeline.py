"""From raw documents to training tokens, stage by stage.

Each stage takes what the one before it kept. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofline.llm.common import PIECE_MODEL, remainder_of_id, small_batches, stored, table
from proofline.llm.decontaminate import drop_contaminated
from proofline.llm.exact_dedup import drop_repeats
from proofline.llm.language import drop_undetermined, learn_filters
from proofline.llm.near_dedup import drop_near_copies
from proofline.llm.pieces import PieceModel, encode


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter go."""
    small_batches(spark)
    return drop_undetermined(docs, learn_filters(docs.where(remainder_of_id("doc_id", 3) != 1)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts that with the largest id."""
    return drop_repeats(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates that with the smallest id."""
    small_batches(spark)
    return drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    small_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces, n_pieces, and whether the pieces give the text again."""
    small_batches(spark)
    model = PieceModel(PIECE_MODEL)
    both = encode(docs.select("doc_id", "text"), model, decoded="decoded")
    return both.select(
        "doc_id",
        "pieces",
        F.coalesce(F.size("pieces"), F.lit(0)).cast("bigint").alias("n_pieces"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("same_text"),
    )


STAGES = [
    ("language", identify_language),
    ("exact copies", drop_exact_copies),
    ("near copies", drop_near),
    ("benchmark", decontaminate),
    ("pieces", to_pieces),
]

# Language, near copies and pieces are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the documents that all stages keep; each stage is stored."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, "stage")
    return docs
