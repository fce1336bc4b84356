"""From raw documents to token ids, stage by stage; each works on all that the one before kept.

Quality classifier -> near duplicates -> benchmark decontamination -> personal data -> tokens. All but the last return the
columns of their input, whatever further ones there are and however they are named. Null texts count as empty for every
decision and are never altered; very long texts are taken whole; repeated rows count once, and different texts under one id are
kept or dropped together; empty tables give empty results. ORACLE_SQL is None, as no SQL states the classifier; tests compare
the stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, jaccard_join, pii, quality, sentencepiece_bpe
from tracelake.llm.common import stored, table
from tracelake.llm.queries import held_out, piece_model


def _private(docs: DataFrame) -> DataFrame:
    """All columns but doc_id and text under names of their own, so that none is taken for a result of an operator."""
    return docs.select(*[F.col(f"`{n}`").alias(n if n in ("doc_id", "text") else f"_own{k}") for k, n in enumerate(docs.columns)])


def _named(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under their names again."""
    return found.select(*[F.col(n if n in ("doc_id", "text") else f"_own{k}").alias(n) for k, n in enumerate(docs.columns)])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows outside the held-out fold, does not reject."""
    own = _private(docs)
    judged = quality.judge(own, table(spark, sf_dir, "labels"), ~held_out(3), own.columns)
    return _named(judged.where("predicted = 1"), docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: that with the smallest id. Rows without an id stay, and so do all different
    texts under one id."""
    return _named(jaccard_join.first_of_each_group(_private(docs)), docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return _named(decontaminate.remove_contaminated(_private(docs), table(spark, sf_dir, "benchmark")), docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, identifiers replaced by their kind; n_chars, where there is such a column, follows the text."""
    clean = _named(pii.redact(_private(docs)), docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with ids, n_tokens, and whether decoding the ids gives the text back; these replace columns of such names."""
    results = ("n_tokens", "ids", "round_trip")
    docs = docs.drop(*results)
    own = _private(docs)
    coded = sentencepiece_bpe.round_trip(own, piece_model(), own.columns)
    back = F.col("decoded") == F.coalesce("text", F.lit(""))
    kept = [F.col(n if n in ("doc_id", "text") else f"_own{k}").alias(n) for k, n in enumerate(docs.columns)]
    return coded.select(*kept, F.size("ids").cast("long").alias("n_tokens"), "ids", back.alias("round_trip"))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("tokens", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
