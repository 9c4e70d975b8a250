"""A corpus pipeline: quality rules, one document of each near-duplicate group, decontamination, redaction, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyloom.llm import decontaminate, jaccard_join, mixing, pii, quality_rules
from studyloom.llm.common import may_hold, settle, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null and empty texts are rejected, repeated rows stay or go together, an empty table stays empty."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (0.8 of five-word shingles) the one with the smallest doc_id stays; rows without an id stay.

    Of rows of one doc_id the one with the least text stays, then that whose other columns are least as JSON; a null text comes last.
    """
    found = jaccard_join.components(docs, size=5, percent=80).where("doc_id IS NOT NULL").groupBy("doc_id")
    odd = settle(found.agg(F.bool_or(F.col("component_id") != F.col("doc_id")).alias("lost"), F.count("*").alias("rows")).where("lost OR rows > 1"))
    # the other rows stay where they are read
    here = F.col("doc_id").isNotNull() & may_hold(odd.select("doc_id"))(F.col("doc_id"))
    kept = docs.where(here).join(odd.where("lost").select("doc_id"), "doc_id", "left_anti")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    # as JSON, as a map has no order of its own
    order = F.struct(F.col("text").isNull(), "text", F.to_json(F.struct(*rest)) if rest else F.lit(""))
    first = kept.groupBy("doc_id").agg(F.min_by(F.struct("text", *rest), order).alias("__row"))
    return first.select("doc_id", "__row.*").select(*docs.columns).unionByName(docs.where(~here))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go. Null and empty texts leak nothing; null and empty items are in no text; of repeated rows all stay or go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind, and n_chars follows. Null and empty texts and all other columns stay."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken, pieces. Null texts have size 0; a null source is one source."""
    return mixing.mix(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("mixture", mixture)]
#: No SQL: covariance estimates, tiling and boosted trees can't be put in it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each on what the one before has written; columns that documents has besides its own ride along."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k == len(STAGES) - 1 else settle(out)
    return docs
