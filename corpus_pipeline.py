"""The corpus pipeline: five stages of the training-data operators over `documents`.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet to the shared checkpoint folder and read again as the next
one's docs.  All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstack.llm import bpe, exact_dedup, mixing, near_dedup, queries, toxicity
from panelstack.llm.common import id_crc, table
from panelstack.session import materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold.  Rows with crc32(doc_id) mod 4 = 2 teach nothing."""
    taught = docs.select("doc_id", "text").filter(F.pmod(id_crc(F.col("doc_id")), F.lit(4)) != 2)
    model = toxicity.fit(toxicity.training_rows(taught, table(spark, sf_dir, "labels")))
    return toxicity.reject(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z) the row with the largest doc_id."""
    return exact_dedup.keep_owners(docs, "max")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.drop_near(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the quality domains meet their target token shares, or come as near as they can; every one keeps a copy."""
    _, mixed = queries.mixture(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return mixing.apply(docs, mixed)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    return bpe.encode_digests(docs, *queries.ranks_and_pattern())


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: SQL cannot express the toxicity model; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result for the table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
