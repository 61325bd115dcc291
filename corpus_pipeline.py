"""A corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
A doc_id names a document: rows without one pass every filter, and rows that repeat one share its decisions. In every
stage null and empty texts are texts like others (language ID rejects them), very long ones are read whole, an empty
table gives an empty table, and columns beside doc_id, text, lang and source pass through under whatever name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import bpe, exact_dedup, language, mixing, simhash
from tracefold.llm.common import table, without, written

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the text model is fitted on a bounded sample of the documents table."""
    found = language.identify_documents(docs, table(spark, sf_dir, "documents"))
    return without(docs, found.where("rejected").select("doc_id"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, and one row of rows that repeat it."""
    found = written(exact_dedup.exact_dedup(docs), "exact")
    by_id = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"), F.countDistinct("text_sha256").alias("texts"))
    left = without(docs, by_id.where("NOT kept").select("doc_id"))
    return left.dropDuplicates(["doc_id", "text"]) if not by_id.where("n > texts AND doc_id IS NOT NULL").isEmpty() else left


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the smallest id."""
    found = simhash.near_duplicates(docs)
    return without(docs, found.where("doc_id <> component_id").select("doc_id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes whole copies. Columns of docs may have any name."""
    copies = mixing.mix(docs).where("copies > 0").groupBy(F.col("doc_id").alias("id")).agg(F.max("copies").alias("copies"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("of"))
    taken = rows.join(copies, F.col("of").eqNullSafe(F.col("id"))).select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of every row."""
    return bpe.encoded(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("language ID", language_id), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing", mix), ("byte-level BPE", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
