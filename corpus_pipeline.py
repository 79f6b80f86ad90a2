"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents that the one
before kept, and returns a DataFrame that is written and read again. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.llm.common import cut, drop, release, table, written
from tagweave.llm.decontam import contamination
from tagweave.llm.packing import pack_documents
from tagweave.llm.quality import THRESHOLD, fit_quality, score_quality
from tagweave.llm.queries import tokenizer_path
from tagweave.llm.simhash import one_of_each_group
from tagweave.llm.suffix_dedup import repeated_passages

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 0 go; rows without a doc_id are judged like any other."""
    docs = docs.select(*COLUMNS)
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.where(F.col("quality_score") >= THRESHOLD).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; different texts with one id stay both."""
    return one_of_each_group(docs.select(*COLUMNS))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has too are cut out; documents of which nothing is left go."""
    cut_out = repeated_passages(docs, carry=("lang", "source"))
    return cut_out.where("n_removed < n_bytes or n_bytes = 0").select(
        "doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars")
    )


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Texts decide, so they are told apart by a digest, not by id."""
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    docs = docs.select(*COLUMNS).withColumn("digest", digest)
    hit = contamination(docs, table(spark, sf_dir, "benchmark"), id_col="digest").where("contaminated")
    return docs.join(hit.select(F.col("doc_id").alias("digest")).distinct(), "digest", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", simhash_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: SQL can't express the classifier, the hashes, the byte runs or the tokenizer; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, made_from = written(), docs
        docs = cut(stage(spark, docs, sf_dir), f"stage{k}")
        release(before, keep=docs)  # what the stage wrote on its way, and what it read
        drop(made_from)
    return docs
