"""Corpus cleaning in five stages: quality rules, line dedup, near dedup, decontamination, encoding.

Each stage takes what its predecessor kept, written as Parquet and read again; all
but the last return the columns of ``documents``. The last returns the ids of each
text and whether they decode to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import decontaminate, lines, quality, sentencepiece, simhash
from docmill.llm.common import forget, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MODEL = "piece_bpe_32k.model"


def as_documents(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with ``n_chars`` of the text as it now is."""
    return docs.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without lines that too many documents of their host have. Null and empty texts go. Columns that documents don't have are left out."""
    return as_documents(quality.apply(docs.select(*COLUMNS)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are on many sites. Null texts stay null; null sites are one site. Columns that documents don't have are left out."""
    return as_documents(lines.dedup_lines(docs.select(*COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies; of repeated rows one. Texts without a word are copies of each other. Columns that documents don't have are left out."""
    return as_documents(simhash.keep_one(docs.select(*COLUMNS)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; one of which over half is such passages goes. Null texts stay. Columns that documents don't have are left out."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return as_documents(decontaminate.clean(docs.select(*COLUMNS), benchmark))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, and whether they decode to it. Null texts count as empty. Columns that documents don't have are left out."""
    import public_tokenizers

    sha = F.sha1(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    got = sentencepiece.encode(docs, public_tokenizers.path(MODEL), {"doc_id": "doc_id", "lang": "lang", "source": "source", "text_sha1": sha})
    return got.select("doc_id", "lang", "source", "n_tokens", "ids", (F.sha1(F.col("decoded").cast("binary")) == F.col("text_sha1")).alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", encoding),
]

#: The last stage's ids have no SQL; tests hold the pipeline, and the operators of its stages, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result a table in the shared folder, deleted when the next one has read it."""
    shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        was, docs = docs, table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        forget(was)
    return docs
