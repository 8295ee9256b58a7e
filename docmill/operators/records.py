"""The 23-field document record that HTML and AsciiDoc sections end in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, split, text


@dataclass(frozen=True)
class RecordSettings:
    """Constants of every record, and the sizes that texts are split to."""

    most: int = 1500
    overlap: int = 100
    usecase_id: str = "docs"
    agent_filter: str = "docs"
    data_classification: str = "Public"


def records(sections: DataFrame, prefix: Column, settings: RecordSettings, last_modified: Column, page_url: Column) -> DataFrame:
    """Records of ``sections``: ``document_id, section_pos, file_name, source_dir, relative_path, page_name, heading, breadcrumbs, anchor, body``.

    Bodies are packed to sub-chunks, numbered through each document; a document's
    rows meet in one shuffle by its id.
    """
    s = settings
    src = sections.withColumns({"__prefix": prefix, "__modified": F.coalesce(last_modified, F.lit("")), "__url": page_url})
    parts = src.select("*", F.posexplode(split.pack_paragraphs(F.col("body"), s.most, s.overlap)).alias("__k", "__sub"))
    index = (F.row_number().over(Window.partitionBy("document_id").orderBy("section_pos", "__k")) - 1).cast("int")
    parts = parts.withColumns({"chunk_index": index, "text": F.concat("__prefix", F.lit("\n\n"), "__sub")})
    parts = parts.withColumn("chunk_id", ids.stable_uuid(F.col("document_id"), F.col("chunk_index"), ids.content_hash(F.col("text"))))
    return parts.select(
        F.col("chunk_id").alias("id"), F.col("file_name").alias("source_file"), "source_dir", "relative_path", "document_id", "chunk_id", "chunk_index",
        F.lit("chars").alias("unit"), F.lit(s.most).alias("chunk_size_setting"), F.lit(s.overlap).alias("overlap_setting"), F.lit(s.usecase_id).alias("usecase_id"), "file_name",
        F.lit(s.data_classification).alias("data_classification"), F.col("__modified").alias("sor_last_modified"), ids.deep_link(F.col("__url"), F.col("anchor")).alias("page_url"), "page_name",
        F.lit(s.agent_filter).alias("agent_filter"), F.length("text").alias("char_count"), text.word_count(F.col("text")).alias("word_count"),
        F.col("heading").alias("section_heading"), F.col("breadcrumbs").alias("section_breadcrumbs"), F.col("anchor").alias("section_anchor"), "text",
    )
