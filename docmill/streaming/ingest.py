"""Incremental ingest: new Markdown files of a folder into the index, each micro-batch an upsert."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..functions import text
from ..operators import embed, markdown
from ..sources import files
from ..sources.store import ChunkTable


def watch(spark: SparkSession, path: str, settings: Settings, checkpoint: str, tags: list[str] | None = None, once: bool = True) -> StreamingQuery:
    """Start a stream over ``path``. The checkpoint remembers files; ids are deterministic, so a batch run again changes nothing."""
    settings.validate()
    store = ChunkTable(spark, settings.index_path, settings.dimensions)
    store.create()
    stream = spark.readStream.schema("value string").option("wholetext", True).option("pathGlobFilter", "*.md").format("text").load(path)
    src = stream.select(files.source_path(), text.unix_lines(F.validate_utf8("value")).alias("text"))

    def upsert(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            chunks = markdown.chunks(batch, tags, settings.max_chars, settings.overlap)
            store.upsert(embed.embed_chunks(chunks, settings.provider, settings.provider_settings, settings.batch), int(time.time()), F.struct("source", "chunk_index"))

    writer = src.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
