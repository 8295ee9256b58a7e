"""Whole jobs: ingest Markdown, make records of HTML pages or an AsciiDoc tree, search."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import ids, text
from ..operators import adoc, embed, html, markdown, records, search
from ..operators.records import RecordSettings
from ..sources import files
from ..sources.ordered import path_order, write_ordered
from ..sources.stage import forget, staged
from ..sources.store import ChunkTable


def ingest(spark: SparkSession, path: str, settings: Settings, tags: list[str] | None = None, pattern: str = "**/*.md", jsonl: str | None = None, index: bool = True) -> DataFrame:
    """Markdown at ``path`` to chunks with vectors, written as JSON lines and to the index as asked; gives the stored chunks.

    Chunks are written once, and both sinks read that table: nothing is embedded twice.
    """
    settings.validate()
    chunks = markdown.chunks(files.markdown(spark, path, pattern), tags, settings.max_chars, settings.overlap)
    done = embed.embed_chunks(chunks, settings.provider, settings.provider_settings, settings.batch)
    done = staged(done, "chunks")
    if done.isEmpty():
        return done
    if jsonl:
        export_jsonl(done, jsonl, [path_order(), F.col("chunk_index")], [c for c in done.columns if c != "chunk_index"])
    if index:
        ChunkTable(spark, settings.index_path, settings.dimensions).upsert(done, int(time.time()), F.struct("source", "chunk_index"))
    return done


def export_jsonl(chunks: DataFrame, path: str, by: list | None = None, keep: list[str] | None = None) -> None:
    """JSON lines in place of what is there; nulls are written. By the columns ``by`` files are in order, and sorted in themselves."""
    if by:
        write_ordered(chunks, path, by, keep=keep, ignoreNullFields="false")
    else:
        chunks.select(*(keep or chunks.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def html_records(pages: DataFrame, version: str, settings: RecordSettings = RecordSettings()) -> DataFrame:
    """Records of fetched pages ``(url, last_modified, html)``: sections, then packed sub-chunks."""
    found = html.sections(pages, ["url", "last_modified"])
    path = ids.url_path(F.col("url"))
    src = found.withColumns({
        "document_id": ids.stable_uuid(F.lit(version), F.col("url")), "file_name": ids.last_part(path), "source_dir": ids.all_but_last(path),
        "relative_path": ids.without_leading_slashes(path), "page_name": F.col("page_title"),
    })
    prefix = text.html_prefix(F.col("page_title"), F.col("breadcrumbs"), F.col("heading"))
    modified = F.coalesce(F.nullif(F.col("last_modified"), F.lit("")), F.nullif(F.col("meta_modified"), F.lit("")))
    return records.records(src, prefix, settings, modified, F.col("url"))


def crawl(pages: DataFrame, seen: DataFrame, version: str, output: str, settings: RecordSettings = RecordSettings(), progress: str | None = None) -> dict[str, int]:
    """Append records of the pages not seen yet to ``output``; then mark good and non-HTML pages as seen, in order of their URLs. Gives run counters.

    HTML is read once: chunks and pages are counted as they are written. What is new
    and what was fetched comes from a table without the HTML.
    """
    fetched = F.coalesce(F.col("status"), F.lit(0)).between(200, 299)
    new = staged(files.unseen(pages.select("url", fetched.alias("fetched")), seen), "crawl")
    rows, counted = counted_records(html_records(files.html_responses(files.unseen(pages, seen))[0], version, settings))
    rows.write.mode("append").option("ignoreNullFields", "false").json(output)
    if progress:
        write_ordered(new.where("fetched").select("url"), progress, ["url"], mode="append")
    n = counted.get
    out = {"pages": n["documents"], "skipped": new.count() - n["documents"], "chunks": n["chunks"]}
    forget(new)
    return out


def counted_records(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """``rows``, and what counts ``chunks`` and ``documents`` (each has a first chunk) while they are written."""
    seen = Observation()
    return rows.observe(seen, F.count("*").alias("chunks"), F.count_if(F.col("chunk_index") == 0).alias("documents")), seen


def adoc_records(sources: DataFrame, topics: DataFrame, branch: str, settings: RecordSettings = RecordSettings(), modified: DataFrame | None = None) -> DataFrame:
    """Records of the AsciiDoc files ``(path, text)`` whose stem is in ``topics``, includes resolved. ``modified``: (path, committed_at)."""
    name = ids.last_part(F.col("path"))
    # topics come from a few hand-written files and are one row for each stem
    mapped = sources.select("path", ids.file_stem(name).alias("stem")).join(topics.select("stem", "page_url", "page_name"), "stem")
    docs = adoc.resolve_includes(sources, mapped).join(mapped, "path")
    found = adoc.sections(docs, ["page_url"])
    if modified is not None:
        found = found.join(modified.select("path", "committed_at"), "path", "left")
    else:
        found = found.withColumn("committed_at", F.lit(""))
    folder = ids.all_but_last(F.col("path"))
    src = found.withColumns({"document_id": ids.stable_uuid(F.lit(branch), F.col("path")), "file_name": name, "source_dir": F.when(folder == "", ".").otherwise(folder), "relative_path": F.col("path")})
    prefix = text.adoc_prefix(F.col("page_name"), F.col("breadcrumbs"), F.col("heading"))
    return records.records(src, prefix, settings, F.col("committed_at"), F.col("page_url"))


def convert(sources: DataFrame, topics: DataFrame, branch: str, output: str, settings: RecordSettings = RecordSettings(), modified: DataFrame | None = None) -> dict[str, int]:
    """Write the records of :func:`adoc_records` in place of what is at ``output``. Gives run counters: files of the map with chunks, without, and chunks."""
    rows, counted = counted_records(adoc_records(sources, topics, branch, settings, modified))
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(output)
    mapped = sources.select(ids.file_stem(ids.last_part(F.col("path"))).alias("stem")).join(topics.select("stem"), "stem").count()
    n = counted.get
    return {"processed": n["documents"], "skipped": mapped - n["documents"], "chunks": n["chunks"]}


def query(spark: SparkSession, question: str, settings: Settings, k: int = 5, where: str | F.Column | None = None) -> DataFrame:
    """The ``k`` chunks nearest to ``question`` of those for which ``where`` holds: ``chunk_id, source, title, section, content, tags, score``."""
    settings.validate()
    vector = embed.PROVIDERS[settings.provider](settings.provider_settings)([question])[0]
    hits = search.knn(ChunkTable(spark, settings.index_path, settings.dimensions).read(), vector, k, where)
    return hits.select("chunk_id", "source", "title", "section", "content", "tags", "score")
