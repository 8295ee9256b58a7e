"""Stored sitemaps as a data source: an index and the sub-sitemaps that it names, a partition for each of these.

``spark.read.format("sitemaps").load(folder)`` gives a row for each URL of each sub-sitemap.
Conditions on the sub-sitemap's name leave out its file, those on the beginning of URLs
are answered while a file is read; both reach the source where :func:`read` finds
``spark.sql.python.filterPushdown.enabled`` on. Files are read event by event, so that
their size doesn't matter.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from .files import first_urls, is_page

SCHEMA = "sitemap string, sitemap_pos int, pos int, url string"
#: Rows of a batch.
BATCH = 10_000


@dataclass
class SubSitemap(InputPartition):
    name: str
    place: int


class Sitemaps(DataSource):
    """Options: ``path``, the folder; ``index``, the name of the index in it (``sitemap_index.xml``); ``prefix``, of the URLs wanted; ``pushdown``, whether Spark gives it conditions."""

    @classmethod
    def name(cls) -> str:
        return "sitemaps"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kind = FilteringReader if self.options.get("pushdown", "false") == "true" else SitemapReader
        return kind(self.options["path"], self.options.get("index", "sitemap_index.xml"), self.options.get("prefix", ""))


class SitemapReader(DataSourceReader):
    def __init__(self, path: str, index: str, prefix: str) -> None:
        self.path, self.index, self.prefixes, self.only = path.rstrip("/"), index, [prefix], None

    def locations(self, name: str) -> Iterator[str]:
        """The text of all ``loc`` elements of a file, or of the files that Spark has written to ``name=<name>``; a file that isn't there raises."""
        system, at = fs.FileSystem.from_uri(self.path if "://" in self.path else self.path.replace("file:", ""))
        own = f"{at}/{name}"
        if system.get_file_info(own).type == fs.FileType.NotFound:
            folder = system.get_file_info(fs.FileSelector(f"{at}/name={name}"))
            own = min(f.path for f in folder if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
        with system.open_input_stream(own) as stream:
            for _, element in ET.iterparse(stream):
                if element.tag.rsplit("}", 1)[-1] == "loc" and element.text:
                    yield element.text
                element.clear()

    def partitions(self) -> list[SubSitemap]:
        names = [u.rsplit("/", 1)[-1] for u in self.locations(self.index)]
        return [SubSitemap(n, k) for k, n in enumerate(names) if self.only is None or n in self.only] or [SubSitemap("", -1)]

    def read(self, partition: SubSitemap) -> Iterator[pa.RecordBatch]:
        if partition.place < 0:
            return
        held: list[tuple[int, str]] = []
        for k, url in enumerate(self.locations(partition.name)):
            if all(map(url.startswith, self.prefixes)):
                held.append((k, url))
            if len(held) == BATCH:
                yield self.batch(partition, held)
                held = []
        if held:
            yield self.batch(partition, held)

    def batch(self, partition: SubSitemap, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([partition.name] * n), pa.array([partition.place] * n, pa.int32()), pa.array([k for k, _ in rows], pa.int32()), pa.array([u for _, u in rows])], names=["sitemap", "sitemap_pos", "pos", "url"])


class FilteringReader(SitemapReader):
    """A reader that takes conditions; Spark allows one only where pushdown is on."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("sitemap",):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = some if self.only is None else self.only & some
            elif isinstance(f, StringStartsWith) and f.attribute == ("url",):
                self.prefixes.append(f.value)
            else:
                yield f


def read(spark: SparkSession, path: str, prefix: str = "", index: str = "sitemap_index.xml") -> DataFrame:
    """``(sitemap, sitemap_pos, pos, url)`` of the URLs with ``prefix``, places counted over all."""
    spark.dataSource.register(Sitemaps)
    on = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("sitemaps").options(index=index, prefix=prefix, pushdown=on).load(path)


def pages(urls: DataFrame, prefix: str) -> DataFrame:
    """``(url, ord)``: distinct page URLs, in the order of the first place of each."""
    return first_urls(urls.select("url", F.struct("sitemap_pos", "pos").alias("ord")), prefix)


def counts(urls: DataFrame, prefix: str) -> DataFrame:
    """``(sitemap, sitemap_pos, n)``: URLs with ``prefix`` by sub-sitemap, those that are left out later and repeats too; sub-sitemaps without one aren't there."""
    return urls.where(F.col("url").startswith(prefix)).groupBy("sitemap", "sitemap_pos").agg(F.count("*").alias("n"))


def write(urls: DataFrame, path: str, index: str = "sitemap_index.xml") -> None:
    """Store sitemaps of ``(sitemap, sitemap_pos, pos, url)``: a folder ``name=<sitemap>`` with one file each, a line for each URL, and the index."""
    escaped = F.replace(F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    space = ' xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    ends = lambda rows, tag: rows.select(F.posexplode(F.array(F.lit(f"<{tag}{space}>"), F.lit(f"</{tag}>"))).alias("at", "value"), "*")
    line = urls.select(F.col("sitemap").alias("name"), F.lit(0.5).alias("at"), F.col("pos").alias("ord"), F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc></url>")).alias("value"))
    named = urls.select(F.col("sitemap").alias("name"), "sitemap_pos").distinct()
    edge = ends(named, "urlset").select("name", F.col("at").cast("double").alias("at"), F.lit(0).alias("ord"), "value")
    whole = line.unionByName(edge).repartition("name").sortWithinPartitions("name", "at", "ord")
    whole.select("value", "name").write.mode("append").partitionBy("name").text(path)
    top = ends(urls.sparkSession.range(1), "sitemapindex").select(F.lit(index).alias("name"), F.col("at").cast("double").alias("at"), F.lit(0).alias("ord"), "value")
    subs = named.select(F.lit(index).alias("name"), F.lit(0.5).alias("at"), F.col("sitemap_pos").alias("ord"), F.concat(F.lit("<sitemap><loc>https://h/"), "name", F.lit("</loc></sitemap>")).alias("value"))
    top.unionByName(subs).coalesce(1).sortWithinPartitions("name", "at", "ord").select("value", "name").write.mode("append").partitionBy("name").text(path)
