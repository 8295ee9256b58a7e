"""File sources: Markdown, AsciiDoc, JSON lines, sitemaps, fetched pages, progress."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text
from .stage import file_system

SITEMAP_LOC = "//*[local-name()='loc']/text()"
CHUNK_SCHEMA = "chunk_id string, source string, title string, section string, content string, tags array<string>, metadata variant, embedding array<float>"


def source_path() -> Column:
    """The path of the file that a row is of, as ``source``: decoded, local ones without a scheme."""
    return F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/").alias("source")


def glob_regex(pattern: str) -> str:
    """A path pattern as a regular expression: ``**/`` is any folders or none, ``*`` and ``?`` stay in one name, ``[...]`` is one of these characters."""
    say = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    out = ""
    for part in re.findall(r"\*\*/|\*\*|\*|\?|\[[^\]]+\]|[^*?\[]+|\[", pattern):
        out += say.get(part) or ("[" + part[1:-1].replace("!", "^", 1).replace("\\", "\\\\") + "]" if part[0] == "[" and len(part) > 1 else re.escape(part))
    return f"^{out}$"


def relative(spark: SparkSession, path: str, source: Column) -> Column:
    """``source`` from the folder ``path`` on; the name alone if ``path`` is the file."""
    fs, p = file_system(spark, path)
    base = re.sub("^file:/+", "/", fs.makeQualified(p).toString()).rstrip("/")
    return F.when(source == base, F.substring_index(source, "/", -1)).otherwise(F.substring(source, F.lit(len(base) + 2), F.length(source)))


def whole_files(spark: SparkSession, path: str, pattern: str = "**/*.md", strict: bool = True) -> DataFrame:
    """``(source, text)`` of files whose path from ``path`` on fits ``pattern``; invalid UTF-8 raises if ``strict``, else is replaced.

    Names are filtered as files are listed, folders before they are read.
    """
    name = pattern.rsplit("/", 1)[-1].replace("**", "*")
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path, wholetext=True)
    value = F.validate_utf8("value") if strict else F.make_valid_utf8("value")
    rows = df.select(source_path(), text.unix_lines(value).alias("text"))
    return rows.where(relative(spark, path, F.col("source")).rlike(glob_regex(pattern)))


def markdown(spark: SparkSession, path: str, pattern: str = "**/*.md") -> DataFrame:
    return whole_files(spark, path, pattern)


def asciidoc(spark: SparkSession, root: str) -> DataFrame:
    """``(path, text)`` of the AsciiDoc files below ``root``, paths from there."""
    return whole_files(spark, root, "**/*.adoc", strict=False).select(relative(spark, root, F.col("source")).alias("path"), "text")


def json_lines(spark: SparkSession, path: str, schema: str | StructType = CHUNK_SCHEMA) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped and a malformed one fails."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def sitemap_urls(sitemaps: DataFrame, prefix: str, order: str = "ord", xml: str = "xml") -> DataFrame:
    """``(url, ord)`` of the page URLs of ``sitemaps``, the first place of each kept.

    Kept: URLs with ``prefix``; left out: single-page books and PDF files.
    """
    locs = sitemaps.select(order, F.posexplode(F.xpath(xml, F.lit(SITEMAP_LOC))).alias("at", "url"))
    return first_urls(locs.withColumn("ord", F.struct(order, "at")), prefix)


def is_page(url: Column, prefix: str) -> Column:
    return url.startswith(prefix) & ~url.contains("/html-single/") & ~url.contains("/pdf/") & ~url.endswith(".pdf")


def first_urls(urls: DataFrame, prefix: str) -> DataFrame:
    """``(url, ord)``: distinct page URLs, each with the least ``ord`` it has."""
    return urls.where(is_page(F.col("url"), prefix)).groupBy("url").agg(F.min("ord").alias("ord"))


def html_responses(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Responses that are HTML, and the others; of ``(url, status, content_type, last_modified, html)``."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    ok = F.coalesce(F.col("status"), F.lit(0)).between(200, 299) & (kind.contains("text/html") | kind.contains("application/xhtml")) & F.col("html").isNotNull()
    return pages.where(ok), pages.where(~ok)


def unseen(urls: DataFrame, seen: DataFrame) -> DataFrame:
    return urls.join(seen.select("url"), "url", "left_anti")


def load_seen(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a progress table; a missing or unreadable one is empty."""
    empty = spark.createDataFrame([], "url string")
    try:
        df = spark.read.schema("url string").json(path)
        return df.where("url is not null") if df.columns == ["url"] else empty
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return empty
        raise
