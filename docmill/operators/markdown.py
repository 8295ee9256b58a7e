"""Markdown documents to chunks: front matter, heading sections, pieces."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ids, split, tags, text
from .headings import with_crumbs

FRONT = r"(?sdU)\A---[\s\x1c-\x1f]*\n(.*?)\n---[\s\x1c-\x1f]*\n"
HEADING = r"(?mdU)^(#{1,6})[\s\x1c-\x1f]+(.*)"
#: Marks of what a pattern found: a code point that is no character, and a digit. Where a text has that code point, a 0 is put after it first.
ESCAPE = "\ufdd0"
MARK, SEP, END = ESCAPE + "1", ESCAPE + "2", ESCAPE + "3"


def front_matter(block: str | None) -> dict:
    """Title, tags and other keys of a YAML block. What can't be read, or isn't a mapping, gives nothing; a single tag is a list of one."""
    import yaml

    try:
        got = yaml.safe_load(block) if block else {}
    except yaml.YAMLError:
        got = {}
    got = got if isinstance(got, dict) else {}
    names = got.get("tags")
    names = [] if names is None else names if isinstance(names, list) else [names]
    rest = plain({k: v for k, v in got.items() if k not in ("title", "tags")})
    title = got.get("title")
    return {"title": "" if title is None else str(title), "tags": [str(x) for x in names], "metadata": json.dumps(rest, ensure_ascii=False)}


def plain(v: object) -> object:
    """``v`` with values that JSON can't say (dates, sets, not a number) as strings."""
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v if v is None or isinstance(v, (str, bool, int)) or isinstance(v, float) and math.isfinite(v) else str(v)


FRONT_MATTER = T.StructType([T.StructField("title", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("metadata", T.StringType())])


@F.pandas_udf(FRONT_MATTER)
def _front_matter(blocks: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([front_matter(b) for b in blocks], columns=["title", "tags", "metadata"])


def with_front_matter(docs: DataFrame) -> DataFrame:
    """``docs`` (source, text) with ``fm_title, fm_tags, metadata`` and ``body``, by one scan.

    ``metadata`` is a VARIANT of the other keys with the types that YAML gave them:
    ``try_variant_get(metadata, '$.key', 'int')`` reads one, from a column of its own where
    the rows are stored.
    """
    docs = docs.withColumn("text", text.unix_lines(F.coalesce("text", F.lit(""))))
    has = F.col("text").rlike(FRONT)
    docs = docs.withColumns({"__block": F.when(has, F.regexp_extract("text", FRONT, 1)), "body": F.when(has, F.regexp_replace("text", FRONT, "")).otherwise(F.col("text"))})
    # Python gets the blocks alone, null for most documents
    docs = docs.withColumn("__fm", _front_matter("__block"))
    return docs.withColumns({"fm_title": F.col("__fm.title"), "fm_tags": F.col("__fm.tags"), "metadata": F.parse_json("__fm.metadata")}).drop("__fm", "__block")


def segments(docs: DataFrame, body: str = "body") -> DataFrame:
    """A row for each heading section of ``body``: ``pos, level, heading, content``; level 0 is what comes before the first heading."""
    escaped = F.replace(body, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    parts = F.split(F.regexp_replace(escaped, HEADING, f"{MARK}$1{SEP}$2{END}"), MARK)
    bare = lambda c: text.strip(F.replace(c, F.lit(ESCAPE + "0"), F.lit(ESCAPE)))
    out = docs.select("*", F.posexplode(parts).alias("pos", "__p"))
    first = F.col("pos") == 0
    out = out.withColumns({
        "level": F.when(first, 0).otherwise(F.length(F.substring_index("__p", SEP, 1))),
        "heading": F.when(first, "").otherwise(bare(F.regexp_extract("__p", f"(?s){SEP}(.*?){END}", 1))),
        "content": bare(F.when(first, F.col("__p")).otherwise(F.regexp_extract("__p", f"(?s){END}(.*)", 1))),
    }).drop("__p")
    return out


def chunks(docs: DataFrame, extra_tags: list[str] | None = None, most: int = 2000, overlap: int = 200) -> DataFrame:
    """Chunks of Markdown documents ``(source, text)``: ``chunk_id, source, title, section, content, tags, metadata, chunk_index``.

    The title is the front matter's, the first level-1 heading, or the file stem.
    ``section`` joins the title and the heading stack by `` > ``, with `` [i/n]`` for
    pieces of long sections. Ids are deterministic. Work is by document: two windows
    over its own sections, and no other shuffle.
    """
    split.check_window(most, overlap)
    segs = segments(with_front_matter(docs.select("source", "text")))
    whole = Window.partitionBy("source")
    h1 = F.min_by("heading", F.when(F.col("level") == 1, F.col("pos"))).over(whole)
    stem = ids.file_stem(ids.last_part(F.col("source")))
    segs = with_crumbs(segs, ["source"], "pos")
    title = F.coalesce(F.nullif(F.col("fm_title"), F.lit("")), F.nullif(h1, F.lit("")), stem)
    segs = segs.withColumn("title", title).where("content <> ''")
    path = F.when(F.col("level") == 0, F.col("title")).otherwise(text.section_path(F.concat(F.array("title"), F.col("crumbs"))))
    segs = segs.withColumns({"path": path, "pieces": split.sliding_window(F.col("content"), most, overlap), "tags": tags.add(F.col("fm_tags"), extra_tags or [])})
    out = segs.select("source", "title", "path", "tags", "metadata", "pos", F.size("pieces").alias("n"), F.posexplode("pieces").alias("k", "piece"))
    out = out.withColumn("content", text.strip(F.col("piece"))).where("content <> ''")
    section = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat("path", F.lit(" ["), (F.col("k") + 1).cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit("]")))
    index = F.row_number().over(Window.partitionBy("source").orderBy("pos", "k")) - 1
    out = out.withColumns({"section": section, "chunk_index": index})
    return out.select(ids.stable_uuid(F.col("source"), F.col("chunk_index"), ids.content_hash(F.col("content"))).alias("chunk_id"), "source", "title", "section", "content", "tags", "metadata", "chunk_index")
