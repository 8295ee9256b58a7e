"""AsciiDoc documents to heading sections: includes, anchors, headings, markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.stage import staged
from .headings import with_crumbs

# The directive of an include, and anchor and heading lines.
INCLUDE = r"(?dm)^include::([^\[]+)\[.*?\]$"
ANCHOR = r"""^(?:\[id=["']([^"']+)["']\]|\[\[([^\]]+)\]\])"""
HEADING = r"(?dU)^(={1,4})[\s\x1c-\x1f]+(.+)$"
#: Files nested deeper than this, a power of two, are left out, which also ends cycles.
MAX_INCLUDES = 8


def normal_path(path: Column) -> Column:
    """A relative path with ``.`` and ``..`` resolved; one that leads out of the tree keeps its dots and matches nothing."""
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def resolve_includes(files: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``(path, text)`` of ``roots`` (paths; all files if None) with include directives replaced by the files that they name.

    A target is looked up beside the including file, then from the top; one that is
    in neither place is dropped, as is one nested more than ``MAX_INCLUDES`` deep.
    Texts are read once, to the pieces between directives. Who includes whom is a graph
    of file names; its paths are made by doubling, without texts: those of up to twice
    the length are the ones there are, and the longest of them followed by any. A piece's
    place is the array of its positions on the way in, and pieces are joined by root.
    """
    body = text.unix_lines(F.coalesce("text", F.lit("")))
    src = staged(files.select("path", F.split(body, INCLUDE, -1).alias("pieces"), F.regexp_extract_all(body, F.lit(INCLUDE), 1).alias("targets")), "includes")
    names = src.select(F.col("path").alias("name"))
    asked = src.select(F.col("path").alias("file"), F.posexplode("targets").alias("at", "target")).withColumn("target", text.strip(F.col("target")))
    asked = asked.withColumns({"beside": normal_path(F.concat(directory(F.col("file")), F.lit("/"), F.col("target"))), "top": normal_path(F.col("target"))})
    found = asked.join(names.select(F.col("name").alias("beside"), F.lit(True).alias("has")), "beside", "left")
    found = found.withColumn("name", F.when(F.col("has"), F.col("beside")).otherwise(F.col("top"))).join(names, "name", "left_semi")
    # pieces have even places, what is included between them odd ones
    paths = staged(found.select("file", F.array(2 * F.col("at") + 1).alias("key"), "name"), "include-paths")
    start = names.select(F.col("name").alias("file")) if roots is None else roots.select(F.col("path").alias("file")).distinct()
    longest = 1
    while longest < MAX_INCLUDES:
        last = longest * 2 >= MAX_INCLUDES
        first = paths.join(start, "file", "left_semi") if last else paths
        more = paths.select(F.col("file").alias("name"), F.col("key").alias("then"), F.col("name").alias("to"))
        further = first.where(F.size("key") == longest).join(more, "name").where(F.size("key") + F.size("then") <= MAX_INCLUDES)
        paths = staged(first.unionByName(further.select("file", F.concat("key", "then").alias("key"), F.col("to").alias("name"))), "include-paths")
        longest *= 2
    own = start.select("file", F.array().cast("array<int>").alias("key"), F.col("file").alias("name"))
    parts = own.unionByName(paths).join(src.select(F.col("path").alias("name"), "pieces"), "name").select("file", "key", F.posexplode("pieces").alias("at", "piece"))
    whole = parts.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(F.concat("key", F.array(2 * F.col("at"))).alias("key"), "piece"))).alias("p"))
    return whole.select(F.col("file").alias("path"), F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"))


def sections(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Sections of ``docs`` (path, page_name, text): ``path``, ``keep``, ``section_pos, heading, level, anchor, breadcrumbs, body``.

    Text before the first heading is a section named as the page. A heading takes the
    last anchor line since the heading before it. Sections without text are left out.
    """
    keep = [c for c in keep or [] if c not in ("path", "page_name")]
    lines = docs.select("path", "page_name", *keep, F.posexplode(text.split_lines(F.col("text"))).alias("at", "line"))
    bare = text.strip(F.col("line"))
    anchor = F.when(bare.rlike(ANCHOR), F.coalesce(F.nullif(F.regexp_extract(bare, ANCHOR, 1), F.lit("")), F.regexp_extract(bare, ANCHOR, 2)))
    lines = lines.withColumn("anchor_line", anchor)
    head = F.col("anchor_line").isNull() & F.col("line").rlike(HEADING)
    w = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"is_head": head, "section_pos": F.sum(head.cast("int")).over(w)})
    title = text.strip(F.regexp_replace(text.strip(F.regexp_extract("line", HEADING, 2)), text.ADOC_ATTRIBUTE, ""))
    part = lines.groupBy("path", "page_name", *keep, "section_pos").agg(
        F.max(F.when(F.col("is_head"), F.struct(F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), title.alias("heading")))).alias("h"),
        F.max_by("anchor_line", F.when(F.col("anchor_line").isNotNull(), F.col("at"))).alias("pending"),
        F.array_sort(F.collect_list(F.when(~F.col("is_head") & F.col("anchor_line").isNull(), F.struct("at", "line")))).alias("l"),
    )
    by = Window.partitionBy("path").orderBy("section_pos")
    part = part.withColumns({
        "anchor": F.when(F.col("section_pos") == 0, "").otherwise(F.coalesce(F.lag("pending").over(by), F.lit(""))),
        "level": F.coalesce("h.level", F.lit(0)), "heading": F.coalesce("h.heading", F.col("page_name")),
        "body": text.strip_adoc(F.array_join(F.transform("l", lambda x: x["line"]), "\n")),
    })
    out = with_crumbs(part, ["path"], "section_pos", root=F.col("page_name")).where("body <> ''")
    parents = F.when(F.col("section_pos") == 0, F.array().cast("array<string>")).otherwise(F.slice("crumbs", F.lit(1), F.size("crumbs") - 1))
    return out.select("path", "page_name", *keep, "section_pos", "heading", F.greatest("level", F.lit(1)).alias("level"), "anchor", parents.alias("breadcrumbs"), "body")
