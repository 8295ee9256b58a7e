"""Line dedup by distinct-site spread.

HyperLogLog sketches of the sites and of the texts of each line hash are merged by
aggregation. Lines near a threshold get exact distinct counts. A line on many sites
is boilerplate and is removed everywhere, unless it is only in so few distinct texts
that these are copies as wholes, which near dedup deals with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, row_key, table, unboxed

#: A line on so many distinct sites, in so many distinct texts, is boilerplate.
MIN_SITES = 5
LG_K = 12
#: Estimates within this share of a threshold (and at least one) are counted exactly; six standard errors of the sketch are 0.1.
BAND = 0.15

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_hash(line: Column) -> Column:
    """XXH64 (seed 42) of a line in lower case (A-Z), white space joined to single blanks; null for a blank line."""
    norm = F.trim(F.regexp_replace(F.translate(line, UPPER, LOWERED), "[ \\t\\x0B\\f\\r]+", " "))
    return F.when(norm != "", F.xxhash64(norm))


def line_arrays(docs: DataFrame, site: str, text: str, doc_id: str) -> DataFrame:
    """``(__id, __th, site, lines)``: the distinct hashes of the lines of a row that aren't blank."""
    hs = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), line_hash)
    return docs.select(*row_key(text, doc_id), F.xxhash64(site).alias("site"), hs.alias("hs")).select("__id", "__th", "site", F.array_distinct(F.filter("hs", lambda h: h.isNotNull())).alias("lines"))


def boilerplate(lines: DataFrame, sites: int = MIN_SITES) -> DataFrame:
    """``(h)`` of lines on ``sites`` sites and in as many texts, of exploded ``(site, h, th)``."""
    some = lines.groupBy("h").agg(F.count("*").alias("n"), F.min("site").alias("s0"), F.max("site").alias("s1"), F.min("th").alias("t0"), F.max("th").alias("t1"))
    some = some.where((F.col("n") >= sites) & (F.col("s0") != F.col("s1")) & (F.col("t0") != F.col("t1"))).select("h")
    # written before they are grouped: else a line that is everywhere would stay in the one task that joined it
    mine = table(lines.join(some, "h", "left_semi"), "lines-on-sites")
    sketched = mine.groupBy("h").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("n_sites"),
        F.hll_sketch_estimate(F.hll_sketch_agg("th", F.lit(LG_K))).alias("n_texts"),
    )
    fewer = F.least("n_sites", "n_texts")
    over = fewer >= sites
    within = F.least(F.abs(F.col("n_sites") - sites), F.abs(F.col("n_texts") - sites)) <= max(1.0, sites * BAND)
    below = fewer < sites * (1 - BAND) - 1
    sketched = table(sketched.where(~below).select("h", over.alias("over"), within.alias("within")), "line-sketches")
    close = table(mine.join(sketched.where("within").select("h"), "h", "left_semi"), "lines-to-count")
    exact_sites = close.groupBy("h", "site").agg(F.lit(1).alias("x")).groupBy("h").agg(F.count("*").alias("n_sites"))
    exact_texts = close.groupBy("h", "th").agg(F.lit(1).alias("x")).groupBy("h").agg(F.count("*").alias("n_texts"))
    exact = exact_sites.join(exact_texts, "h").where(over).select("h")
    return sketched.where("over and not within").select("h").unionByName(exact)


def drops(docs: DataFrame, site: str = "source", text: str = "text", doc_id: str = "doc_id", sites: int = MIN_SITES) -> DataFrame:
    """``(__id, __th, drop)``: hashes of the lines to remove of rows that have any; rows are named by id and text."""
    rows = table(line_arrays(docs, site, text, doc_id), "lines")
    flat = rows.select("__id", "__th", "site", F.explode("lines").alias("h"))
    bad = table(boilerplate(flat.select("site", "h", F.col("__th").alias("th")), sites), "boilerplate")
    return flat.join(bad, "h").groupBy("__id", "__th").agg(F.collect_set("h").alias("drop"))


def without_lines(text: Column, drop: Column) -> Column:
    """``text`` without lines whose hash is in ``drop``."""
    # exists, as a blank line's hash is null
    keep = F.filter(F.split(text, "\n"), lambda x: F.coalesce(~F.array_contains(drop, line_hash(x)), F.lit(True)))
    return F.when(drop.isNull(), text).otherwise(F.array_join(keep, "\n"))


def dedup_lines(docs: DataFrame, site: str = "source", text: str = "text", doc_id: str = "doc_id", sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``, and two columns more: ``n_lines`` and ``n_removed_lines``.

    All rows stay, in count and order of lines. Null texts stay null, with 0 lines;
    blank lines are neither counted nor removed; rows without a site share one; no
    rows give none. Repeated rows (same id and text) are treated alike. Long texts are
    worked on whole. Columns may have any names; ones named as the two that are added
    are left out.
    """
    drop = drops(docs, site, text, doc_id, sites).withColumnsRenamed({"__id": "__id2", "__th": "__th2", "drop": "__drop"})
    both = boxed(docs, text, doc_id).join(drop, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__th") == F.col("__th2")), "left")
    n = lambda t: F.coalesce(F.size(F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\t\\x0B\\f\\r]"))), F.lit(0)).cast("long")
    old = F.col("__doc").getField(text)
    new = both.withColumn("__new", without_lines(old, F.col("__drop")))
    out = unboxed(docs, ("n_lines", "n_removed_lines")) | {text: F.col("__new").alias(text)}
    return new.select(*out.values(), n(old).alias("n_lines"), (n(old) - n(F.col("__new"))).alias("n_removed_lines"))
