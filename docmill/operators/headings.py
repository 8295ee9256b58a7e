"""Heading stacks as windows.

A stack cut to ``level - 1`` entries and pushed has depth ``min(before + 1, level)``,
so depth is ``i + least(start, min over j <= i of (level_j - j))``, and the entry at
depth p is the heading of the latest row of that depth.

What a run of headings does to a stack is an associative value: their number, the
least ``level_j - j``, and the last heading of each depth. So a long document can be
worked on in blocks: each by itself, then a scan over the values of the blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged

MAX_DEPTH = 6
#: Rows of a document that one task works on in :func:`with_crumbs_in_blocks`.
BLOCK = 4096


def with_crumbs(df: DataFrame, by: list[str], order: str, level: str = "level", heading: str = "heading", root: Column | None = None) -> DataFrame:
    """``df`` with ``crumbs``, the stack at each row, its own heading last. Rows of level 0 leave the stack as it is.

    ``root``: an entry that the stack begins with, at depth 1.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    real = F.col(level) > 0
    n = F.sum(real.cast("int")).over(w)
    df = df.withColumn("__n", n)
    low = F.min(F.when(real, F.col(level) - F.col("__n"))).over(w)
    start = 0 if root is None else 1
    df = df.withColumn("__d", F.when(real, F.col("__n") + F.least(F.lit(start), low)))
    at = F.last("__d", ignorenulls=True).over(w)
    base = F.lit(0) if root is None else F.lit(1)
    df = df.withColumn("__at", F.coalesce(at, base))
    entry = lambda p: F.last(F.when(F.col("__d") == p, F.struct(F.col(heading).alias("h"))), ignorenulls=True).over(w)["h"]
    slots = [entry(p) if root is None or p > 1 else F.coalesce(entry(1), root) for p in range(1, MAX_DEPTH + 2)]
    return df.withColumn("crumbs", F.slice(F.array(*slots), F.lit(1), F.col("__at"))).drop("__n", "__d", "__at")


def with_crumbs_in_blocks(df: DataFrame, by: list[str], order: str, level: str = "level", heading: str = "heading", root: Column | None = None, block: int = BLOCK) -> DataFrame:
    """The same as :func:`with_crumbs` for documents of any length: no task holds more than ``block`` rows of one.

    ``order`` counts the rows of a document. Rows are shuffled by document and block,
    and once more as they are joined with what the blocks before do to the stack, which
    comes from two scans over a row for each block. All columns go along: leave out long
    texts that aren't needed.
    """
    start, real = (0 if root is None else 1), F.col(level) > 0
    own = df.withColumn("__b", F.floor(F.col(order) / block))
    w = Window.partitionBy(*by, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("__n", F.sum(real.cast("int")).over(w))
    own = staged(own.withColumn("__low", F.min(F.when(real, F.col(level) - F.col("__n"))).over(w)), "headings")

    earlier = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy(*by, "__b").agg(F.max("__n").alias("__count"), F.min("__low").alias("__least"))
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__count").over(earlier), F.lit(0)))
    blocks = staged(blocks.withColumn("__lower", F.min(F.col("__least") - F.col("__before")).over(earlier)).drop("__count", "__least"), "blocks")

    depth = F.when(real, F.col("__n") + F.col("__before") + F.least(F.lit(start), F.col("__low") - F.col("__before"), F.col("__lower")))
    range_ = range(1, MAX_DEPTH + 2)
    marks = own.where(real).select(*by, "__b", F.col(order).alias("__o"), F.col(level), F.col(heading).alias("__h"), "__n", "__low").join(blocks, [*by, "__b"]).withColumn("__d", depth)
    tops = marks.groupBy(*by, "__b").agg(*[F.max_by(F.struct(F.col("__h").alias("h")), F.when(F.col("__d") == p, F.col("__o"))).alias(f"__e{p}") for p in range_])
    carried = blocks.join(tops, [*by, "__b"], "left").select(*by, "__b", "__before", "__lower", *[F.last(f"__e{p}", ignorenulls=True).over(earlier).alias(f"__e{p}") for p in range_])

    rows = own.join(carried, [*by, "__b"]).withColumn("__d", depth)
    coming = F.when(F.col("__before") > 0, F.col("__before") + F.least(F.lit(start), F.col("__lower"))).otherwise(start)
    at = F.coalesce(F.last("__d", ignorenulls=True).over(w), coming)
    entry = lambda p: F.coalesce(F.last(F.when(F.col("__d") == p, F.struct(F.col(heading).alias("h"))), ignorenulls=True).over(w), F.col(f"__e{p}"))["h"]
    slots = [entry(p) if root is None or p > 1 else F.coalesce(entry(1), root) for p in range_]
    return rows.withColumn("crumbs", F.slice(F.array(*slots), F.lit(1), at.cast("int"))).drop("__b", "__n", "__low", "__before", "__lower", "__d", *[f"__e{p}" for p in range_])
