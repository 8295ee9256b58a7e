"""Last changes of files from a table of commits, through all the names that a file had."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import staged


def present_names(changes: DataFrame) -> DataFrame:
    """``(name, path)``: the present name of each name of ``changes`` (committed_at, path, renamed_from).

    A name was given up if the last rename away from it is later than its last change; one
    that is used again later is a file of its own, with all its changes. Times grow along a
    chain of renames, so that there are no circles. Pointers are doubled: a round halves
    the way to the end of all chains at once, by one join of as many rows as there are names.
    """
    moved = F.col("renamed_from").isNotNull() & (F.col("renamed_from") != F.col("path"))
    kept = changes.where("path is not null").groupBy(F.col("path").alias("name")).agg(F.max("committed_at").alias("kept_at"))
    left = changes.where(moved).groupBy(F.col("renamed_from").alias("name")).agg(F.max("committed_at").alias("left_at"), F.max_by("path", F.struct("committed_at", "path")).alias("next"))
    both = kept.join(left, "name", "full")
    gone = F.coalesce(F.col("left_at") > F.col("kept_at"), F.col("kept_at").isNull())
    pointers = staged(both.select("name", F.when(gone, F.col("next")).otherwise(F.col("name")).alias("path")), "names")
    while True:
        then = pointers.select(F.col("name").alias("path"), F.col("path").alias("further"))
        further = staged(pointers.join(then, "path").select("name", F.col("further").alias("path"), (F.col("further") != F.col("path")).alias("moved")), "names")
        pointers = further.drop("moved")
        if further.where("moved").isEmpty():
            return pointers


def file_history(changes: DataFrame) -> DataFrame:
    """``(path, last_changed, first_changed, n_changes)`` of every file of ``changes`` under its present name.

    A rename is a change of the new name. Rows without a path are left out; equal rows
    count as often as they are there.
    """
    by_name = changes.where("path is not null").groupBy(F.col("path").alias("name")).agg(F.max("committed_at").alias("last"), F.min("committed_at").alias("first"), F.count("*").alias("n"))
    named = by_name.join(present_names(changes), "name")
    return named.groupBy("path").agg(F.max("last").alias("last_changed"), F.min("first").alias("first_changed"), F.sum("n").alias("n_changes"))
