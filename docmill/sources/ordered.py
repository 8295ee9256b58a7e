"""Files in order: each is sorted, and one after the other they are sorted too."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .stage import file_system, small_batches


def path_order(path: str = "source") -> Column:
    """Paths by their parts: what is in a folder stands together."""
    return F.split(path, "/")


def write_ordered(df: DataFrame, path: str, by: list[str | Column], kind: str = "json", mode: str = "overwrite", keep: list[str] | None = None, **options: str) -> None:
    """Write ``df`` by ranges of ``by``, nulls first; rows that are equal in it stay in their order, and may be dealt to several files.

    ``keep``: the columns that are written, all by default. One shuffle, and a sort that
    spills; no task needs more than its range.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.withColumns({k: F.col(c) if isinstance(c, str) else c for k, c in zip(keys, by)}).withColumn("__row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*keys, "__row").sortWithinPartitions(*keys, "__row")
    rows.select(*(keep or df.columns)).write.mode(mode).options(**options).format(kind).save(path)


def in_order(spark: SparkSession, path: str) -> list[str]:
    """The files that :func:`write_ordered` left at ``path``, in order; by number, as names are not in order beyond 99999."""
    fs, p = file_system(spark, path)
    found = [(re.match(r"part-(\d+)-.*?(?:-c(\d+))?\.", s.getPath().getName()), s.getPath().toString()) for s in fs.listStatus(p)]
    return [f for _, f in sorted(((int(m[1]), int(m[2] or 0)), f) for m, f in found if m)]


def numbered(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of JSON lines at ``path`` with ``position``, their place in the order of the files.

    Places in a file are counted by file; the rows of all files before it come from a
    count for each file.
    """
    place = F.array_position(F.array(*[F.lit(f.rsplit("/", 1)[-1]) for f in in_order(spark, path)] or [F.lit("")]), F.col("__file"))
    rows = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))
    rows = rows.withColumn("__at", F.row_number().over(Window.partitionBy("__file").orderBy("__block", "__row")))
    files = rows.groupBy("__file").agg(F.count("*").alias("__n")).withColumn("__place", place)
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(files.select("__file", before.alias("__before")), "__file").withColumn("position", F.col("__before") + F.col("__at") - 1).drop("__file", "__block", "__row", "__at", "__before")


def part_order(path: str = "source") -> Column:
    """The order in which a job has written the file at ``path``: its task, and the file's number in it."""
    number = lambda pattern: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")), F.lit("9" * 18)), F.lit(0)).cast("long")
    return F.struct(number(r"/part-(\d+)-[^/]*$").alias("task"), number(r"[-.]c(\d+)\.[^/]*$").alias("file"))


def digests(rows: DataFrame, by: str, order: Column, value: str) -> DataFrame:
    """``(by, chars, sha)``: characters and hexadecimal SHA-256 of the texts ``value`` of each ``by``, one after the other in ``order``.

    A digest is one sequence: a task reads the texts of one ``by`` as they come from a
    sort that spills, and holds a batch of them.
    """
    small_batches(rows.sparkSession)
    src = rows.select(F.col(by).alias("by"), order.alias("__order"), F.length(value).cast("bigint").alias("n"), F.col(value).cast("binary").alias("value"))
    src = src.repartition("by").sortWithinPartitions("by", "__order").select("by", "n", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple | None = None
        chars, sha = 0, hashlib.sha256()
        said = lambda: pa.RecordBatch.from_arrays([pa.array([own[0]], kind), pa.array([chars], pa.int64()), pa.array([sha.hexdigest()])], names=[by, "chars", "sha"])
        for batch in batches:
            kind = batch.column(0).type
            for key, n, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if own != (key,):
                    if own:
                        yield said()
                    own, chars, sha = (key,), 0, hashlib.sha256()
                if v.is_valid:
                    chars += n
                    sha.update(v.as_buffer())
        if own:
            yield said()

    return src.mapInArrow(run, f"`{by}` {src.schema['by'].dataType.simpleString()}, chars bigint, sha string")
