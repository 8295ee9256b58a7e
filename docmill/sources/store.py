"""A table of chunks in buckets by hash of their id: upserts, tag updates and lookups touch the buckets of their ids only.

The table is plain Parquet, partitioned by ``bucket``. A change reads the buckets that
its ids fall in, by partition pruning, and puts them in place with a dynamic
partition overwrite: all other files stay as they are. Buckets are replaced when
the job is committed, so one writer at a time, and readers of a bucket that was
replaced meanwhile have to be run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tags
from .stage import forget, staged

SCHEMA = "chunk_id string, source string, title string, section string, content string, tags array<string>, metadata variant, ingested_at long, embedding array<float>"
#: Buckets of a new table: choose them so that one holds what a task can sort.
BUCKETS = 64


class ChunkTable:
    """The table at ``path``; ``buckets`` counts where it is made, and stays."""

    def __init__(self, spark: SparkSession, path: str, dimensions: int, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.dimensions, self.buckets = spark, path.rstrip("/"), dimensions, buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self) -> bool:
        fs, p = self._fs(f"{self.path}/settings/_SUCCESS")
        return fs.exists(p)

    def _settings(self):
        if not self.exists():
            raise FileNotFoundError(f"no index at {self.path}")
        return self.spark.read.schema("dimensions int, buckets int").json(f"{self.path}/settings").first()

    def create(self) -> None:
        """Make an empty table, or take up the rows that a dropped one left; one that is there stays, but must have the same dimensions."""
        if self.exists():
            if (n := self._settings()["dimensions"]) != self.dimensions:
                raise ValueError(f"the index has vectors of {n}, not {self.dimensions}")
            return
        fs, p = self._fs(f"{self.path}/rows")
        left = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if "=" in s.getPath().getName()] if fs.exists(p) else []
        if left:  # their buckets are kept in the rows themselves
            self.buckets = self.spark.read.parquet(f"{self.path}/rows").agg(F.max("buckets")).first()[0]
        else:
            self._write(self.spark.createDataFrame([], SCHEMA), self.buckets)
        self.spark.createDataFrame([(self.dimensions, self.buckets)], "dimensions int, buckets int").coalesce(1).write.mode("overwrite").json(f"{self.path}/settings")

    def drop(self, delete_docs: bool = False) -> bool:
        """Forget the table, and its rows too if ``delete_docs``; False if there is none."""
        if not self.exists():
            return False
        for part in ("settings", "rows") if delete_docs else ("settings",):
            fs, p = self._fs(f"{self.path}/{part}")
            fs.delete(p, True)
        return True

    def _stored(self) -> DataFrame:
        """All rows, with their bucket."""
        return self.spark.read.schema(f"{SCHEMA}, buckets int, bucket int").parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        self._settings()
        return self._stored().drop("buckets", "bucket")

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64("chunk_id"), F.lit(n)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame, n: int) -> None:
        """Put ``rows`` in place of what their buckets hold."""
        out = rows.withColumns({"buckets": F.lit(n), "bucket": self._bucket(n)})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")

    def _of(self, ids: DataFrame, n: int) -> DataFrame:
        """The rows of the buckets that ``ids`` fall in; at most ``n`` numbers come to the driver, and the scan lists their folders only."""
        touched = [r[0] for r in ids.select(self._bucket(n)).distinct().collect()]
        return self._stored().where(F.col("bucket").isin(touched)).drop("buckets")

    def upsert(self, chunks: DataFrame, now: int, arrival: str | Column | None = None) -> None:
        """Add ``chunks``, in place of rows with their ids; all get ``now`` as ``ingested_at``. Of chunks with one id the last by ``arrival`` counts."""
        self.create()
        n = self._settings()["buckets"]
        new = staged(latest(chunks.withColumn("ingested_at", F.lit(now).cast("long")), arrival), "upsert")
        old = self._of(new, n)
        # rows of a bucket meet in one task, by one shuffle: the window and the writer need no other
        both = merged(old.drop("bucket"), new, by=lambda rows: rows.withColumn("bucket", self._bucket(n)).repartition("bucket"), also=["bucket"])
        self._write(both, n)
        forget(new)

    def retag(self, ids: list[str], add: list[str], remove: list[str]) -> DataFrame:
        """Add and then remove tags of the rows named; gives the ids that there are no rows of."""
        if not add and not remove:
            raise ValueError("nothing to add or remove")
        n = self._settings()["buckets"]
        wanted = self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "chunk_id string")
        here = self._of(wanted, n)
        missing = staged(wanted.join(here, "chunk_id", "left_anti"), "missing")
        self._write(retagged(self._of(wanted.join(missing, "chunk_id", "left_anti"), n).drop("bucket"), wanted, add, remove).repartition(self._bucket(n)), n)
        return missing

    def set_tags(self, chunk_id: str, names: list[str]) -> None:
        """Put ``names`` in place of the tags of a row; nothing happens if there is none."""
        n = self._settings()["buckets"]
        old = self._of(self.spark.createDataFrame([(chunk_id,)], "chunk_id string"), n).drop("bucket")
        self._write(old.withColumn("tags", F.when(F.col("chunk_id") == chunk_id, tags.literal(names)).otherwise(F.col("tags"))).repartition(self._bucket(n)), n)

    def get(self, chunk_id: str) -> DataFrame:
        """The row of an id, from its bucket."""
        n = self._settings()["buckets"]
        here = self._stored().where(F.col("bucket") == F.pmod(F.xxhash64(F.lit(chunk_id)), F.lit(n)).cast("int"))
        return here.where(F.col("chunk_id") == chunk_id).drop("buckets", "bucket")


def latest(rows: DataFrame, arrival: str | Column | None = None, key: str = "chunk_id") -> DataFrame:
    """Of the rows of each key the last by ``arrival``; of those that arrive together, or without it, the last by content.

    Rows are reduced before they are shuffled, so that a key that arrives very often is
    one row a task. ``arrival`` isn't kept.
    """
    named = arrival if isinstance(arrival, str) else None
    rest = [c for c in rows.columns if c not in (key, named)]
    comparable = [c for c in rest if not rows.schema[c].dataType.simpleString().startswith(("map", "variant"))]
    when = F.col(arrival) if named else arrival if arrival is not None else F.lit(0)
    last = F.max_by(F.struct(*rest), F.struct(when.alias("__when"), F.struct(*comparable).alias("__rest")))
    return rows.groupBy(key).agg(last.alias("__r")).select(key, "__r.*")


def merged(old: DataFrame, new: DataFrame, arrival: str | Column | None = None, by=None, also: list[str] | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same id; of rows of ``new`` with one id, the last by ``arrival``.

    Columns that ``new`` hasn't are null. ``by`` deals out the union of both, by the
    columns ``also``, where the caller has a partitioning that serves it afterwards.
    """
    columns = old.columns
    one = latest(new, arrival) if by is None else new
    one = one.select(*[F.col(c) if c in one.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in columns])
    both = old.withColumn("__new", F.lit(0)).unionByName(one.withColumn("__new", F.lit(1)))
    both = by(both) if by else both
    first = F.row_number().over(Window.partitionBy(*(also or []), "chunk_id").orderBy(F.desc("__new")))
    return both.withColumn("__n", first).where("__n = 1").select(*columns)


def retagged(old: DataFrame, ids: DataFrame, add: list[str], remove: list[str]) -> DataFrame:
    """``old`` with tags added to and then removed from rows whose id is in ``ids``."""
    marked = old.join(ids.select("chunk_id").distinct().withColumn("__hit", F.lit(True)), "chunk_id", "left")
    new = F.when(F.col("__hit"), tags.retag(F.coalesce("tags", tags.literal([])), add, remove)).otherwise(F.col("tags"))
    return marked.withColumn("tags", new).select(*old.columns)
