"""Tables in the folder that driver and executors share, for lineage that grows by rounds.

Each application has a folder of its own there, which goes when it ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, a local folder will do if the executors are in the driver's
    own process; on a cluster it raises, as they would not see one another's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{tempfile.gettempdir()}/docmill-shared"
    return root.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The file system that ``path`` is on, and the path for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fresh(spark: SparkSession, label: str) -> str:
    """A new path in this application's folder, which is deleted when the application ends."""
    folder = f"{shared_dir(spark)}/docmill/{spark.sparkContext.applicationId}"
    fs, p = file_system(spark, folder)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


#: Rows and bytes of an Arrow batch, whichever comes first: texts may be long, so fewer rows than Spark's 10,000.
ARROW_ROWS = 1000
ARROW_BYTES = 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small for the rest of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written below the shared folder and read back: lineage ends there and a lost executor costs no rework."""
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._docmill_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table of :func:`staged` that nothing reads any more."""
    path = getattr(df, "_docmill_path", None)
    if path:
        fs, p = file_system(df.sparkSession, path)
        fs.delete(p, True)
