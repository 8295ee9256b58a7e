"""URLs seen, as the state of a stream: each URL comes out once, with the time it was first seen, until it expires."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """The first time of each key, kept for ``expiry_ms`` of event time."""

    def __init__(self, expiry_ms: int) -> None:
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "seen_at timestamp")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        times = [t for t in (min((r["seen_at"] for r in rows), default=None),) if t is not None]
        if times and not self.first.exists():
            self.first.update((times[0],))
            self.handle.registerTimer(int(times[0].timestamp() * 1000) + self.expiry_ms)
            yield Row(url=key[0], first_seen=times[0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_seen(urls: DataFrame, expiry: str = "30 days", late: str = "1 hour") -> DataFrame:
    """``(url, first_seen)`` of a stream ``(url, seen_at)``: a row when a URL is seen first, and again when it comes back after ``expiry``.

    State is one time for each URL, by hash of the URL over all state partitions. Rows
    more than ``late`` behind the newest are left out, as are null URLs and times; a URL
    expires when the watermark passes its first time plus ``expiry``.
    """
    rows = urls.select("url", F.col("seen_at").cast("timestamp").alias("seen_at")).where("url is not null and seen_at is not null")
    ms = urls.sparkSession.range(1).select(F.expr(f"CAST(unix_millis(TIMESTAMP_SECONDS(0) + INTERVAL {expiry}) AS BIGINT)")).first()[0]
    return rows.withWatermark("seen_at", late).groupBy("url").transformWithState(FirstSeen(ms), "url string, first_seen timestamp", "append", "eventtime")


def remember(spark: SparkSession, path: str, output: str, checkpoint: str, expiry: str = "30 days", late: str = "1 hour", once: bool = True) -> StreamingQuery:
    """Start a stream over JSON lines ``(url, seen_at)`` below ``path`` that appends each URL first seen to ``output``.

    The checkpoint holds the state and which files were read, and the file sink commits
    a batch once, so that a run that was stopped goes on without a URL lost or twice.
    """
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)  # a query keeps the settings that it was started with
    try:
        stream = spark.readStream.schema("url string, seen_at timestamp").json(path)
        writer = first_seen(stream, expiry, late).writeStream.format("json").option("path", output).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
