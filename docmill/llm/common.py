"""What the operators of this package share: tables in the shared folder, byte-bounded batches, word rules."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import forget, fresh, shared_dir, small_batches, staged

#: Bytes of text that a task works on at once inside an Arrow batch.
SLICE_BYTES = 4 << 20

#: A-Z to a-z, all other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower case, and a blank for every byte outside 0-9, a-z and the non-ASCII bytes.
ALNUM = bytes(LOWER[b] if chr(b).isalnum() and b < 128 or b > 127 else 32 for b in range(256))


#: Tables that end the lineage of what they hold.
table = staged


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of phases that have ended: it does so when the driver's objects for them are collected, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def by_bytes(values: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``values`` holding at most ``most`` bytes each, or one value."""
    start, size = 0, 0
    for i, v in enumerate(values):
        n = len(v) if v is not None else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(values):
        yield start, len(values)


def map_texts(
    df: DataFrame,
    keys: dict[str, F.Column | str],
    text: F.Column | str,
    fn: Callable[[], Callable[[list], dict[str, object]]],
    schema: str,
    most: int = SLICE_BYTES,
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """One row out for each row in: ``keys`` as they are, then what ``fn()(texts)`` gives for the byte slices.

    ``text`` goes to the tasks as UTF-8 bytes. ``fn`` is called once a task and
    returns the function of a list of bytes (None for null) to columns, named and
    typed as in ``schema`` (DDL of the added columns). Slices have ``most`` bytes;
    ``done`` is called when a task ends, as workers go on to tasks of other kinds.
    """
    small_batches(df.sparkSession)
    src = df.select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in keys.items()], (F.col(text) if isinstance(text, str) else text).cast("binary").alias("__text"))
    head = [f for f in src.schema.fields if f.name != "__text"]
    added = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    full = StructType(head + added.fields)
    arrow = to_arrow_schema(full)
    names = list(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            for a, b in by_bytes(texts, most):
                cols = work(texts[a:b])
                part = batch.slice(a, b - a)
                arrays = [part.column(n) for n in names]
                for f in added.fields:
                    v = cols[f.name]
                    kind = arrow.field(f.name).type
                    arrays.append(v if isinstance(v, pa.Array) else pa.array(v, kind))
                yield pa.RecordBatch.from_arrays([x.cast(arrow.field(i).type) for i, x in enumerate(arrays)], schema=arrow)
        if done:
            done()
        pa.default_memory_pool().release_unused()

    return src.mapInArrow(run, full)


def boxed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` as one, ``__doc``, beside :func:`row_key`: whatever their names, they can't clash with others."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), *row_key(text, doc_id))


def unboxed(docs: DataFrame, but: tuple[str, ...] = ()) -> dict[str, F.Column]:
    """The columns of ``docs`` out of ``__doc``, by name."""
    return {c: F.col("__doc").getField(c).alias(c) for c in docs.columns if c not in but}


def row_key(text: str = "text", doc_id: str = "doc_id") -> list[F.Column]:
    """Columns that name a row by id and text; equal rows share a key, and all that is derived from it."""
    return [F.col(doc_id).alias("__id"), F.xxhash64(F.col(text), F.col(text).isNull()).alias("__th")]
