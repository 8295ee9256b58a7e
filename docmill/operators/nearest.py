"""Exact nearest vectors under cosine distance, with cells that can't hold any left unread.

Vectors are kept in cells around pivots, each with its distance from the pivot of its
cell, as one partition of a table for each cell. On unit vectors cosine distance is
half the square of the Euclidean one, for which the triangle inequality holds: a
query at distance ``a`` from a pivot is at least ``a - high`` and ``low - a`` from all
vectors of the cell, where ``low`` and ``high`` are the least and the greatest distance
kept. The cells next to a query give a first best ``k``; of the others those are read
that may hold better ones.

Where vectors lie in all directions alike, as random ones do, bounds are weak and
all cells are read; results are the same.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..sources.stage import staged

#: Pivots, and the bytes that they may take in each task; fewer of longer vectors.
PIVOTS = 64
PIVOT_BYTES = 8 << 20
#: Bytes of vectors, and queries, that one task compares.
PART_BYTES = 16 << 20
QUERY_BLOCK = 4096
#: What rounding and doubles may add to a distance.
SLACK = 1e-6


@dataclass
class Cells:
    """Vectors ``(cell, id, v, far)`` at ``path``; ``bounds``: rows, least and greatest distance of each cell."""

    path: str
    pivots: np.ndarray
    bounds: list[tuple[int, float, float]]

    def read(self, spark: SparkSession, some: list[int]) -> DataFrame:
        """The rows of some cells; the other partitions aren't listed."""
        return spark.read.parquet(self.path).where(F.col("cell").isin(some))

    def lower(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and cell the Euclidean distance from the pivot, and the least cosine distance of a vector of the cell."""
        away = euclid(units, self.pivots)
        low, high = np.array([b[1] for b in self.bounds]), np.array([b[2] for b in self.bounds])
        least = np.maximum(np.maximum(away - high, low - away), 0) ** 2 / 2
        least[:, [b[0] == 0 for b in self.bounds]] = np.inf
        return away, least


def euclid(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def units(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of ``dims`` entries as unit vectors, and which rows they are; null, zero, other and not finite ones are left out."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dims)
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    n = np.linalg.norm(x, axis=1)
    ok = np.isfinite(n) & (n > 0)
    return x[ok] / n[ok, None], rows[ok]


def build(index: DataFrame, path: str, id_col: str = "chunk_id", vector_col: str = "embedding", pivots: int = PIVOTS) -> Cells:
    """Write the vectors of ``index`` to cells at ``path``.

    Pivots are the rows with the least hashes, a bounded choice that any run makes
    alike. Vectors are as long as the pivots', the longest of those; rows without a
    distance are left out.
    """
    spark = index.sparkSession
    rows = index.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    hashed = rows.where("size(v) > 0").select(F.xxhash64("v").alias("h"), "v")

    def least(batches):
        held = None
        for b in batches:
            held = pa.concat_batches([held, b]) if held else b
            _, first = np.unique(held.column("h").to_numpy(), return_index=True)
            held = held.take(pa.array(first[:pivots]))
        if held:
            yield held

    # each task gives its own least hashes, so that a vector that is there very often is one
    chosen = [r["v"] for r in hashed.mapInArrow(least, hashed.schema).dropDuplicates(["h"]).orderBy("h").limit(pivots).collect()]
    dims = max(map(len, chosen), default=1)
    some, _ = units(pa.array(chosen, pa.list_(pa.float32())), dims)
    some = some[: max(1, PIVOT_BYTES // (8 * dims))]
    key = StructField("id", rows.schema["id"].dataType)
    schema = StructType([*_parse_datatype_string("cell int").fields, key, *_parse_datatype_string("v array<float>, far double").fields])
    arrow = to_arrow_schema(schema)

    def place(batches):
        for b in batches:
            x, at = units(b.column("v"), dims)
            if len(at) and len(some):
                away = euclid(x, some)
                cell = away.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column("id").take(pa.array(at)).cast(arrow.field(1).type), b.column("v").take(pa.array(at)).cast(arrow.field(2).type), pa.array(away[np.arange(len(at)), cell])], schema=arrow)

    rows.mapInArrow(place, schema).write.mode("overwrite").partitionBy("cell").parquet(path)
    kept = spark.read.schema(schema).parquet(path).groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()
    bounds = {r["cell"]: (r["n"], r["low"], r["high"]) for r in kept}
    return Cells(path, some, [bounds.get(c, (0, 0.0, 0.0)) for c in range(len(some))])


def asked(cells: Cells, queries: DataFrame, k: int) -> DataFrame:
    """``queries`` (q, v, and tau, the k-th distance so far) with the ``cells`` that each needs: without tau those next to it with ``k`` rows, else all that may hold one as near, but for those."""
    dims = cells.pivots.shape[1]
    rows = np.array([b[0] for b in cells.bounds])
    schema = StructType([queries.schema["q"], *_parse_datatype_string("cells array<int>").fields])
    arrow = to_arrow_schema(schema)

    def choose(batches):
        for b in batches:
            x, at = units(b.column("v"), dims)
            if not len(at):
                continue
            away, least = cells.lower(x)
            tau = b.column("tau").to_numpy(zero_copy_only=False)[at]
            out = []
            for i in range(len(at)):
                near = np.argsort(np.where(rows > 0, away[i], np.inf), kind="stable")
                near = near[: int(np.searchsorted(np.cumsum(rows[near]), k)) + 1]
                near = near[rows[near] > 0]
                if np.isnan(tau[i]):
                    out.append(near.tolist())
                else:
                    out.append(np.setdiff1d(np.flatnonzero(least[i] <= tau[i] + SLACK), near).tolist())
            yield pa.RecordBatch.from_arrays([b.column("q").take(pa.array(at)), pa.array(out, pa.list_(pa.int32())).cast(arrow.field(1).type)], schema=arrow)

    return queries.select("q", "v", "tau").mapInArrow(choose, schema).select("q", F.explode("cells").alias("cell"))


def compared(spark: SparkSession, cells: Cells, queries: DataFrame, pairs: DataFrame, k: int, blocks: int, decimals: int, local: StructType) -> DataFrame:
    """``(q, id, score)``: of each part of the cells that a query is paired with, its best ``k``."""
    dims = cells.pivots.shape[1]
    some = sorted(r[0] for r in pairs.select("cell").distinct().collect())  # at most PIVOTS numbers
    parts = {c: max(1, math.ceil(cells.bounds[c][0] * 4 * dims / PART_BYTES)) for c in some}
    n_parts = F.get(F.array(*[F.lit(parts.get(c, 1)) for c in range(len(cells.bounds))]), F.col("cell"))
    vectors = cells.read(spark, some).select("cell", F.pmod(F.xxhash64("id", "v"), n_parts).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "id", "v")
    near = pairs.join(queries, "q").select("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), (n_parts - 1).cast("bigint"))).alias("part"), F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"), "q", F.col("v").alias("qv"), "tau")
    arrow = to_arrow_schema(local)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        x, at = units(left["v"].combine_chunks(), dims)
        m, asks = units(right["qv"].combine_chunks(), dims)
        ids = left["id"].combine_chunks().take(pa.array(at))
        order = np.empty(len(at), np.int64)
        order[pc.sort_indices(ids).to_numpy()] = np.arange(len(at))  # ties go by id
        tau = right["tau"].to_numpy()[asks]
        q, hit, score = [], [], []
        for a in range(0, len(asks), 256):
            d = np.round(1 - m[a : a + 256] @ x.T, decimals) + 0.0
            for i, row in enumerate(d):
                may = np.flatnonzero(row <= (np.inf if np.isnan(tau[a + i]) else tau[a + i] + SLACK))
                if len(may) > k:
                    may = may[row[may] <= np.partition(row[may], k - 1)[k - 1]]
                may = may[np.lexsort((order[may], row[may]))][:k]
                q += [asks[a + i]] * len(may)
                hit.append(may)
                score.append(row[may])
        hit = np.concatenate([np.zeros(0, np.int64), *hit])
        return pa.Table.from_arrays([right["q"].combine_chunks().take(pa.array(q, pa.int64())), ids.take(pa.array(hit)).cast(arrow.field(1).type), pa.array(np.concatenate([np.zeros(0), *score]))], schema=arrow)

    keys = ["cell", "part", "block"]
    return vectors.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInArrow(best, local)


def search(cells: Cells, queries: DataFrame, k: int = 5, vector_col: str = "embedding", query_id: str = "query_id", decimals: int = 6) -> DataFrame:
    """``(query_id, id, score, rank)``: the ``k`` nearest vectors for each row of ``queries``, ties by id.

    Each row is a query of its own; those without a distance give no rows. Two rounds
    of joins, whatever the number of queries: the cells next to each, then those that
    its k-th distance so far doesn't rule out. A task compares a part of a cell, bounded
    by bytes, with a block of queries.
    """
    spark = queries.sparkSession
    rows = staged(queries.select(F.monotonically_increasing_id().alias("q"), F.col(query_id).alias("query_id"), F.col(vector_col).cast("array<float>").alias("v"), F.lit(None).cast("double").alias("tau")), "queries")
    local = StructType([rows.schema["q"], StructField("id", spark.read.parquet(cells.path).schema["id"].dataType) if any(b[0] for b in cells.bounds) else StructField("id", _parse_datatype_string("string")), *_parse_datatype_string("score double").fields])
    if not any(b[0] for b in cells.bounds):
        return rows.limit(0).select("query_id", F.lit(None).cast(local["id"].dataType).alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    blocks = max(1, math.ceil(rows.count() / QUERY_BLOCK))
    first = staged(compared(spark, cells, rows, staged(asked(cells, rows, k), "pairs"), k, blocks, decimals, local), "near")
    by = Window.partitionBy("q").orderBy("score", "id")
    tau = first.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k).groupBy("q").agg(F.max("score").alias("tau"), F.count("*").alias("n"))
    # a query with fewer than k rows so far can't rule out anything
    again = staged(rows.drop("tau").join(tau, "q").withColumn("tau", F.when(F.col("n") == k, F.col("tau")).otherwise(F.lit(float("inf")))).drop("n"), "queries")
    second = compared(spark, cells, again, staged(asked(cells, again, k), "pairs"), k, blocks, decimals, local)
    found = first.unionByName(second).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return found.join(rows.select("q", "query_id"), "q").select("query_id", "id", "score", "rank")
