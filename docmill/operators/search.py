"""Exact vector search under cosine distance, with filters before the top k."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..sources.stage import fresh
from . import nearest

#: Query vectors that go to every task.
QUERY_BLOCK = 4096
#: Rows that are compared with all queries at a time, first and later.
FIRST_ROWS, MOST_ROWS = 64, 1024


def knn(index: DataFrame, vector: list[float], k: int = 5, where: Column | str | None = None, id_col: str = "chunk_id", vector_col: str = "embedding", decimals: int | None = None) -> DataFrame:
    """The ``k`` rows nearest to ``vector`` of those that pass the filter, with ``score``, a distance; ties by id.

    The filter is a column or a condition in Spark SQL. Rows without a distance (null
    or zero vectors, other sizes) are left out. The
    vector is a literal, so this is one scan and a top k for each task, no shuffle.
    """
    keep = F.lit(True) if where is None else F.expr(where) if isinstance(where, str) else where
    q = F.array(*[F.lit(float(np.float32(x))) for x in vector])
    score = vectors.cosine_distance(F.col(vector_col), q)
    out = index.where(keep).withColumn("score", F.round(score, decimals) + F.lit(0.0) if decimals is not None else score)
    return out.where("score is not null").orderBy("score", id_col).limit(k)


def knn_batch(index: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "chunk_id", vector_col: str = "embedding", query_id: str = "query_id", decimals: int = 6) -> DataFrame:
    """``(query_id, id, score, rank)``: the ``k`` nearest rows of ``index`` for each row of ``queries``.

    Up to ``QUERY_BLOCK`` queries go to all tasks: each takes them times its rows as
    matrix products, holds the ``k`` best of each query so far, and gives them once.
    More queries meet the vectors in blocks, by a join of their cells. Rows without a
    distance are left out.
    """
    spark = index.sparkSession
    rows = queries.where(F.col(vector_col).isNotNull()).select(F.col(query_id).alias("q"), F.col(vector_col).cast("array<float>").alias("v")).limit(QUERY_BLOCK + 1).collect()
    if len(rows) > QUERY_BLOCK:
        cells = nearest.build(index, fresh(spark, "cells"), id_col, vector_col)
        return nearest.search(cells, queries, k, vector_col, query_id, decimals)
    kind, qkind = index.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    schema = f"query_id {qkind}, n long, id {kind}, score double"
    if not rows:
        return spark.createDataFrame([], schema).select("query_id", "id", "score", F.lit(1).alias("rank"))
    cast = spark.sparkContext.broadcast(([r["q"] for r in rows], np.array([r["v"] for r in rows], np.float64)))

    def best(frames):
        qs, m = cast.value
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        held, most, step = [], np.full(len(qs), np.inf), FIRST_ROWS
        for f in frames:
            f = f[[v is not None and len(v) == m.shape[1] for v in f["v"]]]
            if not len(f):
                continue
            x = np.stack(f["v"].to_numpy()).astype(np.float64)
            n = np.linalg.norm(x, axis=1)
            x, ids, at = x[n > 0] / n[n > 0, None], f["id"].to_numpy()[n > 0], 0
            while at < len(x):
                d = np.round(1 - m @ x[at : at + step].T, decimals) + 0.0
                q, hit = np.nonzero(d <= most[:, None])
                held.append(pd.DataFrame({"n": q, "score": d[q, hit], "id": ids[at : at + step][hit]}))
                at, step = at + step, min(2 * step, MOST_ROWS)
                one = pd.concat(held).sort_values(["n", "score", "id"]).groupby("n").head(k)
                held = [one]
                full = one.groupby("n")["score"].agg(["size", "max"])
                full = full[full["size"] == k]
                most[full.index] = full["max"]
        if held:
            yield pd.DataFrame({"query_id": [qs[i] for i in held[0]["n"]], "n": held[0]["n"].to_numpy(), "id": held[0]["id"].to_numpy(), "score": held[0]["score"].to_numpy()})

    found = index.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v")).mapInPandas(best, schema)
    rank = F.row_number().over(Window.partitionBy("n").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("n")
