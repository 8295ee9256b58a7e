"""Whitening of embeddings by hierarchical SVD merging.

Entries are put on an integer grid, so that counts and sums are exact whatever the
order. Each partition keeps a summary of its vectors: count, sums, and all singular
values and vectors of its centred rows. Two summaries merge by stacking their rows
(singular value times vector) with one row for the difference of their means and
decomposing again, which loses no dimension. Summaries merge by ``FAN_IN`` in a tree
of small groups; only the last one, as large as one vector's length squared, comes
to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .common import forget, table

#: Summaries that one task merges.
FAN_IN = 8
#: Singular values below this share of the largest are rounding: such a component has no variance.
NO_VARIANCE = 1e-12
#: Integers up to here are summed and squared in 64 bits.
SAFE = 1 << 62
#: The largest size of a scaled entry, so that differences fit 64 bits.
MOST = float(1 << 60)

STATE = "node long, n long, sums array<decimal(38,0)>, values array<double>, vectors array<double>"
MOMENTS = "node long, n long, mean array<double>, comoment array<double>"


class Summary:
    """``n`` integer vectors: exact ``sums``, and the centred rows up to rotation as ``values`` and ``vectors``."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> None:
        self.n, self.sums, self.values, self.vectors = n, sums, values, vectors

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """Of the rows of ``x``."""
        n, sums = len(x), column_sums(x)
        _, values, vectors = np.linalg.svd(centred(x, n, sums), full_matrices=False)
        return cls(n, sums, values, vectors)

    def merge(self, other: Summary) -> Summary:
        """The summary of both together."""
        a, b = self.n, other.n
        apart = np.array([(s * b - t * a) / (a * b) for s, t in zip(self.sums, other.sums)])
        rows = np.vstack([self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, np.sqrt(a * b / (a + b)) * apart[None, :]])
        _, values, vectors = np.linalg.svd(rows, full_matrices=False)
        return Summary(a + b, [s + t for s, t in zip(self.sums, other.sums)], values, vectors)

    @classmethod
    def read(cls, row: dict) -> Summary:
        values = np.array(row["values"], np.float64)
        return cls(row["n"], [int(s) for s in row["sums"]], values, np.array(row["vectors"], np.float64).reshape(len(values), -1))

    def row(self, node: int) -> dict:
        return {"node": node, "n": self.n, "sums": [Decimal(s) for s in self.sums], "values": self.values, "vectors": self.vectors.ravel()}


class Moments:
    """Count, mean and summed products of differences from the mean."""

    def __init__(self, n: int, mean: np.ndarray, comoment: np.ndarray) -> None:
        self.n, self.mean, self.comoment = n, mean, comoment

    @classmethod
    def of(cls, w: np.ndarray) -> Moments:
        mean = w.mean(axis=0)
        return cls(len(w), mean, (w - mean).T @ (w - mean))

    def merge(self, other: Moments) -> Moments:
        n, d = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.comoment + other.comoment + np.outer(d, d) * (self.n * other.n / n))

    @classmethod
    def read(cls, row: dict) -> Moments:
        mean = np.array(row["mean"], np.float64)
        return cls(row["n"], mean, np.array(row["comoment"], np.float64).reshape(len(mean), -1))

    def row(self, node: int) -> dict:
        return {"node": node, "n": self.n, "mean": self.mean, "comoment": self.comoment.ravel()}


def column_sums(x: np.ndarray) -> list[int]:
    if len(x) * max(int(x.max()), -int(x.min())) < SAFE:
        return [int(s) for s in x.sum(axis=0)]
    return [sum(map(int, c)) for c in x.T]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - sums / n`` in doubles: whole parts are taken off as integers, so that nothing cancels."""
    whole = [s // n for s in sums]
    rest = np.array([(s - q * n) / n for s, q in zip(sums, whole)])
    return (x - np.array(whole, np.int64)).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over dimensions of ``(n * x - sums) ** 2``; None for one that 64 bits can't hold."""
    whole = [s // n for s in sums]
    near = x - np.array(whole, np.int64)
    rest = [s - q * n for s, q in zip(sums, whole)]
    if (int(np.abs(near).max()) + 1) * n < int((SAFE / x.shape[1]) ** 0.5):
        d = near * n - np.array(rest, np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = (sum((int(v) * n - r) ** 2 for v, r in zip(row, rest)) for row in near)
    return [v if v < 1 << 63 else None for v in exact]


class Whitener:
    """Components of a fit: ``components`` (rows, unit length) by falling ``variances``, for vectors of ``dims`` entries.

    ``n`` and ``sums`` are those of the fit list; ``total`` is the trace of the covariance.
    """

    def __init__(self, fitted: Summary, most: int) -> None:
        self.n, self.sums = fitted.n, fitted.sums
        self.dims = fitted.vectors.shape[1]
        variances = np.zeros(self.dims)
        variances[: len(fitted.values)] = fitted.values**2 / fitted.n
        self.total = float(variances.sum())
        k, known = min(most, self.dims), min(most, len(fitted.values))
        self.components, self.variances = np.zeros((k, self.dims)), variances[:k]
        self.components[:known] = fitted.vectors[:known]
        self.used = np.sqrt(self.variances * self.n) > NO_VARIANCE * max(fitted.values[0], np.finfo(float).tiny)

    def explained(self) -> list[float | None]:
        return [float(e) / self.total if self.total else None for e in self.variances]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Rows of ``x`` whitened; NaN for components without variance."""
        scale = np.where(self.used, np.sqrt(self.variances), np.nan)
        return centred(x, self.n, self.sums) @ self.components.T / scale


def grid(vector: str, scale: int, shift: int) -> F.Column:
    """``floor(scale * entry) + shift`` of each entry as long; ``scale * entry`` beyond ``MOST`` counts as ``MOST``."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(MOST)), F.lit(-MOST))) + shift)


def usable(vector: str) -> F.Column:
    """Vectors that aren't null or empty and have finite entries only."""
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows; others raise."""
    lengths = np.diff(column.offsets.to_numpy())
    if len(np.unique(lengths)) > 1:
        raise ValueError(f"vectors of {lengths.min()} and of {lengths.max()} entries: whiten those of one length at a time")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def batch_of(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def merged(vectors: DataFrame, of: Callable[[np.ndarray], object], kind: type, schema: str, label: str):
    """``of`` of all rows of the column ``x``, merged in each partition and then in a tree by ``FAN_IN``; None if there are no rows."""
    spark = vectors.sparkSession
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def start(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = None
        for b in batches:
            if b.num_rows:
                own = of(matrix(b.column("x")))
                got = own if got is None else got.merge(own)
        if got is not None:
            yield batch_of([got.row(TaskContext.get().partitionId())], arrow)

    def unite(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: r["node"])
        got = kind.read(rows[0])
        for r in rows[1:]:
            got = got.merge(kind.read(r))
        return pa.Table.from_batches([batch_of([got.row(rows[0]["node"] // FAN_IN)], arrow)])

    first = table(vectors.select("x").mapInArrow(start, schema), label)
    states, nodes = first, first.agg(F.max("node")).first()[0]
    nodes = -1 if nodes is None else nodes
    while nodes > 0:
        states = states.groupBy(F.floor(F.col("node") / FAN_IN)).applyInArrow(unite, schema)
        nodes //= FAN_IN
    rows = states.collect()  # one row: the tree ends in node 0
    forget(first)
    return kind.read(rows[0].asDict()) if rows else None


def fit(df: DataFrame, vector: str = "embedding", scale: int = 64, shift: int = 1_000_000, components: int = 32) -> Whitener | None:
    """The whitener of the vectors of ``df``; None if it has no usable one."""
    got = merged(df.where(usable(vector)).select(grid(vector, scale, shift).alias("x")), Summary.of, Summary, STATE, "whitening-fit")
    return Whitener(got, components) if got else None


def identity_error(df: DataFrame, model: Whitener, vector: str = "embedding", scale: int = 64, shift: int = 1_000_000) -> float:
    """The largest absolute entry of the covariance of all whitened vectors less the identity, over components with variance; 0 if there are none."""
    used = int(model.used.sum())
    if not used:
        return 0.0
    got = merged(df.where(usable(vector)).select(grid(vector, scale, shift).alias("x")), lambda x: Moments.of(model(x)[:, :used]), Moments, MOMENTS, "whitening-error")
    return float(np.abs(got.comoment / got.n - np.eye(used)).max())


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64, shift: int = 1_000_000, components: int = 32) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row for each usable vector and component.

    ``x = floor(scale * entry) + shift``. Null and empty vectors, and those with null
    or non-finite entries, are left out; repeated rows count as often as they are
    there; a null id stays null; no usable vector gives no rows; vectors of several
    lengths raise. A component without variance (fewer vectors than dimensions, or
    all equal) has a null ``whitened``, and ``explained`` is null if there is no
    variance at all. ``deviation`` is null where 64 bits can't hold it. Other columns
    aren't read.
    """
    spark = df.sparkSession
    key = StructField("vec_id", df.schema[vec_id].dataType)
    tail = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(df, vector, scale, shift, components)
    if model is None:
        return spark.createDataFrame([], StructType([key, *_parse_datatype_string(tail).fields]))
    error = identity_error(df, model, vector, scale, shift)
    inner = StructType([key, *_parse_datatype_string("deviation long, w array<double>").fields])
    arrow = to_arrow_schema(inner)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("x"))
            w = model(x)
            flat = pa.array(w.ravel(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(arrow.field(0).type), pa.array(deviations(x, model.n, model.sums), pa.int64()), lists.cast(arrow.field(2).type)], schema=arrow)

    rows = df.where(usable(vector)).select(F.col(vec_id).alias("vec_id"), grid(vector, scale, shift).alias("x")).mapInArrow(work, inner)
    shares = F.array(*[F.lit(e).cast("double") for e in model.explained()])
    return rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
