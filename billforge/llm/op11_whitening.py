"""Embedding whitening: an exact scatter matrix from residues, then a double-precision eigendecomposition.

Every entry c of a vector becomes the integer ``floor(64 * c) + 1000000``. A partition multiplies its integer vectors, a leading one
set before each, by themselves modulo several primes below 2**20: a product of up to 2**13 rows is exact in doubles. Residues
are added up by Spark, one row a prime and matrix entry, and Chinese remaindering gives count, sums and scatter as exact integers, for as
many primes as their bound asks. The covariance is formed from these integers and rounded once. The driver holds matrices of the vectors' dimension, and no vector.

Cases: null vectors and those with a null, a NaN or an infinite entry are dropped, and so are empty ones and those whose length
is not the most common one (of equally common ones, the greatest); 64 * c is kept within 2**61 either way; components whose eigenvalue is
not above 1e-11 of the greatest are left out, as equal vectors have no direction; an empty table gives no rows; repeated rows count
and are returned as often as they stand; ids may be null and of any type; extra columns are not read; deviations beyond a long are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SCALE, SHIFT, COMPONENTS, LEAST = 64, 1_000_000, 32, 1e-11
#: Rows of one product: 2**13 residues below 2**20 squared are below 2**53.
ROWS, PRIME_BITS = 1 << 13, 20


def integers(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``size`` finite entries: which they are, and as a matrix of integers."""
    own = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1)) == size
    values = vectors.filter(pa.array(own)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
    finite = np.isfinite(values).all(axis=1)
    own[own] = finite
    whole = np.clip(np.floor(SCALE * values[finite]), -(2.0**61), 2.0**61)
    return own, whole.astype(np.int64) + SHIFT


def primes(above: int) -> list[int]:
    """The greatest primes of ``PRIME_BITS`` bits, as many as make their product greater than ``above``."""
    found, product, n = [], 1, (1 << PRIME_BITS) - 1
    while product <= above:
        if all(n % k for k in range(2, math.isqrt(n) + 1)):
            found.append(n)
            product *= n
        n -= 1
    return found


def from_residues(residues: np.ndarray, moduli: list[int]) -> np.ndarray:
    """``residues[k]`` modulo ``moduli[k]`` → the integers nearest to zero with these residues, of any size."""
    product = math.prod(moduli)
    total = sum(r.astype(object) * (product // p * pow(product // p, -1, p)) for r, p in zip(residues, moduli, strict=True)) % product
    return np.where(total > product // 2, total - product, total)


@dataclass(frozen=True)
class Whitening:
    """A fit: ``n`` vectors, their exact sums and scatter as Python integers."""

    n: int
    sums: np.ndarray
    scatter: np.ndarray
    components: int

    @cached_property
    def covariance(self) -> np.ndarray:
        return ((self.n * self.scatter - np.outer(self.sums, self.sums)) / (self.n * self.n)).astype(float)

    @cached_property
    def _whole(self) -> np.ndarray:
        """The mean's integer part."""
        return np.array([int(s) // self.n for s in self.sums], np.int64)

    @cached_property
    def _rest(self) -> np.ndarray:
        return np.array([int(s) % self.n for s in self.sums], object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x`` less the mean; integers are subtracted first, so vectors far from zero lose nothing."""
        return (x - self._whole).astype(float) - (self._rest / self.n).astype(float)

    @cached_property
    def eigen(self) -> tuple[np.ndarray, np.ndarray]:
        """Eigenvalues, falling, and unit eigenvectors as columns, of the components that are kept."""
        values, vectors = np.linalg.eigh(self.covariance)
        keep = np.arange(len(values))[::-1][: self.components]
        keep = keep[values[keep] > LEAST * max(values[-1], 0)]
        return values[keep], vectors[:, keep]

    @property
    def explained(self) -> list[float]:
        return [float(x) for x in self.eigen[0] / np.trace(self.covariance)]

    def matrix(self) -> np.ndarray:
        values, vectors = self.eigen
        return vectors / np.sqrt(values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact squared distance of ``n * x`` from the sums."""
        near = x - self._whole
        far = (max(abs(int(near.max())), abs(int(near.min()))) + 1) * self.n
        kind = np.int64 if far * far * x.shape[1] < 2**63 else object
        own = ((self.n * near.astype(kind) - self._rest.astype(kind)) ** 2).sum(axis=1)
        return [v if v < 2**63 else None for v in own.tolist()]


def _added(parts: DataFrame) -> list:
    """``(k, i, row)`` → the sums ``(k, i, j, v)`` over all partitions; as many rows as the matrices have entries."""
    return parts.select("k", "i", F.posexplode("row").alias("j", "v")).groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect()


def _rows(schema: pa.Schema, matrices: np.ndarray) -> pa.RecordBatch:
    k, i, _ = matrices.shape
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), i)), pa.array(np.tile(np.arange(i), k)), pa.array(list(matrices.reshape(k * i, -1)), schema.field("row").type)], schema=schema)


def _parts(kind: pa.DataType) -> tuple[pa.Schema, str]:
    return pa.schema([("k", pa.int64()), ("i", pa.int64()), ("row", pa.list_(kind))]), f"k long, i long, row array<{'long' if kind == pa.int64() else 'double'}>"


def _bounds(vectors: DataFrame) -> tuple[int, int, int]:
    """The most common length of a vector of finite entries, how many have it, and the greatest absolute integer."""
    schema = pa.schema([("size", pa.int64()), ("n", pa.int64()), ("top", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, int]] = {}
        for batch in batches:
            sizes = pc.unique(pc.list_value_length(batch.column(0)).drop_null())
            for size in (s for s in sizes.to_pylist() if s):
                _, x = integers(batch.column(0), size)
                if len(x):
                    n, top = seen.get(size, (0, 0))
                    seen[size] = n + len(x), max(top, abs(int(x.max())), abs(int(x.min())))
        yield pa.RecordBatch.from_pylist([{"size": s, "n": n, "top": top} for s, (n, top) in seen.items()], schema=schema)

    found = vectors.mapInArrow(count, "size long, n long, top long").groupBy("size").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    return next(((r["size"], r["n"], r["top"]) for r in found.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()), (0, 0, 0))


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Count, sums and scatter of all vectors of finite entries; nothing where there are none."""
    vectors = df.select(F.col(vector).alias("x"))
    size, n, top = _bounds(vectors)
    if not n:
        return None
    moduli = primes(2 * n * max(1, top) ** 2)
    schema, ddl = _parts(pa.int64())

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(moduli), size + 1, size + 1), np.int64)
        for batch in batches:
            _, x = integers(batch.column(0), size)
            for at in range(0, len(x), ROWS):
                some = np.hstack([np.ones((len(x[at : at + ROWS]), 1), np.int64), x[at : at + ROWS]])
                for k, p in enumerate(moduli):
                    r = (some % p).astype(float)
                    total[k] = (total[k] + (r.T @ r).astype(np.int64)) % p
        yield _rows(schema, total)

    residues = np.zeros((len(moduli), size + 1, size + 1), np.int64)
    for r in _added(vectors.mapInArrow(scatter, ddl)):
        residues[r.k, r.i, r.j] = r.v % moduli[r.k]
    exact = from_residues(residues, moduli)
    return Whitening(int(exact[0, 0]), exact[0, 1:], exact[1:, 1:], components)


def transform(df: DataFrame, model: Whitening, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id, deviation, whitened`` of every row whose vector the model takes; ``whitened`` has an entry a component."""
    size, matrix, own_mean = len(model.sums), model.matrix(), Whitening(model.n, model.sums, np.zeros(0), 0)
    schema = T.StructType([T.StructField("id", df.schema[id].dataType), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, x = integers(batch.column(1), size)
            if len(x):
                z = own_mean.centred(x) @ matrix
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(own)), pa.array(own_mean.deviations(x), pa.int64()), lists], names=["id", "deviation", "whitened"])

    return df.select(F.col(id).alias("id"), F.col(vector).alias("x")).mapInArrow(project, schema)


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The greatest absolute entry of the covariance of all whitened vectors minus the identity. What is multiplied is centred."""
    size, matrix, own_mean = len(model.sums), model.matrix(), Whitening(model.n, model.sums, np.zeros(0), 0)
    schema, ddl = _parts(pa.float64())
    width = matrix.shape[1]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1, width + 1, width + 1))
        for batch in batches:
            z = own_mean.centred(integers(batch.column(0), size)[1]) @ matrix
            z = np.hstack([np.ones((len(z), 1)), z])
            total[0] += z.T @ z
        yield _rows(schema, total)

    sums = np.zeros((width + 1, width + 1))
    for r in _added(df.select(F.col(vector).alias("x")).mapInArrow(moments, ddl)):
        sums[r.i, r.j] = r.v
    rest = sums[0, 1:] / model.n
    return float(np.abs(sums[1:, 1:] / model.n - np.outer(rest, rest) - np.eye(width)).max(initial=0.0))


def whiten(df: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: ``id, component, n, deviation, whitened, explained, identity_error, eigenvalue``."""
    model = fit(df, vector, components)
    if model is None or not len(model.eigen[0]):
        kind = df.schema[id].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"`{id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double")
    error = identity_error(df, model, vector)
    per = lambda values: F.get(F.array(*map(F.lit, values)), F.col("at"))
    out = transform(df, model, id, vector).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(id), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", per(model.explained).alias("explained"),
        F.lit(error).alias("identity_error"), per([float(e) for e in model.eigen[0]]).alias("eigenvalue"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.read_table(spark, sf_dir, "embeddings"))
