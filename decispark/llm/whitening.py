"""Embedding whitening by blockwise TSQR and one-sided Jacobi SVD (op13).

Vectors are fixed to whole numbers of 1/256. The fit list holds each distinct vector once, so
copies bear no weight. Its centred rows are compressed to one triangle R, block by block within
tasks and then by fans of triangles; the rows themselves never meet. Plane rotations make R's
columns orthogonal: their norms are the standard deviations times the root of the count, and the
accumulated rotations are the components. The covariance is never formed, so small deviations keep
their accuracy. Only sums, one triangle and the components (dimensions squared) reach the driver.

Edge cases: a vector that is null, empty or holds a null or non-finite entry is dropped, as is one
of another length than most distinct vectors have; entries beyond 64 bits are held at their limit; a null
id stays; repeated rows stay; components without variance (below 1e-12 of the largest) have a null
value and do not count in identity_error; deviations beyond 2**95 are null; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables

#: Steps to one; numbers that one step of work holds at a time.
STEPS, BLOCK = 256, 1 << 20
#: Least share of the largest variance that a component must have.
LEAST_VARIANCE = 1e-12


def fixed(vectors: DataFrame, key: str, vector: str, steps: int = STEPS) -> DataFrame:
    """key and x, the usable vectors in whole steps."""
    v = F.col(vector).cast("array<double>")
    usable = (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(key, F.transform(v, lambda c: F.floor(steps * c).cast("long")).alias("x"))


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, place: int = 0) -> Iterator[np.ndarray]:
    step = max(1, BLOCK // dims)
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            yield rows_of(batch.column(place).slice(i, step), dims)


def exact_sums(fit: DataFrame, dims: int) -> list[int]:
    """The sum of each entry over all rows, exact: high and low halves are summed apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for x in _blocks(batches, dims):
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(high), pa.array(low)], names=["i", "high", "low"])

    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    out = [0] * dims
    for r in fit.select("x").mapInArrow(run, "i int, high long, low long").groupBy("i").agg(total("high"), total("low")).collect():
        out[r["i"]] = (int(r["high"]) << 32) + int(r["low"])
    return out


def triangle(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of the centred rows: one a task, then fans of them until one is left."""
    dims = len(mean)

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dims))
        for x in _blocks(batches, dims):
            r = np.linalg.qr(np.vstack([r, x - mean]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["part", "r"])

    def joined(fan: pa.Table) -> pa.Table:
        r = np.linalg.qr(rows_of(fan.column("r").combine_chunks(), dims), mode="r")
        return pa.table({"part": fan.column("part").slice(0, 1), "r": pa.array([r.ravel()], pa.list_(pa.float64()))})

    parts, fan = fit.rdd.getNumPartitions(), max(2, min(32, (1 << 23) // (dims * dims)))
    found = fit.select("x").mapInArrow(compressed, "part int, r array<double>")
    while True:
        found = found.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("part").applyInArrow(joined, "part int, r array<double>")
        parts = -(-parts // fan)
        if parts <= 1:
            return np.array(found.collect()[0]["r"]).reshape(-1, dims)


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors as columns.

    Each round rotates disjoint pairs of columns; a sweep's rounds meet every pair once. It ends with a
    sweep in which no pair is further from orthogonal than rounding makes it.
    """
    dims = r.shape[1]
    u, v = np.array(r, float), np.eye(dims)
    ring = list(range(dims + dims % 2))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[: len(ring) // 2], ring[::-1], strict=False) if max(a, b) < dims]
            p, q = np.array(pairs, int).reshape(-1, 2).T
            a, b = (u[:, p] ** 2).sum(0), (u[:, q] ** 2).sum(0)
            g = (u[:, p] * u[:, q]).sum(0)
            far = np.abs(g) > 1e-15 * np.sqrt(a * b)
            if far.any():
                turned = True
                p, q = p[far], q[far]
                with np.errstate(over="ignore"):
                    z = (b - a)[far] / (2 * g[far])
                t = np.where(z < 0, -1.0, 1.0) / (np.abs(z) + np.hypot(1.0, z))
                c = 1 / np.hypot(1.0, t)
                for m in (u, v):
                    m[:, p], m[:, q] = c * m[:, p] - c * t * m[:, q], c * t * m[:, p] + c * m[:, q]
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if not turned:
            break
    norms = np.sqrt((u**2).sum(0))
    order = np.argsort(-norms, kind="stable")
    return norms[order], v[:, order] / np.sqrt((v[:, order] ** 2).sum(0))


@dataclass(frozen=True)
class Components:
    """What the fit list gives: its length, sums, mean, the kept components (columns, over their deviation), shares of variance and the check."""

    n: int
    sums: list[int]
    mean: np.ndarray
    projection: np.ndarray
    explained: list[float | None]
    identity_error: float | None


def identity_error(fit: DataFrame, mean: np.ndarray, projection: np.ndarray, n: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    dims, k = projection.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k + 1, k))
        for x in _blocks(batches, dims):
            w = (x - mean) @ projection
            sums += np.vstack([w.sum(0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size, dtype=np.int32)), pa.array(sums.ravel())], names=["i", "s"])

    total = np.zeros((k + 1) * k)
    for r in fit.select("x").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        total[r["i"]] = r["s"]
    total = total.reshape(k + 1, k) / n
    return float(np.abs(total[1:] - np.outer(total[0], total[0]) - np.eye(k)).max())


def fitted(fit: DataFrame, dims: int, components: int) -> Components:
    """The components of a written, distinct fit list that is not empty."""
    n, sums = fit.count(), exact_sums(fit, dims)
    mean = np.array([s / n for s in sums])
    norms, rotated = jacobi(triangle(fit, mean))
    variances = norms**2 / n
    kept = min(components, dims)
    real = int((variances[:kept] > LEAST_VARIANCE * variances[0]).sum()) if variances[0] > 0 else 0
    projection = rotated[:, :real] / np.sqrt(variances[:real])
    trace = float(variances.sum())
    explained = [float(e) / trace if trace > 0 else None for e in variances[:kept]]
    return Components(n, sums, mean, projection, explained, identity_error(fit, mean, projection, n) if real else None)


def projected(rows: DataFrame, key: str, dims: int, found: Components) -> DataFrame:
    """key, deviation (decimal) and w, the whitened values, of every row."""
    n, sums, mean, projection = found.n, found.sums, found.mean, found.projection
    most = max(map(abs, sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(sums, np.int64) if most < 2**62 else None
        for batch in batches:
            x = rows_of(batch.column(1), dims)
            reach = n * int(np.abs(x.astype(float)).max(initial=0) + 1) + most
            if whole is not None and dims * reach**2 < 2**63:
                square = ((n * x - whole) ** 2).sum(axis=1)
                high, low = square >> 32, square & 0xFFFFFFFF
            else:
                exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
                high, low = [e >> 32 if e < 2**95 else None for e in exact], [e & 0xFFFFFFFF for e in exact]
            w = (x - mean) @ projection
            offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], names=[key, "high", "low", "w"])

    schema = T.StructType([rows.schema[key], T.StructField("high", T.LongType()), T.StructField("low", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    d = rows.select(key, "x").mapInArrow(run, schema)
    return d.select(key, (F.col("high").cast("decimal(19,0)") * F.lit(4294967296) + F.col("low")).cast("decimal(38,0)").alias("deviation"), "w")


RESULT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4, steps: int = STEPS) -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error, a row for each usable vector and component."""
    tables = Tables(vectors.sparkSession, "whitening")
    rows = fixed(vectors, key, vector, steps)
    fit = tables.cut(rows.select("x").distinct(), "fit")
    lengths = fit.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], T.StructType([vectors.schema[key], *T.StructType.fromDDL(RESULT).fields]))
    dims = lengths["dims"]
    same = F.size("x") == dims
    found = fitted(fit.where(same), dims, components)
    d = projected(rows.where(same), key, dims, found)
    parts = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.get("w", F.lit(k)).alias("whitened"), F.lit(e).cast("double").alias("explained")) for k, e in enumerate(found.explained)])
    d = d.select(key, "deviation", F.explode(parts).alias("c"))
    return d.select(key, "c.component", F.lit(found.n).cast("long").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(found.identity_error).cast("double").alias("identity_error"))
