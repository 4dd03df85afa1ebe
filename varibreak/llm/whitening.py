"""Embedding whitening from exact covariances: bit-sliced cross-products, centred as integers before ``eigh``.

Every component c becomes the integer floor(256 * c).  A task takes a batch of distinct vectors, shifts each dimension
by its least value in the batch, and packs each bit plane of each dimension across the rows into 64-bit words.  The
cross-product of two dimensions is the sum of 2**(p + q) times the ones in the AND of their planes p and q; with the
batch's sums the shift is taken out again, so that batches add up to the exact cross-products of all vectors.  The
driver receives only the sums per pair of dimensions (at most ``MAX_DIMENSIONS`` dimensions, checked), centres them as
Python integers and takes the eigenvectors.  A second pass projects the vectors.

Defined cases: vectors that are NULL or hold a NULL or non-finite entry are dropped; a vector shorter than the longest
is filled with 0; the fit list holds each distinct vector once, but repeated rows and rows without an id are returned
each; without variance along a component ``whitened`` is NULL; an empty table gives no rows; an entry of 2**44 or more
(in units of 1/256: 2**52) is an error, as doubles there no longer hold the integers of the result.  Only the named
columns are read, so extra columns do not matter.
"""

from __future__ import annotations

import uuid
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpoint_folder
from .topk import usable

MAX_DIMENSIONS = 4096
LARGEST = 1 << 52


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of longs as the rows of a matrix, shorter ones filled with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def bit_planes(shifted: np.ndarray) -> np.ndarray:
    """Planes (bits, dimensions, words) of a matrix of non-negative integers: bit p of each row, packed by 64 rows."""
    rows, width = shifted.shape
    bits = max(1, int(shifted.max()).bit_length()) if rows else 1
    words = -(-rows // 64)
    out = np.zeros((bits, width, words * 8), dtype=np.uint8)
    for p in range(bits):
        packed = np.packbits((shifted >> p & 1).astype(np.uint8), axis=0)
        out[p, :, : len(packed)] = packed.T
    return out.view(np.uint64)


def cross_products(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Sums of each dimension and, for i, of x_i * x_j for j >= i; exact Python integers."""
    rows, width = x.shape
    least = x.min(axis=0)
    planes = bit_planes(x - least)
    bits = len(planes)
    narrow = 2 * bits + rows.bit_length() <= 62
    kind = np.int64 if narrow else object
    weight = np.array([1 << p for p in range(bits)], dtype=kind)
    low = [int(v) for v in least]
    shifted_sum = [int(v) for v in np.bitwise_count(planes).sum(axis=2, dtype=np.int64).astype(kind).T @ weight]
    products = []
    for i in range(width):
        both = np.zeros(width - i, dtype=kind)
        for p in range(bits):
            ones = np.bitwise_count(planes[p, i] & planes[:, i:]).sum(axis=2, dtype=np.int64).astype(kind)
            both = both + weight[p] * (weight @ ones)
        # x = u + low, so x_i x_j = u_i u_j + low_i u_j + low_j u_i + low_i low_j
        products.append([
            int(b) + low[i] * shifted_sum[j] + low[j] * shifted_sum[i] + rows * low[i] * low[j] for j, b in enumerate(both, start=i)
        ])
    return [s + rows * v for s, v in zip(shifted_sum, low)], products


def _moments(fit: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """Rows, sums and cross-products (upper triangle by row) of the vectors ``x`` of ``fit``."""

    def batch_sums(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                x = matrix(batch.slice(at, 8192).column(0), width)
                sums, products = cross_products(x)
                flat = [len(x), *sums, *(v for row in products for v in row)]
                place = np.arange(len(flat), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array([Decimal(v) for v in flat], pa.decimal128(38, 0))], ["place", "value"])

    parts = fit.select("x").mapInArrow(batch_sums, "place int, value decimal(38,0)")
    rows = {r.place: int(r.value) for r in parts.groupBy("place").agg(F.sum("value").alias("value")).collect()}
    if not rows:
        return 0, [], []
    products, at = [], 1 + width
    for i in range(width):
        products.append([rows[at + j] for j in range(width - i)])
        at += width - i
    return rows[0], [rows[1 + d] for d in range(width)], products


def components(n: int, sums: list[int], products: list[list[int]], keep: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors (columns) and eigenvalues of the covariance by falling eigenvalue, and its trace.

    n * (cross-products) - sums * sums is the centred matrix times n**2; it is formed in integers and rounded once.
    A direction whose eigenvalue is within rounding of 0 has eigenvalue 0.
    """
    width = len(sums)
    cov = np.empty((width, width))
    for i in range(width):
        for j in range(i, width):
            cov[i, j] = cov[j, i] = (n * products[i][j - i] - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:keep]
    values, vectors = values[order], vectors[:, order]
    top = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[top, np.arange(len(order))] < 0, -1.0, 1.0)
    noise = max(float(np.abs(cov).max()), 0.0) * width * np.finfo(float).eps
    return vectors, np.where(values > noise, values, 0.0), float(np.trace(cov))


def whiten(table: DataFrame, keep: int = 4, scale: int = 256) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact`` of ``vec_id, embedding``.

    ``deviation`` is NULL where the exact number does not fit a long; ``deviation_exact`` is a decimal of 38 digits.
    """
    spark = table.sparkSession
    rows = table.select("vec_id", "embedding").filter(usable(F.col("embedding")))
    wide = F.exists("embedding", lambda c: F.abs(c.cast("double") * scale) >= LARGEST)
    entry = lambda c: F.floor(c.cast("double") * scale).cast("long")
    vectors = F.when(wide, F.raise_error(F.lit("an embedding entry is too large to whiten exactly"))).otherwise(F.transform("embedding", entry))
    rows = rows.select("vec_id", vectors.cast("array<long>").alias("x"))

    kind = dict(rows.dtypes)["vec_id"]
    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, "
              "deviation_exact decimal(38,0)")
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:  # no vectors, or only empty ones
        return spark.createDataFrame([], schema)
    if width > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {width} dimensions; at most {MAX_DIMENSIONS}")
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
    folder = f"{checkpoint_folder(spark).rstrip('/')}/whitening-{uuid.uuid4().hex}"
    rows.select(padded.alias("x")).distinct().write.parquet(folder)  # read twice below; small integers pack well
    fit = spark.read.parquet(folder)
    n, sums, products = _moments(fit, width)
    vectors, values, trace = components(n, sums, products, keep)
    real = np.flatnonzero(values > 0)
    mean = np.array([s / n for s in sums])
    turn = vectors[:, real] / np.sqrt(values[real])
    identity_error = _identity_error(fit, width, n, mean, turn) if len(real) else None
    square, total = sum(s * s for s in sums), n
    count = vectors.shape[1]
    share = [float(v / trace) if trace > 0 else 0.0 for v in values]

    def project(batches):
        for batch in batches:
            ids = batch.column(0)
            x = matrix(batch.column(1), width)
            exact = []
            norms, along = _dots(x, sums)
            for q, p in zip(norms, along):
                exact.append(total * total * q - 2 * total * p + square)  # sum of (n x - S)**2, expanded
            score = np.full((len(x), count), np.nan)
            score[:, real] = (x - mean) @ turn
            deviation = [v if v < 1 << 63 else None for v in exact]
            for c in range(count):
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.full(len(x), c + 1, np.int32)), pa.array(np.full(len(x), total, np.int64)), pa.array(deviation, pa.int64()),
                    pa.array(score[:, c], pa.float64(), mask=np.isnan(score[:, c])), pa.array(np.full(len(x), share[c])),
                    pa.array([identity_error] * len(x), pa.float64()), pa.array(map(Decimal, exact), pa.decimal128(38, 0)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return rows.mapInArrow(project, schema)


def _dots(x: np.ndarray, sums: list[int]) -> tuple[list[int], list[int]]:
    """x . x and x . sums of every row as Python integers."""
    width, most = x.shape[1], int(np.abs(x).max(initial=0))
    safe = most * most * width < 1 << 62
    norms = (x * x).sum(axis=1) if safe else (x.astype(object) ** 2).sum(axis=1)
    safe = most * max(map(abs, sums)) * width < 1 << 62
    along = x @ np.array(sums, dtype=np.int64) if safe else x.astype(object) @ np.array(sums, dtype=object)
    return [int(v) for v in norms], [int(v) for v in along]


def _identity_error(fit: DataFrame, width: int, n: int, mean: np.ndarray, turn: np.ndarray) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over the fit list.

    Batches give their rows, mean and centred products, which are merged on the driver, one small row per task.
    """
    size = turn.shape[1]

    def partial(batches):
        held = None
        for batch in batches:
            z = (matrix(batch.column(0), width) - mean) @ turn
            if len(z):
                held = _merge(held, (len(z), z.mean(axis=0), (z - z.mean(axis=0)).T @ (z - z.mean(axis=0))))
        if held:
            yield pa.RecordBatch.from_pydict({"n": [held[0]], "mean": [held[1].tolist()], "products": [held[2].ravel().tolist()]})

    held = None
    for part in fit.select("x").mapInArrow(partial, "n long, mean array<double>, products array<double>").collect():
        held = _merge(held, (part.n, np.array(part.mean), np.array(part.products).reshape(size, size)))
    return float(np.abs(held[2] / n - np.eye(size)).max())


def _merge(a, b):
    if a is None:
        return b
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)
