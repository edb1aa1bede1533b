"""Whitening of embeddings by LOBPCG, the locally optimal block preconditioned conjugate gradient method, here without a preconditioner.

The covariance is never formed. Each step sends one block of directions to the executors, which multiply their centred rows with it and the result with the rows again; only the sums, a
number for each dimension and direction, come back. The Rayleigh-Ritz problem is solved on the span of the iterate, its residuals and the previous directions, until the residuals
of the leading components, from a product made anew, certify them. The fit list (each distinct vector once) is written to the shared folder, so a lost executor costs only its own tasks.

Vectors are rounded down to multiples of 1/256 and handled as whole numbers x, so that n, their sums S, the trace and the deviations are exact; an entry beyond the range of a long is the end of that range.
The driver holds a few blocks of dimensions x directions and one row of sums a dimension, whatever the number of rows.

Cases: a row whose vector is null or empty, or holds null or non-finite entries, is dropped, as is one whose length is not the most frequent one (of equally frequent lengths the largest); a null vec_id is returned as
it is; rows given twice are returned twice and count once in the fit; components of the same eigenvalue are some orthonormal basis of their space; directions without variance, up to rounding, are no
components, so equal vectors, a single row or an empty table give no rows; a deviation that does not fit a long is null, ``deviation_text`` always has it; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import materialise, table

#: Components, directions of the block beyond them, bound of a residual against the largest eigenvalue, the bound that holds where rounding stops a better one, steps at most, seed of the first block.
COMPONENTS, GUARD, TOLERANCE, ROUNDING, STEPS, SEED = 4, 12, 1e-13, 1e-11, 300, 42
#: Eigenvalues below this share of the trace are rounding.
LEAST_SHARE = 1e-13
SCALE = 256
LONG = 2**63


def whole_numbers(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``rows`` with ``x``, floor(256 c) of each entry, in place of the vector; rows without a usable vector go."""
    c = F.col(vector)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = rows.where(c.isNotNull() & (F.size(c) > 0) & finite)
    sizes = kept.groupBy(F.size(c).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    kept = kept.where(F.size(c) == (sizes[0]["d"] if sizes else 0))
    return kept.withColumn("x", F.transform(c, lambda v: F.floor(v.cast("double") * SCALE))).drop(vector)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.int64)


def _roomy(x: np.ndarray, *bounds: int) -> np.ndarray:
    """``x`` as it is where sums of the given sizes fit 64 bits, else as Python's numbers."""
    return x if max(bounds) < LONG else x.astype(object)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


@dataclass
class Sums:
    """Rows, and for each dimension the sum and the sum of squares of the fit list, exact."""

    n: int
    s: list[int]
    q: list[int]

    def trace(self) -> float:
        return sum(self.n * q - s * s for s, q in zip(self.s, self.q)) / self.n**2

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.s])


def sums(fit: DataFrame) -> Sums:
    """The sums of a fit list: a row a dimension and task, added up by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, 0, 0
        for batch in batches:
            x = _matrix(batch.column(0))
            big = _largest(x)
            x = _roomy(x, len(x) * big * big, len(x) * big)
            n, s, q = n + len(x), s + x.sum(axis=0).astype(object), q + (x * x).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(s)), pa.int32()), pa.array([n] * len(s), pa.int64()), pa.array(map(str, s), pa.string()), pa.array(map(str, q), pa.string())], names=["i", "n", "s", "q"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            for i, *values in zip(*(c.to_pylist() for c in batch.columns)):
                total[i] = [a + int(b) for a, b in zip(total.get(i, (0, 0, 0)), values)]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t[0] for t in total.values()], pa.int64()), *(pa.array([str(t[k]) for t in total.values()], pa.string()) for k in (1, 2))], names=["i", "n", "s", "q"])

    schema = "i int, n long, s string, q string"
    rows = sorted(fit.select("x").mapInArrow(run, schema).repartition("i").mapInArrow(add, schema).collect())  # a row a dimension
    return Sums(rows[0]["n"] if rows else 0, [int(r["s"]) for r in rows], [int(r["q"]) for r in rows])


def added_up(fit: DataFrame, partial, rows: int, columns: int) -> np.ndarray:
    """The sum over the fit list of ``partial`` (a batch's matrix to a matrix of rows x columns): a number an entry and task is shuffled, one an entry is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for batch in batches:
            if len(batch):
                total += partial(_matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(range(rows * columns), pa.int32()), pa.array(total.ravel())], names=["at", "v"])

    out = np.zeros(rows * columns)
    for r in fit.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # rows x columns
        out[r["at"]] = r["v"]
    return out.reshape(rows, columns)


def covariance_product(fit: DataFrame, total: Sums, block: np.ndarray) -> np.ndarray:
    """The covariance of the fit list times ``block``, from products of centred rows."""
    mean = total.mean()

    def partial(x: np.ndarray) -> np.ndarray:
        c = x - mean
        return c.T @ (c @ block)

    return added_up(fit, partial, *block.shape) / total.n


def _independent(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to the orthonormal columns ``against``; directions that add nothing but rounding go."""
    for _ in range(2):  # the second time takes away what rounding has left
        block = block - against @ (against.T @ block)
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
        if not block.shape[1]:
            return block
        u, d, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, d > 1e-8 * d[0]]
    return block[:, : against.shape[0] - against.shape[1]]


@dataclass
class Components:
    """``vectors``: a column a component, by falling ``values``; ``residual``: the largest norm of V v - e v, against the first eigenvalue; ``steps``: products made."""

    values: np.ndarray
    vectors: np.ndarray
    residual: float
    steps: int


def lobpcg(product, dimensions: int, components: int = COMPONENTS, guard: int = GUARD, tolerance: float = TOLERANCE) -> Components:
    """The leading eigenvectors of the symmetric matrix behind ``product`` (a block to the matrix times the block), with certified residuals."""
    width, wanted = min(dimensions, components + guard), min(dimensions, components)
    x = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dimensions, width)))[0]
    ax, p, fresh, best, stuck = product(x), np.zeros((dimensions, 0)), True, np.inf, 0
    for step in range(1, STEPS + 1):
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, ax = x @ turn, ax @ turn
        residuals = ax - x * values
        size = float(np.linalg.norm(residuals[:, :wanted], axis=0).max())
        scale = max(float(values[0]), 0.0)
        stuck, best = (0, size) if size < best / 2 else (stuck + 1, best)
        if size <= tolerance * scale or (stuck >= 6 and size <= ROUNDING * scale):
            if fresh:
                return Components(values[:wanted], x[:, :wanted], size / scale if scale else 0.0, step)
            x = np.linalg.qr(x)[0]
            ax, p, fresh = product(x), p[:, :0], True  # certified by a product made anew
            continue
        basis = _independent(np.hstack([residuals, p]), x)
        if not basis.shape[1]:
            x, p = np.linalg.qr(x)[0], p[:, :0]
            ax, fresh = product(x), True
            continue
        both, images = np.hstack([x, basis]), np.hstack([ax, product(basis)])
        gram = both.T @ images
        _, ritz = np.linalg.eigh((gram + gram.T) / 2)
        ritz = ritz[:, ::-1][:, :width]
        x, ax, p, fresh = both @ ritz, images @ ritz, basis @ ritz[width:], False
    raise ArithmeticError(f"residual {size} after {STEPS} steps")


def deviations(x: np.ndarray, total: Sums) -> list[int]:
    """The sum over dimensions of (n x - S)^2 of each row, exact: n^2 x.x - 2 n x.S + S.S."""
    big, top = _largest(x), max(map(abs, total.s))
    x = _roomy(x, x.shape[1] * big * max(big, top), top)
    s = np.array(total.s, x.dtype)
    square = sum(v * v for v in total.s)
    return [total.n**2 * int(a) - 2 * total.n * int(b) + square for a, b in zip((x * x).sum(axis=1), (x * s).sum(axis=1))]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error, eigenvalue, residual, deviation_text): a row for each usable row and component."""
    schema = f"`{key}` long, component int, n long, deviation long, whitened double, explained double, identity_error double, eigenvalue double, residual double, deviation_text string"
    usable = whole_numbers(rows.select(F.col(key).cast("long").alias(key), vector), vector)
    fit = materialise(usable.select("x").distinct(), "fit-list")
    total = sums(fit)
    trace = total.trace() if total.n else 0.0
    if not trace > 0:
        return rows.sparkSession.createDataFrame([], schema)
    found = lobpcg(lambda block: covariance_product(fit, total, block), len(total.s), components)
    real = found.values > LEAST_SHARE * trace
    values, vectors, mean = found.values[real], found.vectors[:, real], total.mean()
    turn = vectors / np.sqrt(values)
    middle = added_up(fit, lambda x: ((x - mean) @ turn).sum(axis=0, keepdims=True), 1, len(values)) / total.n

    def square(x: np.ndarray) -> np.ndarray:
        z = (x - mean) @ turn - middle
        return z.T @ z

    error = float(np.abs(added_up(fit, square, len(values), len(values)) / total.n - np.eye(len(values))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            z, far, m = (x - mean) @ turn, deviations(x, total), len(x)
            each = lambda v: np.tile(v, m)
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(each(np.arange(1, k + 1, dtype=np.int32))), pa.array([total.n] * (m * k), pa.int64()), pa.array([f if f < LONG else None for f in far for _ in range(k)], pa.int64()), pa.array(z.ravel())]
            columns += [pa.array(each(values / trace)), pa.array(np.full(m * k, error)), pa.array(each(values)), pa.array(np.full(m * k, found.residual)), pa.array([str(f) for f in far for _ in range(k)])]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error", "eigenvalue", "residual", "deviation_text"])

    return usable.select(key, "x").mapInArrow(run, schema)


def op13_whitening(spark, sf_dir):
    """The four leading whitened components of each usable row of embeddings."""
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def whitening_base(spark, sf_dir):
    """vec_id, n and deviation of each usable row of embeddings: the exact columns of ``op13_whitening``, for SQL."""
    return op13_whitening(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation")


#: The exact columns, where vectors differ and their lengths do not.
BASE_SQL = f"""
with u as (select vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::double)::bigint) as x from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
f as (select distinct x from u), n as (select count(*) as n from f),
s as (select i, sum(x[i])::hugeint as s from (select x, unnest(range(1, len(x) + 1)) as i from f) group by i), l as (select list(s order by i) as s from s)
select vec_id, n, list_sum(list_transform(list_zip(x, s), lambda p: (n * p[1] - p[2]) * (n * p[1] - p[2])))::bigint as deviation from u, n, l
"""
