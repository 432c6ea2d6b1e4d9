"""Embedding whitening by Jacobi-Davidson.

The covariance is never formed: all that the solver asks of the data are products with a few vectors, and each of them is one
pass in which every task centres its rows, multiplies and adds up. The driver holds the subspace (at most BASIS blocks of
vectors of one dimension's length), solves the small Rayleigh-Ritz problem there, and expands the subspace by corrections: the
projected equations of all open components are solved at the same time by an inner MINRES, one product a step for all of
them. Components whose residual is down to rounding are locked and projected out.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import written

COMPONENTS = 8
BASIS, STEPS, ROUNDS = 5, 8, 300  # blocks in the subspace, products of an inner solution and rounds, at most
LEAST = 1e-12  # components with less than this part of the first one's variance are rounding, and have no whitening
SLOTS = 64  # partial sums that reach the driver
ROWS = 4096  # rows that are multiplied at once

Product = Callable[[np.ndarray], np.ndarray]


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(1024 c) of the vectors whose entries are all finite; of others no row is left."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("v"))
    whole = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(whole).select("vec_id", F.transform("v", lambda c: F.floor(c * 1024).cast("long")).alias("x"))


def _matrices(batches, width: int):
    """(rows, x as a matrix) of the batches, ROWS at a time; a shorter vector goes on with zeros."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            part = batch.slice(first, ROWS)
            column = part.column(part.schema.get_field_index("x"))
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            if (sizes == width).all():
                yield part, flat.reshape(-1, width)
            else:
                x = np.zeros((len(sizes), width), np.int64)
                x[np.arange(width) < sizes[:, None]] = flat
                yield part, x


def _added(rows: DataFrame, schema: str, per_task: Callable, add: Callable) -> list[dict]:
    """At most SLOTS rows: what `per_task` yields for the batches of a task, added up by slot."""
    slots = rows.mapInArrow(lambda b: (pa.RecordBatch.from_pylist([{"slot": TaskContext.get().partitionId() % SLOTS, **r}]) for r in per_task(b)), f"slot long, {schema}")
    out = slots.groupBy("slot").applyInArrow(lambda t: pa.Table.from_pylist([{"slot": t.column("slot")[0].as_py(), **add(t.drop_columns(["slot"]).to_pylist())}]), f"slot long, {schema}")
    return [r.asDict() for r in out.collect()]


def _add_exact(parts: list[dict]) -> dict:
    """n, the greatest |x| and the sums by dimension, as decimal texts of any length."""
    columns = [[int(v) for v in json.loads(p["sums"])] for p in parts]
    return {"n": sum(p["n"] for p in parts), "most": str(max((int(p["most"]) for p in parts), default=0)), "sums": json.dumps([str(sum(c)) for c in zip(*columns, strict=True)])}


def exact_sums(rows: DataFrame, width: int) -> tuple[int, int, list[int]]:
    def per_task(batches):
        n, most, sums = 0, 0, [0] * width
        for _, x in _matrices(batches, width):
            n, most = n + len(x), max(most, abs(int(x.min())), abs(int(x.max())))
            high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
            sums = [s + (h << 32) + w for s, h, w in zip(sums, high, low, strict=True)]
        if n:
            yield {"n": n, "most": str(most), "sums": json.dumps(list(map(str, sums)))}

    total = _add_exact(_added(rows, "n long, most string, sums string", per_task, _add_exact))
    return total["n"], int(total["most"]), [int(s) for s in json.loads(total["sums"])]


def _add_pairs(parts: list[dict]) -> dict:
    total = sum(np.frombuffer(p["high"], "<f8").astype(np.longdouble) + np.frombuffer(p["low"], "<f8") for p in parts)
    high = np.asarray(total, "<f8")
    return {"high": high.tobytes(), "low": np.asarray(total - high, "<f8").tobytes()}


def summed(rows: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum of `part(x)`, a flat array, over all rows' matrices; sums of blocks are added in longer floats, so their number
    costs no precision."""

    def per_task(batches):
        total = None
        for _, x in _matrices(batches, width):
            more = part(x).astype(np.longdouble)
            total = more if total is None else total + more
        if total is not None:
            high = np.asarray(total, "<f8")
            yield {"high": high.tobytes(), "low": np.asarray(total - high, "<f8").tobytes()}

    parts = _added(rows, "high binary, low binary", per_task, _add_pairs)
    return np.frombuffer(_add_pairs(parts)["high"], "<f8").copy() if parts else None


class Centre:
    """Exact centred vectors: n * x - S, in 64 bits where they fit, else in integers of any length."""

    def __init__(self, n: int, most: int, sums: list[int]):
        fits = n * most + max(map(abs, sums), default=0) < 1 << 62
        self.n, self.fits, self.sums = n, fits, np.array(sums, np.int64 if fits else object)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return self.n * (x if self.fits else x.astype(object)) - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of scaled(x); None beyond 64 bits."""
        y = self.scaled(x)
        about = (y.astype(np.float64) ** 2).sum(1)
        if self.fits and (about < 9e18).all():
            return (y * y).sum(1).tolist()
        exact = (int(sum(int(v) ** 2 for v in row)) if a < 1e19 else 1 << 63 for row, a in zip(y.tolist(), about.tolist(), strict=True))
        return [e if e < 1 << 63 else None for e in exact]


def _orthonormal(new: np.ndarray, base: np.ndarray) -> np.ndarray:
    """A basis of what the columns `new` add to the orthonormal columns `base`."""
    out = base[:, :0]
    for column in new.T:
        size = np.linalg.norm(column)
        for _ in range(3):
            for known in (base, out):
                column = column - known @ (known.T @ column)
        left = np.linalg.norm(column)
        if size > 0 and left > 1e-8 * size:
            column = column / left
            for known in (base, out):
                column = column - known @ (known.T @ column)
            out = np.column_stack((out, column / np.linalg.norm(column)))
    return out


def minres(apply: Product, rhs: np.ndarray, steps: int, goal: float) -> np.ndarray:
    """For every column an x with apply(x) close to rhs: independent MINRES runs that share each product."""
    some = lambda z: np.where(z == 0, 1.0, z)
    size = np.linalg.norm(rhs, axis=0)
    x, old, now = np.zeros_like(rhs), np.zeros_like(rhs), rhs / some(size)
    way_old, way = np.zeros_like(rhs), np.zeros_like(rhs)
    cos = cos_old = np.ones_like(size)
    sin = sin_old = np.zeros_like(size)
    left, beta = size.copy(), size.copy()
    for _ in range(steps):
        y = apply(now)
        alpha = (now * y).sum(0)
        y = y - alpha * now - beta * old
        after = np.linalg.norm(y, axis=0)
        first = cos * alpha - cos_old * sin * beta
        length = some(np.hypot(first, after))
        step = (now - sin_old * beta * way_old - (sin * alpha + cos_old * cos * beta) * way) / length
        cos_old, sin_old, cos, sin = cos, sin, first / length, after / length
        x = x + cos * left * step
        left = -sin * left
        way_old, way, old, now, beta = way, step, now, y / some(after), after
        if (np.abs(left) <= goal * size).all():
            break
    return x


def jacobi_davidson(product: Product, width: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The `count` greatest eigenvalues, falling, and eigenvectors (columns) of the symmetric positive matrix behind `product`,
    with residuals of the order of rounding."""
    count = min(count, width)
    tolerance = np.finfo(float).eps * (32 + np.sqrt(width))
    basis = _orthonormal(np.random.default_rng(11).standard_normal((width, min(width, 2 * count))), np.zeros((width, 0)))
    image = product(basis)
    locked = np.zeros((width, 0))
    for turn in range(ROUNDS):
        small = basis.T @ image
        values, turned = np.linalg.eigh((small + small.T) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        basis, image = basis @ turned, image @ turned
        apart = image - basis * values
        if locked.shape[1]:
            apart = apart - locked @ (locked.T @ apart)
        residual = np.linalg.norm(apart, axis=0)
        scale = top if locked.shape[1] else max(values[0], np.finfo(float).tiny)
        top = scale
        done = 0
        while done < min(len(values), count - locked.shape[1]) and residual[done] <= tolerance * scale:
            done += 1
        if done:
            locked = np.column_stack((locked, basis[:, :done]))
            basis, image, values, apart, residual = basis[:, done:], image[:, done:], values[done:], apart[:, done:], residual[done:]
        if locked.shape[1] == count:
            final = _orthonormal(locked, locked[:, :0])
            found = product(final)
            values, turned = np.linalg.eigh((final.T @ found + found.T @ final) / 2)
            values, turned = values[::-1], turned[:, ::-1]
            vectors, found = final @ turned, found @ turned
            if (np.linalg.norm(found - vectors * values, axis=0) <= 4 * tolerance * max(values[0], np.finfo(float).tiny)).all():
                return values, vectors
            basis, image = np.column_stack((vectors, basis)), np.column_stack((found, product(basis)))  # not yet: all are open again
            locked = locked[:, :0]
            continue
        open_now = min(count - locked.shape[1], basis.shape[1])
        out = np.column_stack((locked, basis[:, :open_now]))
        project = lambda z, out=out: z - out @ (out.T @ z)
        shift = values[:open_now]
        wrong = -project(project(apart[:, :open_now]))
        equation = lambda z, shift=shift, project=project: project(product(z) - z * shift)
        correction = minres(equation, wrong, STEPS, max(0.5 ** (turn + 1), 1e-3))
        if basis.shape[1] + open_now > min(width, BASIS * count):
            basis, image = basis[:, : 2 * count], image[:, : 2 * count]
        new = _orthonormal(np.column_stack((correction, wrong)) if turn % 2 == 0 else correction, np.column_stack((locked, basis)))
        if not new.shape[1]:  # the subspace is whole, or the corrections are at rounding: fresh products
            basis = _orthonormal(basis, locked)
            image = product(basis)
            tolerance *= 2
            continue
        basis, image = np.column_stack((basis, new)), np.column_stack((image, product(new)))
    raise RuntimeError(f"residuals are above rounding after {ROUNDS} rounds")


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each vector and each of the first components.

    Vectors that are null, or hold null, NaN or infinite entries, have no rows. Repeated rows and null ids are ordinary rows;
    other columns are not read. A vector shorter than the longest one goes on with zeros; entries beyond the range of a long
    count as its ends. Components without variance (less than LEAST of the first one's) cannot be whitened and have no rows,
    so an empty table, one vector or equal vectors give none. deviation is null where it does not fit in a long.
    """
    spark = df.sparkSession
    rows = written(integer_vectors(df, id_col, vec_col), "vectors")
    schema = T.StructType([
        rows.schema["vec_id"], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return spark.createDataFrame([], schema)
    vectors = rows.select("x")
    n, most, sums = exact_sums(vectors, width)
    centre = Centre(n, most, sums)

    def product(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centre.centred(x)
            return (c.T @ (c @ block)).ravel()

        return summed(vectors, width, part).reshape(block.shape) / n

    trace = summed(vectors, width, lambda x: np.array([(centre.centred(x) ** 2).sum()]))[0] / n
    if not trace > 0:
        return spark.createDataFrame([], schema)
    values, axes = jacobi_davidson(product, width, components)
    kept = values > LEAST * values[0]
    values, axes = values[kept], axes[:, kept]
    k = len(values)
    white = lambda x: (centre.centred(x) @ axes) / np.sqrt(values)
    mean = summed(vectors, width, lambda x: white(x).sum(0)) / n
    spread = summed(vectors, width, lambda x: ((w := white(x) - mean).T @ w).ravel()).reshape(k, k) / n
    error = float(np.abs(spread - np.eye(k)).max())
    explained = values / trace

    def out(batches):
        for part, x in _matrices(batches, width):
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(part.schema.get_field_index("vec_id")).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, np.int64)), pa.array([v for v in centre.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array(white(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(out, schema)
