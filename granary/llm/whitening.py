"""Embedding whitening: eigenvectors in single precision, refined to double by matrix products.

Vectors become integers, floor(scale * c). Over the distinct vectors (the fit list) Spark sums first the components, then
the products of components centred at the rounded mean. These are integers, so the sums are exact and do not depend on the
order of rows, tasks or machines; the covariance is their exact quotient. A float32 eigensolver gives first vectors;
Ogita-Aishima steps X + X E, which need matrix products only, correct them in extended precision, doubling the right digits
with each step. Eigenvalues closer than the step can tell apart form clusters: each is solved anew as a small problem inside its
own subspace, shifted by its mean, and the steps go on with vectors that the shift has separated.

Only matrices of the size of a vector pass the driver; vectors never do. Equal vectors collapse map-side before the
shuffle, so a vector that holds a third of all rows costs one row per task.

Behaviour at the edges: rows with a null vector, or one with a null or non-finite entry, are dropped; a vector shorter than the longest
counts as continued by zeros; entries beyond a long are cut to it; repeated rows get a result each; a component without
variance has a null `whitened`; `deviation` is null where a long can't hold it; an empty table gives an empty result;
other columns are fields of `row`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from granary.session import scratch_path

SCALE, STEPS, COMPONENTS = 256, 40, 4
_SPLIT = 1 << 60  # sums travel as two decimals, so that 38 digits hold each
Matrix = np.ndarray


# --- symmetric eigenproblem -----------------------------------------------------------------------------------------


def refine_step(a: Matrix, x: Matrix) -> tuple[Matrix, Matrix, Matrix, float]:
    """One Ogita-Aishima step: better vectors, eigenvalues, which pairs were too close to tell apart, size of the step.

    Pairs closer than the root of the working precision count as too close at any step: rounding alone would turn them
    by more than the next step can put right.
    """
    one = np.eye(len(a), dtype=a.dtype)
    r = one - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    norm = np.sqrt((a * a).sum())
    off = s - np.diag(np.diag(s))
    delta = max(2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum())), norm * np.sqrt(np.finfo(a.dtype).eps))
    gap = values[None, :] - values[:, None]
    close = np.abs(gap) <= delta
    e = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
    return x + x @ e, values, close & ~one.astype(bool), float(np.abs(e).max())


def clusters(close: Matrix) -> list[list[int]]:
    """Indices linked by `close`, groups of two or more."""
    left, out = set(range(len(close))), []
    while left:
        group, todo = [], [left.pop()]
        while todo:
            i = todo.pop()
            group.append(i)
            near = {int(j) for j in np.flatnonzero(close[i])} & left
            left -= near
            todo.extend(near)
        if len(group) > 1:
            out.append(sorted(group))
    return out


def solve_cluster(a: Matrix, x: Matrix, group: list[int], values: Matrix) -> Matrix:
    """The vectors of `group`, turned inside their own subspace to those of the small problem shifted by its mean."""
    one = np.eye(len(group), dtype=a.dtype)
    q = x[:, group]
    for _ in range(3):  # orthonormal within working precision
        q = q @ (3 * one - q.T @ q) / 2
    shifted = a - values[group].mean() * np.eye(len(a), dtype=a.dtype)
    small = q.T @ (shifted @ q)
    size = np.abs(small).max()
    if size == 0:
        return q
    turn = np.linalg.eigh((((small + small.T) / 2) / size).astype(np.float64))[1].astype(a.dtype)
    return q @ turn @ (3 * one - turn.T @ turn) / 2


def eigenvectors(covariance: Matrix, steps: int = STEPS) -> tuple[Matrix, Matrix]:
    """(eigenvalues falling, unit vectors in columns) of a symmetric matrix in extended precision."""
    a = covariance.astype(np.longdouble)
    size = np.abs(a).max() if a.size else 0
    if size == 0:
        return np.zeros(len(a), np.longdouble), np.eye(len(a), dtype=np.longdouble)
    a = a / size
    _, first = np.linalg.eigh(a.astype(np.float32))
    x = first.astype(np.longdouble)
    before, sure, settled = np.inf, None, 1e-6
    for _ in range(steps):
        x, values, close, moved = refine_step(a, x)
        groups = clusters(close)
        if moved < settled and 2 * moved > before and groups == sure:
            break  # only rounding moves on; what still clusters has equal eigenvalues, any basis of their space will do
        if moved < settled:
            for g in groups:
                x[:, g] = solve_cluster(a, x, g, values)
        before, sure = moved, groups
    for _ in range(2):
        x = x @ (3 * np.eye(len(a), dtype=a.dtype) - x.T @ x) / 2
    values = refine_step(a, x)[1]
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order] * size
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(a))])
    return values, x / np.sqrt((x * x).sum(axis=0)) * sign


# --- sums over vectors ----------------------------------------------------------------------------------------------


def usable(vector: str) -> Column:
    """A vector without null or non-finite entries."""
    sound = F.forall(F.col(vector), lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c.cast("double")))
    return F.col(vector).isNotNull() & F.coalesce(sound, F.lit(False))


def integers(vector: str, scale: int = SCALE) -> Column:
    return F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * scale) + F.lit(0).cast("long"))


def _matrix(column: pa.Array, dims: int) -> Matrix:
    """The rows of an array column as a matrix, short ones continued by zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), flat.dtype)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def _most(x: Matrix) -> float:
    return float(np.abs(x.astype(np.float64)).max(initial=0))


def _products(z: Matrix) -> Matrix:
    """z.T @ z of integers, exact: by floating products where 53 bits hold them, else by whole numbers of any size."""
    most = int(max(abs(int(z.max())), abs(int(z.min())))) if z.size else 0
    rows = 0 if z.dtype == object else max((1 << 53) // max(most * most, 1), 1)
    total = np.zeros((z.shape[1], z.shape[1]), object)
    if rows < 64:
        big = z.astype(object)
        return total + big.T @ big
    for i in range(0, len(z), rows):
        part = z[i : i + rows].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _summed(fit: DataFrame, dims: int, centre: list[int] | None) -> dict[tuple[int, int], int]:
    """Exact sums over the fit list: of the components, or of their products around `centre` with `centre` given."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(dims if centre is None else (dims, dims), object), False
        for batch in batches:
            x, seen = _matrix(batch.column(0), dims), seen or batch.num_rows > 0
            if centre is None:
                wide = _most(x) > (1 << 62) // max(len(x), 1)
                total = total + (x.astype(object) if wide else x).sum(axis=0).astype(object)
            else:
                far = max(_most(x), max(map(abs, centre))) >= 1 << 61
                shift = np.array(centre, object)
                total = total + _products(x.astype(object) - shift if far else x - shift.astype(np.int64))
        if not seen:
            return
        cells = [(i, -1) for i in range(dims)] if centre is None else [(i, j) for i in range(dims) for j in range(i, dims)]
        sums = [int(total[i] if centre is None else total[i, j]) for i, j in cells]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in cells], pa.int32()), pa.array([j for _, j in cells], pa.int32())]
            + [pa.array([Decimal(divmod(s, _SPLIT)[k]) for s in sums], pa.decimal128(38)) for k in (0, 1)],
            names=["i", "j", "high", "low"],
        )

    parts = fit.select("x").mapInArrow(rows, "i int, j int, high decimal(38,0), low decimal(38,0)")
    found = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()  # as many as a matrix has cells
    return {(r.i, r.j): int(r.high) * _SPLIT + int(r.low) for r in found}


def covariance(n: int, sums: list[int], centre: list[int], products: dict[tuple[int, int], int]) -> Matrix:
    """The exact covariance as the sum of two doubles."""
    d = len(sums)
    left = [s - n * c for s, c in zip(sums, centre, strict=True)]
    out = np.zeros((d, d), np.longdouble)
    for i in range(d):
        for j in range(i, d):
            exact = Fraction(n * products[i, j] - left[i] * left[j], n * n)
            high = float(exact)
            out[i, j] = out[j, i] = np.longdouble(high) + np.longdouble(float(exact - Fraction(high)))
    return out


# --- the operator ---------------------------------------------------------------------------------------------------


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row for each usable row and component: row, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    kinds = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    struct = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != vector] or [F.lit(None).alias("none")]).alias("row")

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    vectors = stored(rows.where(usable(vector)).select(struct, integers(vector, scale).alias("x")), "vectors")
    sizes = vectors.agg(F.max(F.size("x")).alias("most"), F.min(F.size("x")).alias("least")).first()
    dims = sizes.most or 0
    if not dims:
        return vectors.select("row", *[F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in kinds.split(", ")]).limit(0)
    if sizes.least < dims:
        vectors = vectors.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x"))))
    fit = stored(vectors.select("x").distinct(), "fit_list")
    n = fit.count()
    found = _summed(fit, dims, None)
    sums = [found[i, -1] for i in range(dims)]
    centre = [(2 * s + n) // (2 * n) for s in sums]
    matrix = covariance(n, sums, centre, _summed(fit, dims, centre))
    values, axes = eigenvectors(matrix)
    kept = min(components, dims)
    total = float(np.trace(matrix))
    real = np.array([float(v) > dims * np.finfo(float).eps * float(values[0]) for v in values[:kept]])
    turn = np.where(real, axes[:, :kept] / np.sqrt(np.where(real, values[:kept], 1)), 0).astype(np.float64)
    off = np.array([float(Fraction(s, n) - c) for s, c in zip(sums, centre, strict=True)])

    def projected(x: Matrix) -> Matrix:
        far = max(_most(x), max(map(abs, centre))) >= 1 << 61
        around = x.astype(np.float64) - np.array(centre, np.float64) if far else (x - np.array(centre, np.int64)).astype(np.float64)
        out = np.zeros((len(x), kept))
        for i in range(dims):  # a matrix product may round a row by how many others are in its batch
            out += (around[:, i] - off[i])[:, None] * turn[i]
        return out

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((kept, kept)), np.zeros(kept)
        for batch in batches:
            w = projected(_matrix(batch.column(0), dims))
            total, first = total + w.T @ w, first + w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()]), pa.array([first.tolist()])], names=["products", "sums"])

    each = fit.mapInArrow(spread, "products array<double>, sums array<double>")
    cells = [F.sum(F.col("products")[i]).alias(f"p{i}") for i in range(kept * kept)] + [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(kept)]
    seen = each.agg(*cells).first()
    mean = np.array([seen[f"s{i}"] for i in range(kept)]) / n
    whole = np.array([seen[f"p{i}"] for i in range(kept * kept)]).reshape(kept, kept) / n - np.outer(mean, mean)
    gaps = np.abs(whole - np.eye(kept))[np.ix_(real, real)]
    error = float(gaps.max()) if gaps.size else None
    explained = [float(v / np.trace(matrix)) if total > 0 else None for v in values[:kept]]
    edge = (1 << 63) - 1

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            far = int(_most(x)) * n + max(map(abs, sums))
            apart = x.astype(object) * n - np.array(sums, object) if dims * far * far > edge else x * n - np.array(sums, np.int64)
            deviation = [int(v) if v <= edge else None for v in (apart * apart).sum(axis=1).tolist()]
            w = projected(x)
            w[:, ~real] = np.nan
            columns = [pa.array(deviation, pa.int64()), pa.array(w.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns], names=["row", "deviation", "w"])

    shape = StructType([vectors.schema["row"], StructField("deviation", LongType()), StructField("w", ArrayType(DoubleType()))])
    done = vectors.select("row", "x").mapInArrow(results, shape)
    shares = F.array(*[F.lit(e).cast("double") for e in explained])
    return done.select("row", "deviation", F.posexplode("w").alias("i", "v")).select(
        "row",
        (F.col("i") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(~F.isnan("v"), F.col("v")).alias("whitened"),
        F.get(shares, F.col("i")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
