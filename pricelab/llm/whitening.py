"""Embedding whitening by pivoted Cholesky and one-sided Jacobi.

Entries become whole numbers on a grid (``x = floor(scale * c) + offset``), so every sum below is exact and does not
depend on how Spark cuts the table. Four passes over the table, none of which shuffles a vector:

1. per length of vector: the number of rows and the sums of every dimension (one partial row a task and dimension);
2. the scatter of the vectors after a shift by their rounded mean; with the sums it gives the centred scatter exactly,
   which is rounded to double once. d * (d + 1) / 2 sums reach the driver, d being the vectors' dimension;
3. the covariance of the whitened vectors, as a check;
4. the whitened vectors.

On the d x d matrix the driver runs the named method: Cholesky of the centred scatter with diagonal pivoting, then
one-sided Jacobi directly on the triangular factor. The rotated columns' squared norms are the eigenvalues, the
normalised columns the components (numbered by falling eigenvalue, their largest entry positive).

Rows: a vector that is null, empty, or holds a null or non-finite entry takes no part, nor does one with an entry
beyond 2^52 / scale, whose grid value a double can't hold, nor one that has another length than most vectors (of
equally frequent lengths the larger counts). Ids may be null and repeat: every row counts and is returned. A table
without vectors, with one vector or with equal ones only has no component and gives no rows. Components whose
eigenvalue is zero to double precision are left out. Extra columns are ignored, whatever their names. A ``deviation``
beyond the range of a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelab.session import ensure_checkpoint_dir, small_frame

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32

#: Rows of one step inside a task, whatever the session's Arrow batch is.
STEP_ROWS = 4096

_GRID = float(1 << 52)   # a double holds every whole number up to here
_LONG = 1 << 63


@dataclass
class Whitening:
    """A fitted whitening; everything but ``components`` and ``eigenvalues`` is exact."""

    n: int
    sums: list[int]            # of x, by dimension
    components: np.ndarray     # dimension x components, unit columns
    eigenvalues: np.ndarray    # of the covariance of x, falling
    trace: float
    scale: int = SCALE
    offset: int = OFFSET

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) for e in self.eigenvalues]


def _grids(batches: Iterator[pa.RecordBatch], scale: int, dim: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(step of a batch, its row numbers, floor(scale * entry) of those rows) per length of vector.

    The vectors are the batch's last column. Rows that take no part are left out; with ``dim`` only that length comes."""
    for whole in batches:
        for at in range(0, whole.num_rows, STEP_ROWS):
            batch = whole.slice(at, STEP_ROWS)
            lists = batch.column(batch.num_columns - 1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = pc.cast(lists.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            for size in ([dim] if dim else np.unique(sizes[sizes > 0]).tolist()):
                rows = np.flatnonzero(sizes == size)
                with np.errstate(invalid="ignore", over="ignore"):
                    y = np.floor(flat[(ends[rows] - size)[:, None] + np.arange(size)] * scale)
                    good = (np.abs(y) < _GRID).all(axis=1)
                if good.any():
                    yield batch, rows[good], y[good].astype(np.int64)


def _exact_sums(y: np.ndarray) -> np.ndarray:
    big = int(np.abs(y).max(initial=0)) * len(y) >= 1 << 62
    return (y.astype(object) if big else y).sum(axis=0).astype(object)


def _exact_scatter(z: np.ndarray) -> np.ndarray:
    """z' z in whole numbers: by doubles where every partial sum fits into 53 bits, else in halves, else by Python's."""
    if int(np.abs(z).max(initial=0)) ** 2 * len(z) < 1 << 53:
        d = z.astype(np.float64)
        return (d.T @ d).astype(np.int64).astype(object)
    if len(z) > 1:
        return _exact_scatter(z[: len(z) // 2]) + _exact_scatter(z[len(z) // 2:])
    row = z[0].astype(object)
    return np.outer(row, row)


def _whole_numbers(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Whole numbers of any size travel as text; the sums below are decimals."""
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    kinds = [pa.string() if c == "v" else pa.int64() for c in names]
    return pa.RecordBatch.from_arrays([pa.array([str(x) for x in c] if n == "v" else c, k) for n, c, k in zip(names, cols, kinds)], names)


def _sums(df: DataFrame, scale: int, vector: str) -> DataFrame:
    def partial(batches):
        found: dict[int, list] = {}
        for _, rows, y in _grids(batches, scale):
            own = found.setdefault(y.shape[1], [0, np.zeros(y.shape[1], object)])
            own[0] += len(rows)
            own[1] = own[1] + _exact_sums(y)
        for size, (n, s) in found.items():
            yield _whole_numbers([(size, i, n, v) for i, v in enumerate(s)], ["dim", "i", "n", "v"])

    parts = df.select(vector).mapInArrow(partial, "dim long, i long, n long, v string")
    return parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))


def _scatter(df: DataFrame, scale: int, vector: str, centre: list[int]) -> DataFrame:
    dim = len(centre)

    def partial(batches):
        total, shift = np.zeros((dim, dim), object), np.array(centre, np.int64)
        for _, _, y in _grids(batches, scale, dim):
            total = total + _exact_scatter(y - shift)
        yield _whole_numbers([(i, j, total[i, j]) for i in range(dim) for j in range(i, dim)], ["i", "j", "v"])

    parts = df.select(vector).mapInArrow(partial, "i long, j long, v string")
    return parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with a = L L' for a positive semidefinite ``a``, rows in a's order, one column per pivot.

    Ends where the largest remaining diagonal entry is zero to double precision."""
    rest, n = a.astype(np.float64).copy(), len(a)
    factor = np.zeros((n, n))
    least = n * np.finfo(np.float64).eps * max(0.0, float(np.diag(a).max(initial=0.0)))
    for k in range(n):
        p = int(np.argmax(np.diag(rest)))
        if not rest[p, p] > least:
            return factor[:, :k]
        column = rest[:, p] / np.sqrt(rest[p, p])
        factor[:, k] = column
        rest -= np.outer(column, column)
        rest[p, :] = rest[:, p] = 0.0
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` times the rotations that make its columns orthogonal, longest column first.

    A sweep turns every pair of columns once, in rounds of disjoint pairs."""
    cols = factor.T.copy()                       # a row per column: pairs are read whole
    if len(cols) % 2:
        cols = np.vstack([cols, np.zeros(cols.shape[1])])
    m = len(cols)
    eps = np.finfo(np.float64).eps
    for _ in range(sweeps if m else 0):
        turned, ring = False, np.arange(m)
        for _ in range(m - 1):
            p, q = ring[: m // 2], ring[: m // 2 - 1: -1]
            a, b = cols[p], cols[q]
            aa, bb, ab = (a * a).sum(1), (b * b).sum(1), (a * b).sum(1)
            todo = np.abs(ab) > 4 * eps * np.sqrt(aa * bb)
            if todo.any():
                turned = True
                a, b, aa, bb, ab, p, q = a[todo], b[todo], aa[todo], bb[todo], ab[todo], p[todo], q[todo]
                zeta = (bb - aa) / (2.0 * ab)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1.0 / np.hypot(1.0, t)
                s = c * t
                cols[p], cols[q] = c[:, None] * a - s[:, None] * b, s[:, None] * a + c[:, None] * b
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    norms = np.sqrt((cols * cols).sum(1))
    return cols[np.argsort(-norms, kind="stable")][: factor.shape[1]].T


def components(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit columns) of a scatter matrix by the two steps above, falling; zero ones are left out."""
    rotated = one_sided_jacobi(pivoted_cholesky(scatter))
    values = (rotated * rotated).sum(0)
    rotated, values = rotated[:, values > 0], values[values > 0]
    units = rotated / np.sqrt(values)
    if units.size:
        units = units * np.sign(units[np.abs(units).argmax(0), np.arange(units.shape[1])])
    return values, units


def fit(df: DataFrame, vector: str = "embedding", k: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET) -> Whitening:
    """The whitening of all vectors of ``df``: up to ``k`` components."""
    ensure_checkpoint_dir(df.sparkSession)
    sums = _sums(df, scale, vector).checkpoint(eager=True)
    most = sums.where("i = 0").orderBy(F.col("n").desc(), F.col("dim").desc()).limit(1).collect()
    if not most:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, scale, offset)
    dim, n = most[0]["dim"], most[0]["n"]
    own = {r["i"]: int(r["s"]) for r in sums.where(F.col("dim") == dim).collect()}           # one number a dimension
    totals = [own[i] for i in range(dim)]
    centre = [(2 * s + n) // (2 * n) for s in totals]
    rest = [s - n * m for s, m in zip(totals, centre)]
    products = {(r["i"], r["j"]): int(r["s"]) for r in _scatter(df, scale, vector, centre).collect()}
    centred = np.zeros((dim, dim))
    for (i, j), s in products.items():
        centred[i, j] = centred[j, i] = (n * s - rest[i] * rest[j]) / n                      # whole numbers, rounded once
    trace = sum(n * products[i, i] - rest[i] ** 2 for i in range(dim)) / n ** 2
    values, units = components(centred)
    return Whitening(n, [s + n * offset for s in totals], units[:, :k], values[:k] / n, trace, scale, offset)


def _projector(model: Whitening):
    """Function of grid values (rows x dimension) to (exact n * x - S, whitened rows)."""
    n, rest = model.n, [s - model.n * model.offset for s in model.sums]
    turn = model.components / np.sqrt(model.eigenvalues)
    large = max([abs(r) for r in rest], default=0)

    def project(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if n * int(np.abs(y).max(initial=0)) + large >= 1 << 62:
            apart = y.astype(object) * n - np.array(rest, object)
            return apart, (apart / n).astype(np.float64) @ turn
        apart = y * n - np.array(rest, np.int64)
        return apart, (apart / n) @ turn

    return project


def _square_sums(apart: np.ndarray) -> list[int | None]:
    if apart.dtype != object and int(np.abs(apart).max(initial=0)) ** 2 * apart.shape[1] < _LONG:
        return (apart * apart).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in apart]
    return [v if v < _LONG else None for v in exact]


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity (0 without components).

    Measured on the vectors; partial sums are rounded to 12 decimals, so the order of addition doesn't show."""
    k, dim = len(model.eigenvalues), len(model.sums)
    if not k:
        return 0.0

    def partial(batches):
        project, total, mean = _projector(model), np.zeros((k, k)), np.zeros(k)
        for _, _, y in _grids(batches, model.scale, dim):
            w = project(y)[1]
            total, mean = total + w.T @ w, mean + w.sum(0)
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, np.arange(k))), pa.array(np.append(j, np.full(k, -1))),
                                          pa.array(np.append(total[i, j], mean))], ["i", "j", "v"])

    parts = df.select(vector).mapInArrow(partial, "i long, j long, v double")
    summed = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,12)")).alias("s")).collect()
    at = {(r["i"], r["j"]): float(r["s"]) / model.n for r in summed}
    return max(abs(v - at[i, -1] * at[j, -1] - (i == j)) for (i, j), v in at.items() if j >= 0)


def whiten(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id_col``, ``deviation`` (exact sum of (n * x - S)^2) and the array ``whitened`` of every row that takes part."""
    kind = df.schema[id_col].dataType.simpleString()
    if not len(model.eigenvalues):
        return small_frame(df.sparkSession, [], f"`{id_col}` {kind}, deviation long, whitened array<double>")
    dim = len(model.sums)

    def rows(batches):
        project = _projector(model)
        for batch, own, y in _grids(batches, model.scale, dim):
            apart, w = project(y)
            flat = pa.array(w.reshape(-1), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * w.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), pa.array(_square_sums(apart), pa.int64()), lists],
                                             [id_col, "deviation", "whitened"])

    return df.select(id_col, vector).mapInArrow(rows, f"`{id_col}` {kind}, deviation long, whitened array<double>")


def whiten_rows(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """Fit on all of ``df`` and return one row per vector and component: ``id_col``, ``component`` (from 1), ``n``,
    ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    model = fit(df, vector, k)
    error = identity_error(df, model, vector)
    shares = F.array(*[F.lit(x) for x in model.explained]).cast("array<double>")
    return (whiten(df, model, id_col, vector).select(id_col, "deviation", F.posexplode("whitened").alias("__at", "whitened"))
            .select(id_col, (F.col("__at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                    "whitened", F.get(shares, F.col("__at")).alias("explained"), F.lit(error).alias("identity_error")))
