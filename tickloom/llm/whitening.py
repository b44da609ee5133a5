"""Whitening of embeddings: centred covariance in one distributed pass, leading components by a tridiagonal solver.

Entries become whole numbers ``floor(scale * c) + shift``, so counts and sums are exact and the same for any partitioning.

1. A pass gives the number of vectors and the sum of each dimension.
2. A pass gives the scatter matrix about the whole number next to each mean, tasks add theirs in two steps; the rest of the mean
   (less than one) is taken off afterwards. Products are sums of whole numbers, exact below 2^53.
3. The matrix (dimension x dimension) is reduced to three diagonals by Householder reflections, the leading eigenvalues
   are enclosed by bisection on Sturm counts, and inverse iteration gives their vectors, orthogonalised again
   within clusters of close eigenvalues. That runs on the driver: its size is the width of a vector, not the table.
4. The components (a few vectors) are sent to the tasks, which project every row; one pass measures how far the covariance
   of the result is from the identity.

Rows whose vector is null or empty or holds a null or non-finite entry are dropped, and so are rows whose vector has another
length than most (of equally frequent lengths the longer counts). Numbers beyond 2^61 are cut to it. Components without variance
(relative to the first: dimension x 2^-39, below which rounding would show in the result) are not returned; equal vectors or a
single one have none. Rows that share an id or
have none are answered one by one. An empty table gives an empty result. ``deviation`` is null beyond the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.columns import findable

LIMIT = 2.0**61
ROWS = 4096
EPS = float(np.finfo(float).eps)
NONE = 2.0**-39


class Whitening(NamedTuple):
    n: int
    dim: int
    sums: list[int]
    components: np.ndarray  # one column per component
    variances: np.ndarray
    trace: float
    scale: float
    shift: int


# The tridiagonal solver.


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and the unit vectors of the reflections that bring a symmetric matrix to this form."""
    a = np.array(a, float)
    d = len(a)
    off, reflections = np.zeros(max(d - 1, 0)), []
    for k in range(d - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        off[k] = -size if v[0] > 0 else size
        v[0] -= off[k]
        size = np.linalg.norm(v)
        if size == 0:
            reflections.append(None)
            continue
        v /= size
        p = 2 * (a[k + 1:, k + 1:] @ v)
        p -= (v @ p) * v
        a[k + 1:, k + 1:] -= np.outer(v, p) + np.outer(p, v)
        reflections.append(v)
    if d > 1:
        off[-1] = a[-1, -2]
    return np.diagonal(a).copy(), off, reflections


def reflected(z: np.ndarray, reflections: list[np.ndarray | None]) -> np.ndarray:
    """A vector of the tridiagonal form in the coordinates of the matrix."""
    z = z.copy()
    for k in reversed(range(len(reflections))):
        v = reflections[k]
        if v is not None:
            z[k + 1:] -= 2 * (v @ z[k + 1:]) * v
    return z


def below(diag: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues are less than each x."""
    tiny = np.finfo(float).tiny / EPS
    floor = np.maximum(tiny, EPS * np.abs(off).max(initial=0) * EPS)
    q = diag[0] - x
    count = (q < 0).astype(int)
    for i in range(1, len(diag)):
        q = np.where(np.abs(q) < floor, -floor, q)
        q = diag[i] - x - off[i - 1] ** 2 / q
        count += q < 0
    return count


def leading(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection until an interval holds no further number."""
    side = np.concatenate(([0.0], np.abs(off), [0.0]))
    radius = side[:-1] + side[1:]
    width = float((np.abs(diag) + radius).max())
    lo = np.full(k, (diag - radius).min() - width * EPS)
    hi = np.full(k, (diag + radius).max() + width * EPS + np.finfo(float).tiny)
    rank = len(diag) - 1 - np.arange(k)
    for _ in range(2000):
        mid = lo + (hi - lo) / 2
        going = (mid > lo) & (mid < hi) & (hi - lo > EPS * EPS * width)
        if not going.any():
            break
        above = below(diag, off, mid) > rank
        hi = np.where(going & above, mid, hi)
        lo = np.where(going & ~above, mid, lo)
    return lo + (hi - lo) / 2


def solved(diag: np.ndarray, off: np.ndarray, value: float, b: np.ndarray, floor: float) -> np.ndarray:
    """Solve (T - value) z = b by elimination with row exchanges; pivots are kept away from zero."""
    n = len(diag)
    z = b.astype(float).tolist()
    main, up, up2 = (diag - value).tolist(), [*off.tolist(), 0.0], [0.0] * n
    low = off.tolist()
    for i in range(n - 1):
        if abs(main[i]) >= abs(low[i]):
            if abs(main[i]) < floor:
                main[i] = floor
            f = low[i] / main[i]
        else:  # exchange rows i and i + 1
            f = main[i] / low[i]
            main[i], main[i + 1], up[i] = low[i], up[i], main[i + 1]
            up2[i], up[i + 1] = up[i + 1], 0.0 if i + 2 > n - 1 else up[i + 1]
            z[i], z[i + 1] = z[i + 1], z[i]
            main[i + 1] -= f * up[i]
            up[i + 1] = -f * up2[i]
            z[i + 1] -= f * z[i]
            continue
        main[i + 1] -= f * up[i]
        z[i + 1] -= f * z[i]
    if abs(main[-1]) < floor:
        main[-1] = floor
    for i in reversed(range(n)):
        s = z[i]
        if i + 1 < n:
            s -= up[i] * z[i + 1]
        if i + 2 < n:
            s -= up2[i] * z[i + 2]
        z[i] = s / main[i]
    return np.array(z)


def vectors(diag: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) for falling eigenvalues; those within a thousandth of the norm are one cluster."""
    n, norm = len(diag), float((np.abs(diag) + np.concatenate(([0.0], np.abs(off))) + np.concatenate((np.abs(off), [0.0]))).max())
    floor = max(norm * EPS, np.finfo(float).tiny / EPS)
    rng = np.random.default_rng(5)
    out, cluster, shift = np.zeros((n, len(values))), 0, np.inf
    for j, value in enumerate(values.tolist()):
        if j and values[j - 1] - value > 1e-3 * norm:
            cluster = j
        shift = min(value, shift - 2 * floor) if j > cluster else value  # equal eigenvalues get different shifts
        mates = out[:, cluster:j]
        z = rng.normal(size=n)
        for attempt in range(12):
            z /= np.abs(z).max()
            z = solved(diag, off, shift, z, floor)
            z /= np.abs(z).max() or 1.0
            for _ in range(2):
                z -= mates @ (mates.T @ z)
            size = np.linalg.norm(z)
            if size < 1e-6:  # nothing of its own was left
                z = rng.normal(size=n)
                continue
            z /= size
            rest = diag * z - value * z
            rest[:-1] += off * z[1:]
            rest[1:] += off * z[:-1]
            if attempt and np.linalg.norm(rest) <= 4 * EPS * norm * np.sqrt(n):
                break
        out[:, j] = z
    return out


def components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvalues of a covariance matrix and their unit vectors (columns, largest entry positive); those without
    variance are left out."""
    k = min(k, len(matrix))
    size = float(np.abs(matrix).max(initial=0))
    if not k or size == 0:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diag, off, reflections = tridiagonal(matrix / size)
    values = leading(diag, off, k)
    values = values[values > len(matrix) * NONE * values[0]]
    z = vectors(diag, off, values)
    z = np.column_stack([reflected(z[:, j], reflections) for j in range(len(values))])
    z /= np.linalg.norm(z, axis=0)
    z *= np.sign(z[np.abs(z).argmax(axis=0), np.arange(z.shape[1])])
    return values * size, z


# The passes over the table.


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries as doubles, offsets, and which rows have a vector of finite entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    ok = (bad[offs[1:]] == bad[offs[:-1]]) & (offs[1:] > offs[:-1]) & ~np.asarray(column.is_null())
    return flat, offs, ok


def blocks(column: pa.Array, dim: int, scale: float, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and whole-number vectors of the usable rows of one length, some thousand rows at a time."""
    flat, offs, ok = usable(column)
    which = np.flatnonzero(ok & (np.diff(offs) == dim))
    for lo in range(0, len(which), ROWS):
        rows = which[lo:lo + ROWS]
        c = flat[offs[rows][:, None] + np.arange(dim)]
        with np.errstate(over="ignore"):
            yield rows, np.clip(np.floor(scale * c), -LIMIT, LIMIT).astype(np.int64) + shift


def _sum(x: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    if len(x) * float(np.abs(x).max(initial=0)) < LIMIT:
        return x.sum(axis=0).tolist()
    return x.astype(object).sum(axis=0).tolist()


def _sums(vecs: DataFrame, scale: float, shift: int) -> tuple[int, list[int]]:
    """How many vectors have the most frequent length, and the sum of each of their entries."""
    schema = pa.schema([("dim", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("s", pa.decimal128(38, 0))])

    def run(batches):
        total: dict[int, tuple[int, list[int]]] = {}
        for b in batches:
            _, offs, ok = usable(b.column(0))
            for dim in np.unique(np.diff(offs)[ok]).tolist():
                for _, x in blocks(b.column(0), dim, scale, shift):
                    n, s = total.get(dim, (0, [0] * dim))
                    total[dim] = (n + len(x), [p + q for p, q in zip(s, _sum(x))])
        for dim, (n, s) in total.items():
            yield pa.RecordBatch.from_pydict({"dim": [dim] * dim, "j": range(dim), "n": [n] * dim, "s": [Decimal(v) for v in s]}, schema=schema)

    found = vecs.mapInArrow(run, "dim int, j int, n long, s decimal(38,0)").groupBy("dim", "j").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    best = found.where("j = 0").orderBy(F.col("n").desc(), F.col("dim").desc()).select("dim").limit(1)
    rows = found.join(best, "dim").orderBy("j").collect()  # one row per entry of a vector
    return (rows[0].n, [int(r.s) for r in rows]) if rows else (0, [])


def _added(t: pa.Table) -> pa.Table:
    """The sum of one matrix row's parts."""
    row = np.sum([np.frombuffer(r.as_buffer()) for r in t["row"]], axis=0)
    return pa.table({"i": t["i"][:1], "part": pa.array([int(t["part"][0].as_py()) // 256], pa.int32()), "row": pa.array([row.tobytes()], pa.binary())})


def _collected(parts: DataFrame, d: int) -> np.ndarray:
    """The sum of the tasks' matrices, added in two steps of at most 256 parts or tasks / 256 each; rows of d or fewer columns."""
    ddl = "i int, part int, row binary"
    step = parts.withColumn("_g", F.expr("part div 256")).groupBy("i", "_g").applyInArrow(lambda key, t: _added(t.drop_columns("_g")), ddl)
    rows = step.groupBy("i").applyInArrow(_added, ddl).select("i", "row").collect()
    out = np.zeros((d, max((len(r.row) // 8 for r in rows), default=0)))
    for r in rows:
        out[r.i] = np.frombuffer(bytes(r.row))
    return out


def _scatter(vecs: DataFrame, of, d: int) -> np.ndarray:
    """Sum of ``of(block)^T of(block)`` over all usable rows; ``of`` gives d columns."""
    schema = pa.schema([("i", pa.int32()), ("part", pa.int32()), ("row", pa.binary())])

    def run(batches):
        total = np.zeros((d, d))
        for b in batches:
            for y in of(b.column(0)):
                total += y.T @ y
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"i": range(d), "part": [part] * d, "row": [r.tobytes() for r in total]}, schema=schema)

    return _collected(vecs.mapInArrow(run, "i int, part int, row binary"), d)


def _only(df: DataFrame, vector_col: str) -> DataFrame:
    return findable(df).select(F.col(f"`{vector_col}`").cast("array<double>").alias("v"))


def fit(df: DataFrame, vector_col: str = "embedding", k: int = 8, scale: float = 1024.0, shift: int = 100_000) -> Whitening:
    """Mean, leading components and variances of all usable vectors."""
    vecs = _only(df, vector_col)
    n, sums = _sums(vecs, scale, shift)
    d = len(sums)
    if not n:
        return Whitening(0, 0, [], np.zeros((0, 0)), np.zeros(0), 0.0, scale, shift)
    middle = [(2 * s + n) // (2 * n) for s in sums]
    centre = np.array(middle, np.int64)

    def about(column):
        for _, x in blocks(column, d, scale, shift):
            yield (x - centre).astype(float)

    matrix = _scatter(vecs, about, d) / n
    rest = np.array([(s - n * m) / n for s, m in zip(sums, middle)])
    matrix -= np.outer(rest, rest)
    matrix = (matrix + matrix.T) / 2
    variances, z = components(matrix, k)
    return Whitening(n, d, sums, z, variances, float(np.trace(matrix)), scale, shift)


def _centred(x: np.ndarray, m: Whitening) -> tuple[np.ndarray, list[int | None]]:
    """x - mean, and the exact sum of (n x - S)^2 of each row (None beyond a long)."""
    s_max = max(map(abs, m.sums))
    if m.n * float(np.abs(x).max(initial=0)) + s_max < LIMIT:
        y = m.n * x - np.array(m.sums, np.int64)
        if float(np.abs(y).max(initial=0)) ** 2 * m.dim < LIMIT:
            return y / m.n, (y * y).sum(axis=1).tolist()
        exact = [sum(v * v for v in r) for r in y.tolist()]
        return y / m.n, [v if v < 1 << 63 else None for v in exact]
    rows = [[m.n * v - s for v, s in zip(r, m.sums)] for r in x.tolist()]
    exact = [sum(v * v for v in r) for r in rows]
    return np.array([[v / m.n for v in r] for r in rows]), [v if v < 1 << 63 else None for v in exact]


def _whitened(x: np.ndarray, m: Whitening) -> tuple[np.ndarray, list[int | None]]:
    y, deviation = _centred(x, m)
    return y @ m.components / np.sqrt(m.variances), deviation


def identity_error(df: DataFrame, m: Whitening, vector_col: str = "embedding") -> float:
    """The largest entry, in size, of the covariance of the whitened vectors minus the identity."""
    k = len(m.variances)
    if not k:
        return 0.0

    def with_one(column):
        for _, x in blocks(column, m.dim, m.scale, m.shift):
            w = _whitened(x, m)[0]
            yield np.column_stack([w, np.ones(len(w))])

    total = _scatter(_only(df, vector_col), with_one, k + 1) / m.n
    return float(np.abs(total[:k, :k] - np.outer(total[k, :k], total[k, :k]) - np.eye(k)).max())


def transform(df: DataFrame, m: Whitening, vector_col: str = "embedding") -> DataFrame:
    """Usable rows of ``df`` (all columns) plus struct ``_white``: deviation, values (one per component)."""
    df = df.drop("_white")
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    source = findable(df).select(row, F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    kind = source.schema["row"].dataType.simpleString()
    values = pa.list_(pa.float64())

    def run(batches):
        for b in batches:
            for rows, x in blocks(b.column(1), m.dim, m.scale, m.shift):
                w, deviation = _whitened(x, m)
                k = w.shape[1]
                offs = np.arange(0, len(w) * k + 1, k, dtype=np.int32) if k else np.zeros(len(w) + 1, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(pa.array(offs), pa.array(w.reshape(-1)), type=values)],
                    ["row", "deviation", "values"])

    out = source.mapInArrow(run, f"row {kind}, deviation long, values array<double>")
    return out.select(*(F.col("row").getField(c).alias(c) for c in df.columns), F.struct("deviation", "values").alias("_white"))
