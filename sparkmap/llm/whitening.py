"""Whitening of embeddings by shifted CholeskyQR.

Entries become whole numbers x = floor(1024 c) + 100000.  Let A be the centred
rows of all kept vectors.  A pass over the data gives the Gram matrix A'A; with
a small shift on its diagonal it always has a Cholesky factor R1, however badly
A is conditioned.  The next pass takes the rows of Q1 = A R1^-1, solved row
block by row block, which are nearly orthonormal, and gives R2 from their Gram
matrix, a third pass R3 the same way.  R = R3 R2 R1 then satisfies A = Q3 R with
Q3 orthonormal to double precision (the shift cancels), so the singular values
s of R are those of A: its right singular vectors are the components and s^2 / n
the eigenvalues of the covariance.  Nothing squares the condition of the data.

Every pass sends one matrix a partition, row by row; the rows of one number are
added up in the order of the partitions, so a rerun gives the same sums.  The
driver holds matrices of dimension x dimension only.

The centre is exact: sums are whole numbers, and x is centred as
(x - S div n) - (S mod n) / n.

Defined cases: a vector is left out if it is null, holds null or non-finite
entries or entries of 2^43 and more (1024 c has to be a whole number a double
tells apart), or has another length than most vectors (of lengths equally common
the greater one; empty vectors never count).  A deviation beyond a long is null.
Directions whose eigenvalue is below 1e-13 of the total have no component, so
vectors that are all alike give none.  An empty table gives no rows.  Repeated
rows count each, null ids are kept, other columns stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sparkmap.llm.common import free_name
from sparkmap.session import materialize

SCALE, OFFSET = 1024, 100_000
TOP = 8
LOW_BITS = 26
LEAST_SHARE = 1e-13
COLUMNS_AT_ONCE = 32
UNIT = 2.0**-53


class Whitening(NamedTuple):
    n: int
    sums: list[int]  # of each dimension
    values: np.ndarray  # eigenvalues, falling
    components: np.ndarray  # one a row
    total: float  # trace of the covariance
    solved: int  # passes of triangular solves


def _whole(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors count, and their entries as whole numbers."""
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    keep = lengths == dim
    entries = vectors.filter(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    scaled = np.floor(entries * SCALE)
    good = (np.abs(scaled) < 2.0**53).all(1)  # false for nulls (NaN), NaN and infinity
    keep[keep] = good
    return keep, scaled[good].astype(np.int64) + OFFSET


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (x - whole) - rest


def solve(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q with Q R = A for an upper triangular R, by blocks of columns."""
    q = np.empty_like(a)
    for j in range(0, r.shape[0], COLUMNS_AT_ONCE):
        k = min(j + COLUMNS_AT_ONCE, r.shape[0])
        part = a[:, j:k] - q[:, :j] @ r[:j, j:k]
        for c in range(j, k):
            q[:, c] = (part[:, c - j] - q[:, j:c] @ r[j:c, c]) / r[c, c]
    return q


def _totals(vectors: DataFrame) -> tuple[int, list[int]] | None:
    """Number and entry sums of the vectors of the most common length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            column = batch.column(0)
            for dim in np.unique(np.asarray(column.value_lengths().fill_null(-1))):
                if dim > 0:
                    _, x = _whole(column, int(dim))
                    n, high, low = found.get(dim, (0, 0, 0))
                    found[int(dim)] = [n + len(x), high + (x >> LOW_BITS).sum(0), low + (x & ((1 << LOW_BITS) - 1)).sum(0)]
        for dim, (n, high, low) in found.items():
            yield pa.RecordBatch.from_pydict({"length": [dim] * dim, "pos": range(dim), "n": [n] * dim, "high": high, "low": low})

    parts = vectors.mapInArrow(run, "length long, pos long, n long, high long, low long")
    sums = parts.groupBy("length", "pos").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")])
    most = (
        sums.groupBy("length").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "high", "low"))).alias("s"))
        .where("n > 0").orderBy(F.desc("n"), F.desc("length")).first()
    )
    return most and (most.n, [(r.high << LOW_BITS) + r.low for r in most.s])


def _gram(vectors: DataFrame, rows: Callable[[pa.Array], np.ndarray], dim: int) -> np.ndarray:
    """Sum of Q'Q over all partitions, Q being the rows made of their vectors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((dim, dim))
        for batch in batches:
            q = rows(batch.column(0))
            g += q.T @ q
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()] * dim, "i": range(dim), "v": list(g)})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = None, None
        row = lambda: pa.RecordBatch.from_pydict({"i": [number], "v": [total]})
        for batch in batches:
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for i, v in zip(batch.column("i").to_pylist(), values):
                if i != number:
                    if number is not None:
                        yield row()
                    number, total = i, np.zeros(dim)
                total = total + v
        if number is not None:
            yield row()

    parts = vectors.mapInArrow(partial, "part long, i long, v array<double>")
    sums = parts.repartition("i").sortWithinPartitions("i", "part").mapInArrow(added, "i long, v array<double>")
    out = np.zeros((dim, dim))
    for r in sums.collect():  # dimension x dimension numbers
        out[r.i] = r.v
    return (out + out.T) / 2


def factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper triangular R with R'R = gram + shift."""
    return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T


def _factor_or_shift(gram: np.ndarray, shift: float) -> np.ndarray:
    try:
        return factor(gram, 0.0)
    except np.linalg.LinAlgError:  # fewer directions than dimensions; they only scale by 1 + shift
        return factor(gram, shift)


def fit(df: DataFrame, vector: str = "embedding", passes: int = 3) -> Whitening | None:
    """Centre, components and eigenvalues of all vectors that count; None if there are none."""
    vectors = df.select(F.col(vector).cast("array<double>"))
    totals = _totals(vectors)
    if totals is None:
        return None
    n, sums = totals
    dim = len(sums)
    factors: list[np.ndarray] = []

    def rows(column: pa.Array) -> np.ndarray:
        q = _centred(_whole(column, dim)[1], n, sums)
        for r in factors:
            q = solve(q, r)
        return q

    relative = 11.0 * (n * dim + dim * (dim + 1.0)) * UNIT
    for k in range(passes):
        gram = _gram(vectors, rows, dim)
        if k == 0:
            size = float(np.linalg.norm(gram, 2))
            if size == 0.0:
                return Whitening(n, sums, np.zeros(0), np.zeros((0, dim)), 0.0, 1)
            factors.append(factor(gram, relative * size))
        else:
            factors.append(_factor_or_shift(gram, relative))
    r = factors[0]
    for more in factors[1:]:
        r = more @ r
    _, s, components = np.linalg.svd(r)
    values = s * s / n
    total = float(values.sum())
    some = values > LEAST_SHARE * total
    return Whitening(n, sums, values[some], components[some], total, passes)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """sum (n x - S)^2 of each row, exactly; None beyond a long."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    near = ((n * (x - whole).astype(float) - rest) ** 2).sum(1)
    with np.errstate(over="ignore"):
        exact = ((n * (x - whole) - rest) ** 2).sum(1)  # every part fits where the sum does
    out: list[int | None] = exact.tolist()
    for i in np.flatnonzero(near > 2.0**62):
        v = sum((n * int(a) - s) ** 2 for a, s in zip(x[i], sums))
        out[i] = v if v < 1 << 63 else None
    return out


def _whitened(vector: Column, model: Whitening, top: int) -> Column:
    n, sums = model.n, model.sums
    turn = (model.components[:top] / np.sqrt(model.values[:top])[:, None]).T

    def run(series: pd.Series) -> pd.DataFrame:
        vectors = pa.array(series, pa.list_(pa.float64()))
        keep, x = _whole(vectors, len(sums))
        out = pd.DataFrame({"deviation": pd.array([None] * len(keep), "Int64"), "whitened": [None] * len(keep)})
        at = np.flatnonzero(keep)
        out.loc[at, "deviation"] = pd.array(deviations(x, n, sums), "Int64")
        out.loc[at, "whitened"] = pd.Series(list(_centred(x, n, sums) @ turn), index=at, dtype=object)
        return out

    return F.pandas_udf(run, "deviation long, whitened array<double>")(vector.cast("array<double>"))


def whiten(df: DataFrame, vector: str = "embedding", top: int = TOP, deviation: str = "deviation", whitened: str = "whitened") -> tuple[DataFrame, Whitening | None]:
    """The rows of `df` whose vectors count, with `deviation` and the first `top` whitened components; and the model.

    The rows are written to the shared folder.
    """
    clash = {deviation.lower(), whitened.lower()} & {c.lower() for c in df.columns}
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}; name others")
    model = fit(df, vector)
    if model is None:
        none = df.where(F.lit(False)).withColumns({deviation: F.lit(None).cast("long"), whitened: F.lit(None).cast("array<double>")})
        return none, None
    w = free_name(df, "w__")
    out = df.withColumn(w, _whitened(F.col(vector), model, top)).where(F.col(w)["whitened"].isNotNull())
    return materialize(out.select(*df.columns, F.col(w)["deviation"].alias(deviation), F.col(w)["whitened"].alias(whitened)), "whitened"), model


def identity_error(rows: DataFrame, components: int, whitened: str = "whitened") -> float | None:
    """Largest absolute entry of the whitened rows' covariance (divisor n) minus the identity."""
    if not components:
        return None
    y = [F.col(whitened)[i] for i in range(components)]
    means = rows.agg(*[F.avg(c) for c in y]).first()
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    entries = rows.agg(*[F.avg((y[i] - F.lit(means[i])) * (y[j] - F.lit(means[j]))) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, entries))
