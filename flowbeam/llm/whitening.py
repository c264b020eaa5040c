"""Whitening of an embedding table by shifted CholeskyQR, in passes over its rows.

Entries become exact integers, x = floor(scale * c) + offset. With n vectors and sums S by
dimension, a centred row is (n * x - S) / n, whose numerator is computed in integers, so nothing
cancels whatever the offset. The centred rows A are factored as A = Q R:

* one pass sums the Gram matrix G of the rows as they stand; R_k is the Cholesky factor of G,
  with a small multiple of the identity added while G is far from it;
* the next pass solves every row through all factors so far, one triangle after another, and
  sums the Gram matrix of what comes out; passes end when it is the identity to rounding.

R is the product of the factors. Its singular value decomposition U D V' gives the components
(columns of V), eigenvalues D**2 / n of the covariance, and whitened rows sqrt(n) Q U. A Gram
matrix alone would lose every component whose deviation is under 1e-8 of the largest; the
repeated passes keep those down to about 1e-14.

Only matrices of dimensions x dimensions reach the driver: each task sums its own rows, entries
are added up by a map-side aggregate. No row is shuffled.

Dropped vectors: null, with null or non-finite entries, with entries whose ``scale * c`` is 2**52
or more in size (no exact integer), and vectors of another length than most (the shorter length
on a tie). Constant dimensions, repeated rows and dependent dimensions are no obstacle: there are
as many components as the rank to double precision, at most ``most``. Repeated rows count as often
as they occur. No vectors, or all alike: no components and no rows. ``deviation`` is null where
it exceeds a long. Components of exactly equal eigenvalues are any basis of their space. Only the
two named columns are looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowbeam.session import ship_package

#: Rows turned into matrices at a time.
ROWS = 4096
#: Passes after which directions that are still not orthogonal count as dependent.
MOST_PASSES = 10
_EPS = np.finfo(np.float64).eps
_LONG = 2**63


@dataclass
class Whitening:
    """A fitted whitening: exact moments, triangular factors, rotation and spectrum."""

    scale: int
    offset: int
    size: int  # length of the vectors
    n: int
    sums: list[int]
    live: np.ndarray  # dimensions that are not constant
    factors: list[np.ndarray]
    rotation: np.ndarray  # U of the singular value decomposition of R
    components: np.ndarray  # one row per component, over all dimensions
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def rank(self) -> int:
        return len(self.eigenvalues)


def solve_rows(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """rows @ inv(upper) by substitution, a column at a time."""
    out = np.array(rows, dtype=np.float64, order="F")
    for j in range(upper.shape[0]):
        if j:
            out[:, j] -= out[:, :j] @ upper[:j, j]
        out[:, j] /= upper[j, j]
    return out


def shifted_cholesky(gram: np.ndarray) -> np.ndarray:
    """Upper factor of ``gram``, shifted along the diagonal unless it is near the identity."""
    d = len(gram)
    if np.abs(gram - np.eye(d)).max() < 0.5 / d:
        return np.linalg.cholesky(gram).T
    shift = 11 * d * (ROWS + d + 1) * _EPS * np.linalg.norm(gram, 2)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:  # the rounding of a very long sum was larger
            shift *= 100


def integer_rows(column: pa.Array, scale: int, offset: int, size: int | None) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """{length: (places, integer matrix)} of the valid vectors of a list column.

    With ``size`` only vectors of that length are given.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(lengths, 0))
    found = {}
    for length in np.unique(lengths):
        if length < 0 or (size is not None and length != size):
            continue
        places = np.flatnonzero(lengths == length)
        if length == 0:
            found[0] = (places, np.empty((len(places), 0), np.int64))
            continue
        starts = ends[places] - length
        with np.errstate(all="ignore"):
            scaled = np.floor(values[starts[:, None] + np.arange(length)] * float(scale))
            good = (np.abs(scaled) < 2.0**52).all(axis=1)  # false for NaN as well
        found[int(length)] = (places[good], scaled[good].astype(np.int64) + offset)
    return found


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S exactly: int64 where that is certain to fit, Python integers otherwise."""
    near = [s // n for s in sums]
    rest = [s - n * m for s, m in zip(sums, near)]
    moved = x - np.array(near, np.int64)
    if (int(np.abs(moved).max(initial=0)) + 1) * n < 2**62:
        return moved * n - np.array(rest, np.int64)
    return moved.astype(object) * n - np.array(rest, object)


def deviations(y: np.ndarray) -> list[int | None]:
    """Sums of squares of each row, exactly; None beyond a long."""
    if y.dtype != object and y.size and float(np.square(y.astype(np.float64)).sum(axis=1).max()) >= 2.0**62:
        y = y.astype(object)
    total = (y * y).sum(axis=1) if y.size else np.zeros(len(y), np.int64)
    return [int(v) if int(v) < _LONG else None for v in total]


def centred(y: np.ndarray, n: int, live: np.ndarray) -> np.ndarray:
    return y[:, live].astype(np.float64) / n


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _moments(df: DataFrame, vector: str, scale: int, offset: int) -> tuple[int, int, list[int]]:
    """(length, n, sums by dimension) of the vectors of the commonest length."""
    schema = T._parse_datatype_string("size int, pos int, n bigint, total decimal(38,0)")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        totals: dict[int, np.ndarray] = {}
        for piece in _pieces(batches):
            for size, (places, x) in integer_rows(piece.column(0), scale, offset, None).items():
                if len(places):
                    counts[size] = counts.get(size, 0) + len(places)
                    # in two halves, so that no sum of a piece overflows
                    part = (x >> 24).sum(axis=0).astype(object) * 2**24 + (x & (2**24 - 1)).sum(axis=0).astype(object)
                    totals[size] = totals.get(size, 0) + part
        # position -1 carries the count alone, so that vectors without entries count too
        rows = [(s, p, counts[s], Decimal(int(v))) for s in counts for p, v in enumerate([0, *totals[s]], -1)]
        for at in range(0, len(rows), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[at : at + ROWS]), arrow)], schema=arrow)

    parts = df.select(vector).mapInArrow(run, schema)
    sums = parts.groupBy("size", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    commonest = parts.filter("pos = -1").groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "size").first()
    if commonest is None or commonest["size"] == 0:
        return 0, 0, []
    found = sums.filter((F.col("size") == commonest["size"]) & (F.col("pos") >= 0)).orderBy("pos").collect()
    return commonest["size"], commonest["n"], [int(r["total"]) for r in found]


def _gram(df: DataFrame, vector: str, model: Whitening, rows_of) -> np.ndarray:
    """Sum over all rows r of r' r, where ``rows_of(centred rows)`` gives the rows."""
    schema = T._parse_datatype_string("i int, entries array<double>")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for piece in _pieces(batches):
            for _, x in integer_rows(piece.column(0), model.scale, model.offset, model.size).values():
                if len(x):
                    rows = rows_of(centred(numerators(x, model.n, model.sums), model.n, model.live))
                    part = rows.T @ rows
                    total = part if total is None else total + part
        if total is not None:
            entries = [total[i, i:].tolist() for i in range(len(total))]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(entries, arrow.field(1).type)], schema=arrow)

    parts = df.select(vector).mapInArrow(run, schema).select("i", F.posexplode("entries").alias("j", "v"))
    found = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    d = max(r["i"] for r in found) + 1
    gram = np.zeros((d, d))
    for r in found:
        i, j = r["i"], r["i"] + r["j"]
        gram[i, j] = gram[j, i] = r["v"]
    return gram


def _solve_all(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    for factor in factors:
        rows = solve_rows(rows, factor)
    return rows


def _whitened(rows: np.ndarray, model: Whitening) -> np.ndarray:
    return _solve_all(rows, model.factors) @ model.rotation * np.sqrt(model.n)


def fit_whitening(df: DataFrame, vector: str = "embedding", most: int = 32, scale: int = 64, offset: int = 1_000_000) -> Whitening:
    """Fit the whitening of all valid vectors of ``df``."""
    ship_package(df.sparkSession)
    size, n, sums = _moments(df, vector, scale, offset)
    none = np.empty(0)
    model = Whitening(scale, offset, size, n, sums, np.arange(size), [], np.empty((0, 0)), np.empty((0, size)), none, none)
    if n == 0:
        return model
    gram = _gram(df, vector, model, lambda rows: rows)
    model.live = np.flatnonzero(np.diag(gram) > 0)
    if not len(model.live):
        return model
    gram = gram[np.ix_(model.live, model.live)]
    d = len(model.live)
    upper = np.eye(d)
    for _ in range(MOST_PASSES):
        factor = shifted_cholesky(gram)
        model.factors.append(factor)
        upper = factor @ upper
        factors = list(model.factors)
        gram = _gram(df, vector, model, lambda rows: _solve_all(rows, factors))
        if np.abs(gram - np.eye(d)).max() < 64 * d * _EPS:
            break
    left, values, right = np.linalg.svd(upper)
    # the sign that makes the largest entry of a component positive
    signs = np.sign(right[np.arange(d), np.abs(right).argmax(axis=1)])
    left, right = left * signs, right * signs[:, None]
    keep = min(most, int((values > values[0] * 8 * d * _EPS).sum()))
    model.rotation = left[:, :keep]
    model.components = np.zeros((keep, size))
    model.components[:, model.live] = right[:keep]
    model.eigenvalues = values[:keep] ** 2 / n
    model.explained = values[:keep] ** 2 / (values**2).sum()
    ones = lambda w: np.hstack([w, np.ones((len(w), 1))])
    fitted = model
    second = _gram(df, vector, model, lambda rows: ones(_whitened(rows, fitted)))
    mean = second[:keep, keep] / n
    model.identity_error = float(np.abs(second[:keep, :keep] / n - np.outer(mean, mean) - np.eye(keep)).max())
    return model


def whiten(df: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each valid vector and component."""
    ship_package(df.sparkSession)
    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType),
        *T._parse_datatype_string("component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"),
    ])
    arrow = to_arrow_schema(schema)
    k = model.rank

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            for places, x in integer_rows(piece.column(1), model.scale, model.offset, model.size).values():
                if not k or not len(places):
                    continue
                y = numerators(x, model.n, model.sums)
                white = _whitened(centred(y, model.n, model.live), model)
                m = len(places) * k
                columns = [
                    piece.column(0).take(pa.array(np.repeat(places, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(places))),
                    pa.array(np.full(m, model.n, np.int64)),
                    pa.array(deviations(y), pa.int64()).take(pa.array(np.repeat(np.arange(len(places)), k))),
                    pa.array(white.ravel()),
                    pa.array(np.tile(model.explained, len(places))),
                    pa.array(np.full(m, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.select(key, vector).mapInArrow(run, schema)
