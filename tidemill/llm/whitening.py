"""Whitening of embeddings: single-precision eigenvectors of the distributed covariance, corrected by matrix products in higher precision."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, to_batch
from .vectors import finite, id_type, matrix, whole_numbers

#: Whole numbers beyond this count as this.
MOST = float(1 << 60)
ROWS = 4096
#: Matrix products of so many bits a factor and ROWS rows are exact in doubles.
LIMB = 20


class Whitening(NamedTuple):
    """A fit: n vectors with sums by dimension; components as columns, their eigenvalues and shares of the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: list[float]
    identity_error: float


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y.T @ y of whole numbers as Python integers: products of 20-bit limbs, exact in doubles for up to 4096 rows."""
    size, limbs = np.abs(y), []
    while not limbs or size.any():
        limbs.append((np.sign(y) * (size & ((1 << LIMB) - 1))).astype(np.float64))
        size = size >> LIMB
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object)
    for s, a in enumerate(limbs):
        for t, b in enumerate(limbs):
            total += (a.T @ b).astype(np.int64).astype(object) << LIMB * (s + t) if s + t else (a.T @ b).astype(np.int64).astype(object)
    return total


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Sums by column, as Python integers."""
    return ((x >> 30).sum(axis=0).astype(object) << 30) + (x & ((1 << 30) - 1)).sum(axis=0).astype(object)


def _summed(fit_list: DataFrame, dim: int, rows_of) -> tuple[int, np.ndarray]:
    """The number of vectors, and the sum over all batches of the rows of whole numbers that rows_of makes of one.

    A task adds up its own batches and gives each row as text, since it may exceed a long; rows of one place meet in one
    task, one from each task, and the driver gets one row a place.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in slices(batches, ROWS):
            part = rows_of(matrix(batch.column(0), dim))
            n, total = n + batch.num_rows, part if total is None else total + part
        if n:
            yield to_batch({"place": (pa.int32(), range(len(total))), "n": (pa.int64(), [n] * len(total)), "part": (pa.list_(pa.string()), [list(map(str, row)) for row in total])})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in slices(batches, 64):
            for place, n, part in zip(*(batch.column(c).to_pylist() for c in range(3))):
                had = held.get(place, (0, 0))
                held[place] = (had[0] + n, had[1] + np.array(list(map(int, part)), dtype=object))
        if held:
            yield to_batch({"place": (pa.int32(), list(held)), "n": (pa.int64(), [n for n, _ in held.values()]), "part": (pa.list_(pa.string()), [list(map(str, v)) for _, v in held.values()])})

    kind = "place int, n long, part array<string>"
    found = fit_list.mapInArrow(add, kind).repartition("place").mapInArrow(merge, kind).collect()
    return max((r.n for r in found), default=0), np.array([[int(v) for v in r.part] for r in sorted(found)], dtype=object)


def refined_eigen(a: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors (columns) of a symmetric matrix, in a's precision.

    Starts from single-precision eigenvectors. Each round forms R = I - X'X and S = X'AX in a's precision and corrects X
    to X + XE, which squares the error, where eigenvalues lie further apart than the round's error bound. Those that lie
    closer form clusters: their columns are turned by the eigenvectors of their own block of X'(A - m)X, m its mean, so
    that they are told apart by their own spread, and go on with the next round.
    """
    d, eps = len(a), np.finfo(a.dtype).eps
    scale = np.abs(a).max() or a.dtype.type(1)
    a, one = a / scale, np.eye(d, dtype=a.dtype)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(a.dtype)
    norm = lambda m: np.linalg.norm(m.astype(np.float64), 2)
    size, values = norm(a), np.diag(a)
    for _ in range(rounds):
        r, s = one - x.T @ x, x.T @ (a @ x)
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-values, kind="stable")
        x, r, s, values = x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], values[order]
        bound = 2 * (norm(s - np.diag(values)) + size * norm(r))
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > bound
        e = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
        x = x + x @ e
        step = np.abs(e).max()
        starts = np.flatnonzero(np.r_[True, np.abs(np.diff(values)) > bound, True])
        for lo, hi in zip(starts[:-1], starts[1:]):
            if hi - lo > 1:
                own = x[:, lo:hi]
                block = own.T @ (a @ own - values[lo:hi].mean() * own)
                spread = np.abs(block).max()
                if spread > 4 * d * eps * size:  # else the values are equal as far as this precision tells
                    turn = np.linalg.eigh(((block + block.T) / (2 * spread)).astype(np.float64))[1][:, ::-1]
                    x[:, lo:hi] = own @ turn.astype(a.dtype)
                    step = max(step, np.abs(block - np.diag(np.diag(block))).max() / spread)
        if step <= 64 * d * eps:
            break
    x = x @ (3 * one - x.T @ x) / 2  # what rounding left of non-orthogonality between close eigenvalues
    return values * scale, x / np.sqrt((x * x).sum(axis=0))


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, x = floor(scale * c) of each component c, of the vectors that count, written: see whiten."""
    own = vectors.filter(finite(vector_col) & (F.size(vector_col) > 0)).select(F.col(id_col).alias("id"), whole_numbers(vector_col, scale, MOST).alias("x"))
    rows = materialize(own, "integers")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(2).collect()
    return rows if len(lengths) < 2 else rows.filter(F.size("x") == lengths[0].d)


def fit(rows: DataFrame, components: int = 4) -> Whitening | None:
    """Fits on each distinct vector x of rows once; None if there are none.

    Sums and covariance are exact: x less the whole number next to its dimension's mean is multiplied in whole numbers,
    and the rest of the mean, at most a half, is taken off the sum. The driver holds one d x d matrix.
    """
    fit_list = materialize(rows.select("x").distinct(), "fit-list")
    first = fit_list.first()
    if first is None:
        return None
    dim = len(first.x)
    n, sums = _summed(fit_list, dim, lambda x: exact_sums(x)[None, :])
    sums = sums[0]
    centre = np.array([(2 * int(s) + n) // (2 * n) for s in sums], dtype=np.int64)
    _, gram = _summed(fit_list, dim, lambda x: exact_gram(x - centre))
    rest = sums - n * centre.astype(object)
    covariance = (n * gram - np.outer(rest, rest)).astype(np.longdouble) / np.longdouble(n) ** 2
    values, vectors = refined_eigen(covariance)
    trace, k = np.trace(covariance), min(components, dim)
    vectors = vectors[:, :k] * np.sign(vectors[np.abs(vectors[:, :k]).argmax(axis=0), np.arange(k)])
    flat = values[:k] <= 4 * dim * np.finfo(np.float64).eps * trace  # no spread along these
    values = np.where(flat, np.longdouble(0), values[:k])
    explained = [float(v / trace) if trace > 0 else 0.0 for v in values]
    model = Whitening(n, [int(s) for s in sums], vectors.astype(np.float64), values.astype(np.float64), explained, 0.0)
    return model._replace(identity_error=_identity_error(fit_list, model))


def centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S, exactly: longs where they suffice."""
    fits = model.n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, model.sums)) < 1 << 62
    kind = np.int64 if fits else object
    return model.n * x.astype(kind) - np.array(model.sums, dtype=kind)


def projected(y: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened rows of n * x - S; NaN for components without spread."""
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(model.values > 0, 1 / np.sqrt(model.values), np.nan)
    return (y / model.n).astype(np.float64) @ model.components * scale


def _identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list less the identity, measured over all its vectors."""
    dim, k = len(model.sums), len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in slices(batches, ROWS):
            w = projected(centred(matrix(batch.column(0), dim), model), model)
            sums, products = sums + w.sum(axis=0), products + w.T @ w
        yield to_batch({"sums": (pa.list_(pa.float64()), [sums]), "products": (pa.list_(pa.float64()), [products.reshape(-1)])})

    parts = fit_list.mapInArrow(run, "sums array<double>, products array<double>")
    row = parts.agg(*[F.sum(F.col("sums")[i]) for i in range(k)], *[F.sum(F.col("products")[i]) for i in range(k * k)]).first()
    mean, products = np.array(row[:k]) / model.n, np.array(row[k:]).reshape(k, k) / model.n
    off = np.abs(products - np.outer(mean, mean) - np.eye(k))[np.ix_(model.values > 0, model.values > 0)]
    return float(off.max(initial=0.0))


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """id, n, deviation (sum of (n * x - S) ** 2 over dimensions; null beyond a long), whitened (an array) of every row. Map only."""
    dim = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            y = centred(matrix(batch.column(1), dim), model)
            if y.dtype != object and dim * (int(np.abs(y).max(initial=0)) + 1) ** 2 >= 1 << 62:
                squares = [sum(v * v for v in row) for row in y.tolist()]
            else:
                squares = (y * y).sum(axis=1).tolist()
            whitened = [[None if np.isnan(v) else v for v in row] for row in projected(y, model).tolist()]
            yield to_batch({"id": (batch.column(0).type, batch.column(0)), "n": (pa.int64(), [model.n] * len(y)), "deviation": (pa.int64(), [s if s < 1 << 63 else None for s in squares]), "whitened": (pa.list_(pa.float64()), whitened)})

    return rows.select("id", "x").mapInArrow(run, f"id {id_type(rows, 'id')}, n long, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256) -> tuple[DataFrame, Whitening | None]:
    """(id, n, deviation, whitened of every vector that counts; the fit, None if no vector counts).

    Vectors that are null or hold nulls, NaN or infinities do not count, nor do empty ones and those of another length
    than most have (of lengths as frequent: the smaller one). Components become x = floor(scale * c), within 2 ** 60.
    Each distinct x is fitted once, so copies do not weigh; equal rows are one before they are sent, so copies are no hot
    group. Whitened values are in order of falling eigenvalues, at most `components`; those of a component without spread
    are null. Null and repeated ids each get their row; an empty table gives an empty result; other columns are not read.
    """
    rows = integers(vectors, id_col, vector_col, scale)
    model = fit(rows, components)
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")), None
    return transform(rows, model).withColumnRenamed("id", id_col), model


def whitened_components(vectors: DataFrame, *, id_col: str = "vec_id", **options) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each vector that counts and component. As whiten."""
    rows, model = whiten(vectors, id_col=id_col, **options)
    told = F.array(*[F.lit(v) for v in model.explained] if model else []).cast("array<double>")
    out = rows.select(id_col, "n", "deviation", F.posexplode("whitened").alias("place", "value"))
    return out.select(id_col, (F.col("place") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"), F.try_element_at(told, F.col("place") + 1).alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"))
