"""Centroid clustering on bit planes: 64 components are one 64-bit word for each bit, and weighted popcounts of ANDs are exact dot products."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices, to_batch
from .vectors import finite, id_type, matrix, whole_numbers

WIDTH = 64
#: Components of up to 2 ** 27 in size: squared distances then fit a long.
MOST_BITS = 28
ROWS = 4096


def planes_of(x: np.ndarray, bits: int) -> np.ndarray:
    """Rows of 64 whole numbers as rows of `bits` words: word b holds bit b of all components, in two's complement."""
    planes = [np.packbits((x >> b & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0] for b in range(bits)]
    return np.stack(planes, axis=1)


def plane_weights(bits: int) -> list[int]:
    """What a set bit of each plane counts; that of the last plane, the sign's, is negative."""
    return [1 << b for b in range(bits - 1)] + [-(1 << bits - 1)]


def dot_products(planes: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact dot products of all rows with all centres, by AND and popcount of each two planes."""
    out, weights = np.zeros((len(planes), len(centres)), dtype=np.int64), plane_weights(planes.shape[1])
    for a, u in enumerate(weights):
        for b, v in enumerate(weights):
            out += u * v * np.bitwise_count(planes[:, a, None] & centres[None, :, b]).astype(np.int64)
    return out


def own_products(planes: np.ndarray) -> np.ndarray:
    """Each row's dot product with itself."""
    out, weights = np.zeros(len(planes), dtype=np.int64), plane_weights(planes.shape[1])
    for a, u in enumerate(weights):
        for b, v in enumerate(weights):
            out += u * v * np.bitwise_count(planes[:, a] & planes[:, b]).astype(np.int64)
    return out


def nearest(planes: np.ndarray, norms: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre (of equally near ones the smallest) and the squared distance to it."""
    distance = norms[:, None] - 2 * dot_products(planes, centres) + own_products(centres)
    cluster = distance.argmin(axis=1)
    return cluster, distance[np.arange(len(cluster)), cluster]


def packed(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> tuple[DataFrame, int]:
    """(id, planes, norm of every vector that counts, written; the number of planes). See clusters."""
    most = float(1 << 62)
    own = vectors.filter(finite(vector_col) & (F.size(vector_col) == WIDTH)).select(F.col(id_col).alias("id"), whole_numbers(vector_col, scale, most).alias("x"))
    largest = own.agg(F.max(F.greatest(F.array_max("x"), -1 - F.array_min("x"))).alias("m")).first().m
    bits = (largest or 0).bit_length() + 1
    if bits > MOST_BITS:
        raise ValueError(f"components of up to {largest / scale:.3g}: squared distances would not fit a long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            planes = planes_of(matrix(batch.column(1), WIDTH), bits)
            yield to_batch({"id": (batch.column(0).type, batch.column(0)), "planes": (pa.binary(), [p.tobytes() for p in planes]), "norm": (pa.int64(), own_products(planes))})

    return materialize(own.mapInArrow(run, f"id {id_type(vectors, id_col)}, planes binary, norm long"), "planes"), bits


def _rows(batch: pa.RecordBatch, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u8").reshape(-1, bits), batch.column(2).to_numpy()


def first_centres(vectors: DataFrame, id_col: str, vector_col: str, scale: int, k: int, seed: int) -> np.ndarray:
    """The k vectors that count with the smallest SHA-256 of `seed:id`, in its order; ties by the vector, null ids last."""
    own = vectors.filter(finite(vector_col) & (F.size(vector_col) == WIDTH)).select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256).alias("place"), whole_numbers(vector_col, scale, float(1 << 62)).alias("x"))
    return np.array([r.x for r in own.orderBy(F.col("place").asc_nulls_last(), "x").limit(k).collect()], dtype=np.int64).reshape(-1, WIDTH)


def moved(rows: DataFrame, bits: int, centres: np.ndarray) -> np.ndarray:
    """Each centre as the floor of the mean of the rows that are nearest to it; one that no row is nearest to stays.

    A task gives a row a cluster: its count and sums, which come from the counts of set bits of each plane.
    """
    k, target, weights = len(centres), planes_of(centres, bits), np.array(plane_weights(bits), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, ones = np.zeros(k, dtype=np.int64), np.zeros((k, bits * WIDTH), dtype=np.int64)
        for batch in slices(batches, ROWS):
            planes, norms = _rows(batch, bits)
            cluster, _ = nearest(planes, norms, target)
            count += np.bincount(cluster, minlength=k)
            set_bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8), axis=1, bitorder="little").astype(np.float32)
            ones += (np.equal.outer(np.arange(k), cluster).astype(np.float32) @ set_bits).astype(np.int64)  # below 2 ** 24: exact
        sums = np.einsum("kbw,b->kw", ones.reshape(k, bits, WIDTH), weights)
        own = np.flatnonzero(count)
        if len(own):
            yield to_batch({"cluster": (pa.int32(), own), "n": (pa.int64(), count[own]), "sums": (pa.list_(pa.int64()), list(sums[own]))})

    parts = rows.mapInArrow(run, "cluster int, n long, sums array<long>")
    out = centres.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(WIDTH)]).alias("sums")).collect():
        out[r.cluster] = np.array(r.sums, dtype=np.int64) // r.n
    return out


def clusters(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance of every vector that counts, written; the final centres as rows of whole numbers).

    A vector counts if it has 64 components, none null, NaN or infinite; others are left out. Components become
    floor(scale * c). Each of the rounds assigns all vectors and moves the centres to the floors of their means; rounds
    end before their number once no centre moves, which changes nothing. The driver holds k centres, and a round sends k
    rows a task to the sum, so copies of one vector are no hot group.

    Of fewer than k vectors all are centres; of none the result is empty. Null ids are kept and are the last to be a first
    centre; rows that repeat an id each get a row; other columns are not read. Components beyond 2 ** 27 after scaling
    are an error, as distances would not fit a long.
    """
    rows, bits = packed(vectors, id_col, vector_col, scale)
    centres = first_centres(vectors, id_col, vector_col, scale, k, seed)
    if not len(centres):
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centres
    for _ in range(rounds):
        was, centres = centres, moved(rows, bits, centres)
        if np.array_equal(was, centres):
            break
    target = planes_of(centres, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            cluster, distance = nearest(*_rows(batch, bits), target)
            yield to_batch({id_col: (batch.column(0).type, batch.column(0)), "cluster": (pa.int32(), cluster), "distance": (pa.int64(), distance)})

    return materialize(rows.mapInArrow(run, f"`{id_col}` {id_type(vectors, id_col)}, cluster int, distance long"), "clusters"), centres


def cluster_report(vectors: DataFrame, **options) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia (sums of distances over the row's cluster and over all),
    centroid_sha256 (of its centre's components, joined by commas) of every vector that counts. Options as in clusters."""
    rows, centres = clusters(vectors, **options)
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    of = lambda values, kind: F.try_element_at(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster") + 1)
    inertia = of([sums.get(c, 0) for c in range(len(centres))], "long")
    return rows.withColumns({"cluster_inertia": inertia, "inertia": F.lit(sum(sums.values())).cast("long"), "centroid_sha256": of(digests, "string")})
