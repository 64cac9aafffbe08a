"""Text chunks, hashed trigram vectors and cosine search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def unit(v: Column) -> Column:
    """v with length 1, in doubles; zeros stay zeros."""
    return _let(F.sqrt(dot(v, v)), lambda norm: F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0))))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: inside lambdas an expression would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def trigram_vector(text: Column, dims: int = 128) -> Column:
    """Counts of character trigrams by hashed place, with length 1. Texts under three characters give zeros."""

    def counted(low: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.char_length(low) - 2, F.lit(1)))
        grams = F.filter(F.transform(starts, lambda i: F.substring(low, i, F.lit(3))), lambda g: F.char_length(g) == 3)
        places = F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(dims)))
        return _let(places, lambda ps: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(ps, lambda p: p == d)).cast("double")))

    def scaled(counts: Column) -> Column:
        return _let(F.sqrt(dot(counts, counts)), lambda norm: F.transform(counts, lambda v: F.when(norm > 0, v / norm).otherwise(F.lit(0.0)).cast("float")))

    return _let(_let(F.lower(text), counted), scaled)


#: Rows of a corpus, and of queries, that a task's products take at once.
CORPUS_ROWS, QUERY_ROWS = 50_000, 4_096


class _Best:
    """The k best of the corpus rows seen so far for each query of a cell, by rounded score, then id."""

    def __init__(self, ids: list, vectors: np.ndarray, k: int, threshold: float | None, digits: int):
        self.ids, self.vectors, self.k, self.threshold, self.digits = ids, vectors, k, threshold, digits
        self.found: list[list[tuple]] = [[] for _ in ids]

    def see(self, ids: list, vectors: np.ndarray) -> None:
        scores = np.round(self.vectors @ vectors.T, self.digits)
        most = min(self.k + 1, scores.shape[1])  # the query itself may be among them
        least = -np.partition(-scores, most - 1, axis=1)[:, most - 1]
        for q, (row, low) in enumerate(zip(scores, least)):
            new = [(-row[c], ids[c]) for c in np.flatnonzero(row >= low) if ids[c] != self.ids[q] and (self.threshold is None or row[c] >= self.threshold)]
            self.found[q] = sorted(self.found[q] + new)[: self.k]

    def rows(self) -> list[tuple]:
        return [(q, i, -float(s)) for q, found in zip(self.ids, self.found) for s, i in found]


def _search(queries: DataFrame, corpus: DataFrame, k: int, threshold: float | None, digits: int) -> DataFrame:
    """query_id, id, score, rank of queries and corpus (cell, id, v: vectors of length 1): the k best of a query's cells.

    A cell's queries and corpus rows meet in one task, queries first; corpus rows stream past them in batches. So the
    corpus is read once and dealt once, and what a task holds is a cell's queries. Final ranks are over a cell's best k.
    """
    kind = dict(corpus.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, side, waiting, best = None, 0, [], None

        def told() -> Iterator[pa.RecordBatch]:
            if best is not None and (rows := best.rows()):
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], schema_of["id"]), pa.array(columns[1], schema_of["id"]), pa.array(columns[2], pa.float64())], names=["query_id", "id", "score"])

        schema_of = {}
        for batch in batches:
            schema_of["id"] = batch.column(2).type
            cells, sides, ids = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            vectors = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            cuts = [0, *(i for i in range(1, len(ids)) if (cells[i], sides[i]) != (cells[i - 1], sides[i - 1])), len(ids)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi == lo:
                    continue
                if cells[lo] != cell:
                    yield from told()
                    cell, waiting, best = cells[lo], [], None
                if sides[lo] == 0:
                    waiting.append((ids[lo:hi], vectors[lo:hi]))
                elif waiting or best is not None:
                    if best is None:
                        best = _Best([i for own, _ in waiting for i in own], np.concatenate([v for _, v in waiting]), k, threshold, digits)
                        waiting = []
                    best.see(ids[lo:hi], vectors[lo:hi])
        yield from told()

    scratch.workers_import_this(corpus.sparkSession)
    both = queries.select("cell", F.lit(0).alias("side"), "id", "v").unionByName(corpus.select("cell", F.lit(1).alias("side"), "id", "v"))
    dealt = both.repartition("cell").sortWithinPartitions("cell", "side")
    scored = dealt.mapInArrow(run, f"query_id {kind}, id {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k_cosine(queries: DataFrame, corpus: DataFrame, *, id_col: str, vector_col: str, k: int, threshold: float | None = None, digits: int = 6, block: int = QUERY_ROWS, rows: int = CORPUS_ROWS) -> DataFrame:
    """query_id, id, score, rank: the k most similar rows of corpus for each query, by rounded score, then id.

    queries is a stated set, which meets all rows in a grid: corpus rows in lots of about `rows`, queries in blocks of
    about `block`, a task for each lot and block with the products of its vectors. Both sides are read once; a query is
    sent to each lot, a corpus row to each block. Vectors are scaled to length 1; null vectors are left out.
    """
    q, c = (df.filter(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), unit(F.col(vector_col)).alias("v")) for df in (queries, corpus))
    lots, blocks = max(1, -(-c.count() // rows)), max(1, -(-q.count() // block))
    cell = lambda lot, own: F.struct(lot.alias("lot"), own.alias("block"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    lot, own = F.pmod(F.xxhash64("id"), F.lit(lots)).cast("int"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    q = q.withColumns({"_b": own, "_l": every(lots)}).select(cell(F.col("_l"), F.col("_b")).alias("cell"), "id", "v")
    c = c.withColumns({"_l": lot, "_b": every(blocks)}).select(cell(F.col("_l"), F.col("_b")).alias("cell"), "id", "v")
    texts = lambda df: df.withColumn("cell", F.concat_ws("-", "cell.lot", "cell.block"))
    return _search(texts(q), texts(c), k, threshold, digits)


def retrieve(queries: DataFrame, corpus: DataFrame, condition: str, **options) -> DataFrame:
    """top_k_cosine among the rows of corpus that meet a condition on their metadata."""
    return top_k_cosine(queries, corpus.filter(F.expr(condition)), **options)


class CellIndex:
    """An index of approximate neighbours: every row of a corpus under its nearest centroid.

    Centroids are fitted on a sample of at most `sample` vectors, the first by a hash of their ids; all rows are indexed.
    A query looks into the cells of its nearest `probes` centroids and its candidates are scored exactly. Cells of more
    than `rows` rows are dealt into parts, to each of which the cell's queries go.
    """

    def __init__(self, corpus: DataFrame, *, id_col: str, vector_col: str, cells: int = 64, sample: int = 10_000, rounds: int = 10, rows: int = CORPUS_ROWS):
        self.id_col, self.vector_col, self.most = id_col, vector_col, rows
        own = self._unit(corpus)
        first = own.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()  # a bounded sample
        x = np.array(first["v"].to_pylist(), dtype=np.float64)
        self.centroids = self._fit(x, min(cells, len(x)), rounds) if len(x) else np.zeros((0, 0))
        self.rows = scratch.materialize(self._near(own, 1).select("cell", "id", "v"), "cells")
        self.parts = self.rows.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))  # one row a cell

    def _unit(self, df: DataFrame) -> DataFrame:
        return df.filter(F.col(self.vector_col).isNotNull()).select(F.col(self.id_col).alias("id"), unit(F.col(self.vector_col)).alias("v"))

    @staticmethod
    def _fit(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
        centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
        for _ in range(rounds):
            near = (x @ centroids.T).argmax(axis=1)
            for c in range(k):
                if (near == c).any():
                    mean = x[near == c].mean(axis=0)
                    centroids[c] = mean / max(np.linalg.norm(mean), 1e-12)
        return centroids

    def _near(self, df: DataFrame, probes: int) -> DataFrame:
        """df with cell, a row for each of the nearest centroids."""
        centroids = self.centroids

        @F.arrow_udf("array<int>")
        def cells(v: pa.Array) -> pa.Array:
            x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
            order = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :probes]
            return pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))

        return df.withColumn("cell", F.explode(cells("v")))

    def search(self, queries: DataFrame, k: int, *, probes: int = 16, threshold: float | None = None, digits: int = 6) -> DataFrame:
        """query_id, id, score, rank: the k best rows of the cells that a query probes. No rows for an empty corpus."""
        q = self._near(self._unit(queries), max(1, min(probes, len(self.centroids)))).join(F.broadcast(self.parts), "cell")  # one row a cell
        q = q.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        c = self.rows.join(F.broadcast(self.parts), "cell").withColumn("_part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        named = lambda df: df.select(F.concat_ws("-", "cell", "_part").alias("cell"), "id", "v")
        return _search(named(q), named(c), k, threshold, digits)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, wanted, hits, recall: the share of exact neighbours (query_id, id) that were found."""
    both = exact.select("query_id", "id").join(found.select("query_id", "id").withColumn("_hit", F.lit(1)), ["query_id", "id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("_hit").alias("hits")).withColumn("recall", F.col("hits") / F.col("wanted"))


def chunks(docs: DataFrame, *, text: str = "text", size: int = 1500, overlap: int = 200, least: int = 50) -> DataFrame:
    """docs without its text, with chunk_index and chunk: windows of `size` characters that overlap; trimmed, and those
    under `least` characters dropped. A null or empty text has none."""
    step = size - overlap
    starts = F.when(F.char_length(text) > 0, F.sequence(F.lit(0), F.char_length(text) - 1, F.lit(step)))
    rows = docs.withColumn("_starts", starts).select(*docs.columns, F.posexplode("_starts").alias("chunk_index", "_start"))
    rows = rows.withColumn("chunk", F.trim(F.substring(F.col(text), F.col("_start") + 1, F.lit(size))))
    return rows.filter(F.char_length("chunk") >= least).drop("_start", text)
