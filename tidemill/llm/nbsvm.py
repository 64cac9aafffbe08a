"""Quality classifier: naive Bayes support vectors on byte n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, materialize, slices, texts_of, to_batch

#: Cells that n-grams are hashed to.
DIMS = 1 << 18
_MARK = np.zeros(DIMS, dtype=np.int64)


def ngrams(text: str) -> np.ndarray:
    """Cells of the distinct 1-, 2-, 3- and 4-byte strings of a text (UTF-8), each once, in no special order."""
    data = np.frombuffer(text.encode(), dtype=np.uint8).astype(np.uint32)
    found = [data, data[:-1] << 8 | data[1:] | 1 << 24, data[:-2] << 16 | data[1:-1] << 8 | data[2:] | 2 << 24, data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]]
    cells = np.concatenate([(g * np.uint32(2654435761) ^ g >> np.uint32(15)) % np.uint32(DIMS) for g in found if len(g)] or [data]).astype(np.int32)
    place = np.arange(len(cells))
    _MARK[cells] = place  # the last place written stays: one for each distinct cell
    return cells[_MARK[cells] == place]


class NbSvm:
    """weights of cells (log-count ratio times linear weight), bias, and the line that turns margins into log odds."""

    def __init__(self, rows: list[np.ndarray], good: np.ndarray, *, epochs: int = 10, c: float = 1.0, smoothing: float = 1.0, seed: int = 7):
        self.weights, self.bias, self.line = np.zeros(DIMS), 0.0, (1.0, 0.0)
        if not len(rows):
            return
        if good.all() or not good.any():
            self.line = (1.0, 4.0 if good.all() else -4.0)
            return
        rng = np.random.default_rng(seed)
        apart = rng.random(len(rows)) < 0.25  # a quarter calibrates the margins
        if len(set(good[apart])) < 2 or len(set(good[~apart])) < 2:
            apart[:] = False
        fit, check = np.flatnonzero(~apart), np.flatnonzero(apart) if apart.any() else np.arange(len(rows))
        counts = np.full((2, DIMS), smoothing)
        for i in fit:
            counts[int(good[i]), rows[i]] += 1
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        self._descend(rows, good, fit, ratio, epochs, c, rng)
        self.line = self._line(np.array([self.margin(rows[i]) for i in check]), good[check])

    def _descend(self, rows, good, fit, ratio, epochs, c, rng) -> None:
        """Dual coordinate descent for the hinge loss; classes weigh alike, rows have length 1."""
        w, bias, alpha = np.zeros(DIMS), 0.0, np.zeros(len(rows))
        share = np.array([(good[fit] == k).mean() for k in (0, 1)])
        for _ in range(epochs):
            for i in rng.permutation(fit):
                cells, y = rows[i], 1.0 if good[i] else -1.0
                x = ratio[cells]
                x /= max(np.sqrt(x @ x), 1e-12)
                most = c / (2 * share[int(good[i])])
                slope = y * (w[cells] @ x + bias) - 1
                new = min(max(alpha[i] - slope / 2, 0.0), most)  # x @ x + 1, for the bias, is 2
                if new != alpha[i]:
                    step = (new - alpha[i]) * y
                    w[cells] += step * x
                    bias += step
                    alpha[i] = new
        self.weights, self.ratio, self.bias, self.alpha = w * ratio, ratio, bias, alpha
        self.squares = ratio * ratio

    def margin(self, cells: np.ndarray) -> float:
        if not len(cells) or not hasattr(self, "ratio"):
            return self.bias
        return float(self.weights[cells].sum() / max(np.sqrt(self.squares[cells].sum()), 1e-12) + self.bias)

    @staticmethod
    def _line(margins: np.ndarray, good: np.ndarray, steps: int = 50) -> tuple[float, float]:
        """Slope and offset of the log odds, by Newton's method on a lightly bounded logistic loss."""
        y, x = good.astype(float), np.column_stack([margins, np.ones(len(margins))])
        line = np.array([1.0, 0.0])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
            step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (p - y) + 1e-3 * (line - [1.0, 0.0]))
            line = line - step
            if np.abs(step).max() < 1e-9:
                break
        return float(max(line[0], 1e-3)), float(line[1])

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.line[0] * self.margin(ngrams(text)) + self.line[1], -30, 30))))


def held_out(doc_id):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 8_000, max_cells: int = 40_000_000) -> NbSvm:
    """Fits on at most max_rows labelled rows that are not held out, whose n-grams are max_cells cells at most (4 bytes each).

    Rows are chosen by a hash of doc_id, in its order, one for each doc_id (of texts that repeat an id the one with the
    least hash). They are counted first: what reaches the driver is a number, then the sizes of max_rows rows, then the
    rows that fit into max_cells, by the tasks that hold them. Of ids that repeat in labels the least label counts; null ids and labels are left out.
    """
    own = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    own = materialize(own.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")
    place = F.xxhash64("doc_id")
    share = 2 * max_rows / max(own.count(), 1)
    if share < 1:  # hashes are even: twice the rows wanted lie below, so no task sends rows that cannot be chosen
        own = own.filter(place < int(share * 2**64) - 2**63)
    chosen = own.orderBy(place, "doc_id").limit(max_rows).select("doc_id", F.col("quality").cast("int").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cells = [np.sort(ngrams(t)) for t in texts_of(batch)]
            columns = {"doc_id": (pa.int64(), batch.column(0)), "quality": (pa.int32(), batch.column(2)), "n": (pa.int64(), [len(c) for c in cells])}
            packed = [zlib.compress(np.diff(c, prepend=0).astype("<i4").tobytes(), 1) for c in cells]
            yield to_batch(columns | {"cells": (pa.binary(), packed)})

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # max_rows ids at most
    once = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "quality")
    rows = materialize(once.mapInArrow(run, "doc_id long, quality int, n long, cells binary"), "fit-rows")
    sizes = rows.select("doc_id", "n", place.alias("place")).toArrow()
    ids, places, n = (sizes[c].to_numpy() for c in ("doc_id", "place", "n"))
    order = np.lexsort((ids, places))
    fits = order[np.cumsum(n[order]) <= max_cells]
    if len(fits) < len(order):
        last = fits[-1:].tolist()
        rows = rows.filter(F.struct(place, "doc_id") <= F.struct(*(F.lit(int(x[last[0]])) for x in (places, ids)))) if last else rows.filter("false")
    found = rows.select("doc_id", "quality", "cells").toArrow()
    cells, at, flat = [], 0, np.empty(int(n[fits].sum()), dtype=np.int32)  # one array of all rows, given back as a whole
    order = np.argsort(found["doc_id"].to_numpy())
    for i in order.tolist():
        steps = np.frombuffer(zlib.decompress(found["cells"][i].as_buffer()), dtype="<i4")
        cells.append(np.cumsum(steps, dtype=np.int32, out=flat[at : at + len(steps)]))
        at += len(steps)
    good = found["quality"].to_numpy()[order] == 1
    del found
    pa.default_memory_pool().release_unused()
    return NbSvm(cells, good)


def scorer(model: NbSvm):
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([model.score(t) for t in each_text(texts)], pa.float64())

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, *, max_rows: int = 8_000, max_cells: int = 40_000_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs.

    Learns labels.quality from at most max_rows labelled rows (max_cells of n-grams) outside the held-out third; a score sees the whole text and
    nothing else. Scoring is map only. Null and empty texts are scored by the model's bias; a null doc_id is not held out;
    of ids that repeat in labels the least label counts; rows that repeat a doc_id each get a row; without labels all
    scores are 0.5; an empty table gives an empty result; other columns are not read.
    """
    model = fit(docs, labels, max_rows=max_rows, max_cells=max_cells)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, max_rows: int = 8_000, max_cells: int = 40_000_000) -> DataFrame:
    """Rows of docs that the classifier does not reject (score 0.5 or more), all columns as they were. Map only after the fit.

    Null and empty texts are judged by the model's bias; rows that repeat a doc_id are judged each by its own text; without
    labels, or with labels of good rows only, all rows stay; with labels of bad rows only none does; an empty table gives
    an empty result. Other columns, whatever their names, are not read.
    """
    model = fit(docs, labels, max_rows=max_rows, max_cells=max_cells)
    return docs.filter(scorer(model)("text") >= 0.5)
