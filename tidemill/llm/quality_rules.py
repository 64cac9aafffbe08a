"""Quality rules: fixed base rules, and an isolation forest on the statistics that the rules use."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, materialize, slices, texts_of, to_batch

SYMBOLS, UPPER = b"#*$%&|<>", bytes(range(0x41, 0x5B))
MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_marks")
#: What the forest splits on; shares, so that long and short texts compare.
FEATURES = ("word_length", "symbols", "repeats", "upper", "marks")
STATS = "doc_id long, " + ", ".join(f"{c} long" for c in BASE + MORE)
#: Score cells that thresholds are chosen from.
CELLS = 2000


def repeat_words(words: list[bytes], n: int = 5) -> int:
    """Words that lie in an n-word window found twice or more."""
    grams = list(zip(*(words[k:] for k in range(n))))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    found = np.flatnonzero(np.fromiter((counts[g] > 1 for g in grams), dtype=bool, count=len(grams)))
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(inside, found, 1)
    np.add.at(inside, found + n, -1)
    return int((np.cumsum(inside) > 0).sum())


def stats_of(text: str) -> tuple[int, ...]:
    """BASE, then MORE, of one text."""
    data = text.encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]

    def count(letters: bytes) -> int:
        return len(data) - len(data.translate(None, letters))

    chars = len(text) - count(b" \t\n\r\x0b\x0c")
    return len(words), chars, count(SYMBOLS), len(lines) - len(set(lines)), repeat_words(words), count(UPPER), count(MARKS)


def rule_stats(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of BASE and MORE for every row. Map only; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [stats_of(t) for t in texts_of(batch)]
            columns = {c: (pa.int64(), [r[k] for r in rows]) for k, c in enumerate(BASE + MORE)}
            yield to_batch({"doc_id": (pa.int64(), batch.column(0))} | columns)

    return docs.select("doc_id", "text").mapInArrow(run, STATS)


def feature_columns() -> list:
    words, chars = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars"))
    said = (F.col("word_chars") / words, F.col("n_symbols") / words, F.col("n_repeat_words") / words, F.col("n_upper") / chars, F.col("n_marks") / chars)
    return [e.cast("double").alias(c) for e, c in zip(said, FEATURES)]


class IsolationForest:
    """Trees of random splits over samples of `sample` rows. Unusual rows part from the rest after few splits."""

    def __init__(self, rows: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(rows))
        self.trees = [self._tree(rows[rng.choice(len(rows), self.sample, replace=False)], rng) for _ in range(trees)] if len(rows) > 1 else []

    @staticmethod
    def usual_path(n: int) -> float:
        """Mean path of an unsuccessful search in a binary tree of n rows, the length that a leaf of n rows adds."""
        return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def _tree(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        deepest = max(1, math.ceil(math.log2(max(2, len(rows)))))
        feature, cut, left, path = [], [], [], []
        todo = [(rows, 0)]
        feature.append(0), cut.append(0.0), left.append(0), path.append(0.0)
        at = 0
        while at < len(todo):
            own, depth = todo[at]
            low, high = own.min(axis=0), own.max(axis=0)
            wide = np.flatnonzero(high > low)
            if depth >= deepest or len(own) < 2 or not len(wide):
                left[at], path[at] = at, depth + self.usual_path(len(own))  # a leaf leads to itself
                cut[at] = math.inf
            else:
                f = int(rng.choice(wide))
                c = float(rng.uniform(low[f], high[f]))
                feature[at], cut[at], left[at] = f, c, len(todo)
                under = own[:, f] <= c
                for half in (own[under], own[~under]):
                    todo.append((half, depth + 1))
                    feature.append(0), cut.append(0.0), left.append(0), path.append(0.0)
            at += 1
        return np.array(feature), np.array(cut), np.array(left), np.array(path), deepest

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; the higher, the more unusual."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total, place = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, left, path, deepest in self.trees:
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(deepest):
                node = left[node] + (rows[place, feature[node]] > cut[node])
            total += path[node]
        return np.exp2(-total / len(self.trees) / max(self.usual_path(self.sample), 1e-9))


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """stats of rows with a label, with its `good`; of ids that repeat in labels the least label counts."""
    own = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("good"))
    return stats.join(own, "doc_id")


def fit(stats: DataFrame, labels: DataFrame, *, max_fit: int, max_good_rejected: float, trees: int, sample: int) -> tuple[IsolationForest, float]:
    """The forest, from at most max_fit rows labelled as good, and its threshold, from all labelled rows.

    Rows that repeat a doc_id count each; null ids and labels are left out; without rows nothing is ever found unusual.
    """
    known = materialize(labelled(stats.filter("NOT base_failed"), labels).select("doc_id", "good", *feature_columns()), "labelled")
    good, place = known.filter("good = 1"), F.xxhash64("doc_id")
    share = 2 * max_fit / max(good.count(), 1)
    if share < 1:  # hashes are even: twice the rows wanted lie below, so no task sends rows that cannot be chosen
        good = good.filter(place < int(share * 2**64) - 2**63)
    chosen = good.orderBy(place, "doc_id").limit(max_fit).select(*FEATURES).toPandas()
    forest = IsolationForest(chosen.to_numpy(dtype=float), trees, sample)
    cells = known.groupBy("good", F.floor(scorer(forest)(*FEATURES) * CELLS).alias("cell")).count().collect()
    return forest, choose_threshold([(r["cell"], r["good"] == 1, r["count"]) for r in cells], max_good_rejected) / CELLS


def choose_threshold(cells: list[tuple[int, bool, int]], max_good_rejected: float, price: float = 5.0) -> int:
    """The cell from which rows are rejected. cells: (cell, good, rows).

    Of the cuts that reject at most max_good_rejected of the good rows, the one with the greatest share of bad rows
    caught less `price` times the share of good rows lost; a cut above all cells if none gains.
    """
    totals = [max(1, sum(n for _, good, n in cells if good == kind)) for kind in (False, True)]
    best, cut, lost = 0.0, max([c for c, _, _ in cells], default=CELLS) + 1, [0, 0]
    for cell in sorted({c for c, _, _ in cells}, reverse=True):
        for c, good, n in cells:
            if c == cell:
                lost[good] += n
        if lost[True] > max_good_rejected * totals[True]:
            break
        gain = lost[False] / totals[False] - price * lost[True] / totals[True]
        if gain > best:
            best, cut = gain, cell
    return cut


def scorer(forest: IsolationForest):
    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            yield pa.array(forest.score(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])))

    return score


def quality_rules(docs: DataFrame, labels: DataFrame, *, max_fit: int = 20_000, max_good_rejected: float = 0.01, trees: int = 100, sample: int = 256) -> DataFrame:
    """doc_id, the counts of BASE, base_failed, anomaly (0 to 1, null without verdict) and kept, of every row of docs.

    base_failed: fewer than 10 words, or over 20 % of them in repeated 5-word windows. Others are kept unless the
    isolation forest finds them more unusual than the threshold that choose_threshold takes. The forest is fitted
    on at most max_fit rows labelled as good (by a hash of doc_id); its threshold comes from all labelled rows, and every document
    is scored. Statistics are counted once and written.

    Null and empty texts have 0 of everything and fail; without labels nothing is found unusual; rows that repeat a doc_id
    each get a row; an empty table gives an empty result; other columns are not read.
    """
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words").alias("base_failed")
    stats = materialize(rule_stats(docs).select("*", failed), "rule_stats")
    forest, threshold = fit(stats, labels, max_fit=max_fit, max_good_rejected=max_good_rejected, trees=trees, sample=sample)
    scored = stats.select("doc_id", *BASE, "base_failed", *feature_columns()).withColumn("anomaly", scorer(forest)(*FEATURES))
    return scored.select("doc_id", *BASE, "base_failed", F.when(~F.col("base_failed"), F.col("anomaly")).alias("anomaly"), (~F.col("base_failed") & (F.col("anomaly") < F.lit(threshold))).alias("kept"))


def keep_by_rules(docs: DataFrame, labels: DataFrame, *, max_fit: int = 20_000, max_good_rejected: float = 0.01, trees: int = 100, sample: int = 256) -> DataFrame:
    """Rows of docs that quality_rules keeps, all columns as they were.

    The forest and its threshold come from statistics of all rows, of which only those of labelled rows are joined; the
    verdict is then taken row by row from the text, so texts are not shuffled. Null and empty texts go; rows that repeat a
    doc_id are judged each by its own text; without labels only the base rules count; an empty table gives an empty result;
    other columns, whatever their names, are not read.
    """
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words").alias("base_failed")
    forest, threshold = fit(rule_stats(docs).select("*", failed), labels, max_fit=max_fit, max_good_rejected=max_good_rejected, trees=trees, sample=sample)

    @F.arrow_udf("boolean")
    def keeps(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = np.array([stats_of(t) for t in each_text(texts)], dtype=np.int64).reshape(-1, len(BASE + MORE))
            own = dict(zip(BASE + MORE, rows.T))
            failed = (own["n_words"] < 10) | (100 * own["n_repeat_words"] > 20 * own["n_words"])
            words, chars = np.maximum(own["n_words"], 1), np.maximum(own["word_chars"], 1)
            features = np.column_stack([own["word_chars"] / words, own["n_symbols"] / words, own["n_repeat_words"] / words, own["n_upper"] / chars, own["n_marks"] / chars])
            yield pa.array(~failed & (forest.score(features) < threshold))

    return docs.filter(keeps("text"))
