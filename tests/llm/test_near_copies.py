import random

import numpy as np
import pytest

from tidemill.llm import common, simhash


@pytest.fixture
def ready(spark):
    common.workers_import_this(spark)
    return spark


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def jaccard(x, y):
    x, y = shingles(x), shingles(y)
    return len(x & y) / len(x | y)


def pairs(words, low, high, count, rnd, low_words=0):
    """Texts of so many words, and copies with some words replaced or added whose similarity lies from low to high."""
    vocabulary = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(3000)]
    out = []
    while len(out) < count:
        x = rnd.choices(vocabulary, k=words)
        y = x + rnd.choices(vocabulary, k=rnd.randint(0, 7))
        for _ in range(rnd.randint(low_words, words // 40)):
            y[rnd.randrange(words)] = rnd.choice(vocabulary)
        x, y = " ".join(x), " ".join(y)
        if low <= jaccard(x, y) <= high:
            out.append((x, y))
    return out


def components(spark, both):
    rows = [(2 * k + side, text) for k, pair in enumerate(both) for side, text in enumerate(pair)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r.doc_id: r.component_id for r in found.collect()}


def test_pairs_of_all_lengths_are_found(ready):
    rnd = random.Random(7)
    both = [pair for words in (30, 100, 400) for pair in pairs(words, 0.8, 0.85, 60, rnd)]
    far = [simhash.fingerprint(simhash.shingle_hashes(simhash.words_of(x), 1)) ^ simhash.fingerprint(simhash.shingle_hashes(simhash.words_of(y), 1)) for x, y in both]
    assert sum((v & (1 << 64) - 1).bit_count() > 5 for v in far) > 3
    got = components(ready, both)
    assert [k for k in range(len(both)) if got[2 * k] != got[2 * k + 1]] == []
    assert len(set(got.values())) == len(both)


def test_links_are_decided_by_whole_sets(ready):
    rnd = random.Random(8)
    below = pairs(1000, 0.77, 0.799, 60, rnd, low_words=5)
    above = pairs(1000, 0.8, 0.82, 60, rnd, low_words=5)
    got = components(ready, below + above)
    assert [jaccard(*pair) for k, pair in enumerate(below + above) if (got[2 * k] == got[2 * k + 1]) != (k >= len(below))] == []


def test_spanning_edges_are_links():
    rnd = np.random.default_rng(3)
    i, j = rnd.integers(0, 200, 150), rnd.integers(0, 200, 150)
    forest = simhash.Forest(200)
    for k in range(0, 150, 50):
        forest.join(i[k : k + 50], j[k : k + 50])
    again, told = simhash.Forest(200), [pair for a, b in forest.edges for pair in zip(a.tolist(), b.tolist())]
    assert set(told) <= set(zip(i.tolist(), j.tolist())) and len(told) == 200 - len(set(forest.root.tolist()))
    again.join(*np.array(told).T)
    assert np.array_equal(again.root, forest.root)


def test_equal_keys_are_told_apart_by_verify():
    rng = np.random.default_rng(4)
    keys = np.full(300, 12345, dtype=np.uint64)
    kind = rng.integers(0, 5, 300)
    forest = simhash.Forest(300)
    simhash.trie_links(keys, [(0, 300, 0, 300, 12, 0)], 3, forest, lambda i, j: kind[i] == kind[j])
    assert len(set(zip(kind.tolist(), forest.root.tolist()))) == 5 == len(set(forest.root.tolist()))
    sides = simhash.Forest(300)
    simhash.trie_links(keys, [(0, 150, 150, 300, 12, 0)], 3, sides, lambda i, j: kind[i] == kind[j])
    assert len(set(zip(kind.tolist(), sides.root.tolist()))) == 5
