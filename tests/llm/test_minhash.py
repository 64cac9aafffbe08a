import random
import re
import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import common, minhash, simhash

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture
def ready(spark):
    common.workers_import_this(spark)
    return spark


def plain_set(text, n):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def plain_components(rows, n=2):
    """(doc_id, size of the set, component) of each row, all pairs compared."""
    sets = [plain_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return [(d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def found(docs, **options):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_components(docs, **options).collect())


def near(rnd, base, edits):
    w = base.split()
    for _ in range(edits):
        w[rnd.randrange(len(w))] = "".join(rnd.choices("abcdef", k=6))
    return " ".join(w)


def test_word_hashes_follow_the_words():
    rnd = random.Random(1)
    texts = ["", " \t\x0b", "a", "A b\x0cC d  e\n", "Ä ä K K", "x" * 70_000 + " y " + "x" * 70_000, " ".join(rnd.choices(["ab", "Ab", "ba", "b", "aab"], k=40_000))]
    known = {}
    for text in texts:
        words, got = text.encode().lower().split(), minhash.word_hashes(text)
        assert len(words) == len(got) and np.array_equal(got, minhash.word_hashes(text, 64))
        assert all(known.setdefault(w, h) == h for w, h in zip(words, got.tolist()))
    assert len(set(known.values())) == len(known)


def test_components_of_the_table_and_odd_rows(ready):
    rnd = random.Random(2)
    rows = [(r.doc_id, r.text) for r in ready.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    base = " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(60))
    rows += [(None, None), (None, ""), (-1, " \n"), (-2, ""), (-3, "one"), (-4, "ONE"), (-5, "one two"), (-6, "two one"), (None, base), (None, base + " more"), (-7, base.upper()), (-7, base), (-7, "quite another text here"), (-8, near(rnd, base, 2)), (-9, near(rnd, base, 9)), (-10, "again " * 500), (-11, "again " * 3)]
    docs = ready.createDataFrame([(*r, "x", 1, b"z") for r in rows], "doc_id long, text string, node string, n long, tokens binary")
    want = Counter(plain_components(rows))
    assert found(docs) == want and found(docs, hot=2) == want
    kept = minhash.near_components(docs).filter("kept <> (doc_id <=> component_id)")
    assert kept.count() == 0 and found(docs.limit(0)) == Counter()


def test_hot_lists_lose_no_link(ready):
    """Chains and families of near copies about one passage, dealt over lists of at most five rows."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefgh", k=rnd.randint(2, 6)))
    passage, rows = " ".join(word() for _ in range(30)), []
    for family in range(3):
        text = passage + " " + " ".join(word() for _ in range(40 + 30 * family))
        for _ in range(40):
            text = near(rnd, text, rnd.randint(1, 4)) if rnd.random() < 0.5 else text
            rows.append((len(rows), near(rnd, text, rnd.randint(0, 5))))
    rows += [(len(rows) + k, passage + " " + " ".join(word() for _ in range(rnd.randint(5, 200)))) for k in range(60)]
    docs = ready.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = Counter(plain_components(rows))
    assert 20 < len({c for _, _, c in want}) < len(rows)
    assert found(docs, hot=5) == want and found(docs) == want


def test_many_copies_hide_no_near_copy(ready):
    """One text of each of eight pairs is copied 12,000 times, over partitions that are not coalesced."""
    rnd = random.Random(4)
    pairs = []
    for k in range(8):
        w = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(46)]
        pairs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w, "one", "more"]))]
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {c: ready.conf.get(c) for c in conf}
    for c, v in conf.items():
        ready.conf.set(c, v)
    try:
        docs = ready.createDataFrame(pairs, "pair long, text string")
        copies = docs.filter("pair % 2 = 0").select(F.explode(F.sequence(F.lit(0), F.lit(11_999))).alias("k"), "pair", "text").select((100 + F.col("pair") + 16 * F.col("k")).alias("doc_id"), "text")
        docs = docs.select(F.col("pair").alias("doc_id"), "text").unionByName(copies)
        got = simhash.near_duplicates(docs).groupBy("component_id").count().collect()
        assert sorted((r.component_id, r["count"]) for r in got) == [(2 * k, 12_002) for k in range(8)]
    finally:
        for c, v in was.items():
            ready.conf.set(c, v)


def test_unlike_texts_of_equal_words_take_no_quadratic_time():
    """Many equal word fingerprints: pairs that are tried grow as rows."""
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 256, size=(20_000, minhash.COORDS), dtype=np.uint8)
    rows[1::2] = rows[::2]  # pairs of equal signatures
    rows[1::2, 40:] += 1
    verify = simhash.Coordinates(rows, 0.7)
    forest = simhash.Forest(len(rows))
    simhash._across(np.full(len(rows), 7, dtype=np.uint64), 0, len(rows), 0, len(rows), 5, forest, verify)
    assert np.array_equal(forest.root, np.repeat(np.arange(0, len(rows), 2), 2))


def test_tables_of_another_thread_stay(ready):
    opened, written = threading.Event(), threading.Event()
    found = {}

    def other():
        opened.wait(60)
        found["df"] = common.materialize(ready.range(5), "other")
        written.set()

    thread = threading.Thread(target=other)
    thread.start()
    with common.passing_tables(ready) as keep:
        opened.set()
        own = common.materialize(ready.range(3), "own")
        keep.append(common.materialize(ready.range(4), "kept"))
        written.wait(60)
    thread.join()
    assert found["df"].count() == 5 and keep[0].count() == 4
    with pytest.raises(Exception, match="(?i)exist"):
        own.count()


def test_a_signature_collision_is_no_link(ready):
    """Sets are told apart by 128 bits and whole sets: equal forms and tokens alone link nothing."""
    a, b = (minhash.shingle_set(minhash.word_hashes(t), 2) for t in ("some text of its own", "some text of her own"))
    sets = ready.createDataFrame([(1, bytearray(a.tobytes())), (2, bytearray(b.tobytes())), (3, bytearray(a.tobytes()))], "id long, members binary")
    pairs = ready.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert [(r.a, r.b) for r in minhash.similar(pairs, sets, 0.8).collect()] == [(1, 3)]


def test_a_list_says_each_row_twice_at_most(ready):
    """The first round's rows grow with a group of near copies, not with its square; each row of it is told."""
    rnd = random.Random(6)
    base = " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(80))
    kinds = "token long, salt int, id long, n long, form binary, root long, home boolean, busy boolean"
    for count in (100, 200):
        sets = [minhash.shingle_set(minhash.word_hashes(near(rnd, base, 2)), 2) for _ in range(count)]
        forms = [minhash.signature(s).astype(np.uint8).tobytes() + minhash.parity_bits(s).tobytes() for s in sets]
        rows = ready.createDataFrame([(1, 0, k, len(s), bytearray(f), k, True, False) for k, (s, f) in enumerate(zip(sets, forms))], kinds)
        told = [(r.a, r.b) for r in minhash.meet(rows, 0.8, "screen").collect()]
        paired = {k for pair in told if pair[1] is not None for k in pair}
        assert paired | {a for a, _ in told} == set(range(count)) and len(told) <= 2 * count
        assert not paired & {a for a, b in told if b is None}


def test_matches_across_components_grow_with_rows(ready):
    """A list whose rows all match and all stand alone gives fewer matches than rows; they join what any match joins."""
    rnd = random.Random(7)
    kinds = "token long, salt int, id long, n long, form binary, root long, home boolean"
    base = " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(100))
    for count in (60, 120):
        sets = [minhash.shingle_set(minhash.word_hashes(near(rnd, base, 2)), 2) for _ in range(count)]
        forms = [minhash.signature(s).astype(np.uint8).tobytes() + minhash.parity_bits(s).tobytes() for s in sets]
        rows = ready.createDataFrame([(1, 0, k, len(s), bytearray(f), k, True) for k, (s, f) in enumerate(zip(sets, forms))], kinds)
        told = [(r.a, r.b) for r in minhash.meet(rows, 0.8, "all").collect()]
        assert len(told) < count
        lists = minhash.Lists(rows.sort("n", "id").toArrow().combine_chunks(), 800, ["token", "salt"])
        matches = [(a, b) for i, j, _ in lists.pairs() for a, b in zip(lists.ids[i].tolist(), lists.ids[j].tolist())]
        whole, part = simhash.Forest(count), simhash.Forest(count)
        whole.join(*np.array(matches).T), part.join(*np.array(told).T)
        assert len(matches) > 5 * count and np.array_equal(whole.root, part.root)
        assert {(min(m), max(m)) for m in matches} >= set(told)


def test_blocks_compare_all_pairs_of_a_group(ready):
    """Groups dealt into shares of three rows, and whole: the links join what comparing all whole sets joins."""
    rnd = random.Random(8)
    texts = []
    for _ in range(3):
        base = " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(60))
        texts += [near(rnd, base, rnd.randint(1, 6)) for _ in range(25)]
    sets = [minhash.shingle_set(minhash.word_hashes(t), 2) for t in texts]
    forms = ready.createDataFrame([(k, len(s), bytearray(minhash.signature(s).astype(np.uint8).tobytes() + minhash.parity_bits(s).tobytes())) for k, s in enumerate(sets)], "id long, n long, form binary")
    members = ready.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "id long, members binary")
    matched = ready.createDataFrame([(k, k + 1) for k in range(len(sets) - 1) if (k + 1) % 25], "a long, b long")
    want = plain_components(list(enumerate(texts)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) * 10 >= 8 * len(np.union1d(sets[i], sets[j]))]
    known = simhash.Forest(len(sets))
    known.join(*np.array([p for p in links if max(p) < 20]).T)  # one large root, and many others
    roots = ready.createDataFrame([(k, int(known.root[k])) for k in range(20)], "node long, root long")
    assert 5 < len({c for _, _, c in want}) < len(sets) - 10
    for hot in (3, 2000):
        dealt = minhash.blocks(matched, roots, forms, hot)
        assert dealt.groupBy("group", "x", "y").count().agg(F.max("count")).first()[0] <= (24 if hot == 3 else 25)
        got = [(r.a, r.b) for r in minhash.settle(dealt.join(forms, "id").join(members, "id"), 0.8).collect()]
        assert {(max(p), min(p)) for p in got} <= set(links)
        forest = simhash.Forest(len(sets))
        forest.join(*np.array(got + [p for p in links if max(p) < 20]).T)
        assert [(k, int(r)) for k, r in enumerate(forest.root)] == [(d, c) for d, _, c in want]
