import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemill.llm import common, graph, nbsvm, packing, pipeline, quality_rules, queries, simhash

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture
def ready(spark):
    common.workers_import_this(spark)
    return spark


def components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_connected_components(ready):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(40)] + [(200, 201 + i) for i in range(30)]
    got = {r.node: r.root for r in graph.connected_components(ready.createDataFrame(edges, "a long, b long")).collect()}
    want = components(300, edges)
    assert set(got) == {n for e in edges if e[0] != e[1] for n in e}
    assert len({(want[n], root) for n, root in got.items()}) == len(set(got.values())) == len({want[n] for n in got})
    assert graph.connected_components(ready.createDataFrame([], "a long, b long")).count() == 0
    assert graph.connected_components(ready.createDataFrame([(None, 1), (2, 2)], "a long, b long")).count() == 0


def test_a_sorted_path_takes_few_rounds(ready, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "materialize", lambda df, label: written.append(label) or common.materialize(df, label))
    n = 4096
    found = graph.connected_components(ready.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert found.agg(F.count("*"), F.countDistinct("node"), F.countDistinct("root")).first()[:] == (n, n, 1)
    assert written.count("hooks") // 2 <= 15


@pytest.mark.parametrize("radius, hot", [(2, 100_000), (2, 5), (4, 100_000), (3, 2)])
def test_trie_join_finds_every_link(ready, radius, hot):
    rnd = random.Random(radius)
    keys = set()
    for _ in range(25):
        x = rnd.getrandbits(64)
        for _ in range(12):
            y = x
            for _ in range(rnd.randint(0, 6)):
                y ^= 1 << rnd.randrange(64)
            keys.add(y)
    keys |= {0xABCDE << 44 | i * 7 for i in range(60)}  # many in one block
    keys = sorted(np.array(sorted(keys), dtype=np.uint64).view(np.int64).tolist())
    u = np.array(keys, dtype=np.int64).view(np.uint64)
    edges = [(i, j) for i in range(len(u)) for j in range(i) if bin(int(u[i]) ^ int(u[j])).count("1") <= radius]
    want = components(len(u), edges)
    found = simhash.links(ready.createDataFrame([(k, k) for k in keys], "node long, fp long"), radius, hot=hot)
    at = {k: i for i, k in enumerate(keys)}
    got = components(len(u), [(at[r.a], at[r.b]) for r in found.collect()])
    assert got == want and len(set(want)) > 10


def test_fingerprints_against_brute_force(ready):
    own = [(None, None), (1, ""), (2, "One two"), (3, "ONE TWO three FOUR five"), (4, "one two three four five"), (5, "é\x0bÀ  b\tc d"), (6, "a " * 400), (6, "a " * 400)]
    got = simhash.simhash_components(ready.createDataFrame([(*r, "x") for r in own], "doc_id long, text string, fp string")).collect()

    def fp(text):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return format(sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)), "016x")

    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((d, fp(t)) for d, t in own)
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[None] == comp[1] == 1 and comp[4] == comp[3] == 3 and comp[6] == 6
    assert simhash.simhash_components(ready.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_copies_leave_one(ready):
    rnd = random.Random(2)
    base = [" ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(300)) for _ in range(20)]
    rows, n = [], 0
    for b in base:
        rows.append((n, b))
        n += 1
    for k in range(5):
        w = base[k].split()
        w[150] = "changed"
        rows += [(n, " ".join(w)), (n + 1, base[k]), (n + 2, base[k].upper())]
        n += 3
    rows += [(None, base[0]), (n, ""), (n + 1, None), (n, "")]
    docs = ready.createDataFrame([(*r, "x", len(r[1] or "")) for r in rows], "doc_id long, text string, _key string, _text_key long")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(20), n]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_null_and_repeated_ids_are_no_copies(ready):
    rnd = random.Random(4)
    texts = [" ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 7))) for _ in range(40)) for _ in range(9)]
    own = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (6, texts[5])]
    own += [(None, texts[6]), (None, texts[6]), (7, texts[7]), (7, texts[7] + " more"), (8, texts[7]), (-(1 << 63), texts[8]), (None, texts[8]), (5, texts[3])]
    got = Counter((r.doc_id, r.text) for r in simhash.drop_near_duplicates(ready.createDataFrame(own, "doc_id long, text string")).collect())
    assert sum(got.values()) == len(got) == 9  # one row of each text's component, and none other is lost
    assert {(None, texts[k]) for k in (0, 1, 2, 6)} | {(5, texts[3]), (5, texts[4]), (6, texts[5]), (-(1 << 63), texts[8])} < set(got)
    assert len({x for x in got if x[1] in (texts[7], texts[7] + " more")}) == 1 and not any(d == 8 for d, _ in got)


def test_every_near_copy_of_the_table_is_found(ready):
    docs = ready.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)) for r in docs.collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for d, w in rows.items()}
    ids, by_shingle, shared = sorted(sets), {}, Counter()
    for d in ids:
        for x in sets[d]:
            for other in by_shingle.setdefault(x, []):
                shared[other, d] += 1
            by_shingle[x].append(d)
    edges = [(ids.index(a), ids.index(b)) for (a, b), n in shared.items() if 10 * n >= 8 * (len(sets[a]) + len(sets[b]) - n)]
    empty = [ids.index(d) for d in ids if not sets[d]]
    want = components(len(ids), edges + [(empty[0], k) for k in empty[1:]])
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert len(edges) > 30 and got == {d: ids[want[k]] for k, d in enumerate(ids)}


def base_of(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_rules_against_brute_force(ready):
    docs = ready.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(200).unionByName(ready.createDataFrame([(None, None), (-1, ""), (-2, "a b c d e " * 9), (-3, "x y\x0bz\n\n \nx\nx"), (-3, "# é")], "doc_id long, text string"))
    labels = ready.read.parquet(f"{DATA}/labels.parquet")
    got = quality_rules.quality_rules(docs, labels).collect()
    want = Counter((r.doc_id, *base_of(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0
    assert quality_rules.quality_rules(docs, labels.limit(0)).filter("NOT base_failed AND NOT kept").count() == 0
    kept = quality_rules.keep_by_rules(docs, labels)
    assert quality_rules.keep_by_rules(docs.limit(0), labels).count() == 0
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)


def test_verdicts_against_a_plain_forest(ready):
    docs, labels = ready.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), ready.read.parquet(f"{DATA}/labels.parquet")
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words").alias("base_failed")
    forest, threshold = quality_rules.fit(quality_rules.rule_stats(docs).select("*", failed), labels, max_fit=20_000, max_good_rejected=0.01, trees=100, sample=256)

    def walk(tree, row):
        feature, cut, left, path, _ = tree
        node = 0
        while left[node] != node:
            node = left[node] + int(row[feature[node]] > cut[node])
        return path[node]

    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = 0
    for r in quality_rules.quality_rules(docs, labels).collect():
        assert (r.anomaly is None) == r.base_failed
        if r.base_failed or seen >= 60:
            continue
        seen += 1
        text = texts[r.doc_id]
        upper, marks = sum("A" <= c <= "Z" for c in text), sum("!" <= c <= "~" and not c.isalnum() for c in text)
        row = (r.word_chars / r.n_words, r.n_symbols / r.n_words, r.n_repeat_words / r.n_words, upper / r.word_chars, marks / r.word_chars)
        mean = sum(walk(t, row) for t in forest.trees) / len(forest.trees)
        assert abs(r.anomaly - 2 ** (-mean / forest.usual_path(forest.sample))) < 1e-9 and r.kept == (r.anomaly < threshold)
    assert seen == 60
    good = sorted((r.anomaly for r in quality_rules.quality_rules(docs, labels).join(labels, "doc_id").filter("quality = 1 AND NOT base_failed").collect()))
    assert sum(x >= threshold for x in good) <= 0.01 * len(good) + 1


def test_forest_finds_outliers_and_thresholds():
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.normal(size=(500, 3)), np.full((3, 3), 9.0)])
    score = quality_rules.IsolationForest(rows).score(rows)
    assert score[-3:].min() > np.quantile(score[:500], 0.99)
    assert quality_rules.choose_threshold([(5, True, 99), (8, True, 1), (9, False, 10)], 0.05) == 9
    assert quality_rules.choose_threshold([(5, True, 100)], 0.05) == 6
    assert quality_rules.choose_threshold([], 0.05) > quality_rules.CELLS


def test_classifier_on_held_out_rows(ready):
    docs, labels = ready.read.parquet(f"{DATA}/documents.parquet"), ready.read.parquet(f"{DATA}/labels.parquet")
    docs = docs.select("doc_id", "text").withColumn("score", F.lit("x"))
    got = nbsvm.quality_scores(docs.unionByName(ready.createDataFrame([(None, None, ""), (-1, "", "")], "doc_id long, text string, score string")), labels)
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.collect()) and got.count() == docs.count() + 2
    flipped = labels.withColumn("quality", F.when(nbsvm.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert got.exceptAll(nbsvm.quality_scores(docs, flipped)).count() == 2  # held-out labels change nothing
    assert nbsvm.quality_scores(docs, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5


def test_dual_descent_is_optimal():
    rng = np.random.default_rng(5)
    good = rng.random(60) < 0.4
    rows = [np.unique(np.r_[rng.integers(0, 40, 12), rng.integers(40, 60, 6) if g else rng.integers(50, 70, 6)]).astype(np.int32) for g in good]
    model = nbsvm.NbSvm(rows, good, epochs=3000)
    fit = np.flatnonzero(np.random.default_rng(7).random(60) >= 0.25)  # the others calibrate
    counts = np.ones((2, nbsvm.DIMS))
    for k in fit:
        counts[int(good[k]), rows[k]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    x = np.zeros((60, 70))
    for k, cells in enumerate(rows):
        x[k, cells] = ratio[cells] / np.linalg.norm(ratio[cells])
    x, y = np.c_[x, np.ones(60)][fit], np.where(good[fit], 1.0, -1.0)
    most = np.where(good[fit], 1 / (2 * good[fit].mean()), 1 / (2 * (1 - good[fit].mean())))
    alpha = model.alpha[fit]
    w = (alpha * y) @ x
    slope = y * (x @ w) - 1
    assert np.abs(slope[(alpha > 1e-9) & (alpha < most - 1e-9)]).max() < 1e-4  # the conditions of the optimum
    assert (slope[alpha <= 1e-9] > -1e-4).all() and (slope[alpha >= most - 1e-9] < 1e-4).all() and (alpha >= 0).all() and (alpha <= most + 1e-12).all()
    primal = w @ w / 2 + most @ np.maximum(0, -slope)
    assert abs(primal - (alpha.sum() - w @ w / 2)) < 1e-3 * primal
    assert all(abs(model.margin(rows[k]) - x[i] @ w) < 1e-9 for i, k in enumerate(fit))


def test_classifier_takes_odd_tables(ready, monkeypatch):
    sent = []
    monkeypatch.setattr(nbsvm, "NbSvm", lambda rows, good, kept=nbsvm.NbSvm: sent.append([len(r) for r in rows]) or kept(rows, good))
    own = [(7, f"copy {k} of id seven") for k in range(300)] + [(k, f"plain words number {k}") for k in range(8, 60)] + [(60, "long " * 90_000 + "".join(map(chr, range(0x100, 0x3000)))), (None, None)]
    docs = ready.createDataFrame([(*r, "a", 0.5) for r in own], "doc_id long, text string, quality string, score double")
    labels = ready.createDataFrame([(k, k % 2, 0) for k in range(7, 61)] + [(7, None, 0), (None, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    got = nbsvm.quality_scores(docs, labels, max_rows=8, max_cells=2000)
    assert got.count() == len(own) and len(sent[0]) <= 8 and sum(sent[0]) <= 2000
    nbsvm.quality_scores(docs, labels)
    assert len(sent[1]) == sum(zlib.crc32(str(k).encode()) % 3 != 1 for k in range(7, 61))  # one row an id
    ones = labels.filter("quality = 1")
    assert nbsvm.keep_good(docs, ones).columns == docs.columns and nbsvm.keep_good(docs, ones).count() == len(own)
    assert nbsvm.keep_good(docs, labels.filter("quality = 0 AND doc_id <> 8")).count() == 0
    assert nbsvm.keep_good(docs.limit(0), labels).count() == 0 and nbsvm.keep_good(docs, labels.limit(0)).count() == len(own)


def test_pipeline_stages_take_odd_tables(ready):
    labels_dir = DATA
    docs = ready.read.parquet(f"{DATA}/documents.parquet").limit(300)
    more = ready.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (5, None, "en", "s", 0), (5, None, "en", "s", 0)], docs.schema)
    for name, stage in pipeline.STAGES:
        assert stage(ready, docs.limit(0), labels_dir).count() == 0
        docs = common.materialize(stage(ready, docs.unionByName(more), labels_dir), "odd") if name != "packing" else docs
        assert docs.filter("doc_id IS NULL OR text IS NULL OR text = ''").count() <= 4
    pieces = pipeline.STAGES[-1][1](ready, docs.unionByName(more), labels_dir)
    assert pieces.filter("doc_id IS NULL").count() >= 2 and pieces.filter("doc_id = 5").count() >= 2


def test_pipeline_stages(ready):
    
    docs = ready.read.parquet(f"{DATA}/documents.parquet")
    labels = dict((r.doc_id, r.quality) for r in ready.read.parquet(f"{DATA}/labels.parquet").collect())
    sizes = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        before = docs
        docs = common.materialize(stage(ready, docs, DATA), "stage")
        assert docs.columns == before.columns and docs.join(before, "doc_id", "left_anti").count() == 0
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in bad) < 0.1 * len(bad) and sum(d in kept for d in good) > 0.7 * len(good)
    assert docs.select("text").distinct().count() == docs.count()
    pieces = pipeline.STAGES[-1][1](ready, docs, DATA)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept
    first = packing.token_ids(docs.orderBy("doc_id").first().text, queries.BYTE_BPE, 0)
    own = pieces.filter(F.col("doc_id") == min(kept)).orderBy("start").collect()
    assert b"".join(bytes(r.ids) for r in own) == first.tobytes()
