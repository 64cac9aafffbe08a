import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from tidemill.llm import bitplanes, common, whitening

DATA = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<double>, n string, component string, cluster string"


@pytest.fixture
def ready(spark):
    common.workers_import_this(spark)
    return spark


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], KIND)


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def plain_clusters(rows, k=8, rounds=10):
    """By the words of the contract, without planes."""
    own = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if usable(v) and len(v) == 64]
    first = sorted(own, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    x, centres = np.array([v for _, v in own]).reshape(-1, 64), np.array([v for _, v in first]).reshape(-1, 64)
    near = lambda: ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        cluster = near().argmin(axis=1)
        for c in range(len(centres)):
            if (cluster == c).any():
                centres[c] = [math.floor(Fraction(int(s), int((cluster == c).sum()))) for s in x[cluster == c].sum(axis=0)]
    d = near()
    cluster = d.argmin(axis=1)
    out = []
    for (i, _), c, row in zip(own, cluster.tolist(), d.tolist()):
        out.append((i, c, row[c], sum(r[k] for r, k in zip(d.tolist(), cluster.tolist()) if k == c), sum(r[k] for r, k in zip(d.tolist(), cluster.tolist())), hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


def clusters_of(df):
    return order(tuple(r) for r in bitplanes.cluster_report(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_planes_give_exact_products():
    rng = np.random.default_rng(1)
    x = rng.integers(-(1 << 12), 1 << 12, size=(50, 64))
    x[0] = -(1 << 12)
    planes = bitplanes.planes_of(x, 13)
    assert planes.shape == (50, 13) and np.array_equal(bitplanes.dot_products(planes, planes[:7]), x @ x[:7].T)
    assert np.array_equal(bitplanes.own_products(planes), (x * x).sum(axis=1))


def test_clusters_of_the_table(ready):
    df = ready.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = clusters_of(df)
    assert len(got) > 100 and got == order(plain_clusters(rows))


def test_clusters_of_odd_vectors(ready):
    rng = np.random.default_rng(2)
    good = [(k, rng.normal(size=64).tolist()) for k in range(40)]
    same = [(100 + k, good[0][1]) for k in range(30)]
    odd = [(50, None), (51, [None] * 64), (52, [math.nan] + [0.0] * 63), (53, [math.inf] + [0.0] * 63), (54, []), (55, [1.0] * 63), (56, [1.0] * 65), (None, good[1][1]), (None, good[2][1]), (3, good[4][1])]
    assert clusters_of(frame(ready, good + same + odd)) == order(plain_clusters(good + same + odd))
    few = [(1, [0.5] * 64), (2, [-0.5] * 64), (3, [0.5] * 64)]
    assert clusters_of(frame(ready, few)) == order(plain_clusters(few))
    assert clusters_of(frame(ready, odd[:7])) == [] and clusters_of(frame(ready, [])) == []
    with pytest.raises(ValueError, match="long"):
        bitplanes.clusters(frame(ready, [(1, [1e9] * 64)]))


def plain_whitening(rows, components=4):
    """Exact whole numbers by Python, eigenvectors by numpy in double precision."""
    own = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if usable(v) and v]
    distinct = np.array(sorted({tuple(x) for _, x in own}), dtype=object)
    n, sums = len(distinct), distinct.sum(axis=0)
    y = n * distinct - sums
    v = (y.T @ y / Fraction(n) ** 3).astype(float)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in own:
        d = n * np.array(x, dtype=object) - sums
        w = (d / n).astype(float) @ vectors[:, :components]
        out += [(i, k + 1, n, s if (s := int((d * d).sum())) < 1 << 63 else None, w[k] / math.sqrt(values[k]), values[k] / values.sum()) for k in range(min(components, len(x)))]
    return out


def hold(got, want):
    """Equal but for the sign of each component, which is the same for all rows."""
    got, want = (sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3] or 0, abs(r[4]))) for rows in (got, want))
    assert len(got) == len(want) and [g[:4] for g in got] == [w[:4] for w in want]
    for k in {g[1] for g in got}:
        a, b = (np.array([r[4] for r in rows if r[1] == k]) for rows in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        a, b = (np.array([r[5] for r in rows if r[1] == k]) for rows in (got, want))
        assert np.abs(a / b - 1).max() < 1e-9


def whitened(df, **options):
    rows = whitening.whitened_components(df, **options).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()
    assert len({r.identity_error for r in rows}) <= 1 and all(r.identity_error <= 1e-9 for r in rows)
    return [tuple(r)[:6] for r in rows]


def test_whitening_of_the_table(ready):
    df = ready.read.parquet(f"{DATA}/embeddings.parquet")
    hold(whitened(df), plain_whitening([(r.vec_id, r.embedding) for r in df.collect()]))


def test_whitening_of_odd_vectors(ready):
    rng = np.random.default_rng(5)
    good = [(k, (rng.normal(size=5) * [3, 2.5, 1, 0.5, 0.2]).tolist()) for k in range(60)]
    odd = [(90, None), (91, [None] * 5), (92, [math.nan, 0.0, 0.0, 0.0, 0.0]), (93, [0.0, 0.0, -math.inf, 0.0, 0.0]), (94, [])]
    copies = [(200 + k, good[3][1]) for k in range(40)] + [(None, good[4][1]), (5, good[6][1]), (7, [-0.0, 0.0, 0.001, 0.002, 0.003])]
    hold(whitened(frame(ready, good + copies + odd + [(95, [1.0, 2.0])])), plain_whitening(good + copies))
    hold(whitened(frame(ready, [(i, v[:2] if v else v) for i, v in good])), plain_whitening([(i, v[:2]) for i, v in good]))
    for s in (1e6, 1e9):
        large = [(k, (rng.normal(size=3) * s).tolist()) for k in range(9)]
        hold(whitened(frame(ready, large), components=3), plain_whitening(large, 3))
    huge = whitening.whitened_components(frame(ready, [(1, [1e300, 0.0]), (2, [-1e300, 1.0])])).collect()
    assert {r.vec_id for r in huge} == {1, 2} and {r.deviation for r in huge} == {None}
    assert whitened(frame(ready, odd)) == [] and whitened(frame(ready, [])) == []


def test_directions_without_spread_are_null(ready):
    got = whitening.whitened_components(frame(ready, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in got} == {(i, c, 1, 0, None, 0.0) for i in (1, 2) for c in (1, 2)}
    got = whitening.whitened_components(frame(ready, [(1, [0.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, 2.0])])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got) and {r.identity_error < 1e-9 for r in got} == {True}


@pytest.mark.parametrize("values", [[9, 5, 2, 1], [9, 9 + 1e-9, 9 + 2e-9, 1], [4, 4, 4, 4], [1e6, 1e6 + 1e-7, 1, 1 + 1e-12, 1e-3, 1e-3]])
def test_clustered_eigenvalues_are_told_apart(values):
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.normal(size=(len(values),) * 2))[0].astype(np.longdouble)
    for _ in range(3):
        q = q @ (3 * np.eye(len(values), dtype=np.longdouble) - q.T @ q) / 2
    told = np.sort(np.array(values, dtype=np.longdouble))[::-1]
    order = np.argsort(-np.array(values, dtype=np.longdouble), kind="stable")
    a = q @ np.diag(np.array(values, dtype=np.longdouble)) @ q.T
    found, x = whitening.refined_eigen((a + a.T) / 2)
    assert np.abs(found - told).max() < 1e-15 * max(values)
    assert np.abs(x.T @ x - np.eye(len(values))).max() < 1e-17
    for k in range(len(values)):
        if min(abs(told[k] - told[j]) for j in range(len(values)) if j != k) > 1e-10 * max(values):
            assert abs(abs(x[:, k] @ q[:, order[k]]) - 1) < 1e-15
            assert np.abs(a @ x[:, k] - found[k] * x[:, k]).max() < 1e-16 * max(values)


def test_gram_is_exact():
    rng = np.random.default_rng(7)
    for most in (100, 1 << 30, 1 << 59):
        y = rng.integers(-most, most, size=(30, 4))
        assert (whitening.exact_gram(y) == y.astype(object).T @ y.astype(object)).all() and (whitening.exact_sums(y) == y.astype(object).sum(axis=0)).all()
