import numpy as np
import pytest

from weftgraph.llm import embedding_dedup as E


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def planted(keep=400, d=64, seed=9):
    n = max(keep, 400)
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(0, n // 2, 2):  # pairs at different distances
        x[i + 1] = x[i] + rng.normal(size=d) * rng.uniform(0.02, 0.3)
    x[300:340] = x[299] + rng.normal(size=(40, d)) * 0.1  # a group
    return (x / np.linalg.norm(x, axis=1)[:, None])[:keep]


def brute(x, near):
    """(links, group) by row, of a matrix of links"""
    group = np.arange(len(x))
    for i, j in zip(*np.nonzero(near)):
        if group[i] != group[j]:
            group[(group == group[i]) | (group == group[j])] = min(group[i], group[j])
    return near.sum(axis=1), group


def links(x, margin=0.0):
    near = x @ x.T >= E.THRESHOLD + margin
    np.fill_diagonal(near, False)
    return near


def found(df):
    rows = df.collect()
    got = {r.vec_id: (r.group_id, r.n_links, r.n_equal) for r in rows}
    assert len(got) == len(rows)
    return got


def test_links_and_groups_against_brute_force(spark):
    x = planted()
    got = found(E.near_vectors(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])))
    least, most = links(x, 1e-6).sum(), links(x, -1e-6).sum()
    assert least > 1400 and least * 0.9 <= sum(n for _, n, _ in got.values()) <= most
    n, group = brute(x, links(x))
    same = sum(got[i] == (group[i], n[i], 0) for i in range(len(x)))
    assert same >= 0.95 * len(x)


@pytest.mark.parametrize("n, offset", [(2000, 0.0), (8000, 0.0), (2000, 0.8), (8000, 0.8)])
def test_recall_at_the_threshold(spark, n, offset):
    """Pairs planted just over the threshold, with and without a direction that all vectors share."""
    d, rng = 64, np.random.default_rng(n)
    common = rng.normal(size=d)
    x = rng.normal(size=(n, d)) / np.sqrt(d) + offset * common / np.linalg.norm(common)
    for i in range(0, 1000, 2):
        u = x[i] / np.linalg.norm(x[i])
        v = rng.normal(size=d)
        v -= (v @ u) * u
        c = rng.uniform(0.9505, 0.96)
        x[i + 1] = c * u + np.sqrt(1 - c * c) * v / np.linalg.norm(v)
    x /= np.linalg.norm(x, axis=1)[:, None]
    got = found(E.near_vectors(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])))
    assert sum(got[i][1] > 0 for i in range(1000)) >= 0.9 * 1000


def test_pairs_met_grow_as_the_vectors():
    met = []
    for n in (2000, 4000, 8000, 16000):
        bits, tables = E.plan_tables(n, E.flip_rate(E.THRESHOLD, 1.0))
        rng, pairs = np.random.default_rng(n), 0
        for _ in range(tables):
            size = np.bincount(rng.integers(0, 1 << bits, n))
            pairs += int((size * (size - 1) // 2).sum())
        met.append(pairs)
    assert all(b <= 2.5 * a for a, b in zip(met, met[1:])) and met[-1] < 40 * 16000


def test_codes_are_balanced_and_near(spark):
    x = planted(800)
    v = vectors(spark, [(i, row.tolist(), 0) for i, row in enumerate(x)]).select("embedding")
    n, mean, cov = E.moments(v)
    assert n == 800 and np.allclose(mean, x.mean(axis=0), atol=1e-6) and np.allclose(cov, np.cov(x.T, bias=True), atol=1e-6)
    for projection in E.fit(v, mean, cov, 2):
        assert np.allclose(projection.T @ projection, np.eye(64), atol=1e-6)  # axes and rotation are orthonormal
        ones = ((x - mean) @ projection >= 0).mean(axis=0)
        assert 0.3 < ones.min() and ones.max() < 0.7
        # the rotation brings vectors nearer to their codes than it did at first
        loss = lambda p: np.square(np.sign((x - mean) @ p) - (x - mean) @ p).sum()
        assert loss(projection) < loss(E.fit(v, mean, cov, rounds=0)[0])


def test_large_groups_are_cut(spark):
    x = planted(400, seed=5)
    x[100:300] = x[100] + np.random.default_rng(1).normal(size=(200, 64)) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    v = vectors(spark, [(i, row.tolist(), 0) for i, row in enumerate(x)])
    assert found(E.near_vectors(v, block=70)) == found(E.near_vectors(v))


def test_copies_and_groups(spark):
    x = planted(60)
    rows = [(i, x[0].tolist(), 0) for i in range(50)] + [(100, x[1].tolist(), 0), (101, x[20].tolist(), 0)]
    got = found(E.near_vectors(vectors(spark, rows)))
    near = int(x[0] @ x[1] >= E.THRESHOLD)
    assert got == {**{i: (0, near, 49) for i in range(50)}, 100: (0 if near else 100, near, 0), 101: (101, 0, 0)}


def test_hard_rows(spark):
    x = planted(40)
    fine = [(i, v.tolist(), 1) for i, v in enumerate(x[:20])] + [(50, x[0].tolist(), None), (50, x[0].tolist(), None)]
    odd = [(20, None, 1), (21, [], 1), (22, [0.0] * 64, 1), (23, [1.0, 2.0], 1), (24, [float("nan")] * 64, 1), (25, [None] * 64, 1), (None, x[0].tolist(), 1), (26, x[0].tolist(), 1), (26, x[5].tolist(), 1)]
    got = [tuple(r) for r in E.near_vectors(vectors(spark, fine + odd).withColumnRenamed("label", "uid")).collect()]
    assert {(i, i, 0, 0) for i in range(20, 26)} <= set(got) and len(got) == 20 + 1 + 6 + 2
    by = {}
    for i, group, _, equal in got:
        by.setdefault(i, []).append((group, equal))
    assert by[0] == [(0, 2)] and by[50] == [(0, 2)] and sorted(e for _, e in by[26]) == [1, 2]
    assert E.near_vectors(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in E.near_vectors(vectors(spark, [(1, None, 0)])).collect()] == [(1, 1, 0, 0)]
