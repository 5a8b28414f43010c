"""Hierarchical clusters against a top-down computation over all pairs."""

import numpy as np
import pytest

from topicflow.operators import hierarchy as H


def blobs(seed=0, equal=0):
    """Three groups of different density, one of them in two halves, and noise."""
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(0, 0.2, (30, 2)), r.normal((6, 0), 1.0, (30, 2)), r.normal((0, 7), 0.15, (14, 2)), r.normal((0, 8.2), 0.15, (14, 2)),
                        r.uniform(-4, 12, (12, 2))])
    return np.concatenate([x, np.repeat(x[:1], equal, 0)])


def plain_edges(x, p):
    """The least spanning tree over all pairs, by Kruskal's rule."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d + np.diag([np.inf] * n), 1)[:, p.min_samples - 1]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    group, out = list(range(n)), []
    for v, i, j in sorted((w[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        if group[i] != group[j]:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
            out.append((v, i, j))
    return out


def plain_clusters(x, p):
    """Top down: cut the heaviest edge, again and again."""
    edges = plain_edges(x, p)

    def sides(pts, own):
        """Split by the last edge."""
        (w, i, j), rest = own[-1], own[:-1]
        near = {k: set() for k in pts}
        for _, a, b in rest:
            near[a].add(b)
            near[b].add(a)
        left, todo = {i}, [i]
        while todo:
            for b in near[todo.pop()] - left:
                left.add(b)
                todo.append(b)
        return w, [(side, [e for e in rest if e[1] in side]) for side in (left, pts - left)]

    def life(pts, own, birth):
        """The chosen clusters of a cluster that began at 1/w = birth, and their stability."""
        start, total = set(pts), 0.0
        while True:
            w, parts = sides(pts, own)
            lam = 1 / max(w, p.least)
            big = [q for q in parts if len(q[0]) >= p.min_cluster_size]
            if len(big) == 1:
                total += (len(pts) - len(big[0][0])) * (lam - birth)
                pts, own = big[0]
                continue
            total += len(pts) * (lam - birth)
            below = [life(*q, lam) for q in big]
            under = sum(s for _, s in below)
            if total >= under:
                return [start], total
            return [c for found, _ in below for c in found], under

    pts = set(range(len(x)))
    own = edges
    while True:                                                          # the root is no cluster
        w, parts = sides(pts, own)
        big = [q for q in parts if len(q[0]) >= p.min_cluster_size]
        if len(big) != 1:
            return [c for q in big for c in life(*q, 1 / max(w, p.least))[0]]
        pts, own = big[0]


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("seed,equal,block", [(0, 0, 500_000), (1, 0, 17), (2, 8, 1000)])
def test_equal_to_a_plain_version(spark, seed, equal, block):
    x = blobs(seed, equal)
    p = H.Params(min_cluster_size=8, min_samples=4, neighbours=len(x), block_edges=block)
    got = {}
    for r in H.hierarchical_clusters(frame(spark, x), "embedding", "vec_id", p).collect():
        got.setdefault(r["cluster"], set()).add(r["vec_id"])
    noise = got.pop(-1, set())
    want = plain_clusters(x, p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert len(want) >= 3 and noise
    assert [len(got[k]) for k in range(len(got))] == sorted(map(len, want), reverse=True)


def test_merge_in_blocks_is_merge_at_once():
    x = blobs(4)
    p = H.Params(min_cluster_size=6, min_samples=3)
    edges = plain_edges(x, p)
    whole = {i: (1, None, 0.0, 0.0) for i in range(len(x))}
    _, first, ended = H.merge([(w, i, j) for w, i, j in edges], whole, p)
    assert len(whole) == 1 and len({c for c, _, _ in ended}) == len(ended)
    assert set(first) <= set(range(len(x)))


def test_neighbour_recall_and_hot_cells(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(1500, 5)), np.zeros((500, 5))])       # a quarter of the points are equal
    p = H.Params(neighbours=10, trees=5, leaf_rows=200)
    rows = H.neighbours(frame(spark, x).selectExpr("vec_id as id", "embedding as x"), p)
    got = {}
    for row in rows.collect():
        got.setdefault(row["u"], set()).add(row["v"])
    d = np.sqrt(((x[:1500, None] - x[None]) ** 2).sum(2))
    d[np.arange(1500), np.arange(1500)] = np.inf
    near = np.sort(d, 1)[:, 9]
    recall = np.mean([np.mean([d[i, v] <= near[i] for v in got[i]]) for i in range(1500)])
    assert recall >= 0.9 and all(len(got[i]) == 10 for i in range(2000))
    leaves = H._leaves(frame(spark, x).selectExpr("vec_id as id", "embedding as x"), 2000, 5, 0, p).groupBy("leaf").count()
    assert leaves.agg({"count": "max"}).first()[0] <= 2 * p.leaf_rows


def test_few_points(spark):
    assert {r["cluster"] for r in H.hierarchical_clusters(frame(spark, np.eye(3)), "embedding", "vec_id").collect()} == {-1}
    assert H.hierarchical_clusters(frame(spark, np.eye(1)), "embedding", "vec_id").count() == 1
    assert H.hierarchical_clusters(frame(spark, np.eye(2)).limit(0), "embedding", "vec_id").count() == 0
