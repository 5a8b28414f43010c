"""Hierarchical density clusters (M8): clusters of uneven density, and noise.

* ``neighbours``: a forest of random-projection trees deals the points into
  leaves of about ``leaf_rows`` (each level splits every leaf at the median of a
  random projection; equal points are told apart by a hash of their id, so a
  hot cell splits too), and a leaf finds the nearest points of each of its own.
* ``reach``: core distances (to the ``min_samples``-th nearest point) and
  mutual reachability of the neighbour graph's edges.
* ``spanning_forest``: Boruvka rounds; in each, every component takes its least
  edge in the order (weight, ends), and components meet by pointer jumping.
* ``condense``: the forest's edges are merged in ascending order, ``block_edges``
  at a time, so one task never holds more.  A component of
  ``min_cluster_size`` points is a cluster until it meets another one; what a
  cluster's points add over its life is its stability.
* the clusters that are more stable than what lies below them are chosen, top
  down, and points outside of them are noise (-1).

No table of pairs is formed: an edge exists for each point and neighbour.  With
``neighbours`` of all points but one, the result is that of the complete graph.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import pinned
from .density import label_components
from .filters import dense_index
from .vectors import as_double


@dataclass(frozen=True)
class Params:
    min_cluster_size: int = 15
    min_samples: int = 5
    neighbours: int = 20
    trees: int = 4
    leaf_rows: int = 1000
    block_edges: int = 500_000
    single: bool = False          # may all points of a connected graph be one cluster?
    least: float = 1e-9           # shorter distances count as this
    seed: int = 0


# -- neighbour graph --------------------------------------------------------------

def _leaves(points: DataFrame, n: int, dims: int, tree: int, p: Params) -> DataFrame:
    """``id, x, leaf`` of one tree."""
    r = np.random.default_rng([p.seed, tree])
    rows = points.withColumn("leaf", F.lit(0).cast("long"))
    for level in range(max(0, int(np.ceil(np.log2(max(1, n) / p.leaf_rows))))):
        way = F.array(*[F.lit(float(v)) for v in r.normal(size=dims)])
        along = F.aggregate(F.zip_with("x", way, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        tie = F.pmod(F.xxhash64("id", F.lit(tree * 100 + level)), F.lit(1 << 20)) * 1e-12
        rows = rows.withColumn("along", along * (1 + tie) + tie)
        middle = rows.groupBy("leaf").agg(F.percentile_approx("along", 0.5, 10_000).alias("middle"))
        rows = rows.join(middle, "leaf").select("id", "x", (F.col("leaf") * 2 + (F.col("along") > F.col("middle")).cast("long")).alias("leaf"))
        if level % 4 == 3:
            rows = pinned(rows)
    return rows


def neighbours(points: DataFrame, p: Params = Params()) -> DataFrame:
    """``u, v, d``: the nearest points of each point ``id, x``, nearest first by (distance, id)."""
    points = pinned(points)
    n, dims = points.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()

    def near(rows):
        import pandas as pd
        rows = rows.sort_values("id")
        ids, x = rows["id"].to_numpy(), np.array(rows["x"].tolist(), float)
        k = min(p.neighbours, len(ids) - 1)
        out = []
        for a in range(0, len(ids), 256):
            gap = x[a:a + 256, None, :] - x[None, :, :]
            d = np.sqrt((gap * gap).sum(2))
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            order = np.argsort(d, axis=1, kind="stable")[:, :k]              # ids ascend, so ties do
            out.append(pd.DataFrame({"u": np.repeat(ids[a:a + 256], k), "v": ids[order].ravel(), "d": np.take_along_axis(d, order, 1).ravel()}))
        return pd.concat(out)

    found = None
    for tree in range(p.trees if n > p.leaf_rows else 1):
        part = _leaves(points, n, dims, tree, p).groupBy("leaf").applyInPandas(near, "u long, v long, d double")
        found = part if found is None else found.unionByName(part)
    nearest = Window.partitionBy("u").orderBy("d", "v")
    rows = found.groupBy("u", "v").agg(F.min("d").alias("d"))
    return rows.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= p.neighbours)


def reach(near: DataFrame, p: Params = Params()) -> DataFrame:
    """``u, v, w`` with u < v: mutual reachability along the graph's edges."""
    near = pinned(near)
    core = pinned(near.where(F.col("place") <= p.min_samples).groupBy("u").agg(F.max("d").alias("core")))
    both = near.join(core, "u").join(core.select(F.col("u").alias("v"), F.col("core").alias("far")), "v")
    w = F.greatest("d", "core", "far")
    return both.select(F.least("u", "v").alias("s"), F.greatest("u", "v").alias("t"), w.alias("w")).groupBy(F.col("s").alias("u"), F.col("t").alias("v")).agg(F.min("w").alias("w"))


# -- spanning forest ----------------------------------------------------------------

def spanning_forest(edges: DataFrame) -> DataFrame:
    """``u, v, w``: the least spanning forest in the order (w, u, v)."""
    left = pinned(edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct("w", "u", "v").alias("e")))
    chosen = None
    while left.limit(1).count():
        ends = left.select(F.col("a").alias("c"), "e", "a", "b").unionByName(left.select(F.col("b").alias("c"), "e", "a", "b"))
        best = pinned(ends.groupBy("c").agg(F.min(F.struct("e", "a", "b")).alias("m")).select("m.e", "m.a", "m.b").distinct())
        chosen = best.select("e") if chosen is None else chosen.unionByName(best.select("e"))
        links = best.select("a", "b").unionByName(best.select(F.col("b").alias("a"), F.col("a").alias("b")))
        label = label_components(links.select("a").distinct(), pinned(links), "a", "b")
        other = label.select(F.col("a").alias("b"), F.col("c").alias("cb"))
        moved = left.join(label, "a").join(other, "b").where("c <> cb")
        left = pinned(moved.select(F.least("c", "cb").alias("a"), F.greatest("c", "cb").alias("b"), "e").groupBy("a", "b").agg(F.min("e").alias("e")))
    if chosen is None:
        return edges.limit(0)
    return chosen.select("e.u", "e.v", "e.w").distinct()


# -- hierarchy ----------------------------------------------------------------------

def merge(edges: list[tuple], state: dict[int, tuple], p: Params, base: int = 0) -> tuple[dict, dict, list]:
    """Merge components along ``(w, a, b)`` in ascending order.

    ``state``: component -> (points, cluster or None, sum over its points of 1/w at which they came, stability chosen below);
    it holds the components that are left afterwards.  Returns where each component went, the cluster that each one
    outside any came into, and the clusters that ended: (cluster, parent, chosen).  New clusters are numbered from ``base``."""
    into: dict[int, int] = {}
    first: dict[int, int] = {}
    inside = {c: [c] for c in state}
    ended, number = [], base

    def root(c: int) -> int:
        while c in into:
            into[c] = into.get(into[c], into[c])
            c = into[c]
        return c

    for w, a, b in edges:
        a, b = root(a), root(b)
        lam = 1 / max(w, p.least)
        (na, ca, sa, under_a), (nb, cb, sb, under_b) = state.pop(a), state.pop(b)
        size = na + nb
        new = size, None, 0.0, 0.0
        if ca is not None and cb is not None:                              # two clusters end, and their parent begins
            below = 0.0
            for c, n, s, under in ((ca, na, sa, under_a), (cb, nb, sb, under_b)):
                own = s - n * lam
                ended.append((c, number, own >= under))
                below += max(own, under)
            new, number = (size, number, size * lam, below), number + 1
        elif ca is not None or cb is not None:                             # what is small falls into the cluster
            c, n, s, under, other = (ca, nb, sa, under_a, b) if ca is not None else (cb, na, sb, under_b, a)
            first.update(dict.fromkeys(inside[other], c))
            new = size, c, s + n * lam, under
        elif size >= p.min_cluster_size:                                   # a cluster begins
            first.update(dict.fromkeys(inside[a] + inside[b], number))
            new, number = (size, number, size * lam, 0.0), number + 1
        keep, go = (a, b) if len(inside[a]) >= len(inside[b]) else (b, a)
        into[go] = keep
        inside[keep] += inside.pop(go)
        state[keep] = new
    return {c: root(c) for c in list(into)}, first, ended


TREE = "cluster long, parent long, chosen boolean"


def condense(points: DataFrame, forest: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """``id, cluster`` (the first cluster each point came into, or null) and the tree ``cluster, parent, chosen``."""
    kinds = "kind string, comp long, size long, cluster long, sum double, below double, chosen boolean"
    order = forest.where("u is not null").orderBy("w", "u", "v")
    edges = pinned(dense_index(order, "place"))
    member = points.select("id", F.col("id").alias("comp"), F.lit(None).cast("long").alias("cluster"))
    state = points.select(F.col("id").alias("comp"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("long").alias("cluster"),
                          F.lit(0.0).alias("sum"), F.lit(0.0).alias("below"))
    tree = None
    for block in range(-(-edges.count() // p.block_edges)):
        own = edges.where(F.floor(F.col("place") / p.block_edges) == block)
        ends = (own.join(member.select(F.col("id").alias("u"), F.col("comp").alias("a")), "u")
                   .join(member.select(F.col("id").alias("v"), F.col("comp").alias("b")), "v").select("place", "w", "a", "b"))
        met = ends.select(F.col("a").alias("comp")).union(ends.select("b")).distinct()
        near = state.join(met, "comp", "left_semi")
        rows = (ends.select(F.lit("edge").alias("kind"), "place", "w", "a", "b", *[F.lit(None).cast(t).alias(c) for c, t in near.dtypes[1:]])
                    .unionByName(near.select(F.lit("state").alias("kind"), F.lit(None).cast("long").alias("place"), F.lit(None).cast("double").alias("w"),
                                             F.col("comp").alias("a"), F.lit(None).cast("long").alias("b"), *near.columns[1:])))
        base = block * 2 * p.block_edges

        def one(rows):                                                     # at most block_edges edges and twice as many components
            import pandas as pd
            links, held = rows[rows["kind"] == "edge"].sort_values("place"), rows[rows["kind"] == "state"]
            now = {int(c): (int(n), None if pd.isna(k) else int(k), float(s), float(u)) for c, n, k, s, u in
                   zip(held["a"], held["size"], held["cluster"], held["sum"], held["below"])}
            into, first, ended = merge(list(zip(links["w"], links["a"].astype(int), links["b"].astype(int))), now, p, base)
            out = [("into", c, None, to, None, None, None) for c, to in into.items()] + [("first", c, None, k, None, None, None) for c, k in first.items()]
            out += [("state", c, n, k, s, u, None) for c, (n, k, s, u) in now.items()] + [("tree", c, None, parent, None, None, ok) for c, parent, ok in ended]
            return pd.DataFrame(out, columns=[x.split()[0] for x in kinds.split(", ")]).astype({"comp": "Int64", "size": "Int64", "cluster": "Int64"})

        done = pinned(rows.withColumn("block", F.lit(block)).groupBy("block").applyInPandas(one, kinds))
        into = done.where("kind = 'into'").select("comp", F.col("cluster").alias("to"))
        first = done.where("kind = 'first'").select("comp", F.col("cluster").alias("came"))
        member = pinned(member.join(into, "comp", "left").join(first, "comp", "left")
                        .select("id", F.coalesce("to", "comp").alias("comp"), F.coalesce("cluster", "came").alias("cluster")))
        state = pinned(state.join(met, "comp", "left_anti").unionByName(done.where("kind = 'state'").select("comp", "size", "cluster", "sum", "below")))
        part = done.where("kind = 'tree'").select(F.col("comp").alias("cluster"), F.col("cluster").alias("parent"), "chosen")
        tree = part if tree is None else tree.unionByName(part)
    top = state.where("cluster is not null")
    alone = top.limit(2).count() == 1 and not p.single                     # the whole graph is no cluster
    last = top.select("cluster", F.lit(None).cast("long").alias("parent"), ((F.col("sum") >= F.col("below")) & F.lit(not alone)).alias("chosen"))
    return member.select("id", "cluster"), pinned(last if tree is None else tree.unionByName(last))


def _chosen_above(tree: DataFrame) -> DataFrame:
    """``cluster, best``: the topmost chosen cluster among each one and those above it, by pointer jumping."""
    rows = tree.select("cluster", F.col("parent").alias("above"), F.when(F.col("chosen"), F.col("cluster")).alias("best"))
    while rows.where("above is not null").limit(1).count():
        up = rows.select(F.col("cluster").alias("above"), F.col("above").alias("next"), F.col("best").alias("over"))
        rows = pinned(rows.join(up, "above", "left").select("cluster", F.col("next").alias("above"), F.coalesce("over", "best").alias("best")))
    return rows.select("cluster", "best")


def hierarchical_clusters(df: DataFrame, vec: str, id_col: str, p: Params = Params()) -> DataFrame:
    """``id_col, cluster``: clusters numbered from the largest on (ties: by their least id), noise -1."""
    points = pinned(df.select(F.col(id_col).cast("long").alias("id"), as_double(vec).alias("x")))
    forest = spanning_forest(reach(neighbours(points, p), p))
    member, tree = condense(points.select("id"), forest, p)
    found = pinned(member.join(_chosen_above(tree), "cluster", "left").select("id", "best"))
    sizes = found.where("best is not null").groupBy("best").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    number = dense_index(sizes.orderBy(F.desc("n"), "least"), "number").select("best", "number")
    return found.join(number, "best", "left").select(F.col("id").alias(id_col), F.coalesce("number", F.lit(-1).cast("long")).alias("cluster"))
