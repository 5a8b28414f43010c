"""Grid density clustering (M8, the density form).

Points fall into grid cells of side ``eps`` on a few (reduced) dimensions.
A cell holding at least ``min_pts`` points is dense; dense cells that touch
(Chebyshev distance 1 in cell coordinates) form clusters, found by
min-label propagation over the cell graph; clusters holding fewer than
``min_cluster_size`` points and points outside dense cells are noise (-1).

Work is per point (one cell key) and per dense cell (3^d - 1 neighbour
keys); no pair of points is ever formed, so a dense region costs what its
cells cost, not the square of its points.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, materialise
from .vectors import as_double


def cell_of(vec, eps: float, dims: int):
    """Cell coordinates; a vector of another length than ``dims`` is an error, not cut."""
    v = as_double(vec)
    whole = F.when(F.size(v) == dims, v).otherwise(F.raise_error(F.lit(f"vectors must have {dims} values")))
    return F.transform(whole, lambda x: F.floor(x / eps))


def label_components(nodes: DataFrame, edges: DataFrame, v: str, u: str) -> DataFrame:
    """``(v, c)``: the least node of each component over undirected ``edges (v, u)``.

    Every round takes the least label among the neighbours and then the label
    of that label (pointer jumping), until no label changes, so the rounds
    grow with the logarithm of the longest path.
    """
    lab = cut_lineage(nodes.select(v, F.col(v).alias("c")))
    while True:
        near = (edges.join(lab.select(F.col(v).alias(u), F.col("c").alias("cn")), u)
                     .groupBy(v).agg(F.min("cn").alias("m")))
        step = lab.join(near, v, "left").select(v, F.col("c").alias("c0"), F.least("c", F.coalesce("m", "c")).alias("c1"))
        # A node also takes what its old label's node found: whole trees move at once.
        found = step.groupBy("c0").agg(F.min("c1").alias("c2"))
        hook = step.join(found, "c0").select(v, "c0", F.least("c1", "c2").alias("c1"))
        jump = hook.select(F.col(v).alias("c1"), F.col("c1").alias("c2"))
        new = cut_lineage(hook.join(jump, "c1", "left").select(v, F.least("c1", F.coalesce("c2", "c1")).alias("c"), "c0"))
        changed = new.where("c <> c0").limit(1).count()
        lab = new.select(v, "c")
        if not changed:
            return lab


def _key(cell_col):
    return F.concat_ws(",", F.transform(cell_col, lambda c: c.cast("string")))


def cell_counts(df: DataFrame, vec: str, eps: float, dims: int = 5) -> DataFrame:
    """``(cell_key, n)`` points per grid cell (partial aggregation before the shuffle)."""
    return (df.select(_key(cell_of(vec, eps, dims)).alias("cell_key"))
              .groupBy("cell_key").agg(F.count(F.lit(1)).alias("n")))


def density_clusters(df: DataFrame, vec: str, eps: float, min_pts: int, min_cluster_size: int,
                     id_col: str, dims: int = 5) -> DataFrame:
    """``(id, cluster)``; cluster = smallest dense-cell key of the component
    turned into a dense integer id (largest cluster first), noise = -1."""
    pts = materialise(df.select(id_col, cell_of(vec, eps, dims).alias("cell"))
                        .withColumn("cell_key", _key(F.col("cell"))))
    cells = pts.groupBy("cell_key", "cell").agg(F.count(F.lit(1)).alias("n"))
    dense = materialise(cells.filter(F.col("n") >= min_pts))
    offsets = [list(o) for o in itertools.product((-1, 0, 1), repeat=dims) if any(o)]
    off = F.array(*[F.array(*[F.lit(v) for v in o]) for o in offsets])
    nb = (dense.select("cell_key", "cell", F.explode(off).alias("_o"))
               .select("cell_key", _key(F.zip_with("cell", "_o", lambda a, b: a + b)).alias("nb_key")))
    edges = materialise(nb.join(dense.select(F.col("cell_key").alias("nb_key")), "nb_key"))
    lab = label_components(dense.select("cell_key"), edges, "cell_key", "nb_key")
    comp = lab.join(dense.select("cell_key", "n"), "cell_key")
    sizes = comp.groupBy("c").agg(F.sum("n").alias("size")).filter(F.col("size") >= min_cluster_size)
    from pyspark.sql import Window
    ids = sizes.withColumn("cluster", (F.row_number().over(Window.orderBy(F.desc("size"), "c")) - 1).cast("long"))
    cell_cluster = comp.join(ids.select("c", "cluster"), "c").select("cell_key", "cluster")
    return (pts.join(cell_cluster, "cell_key", "left")
               .select(id_col, F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster")))
