"""Density clustering of measure tables, on two principal components.

The points are summed up first: where there are more than ``CELLS`` distinct ones, they are counted in the cells of a grid, the finest one that has no more
occupied cells than that. A cell is its mean, its weight and its spread; hierarchy and selection (mutual reachability, single linkage, condensed at ``min_size``, excess of
mass) work on weighted cells, and every row gets its cell's label. So a table of up to ``CELLS`` distinct points is clustered exactly, a larger one
at the grid's resolution, and what reaches the driver is a row per cell. Equal points, or a cell with a third of the rows, are one weight.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinegrid.operators.ml import pca_ordination
from kinegrid.sources.state import settled

CELLS = 3000
LEVELS = range(2, 17)
#: From a cell's middle to its edge, in units of its spread (that of evenly filled squares).
EDGE = 1.23
#: The least distance that a density is taken of.
NEAR = 1e-12


def density_clusters(points: np.ndarray, min_size: int = 10, weights: np.ndarray | None = None, spread: np.ndarray | None = None) -> np.ndarray:
    """Labels of weighted points (of weight 1 by default, noise is -1): as if each were there as often as its weight says, ``spread`` around its place."""
    n = len(points)
    weights = np.ones(n) if weights is None else np.asarray(weights, float)
    if weights.sum() < min_size:
        return np.full(n, -1)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    order = np.argsort(d, axis=1, kind="stable")
    reached = np.cumsum(weights[order], axis=1) >= min_size
    core = np.take_along_axis(d, order, axis=1)[np.arange(n), reached.argmax(axis=1)]
    if spread is not None:
        # a heavy cell holds its own neighbours, in the part of its area that min_size of its points take; cells are as near as their edges are
        edge = EDGE * np.asarray(spread, float)
        core = np.where(weights >= min_size, edge * np.sqrt(min_size / np.maximum(weights, min_size)), core)
        inner = edge / np.sqrt(weights)
        d = np.where(d > 0, np.maximum(d - edge[:, None] - edge[None], 0) + inner[:, None] + inner[None], 0.0)
    linked, near, link = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    edges, now = [], 0
    linked[0] = True
    for _ in range(n - 1):
        reach = np.maximum(np.maximum(core[now], core), d[now])
        closer = (reach < near) & ~linked
        near[closer], link[closer] = reach[closer], now
        now = int(np.where(linked, np.inf, near).argmin())
        edges.append((near[now], now, int(link[now])))
        linked[now] = True
    root, held, weight, child = list(range(n)), {i: [i] for i in range(n)}, list(weights), {}

    def top_of(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for w, a, b in sorted(edges):
        a, b, new = top_of(a), top_of(b), len(root)
        root.append(new)
        root[a] = root[b] = new
        child[new] = (a, b, w)
        held[new] = held[a] + held[b]
        weight.append(weight[a] + weight[b])

    def selected(node: int, birth: float) -> tuple[float, list[list[int]]]:
        """Stability and clusters of the best selection in this cluster, which is born at density ``birth``."""
        stability, at = 0.0, node
        while True:
            if at not in child:  # a cell's points part at its own density
                return stability + weight[at] * (1 / max(core[at], NEAR) - birth), [held[node]]
            a, b, w = child[at]
            density = 1 / max(w, NEAR)
            big = [c for c in (a, b) if weight[c] >= min_size]
            if len(big) == 2:
                stability += weight[at] * (density - birth)
                parts = [selected(c, density) for c in big]
                below = sum(p[0] for p in parts)
                return (below, [c for p in parts for c in p[1]]) if below > stability else (stability, [held[node]])
            stability += (weight[at] - sum(weight[c] for c in big)) * (density - birth)
            if not big:
                return stability, [held[node]]
            at = big[0]

    label = np.full(n, -1)
    top = len(root) - 1
    _, found = selected(top, 1 / max(child[top][2], NEAR) if top in child else 0.0)
    for c, m in enumerate(sorted(found, key=min)):
        label[m] = c
    return label


def _cell(c: str, low: float, high: float, level: int) -> Column:
    """The grid's place of a value; a level halves the cells of the one before."""
    width = (high - low) or 1.0
    return F.least(F.floor((F.col(c) - low) / F.lit(width) * F.lit(2.0**level)), F.lit(2**level - 1)).cast("long")


def cluster_points(points: DataFrame, x: str, y: str, *, min_size: int = 10, cells: int = CELLS) -> DataFrame:
    """points with ``cluster`` (noise is -1); x and y have no nulls."""
    ends = points.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if ends[0] is None:
        return points.withColumn("cluster", F.lit(-1))
    distinct = points.select(x, y).distinct().limit(cells + 1).count()
    if distinct <= cells:
        place = (F.col(x), F.col(y))
    else:
        at = lambda level: (_cell(x, ends[0], ends[1], level), _cell(y, ends[2], ends[3], level))
        many = points.agg(*[F.approx_count_distinct(F.struct(*[c.alias(n) for c, n in zip(at(level), "ab", strict=True)]), 0.02).alias(str(level)) for level in LEVELS]).first()
        place = at(max([level for level in LEVELS if many[str(level)] <= 0.9 * cells], default=LEVELS[0]))
    named = points.withColumn("_a", place[0]).withColumn("_b", place[1])
    square = F.var_pop(x) + F.var_pop(y)
    found = named.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"), F.sqrt(F.greatest(square, F.lit(0.0))).alias("s")).orderBy("_a", "_b").collect()
    label = density_clusters(np.array([[r["x"], r["y"]] for r in found]), min_size, np.array([r["n"] for r in found]), np.array([r["s"] for r in found]))
    kinds = {f.name: f.dataType.simpleString() for f in named.schema}
    labels = points.sparkSession.createDataFrame([(r["_a"], r["_b"], int(c)) for r, c in zip(found, label, strict=True)], f"_a {kinds['_a']}, _b {kinds['_b']}, cluster int")
    return named.join(F.broadcast(labels), ["_a", "_b"]).drop("_a", "_b")  # a row per cell


def cluster_measures(df: DataFrame, columns: Sequence[str], key: Sequence[str], *, min_size: int = 10, cells: int = CELLS) -> DataFrame:
    """(key, emb_1, emb_2, cluster): two principal components of the columns' z-scores, and density clusters on them; -1 is noise. Rows with nulls drop."""
    scored, _ = pca_ordination(df, columns, n=2)
    second = F.col("pc_2") if "pc_2" in scored.columns else F.lit(0.0)
    points = settled(scored.select(*key, F.col("pc_1").alias("emb_1"), second.alias("emb_2")))
    return cluster_points(points, "emb_1", "emb_2", min_size=min_size, cells=cells)
