"""Cleaning of positions and session kinematics. Rows are ordered by frame within their keys.

All but ``clean_outliers`` and the arc tangent of ``angular_measures`` are window expressions: one shuffle on the key, which later windows on it reuse.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinegrid.config import RIG
from kinegrid.functions.expr import by, gradient, sg_derivative, unwrap_step, whole, wrap


def fill_missing(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Linear interpolation over frames; the nearest value at the ends; a series without any value stays null."""
    back = by(*keys).rowsBetween(Window.unboundedPreceding, 0)
    ahead = by(*keys).rowsBetween(0, Window.unboundedFollowing)
    out = {}
    for c in columns:
        v = F.when(~F.isnan(c), F.col(c))
        at = F.when(v.isNotNull(), F.col("frame"))
        v0, f0 = F.last(v, True).over(back), F.last(at, True).over(back)
        v1, f1 = F.first(v, True).over(ahead), F.first(at, True).over(ahead)
        between = v0 + (v1 - v0) * (F.col("frame") - f0) / F.nullif(f1 - f0, F.lit(0))
        out[c] = F.coalesce(v, between, v0, v1)
    return df.withColumns(out)


def outlier_flags(df: DataFrame, threshold: float = RIG.outlier_px, keys: Sequence[str] = ("session_id",), x: str = "x", y: str = "y") -> DataFrame:
    """One pass: adds ``flagged`` for inner frames far from a neighbour, and for a single frame between two such ones."""
    w = by(*keys)
    far = F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)) > threshold
    marked = df.withColumn("_far", far).withColumn("_inner", F.lag(x).over(w).isNotNull() & F.lead(x).over(w).isNotNull())
    marked = marked.withColumn("_hit", F.coalesce(F.col("_inner") & (F.col("_far") | F.lead("_far").over(w)), F.lit(False)))
    gap = F.coalesce(F.lag("_hit").over(w) & F.lead("_hit").over(w), F.lit(False))
    return marked.withColumn("flagged", F.col("_hit") | gap).drop("_far", "_inner", "_hit")


def _despiked(xy: np.ndarray, threshold: float, rounds: int) -> tuple[np.ndarray, int]:
    xy = xy.copy()
    n = len(xy)
    for done in range(rounds):
        far = np.hypot(*np.diff(xy, axis=0).T) > threshold if n > 1 else np.zeros(0, bool)
        hit = np.zeros(n, bool)
        hit[1:-1] = far[:-1] | far[1:]
        lone = np.flatnonzero(hit[:-2] & hit[2:] & ~hit[1:-1]) + 1 if n > 2 else []
        hit[lone] = True
        if not hit.any():
            return xy, done
        good = np.flatnonzero(~hit)
        for k in range(2):
            xy[hit, k] = np.interp(np.flatnonzero(hit), good, xy[good, k])
    return xy, rounds


def clean_outliers(df: DataFrame, threshold: float = RIG.outlier_px, keys: Sequence[str] = ("session_id",), rounds: int = 100) -> DataFrame:
    """Repeats ``outlier_flags`` and interpolation until nothing is flagged, ``rounds`` times at most.

    Adds ``cleaning_rounds`` (equal to ``rounds`` where it did not settle). Positions must have no nulls (see fill_missing).
    """
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema, T.StructField("cleaning_rounds", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        xy, done = _despiked(pdf[["x", "y"]].to_numpy(float), threshold, rounds)
        return pdf.assign(x=xy[:, 0], y=xy[:, 1], cleaning_rounds=done)

    return df.groupBy(*keys).applyInPandas(run, schema)


def centroid(pose: DataFrame, nodes: Sequence[str] | None = None) -> DataFrame:
    """(session_id, frame, x, y): mean of the nodes (all by default) of each frame."""
    rows = pose if nodes is None else pose.where(F.col("node").isin(*nodes))
    return rows.groupBy("session_id", "frame").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def velocity(df: DataFrame, keys: Sequence[str] = ("session_id",), scale: float | Column = 1.0, fps: float = 1.0, into: str = "velocity") -> DataFrame:
    """Speed from Savitzky-Golay slopes (window 7, order 3): pixels per frame, times scale and fps. Null for fewer than seven frames."""
    w, i = by(*keys), F.row_number().over(by(*keys)) - 1
    n = F.count(F.lit(1)).over(whole(*keys))
    marked = df.withColumn("_i", i).withColumn("_n", n)
    slope = lambda c: sg_derivative(F.col(c), F.col("_i"), F.col("_n"), w)
    marked = marked.withColumn("_dx", slope("x")).withColumn("_dy", slope("y"))
    return marked.withColumn(into, F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")) * scale * fps).drop("_i", "_n", "_dx", "_dy")


def heading_from_pair(df: DataFrame, dist: float = 50.0) -> DataFrame:
    """Adds heading_x, heading_y: a point on the normal of the left-right axis. Null where both points are one."""
    dx, dy = F.col("right_x") - F.col("left_x"), F.col("right_y") - F.col("left_y")
    size = F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    return df.withColumns(
        {"heading_x": (F.col("left_x") + F.col("right_x")) / 2 - dist * dy / size, "heading_y": (F.col("left_y") + F.col("right_y")) / 2 + dist * dx / size}
    )


def _direction(x: Column, y: Column) -> Column:
    """The C library's atan2(y, x). The JVM's differs in the last place, which says whether a step of half a turn goes left or right."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter(map(math.atan2, a.tolist(), b.tolist()), float, len(a)))

    x, y = x.cast("double"), y.cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), run(y, x))


def angular_measures(df: DataFrame, fps: float = RIG.framerate, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Adds head_angle (wrapped), angle_unwrapped and ang_vel from vectors (hx, hy)."""
    w = by(*keys)
    rows = df.withColumn("head_angle", wrap(_direction(F.col("hx"), F.col("hy"))))
    rows = rows.withColumn("_turn", F.coalesce(unwrap_step(F.col("head_angle") - F.lag("head_angle").over(w)), F.lit(0.0)))
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("angle_unwrapped", F.col("head_angle") + F.sum("_turn").over(running)).drop("_turn")
    return rows.withColumn("ang_vel", gradient(F.col("angle_unwrapped"), 1 / fps, w))


def session_series(
    pose: DataFrame, *, left: str, right: str, heading: str | None = None, centroid_nodes: Sequence[str] | None = None, scale: float | Column = RIG.fallback_scale, fps: float = RIG.framerate
) -> DataFrame:
    """(session_id, frame, x, y, lin_vel, head_angle, ang_vel) from pose rows (session_id, frame, node, x, y).

    The heading points from the middle of the posterior pair to the heading node, or along the pair's normal without one. A heading node that no row
    names raises KeyError.
    """
    if heading is not None and pose.where(F.col("node") == heading).isEmpty():
        raise KeyError(f"no row of node {heading!r}; for a pair alone pass heading=None")
    inside = F.lit(True) if centroid_nodes is None else F.col("node").isin(*centroid_nodes)
    at = lambda node, c: F.max(F.when(F.col("node") == node, F.col(c)))
    ends = {"left": left, "right": right} | ({"head": heading} if heading is not None else {})
    rows = pose.groupBy("session_id", "frame").agg(
        *[F.avg(F.when(inside, F.col(c))).alias(c) for c in ("x", "y")], *[at(n, c).alias(f"{e}_{c}") for e, n in ends.items() for c in ("x", "y")]
    )
    rows = velocity(rows, scale=scale, fps=fps, into="lin_vel")
    if heading is None:
        rows = heading_from_pair(rows).withColumnsRenamed({"heading_x": "head_x", "heading_y": "head_y"})
    rows = rows.withColumns({"hx": F.col("head_x") - (F.col("left_x") + F.col("right_x")) / 2, "hy": F.col("head_y") - (F.col("left_y") + F.col("right_y")) / 2})
    return angular_measures(rows, fps=fps).select("session_id", "frame", "x", "y", "lin_vel", "head_angle", "ang_vel")


def node_speed(df: DataFrame, scale: float = RIG.fallback_scale, fps: float = RIG.framerate, keys: Sequence[str] = ("session_id", "node")) -> DataFrame:
    """Adds ``speed``: forward differences; the last sample repeats the one before."""
    w = by(*keys)
    step = F.hypot(F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")) * scale * fps
    rows = df.withColumn("_s", step)
    return rows.withColumn("speed", F.coalesce("_s", F.lag("_s").over(w))).drop("_s")


def node_consensus(values: Sequence[Column], threshold: float = 10.0) -> Column:
    """One value of several nodes: of two that differ the lower one, of three or more without the single one that two others contradict."""
    held = F.filter(F.array(*[F.when(~F.isnan(v), v) for v in values]), lambda v: v.isNotNull())
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)
    a, b = F.get(held, 0), F.get(held, 1)
    against = lambda v: F.size(F.filter(held, lambda u: F.abs(u - v) >= threshold))
    odd = F.filter(F.transform(held, lambda v, i: F.struct(against(v).alias("n"), i.alias("i"))), lambda s: s["n"] == 2)
    rest = F.filter(held, lambda v, i: i != F.get(odd, 0)["i"])
    return (
        F.when(F.size(held) == 0, F.lit(None).cast("double"))
        .when(F.size(held) == 1, a)
        .when(F.size(held) == 2, F.when(F.abs(a - b) >= threshold, F.least(a, b)).otherwise((a + b) / 2))
        .when(F.size(odd) == 1, mean(rest))
        .otherwise(mean(held))
    )


def robust_z(df: DataFrame, column: str, keys: Sequence[str], into: str = "robust_z") -> DataFrame:
    """Adds 0.6745 (x - median) / MAD within each group; 0 where the MAD is 0. Medians come from counts along a range sort, so no group is held in one buffer."""
    from kinegrid.operators.stats import medians

    rows = df.join(medians(df, column, keys, "_med"), list(keys)).withColumn("_off", F.abs(F.col(column) - F.col("_med")))
    score = F.when(F.col("_mad") == 0, 0.0).otherwise(0.6745 * (F.col(column) - F.col("_med")) / F.nullif("_mad", F.lit(0.0)))
    return rows.join(medians(rows, "_off", keys, "_mad"), list(keys)).withColumn(into, score).drop("_med", "_mad", "_off")


def mean_squared_displacement(paths: DataFrame, reference: DataFrame, keys: Sequence[str], on: Sequence[str]) -> DataFrame:
    """Mean over samples of the squared distance to a reference path that has rx, ry at the same ``on``."""
    both = paths.join(reference, list(on))
    d = lambda a, b: (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    return both.groupBy(*keys).agg(F.avg(d("x", "rx") + d("y", "ry")).alias("msd"))
