"""Elastic shapes of planar open paths.

A path is known by its square-root velocity q = b' / sqrt |b'|, which no shift changes; for ``scale`` it is also brought to unit length. Paths are turned
(in closed form: in the plane the best rotation is one angle) and re-parametrised towards the mean of their group, whose tangent averages move the mean
until it rests. Groups iterate together, as in ``registration``: their means are a settled table, a round is one job. Principal components
of the tangent vectors are the shape scores.

Paths have one number of points, five or more, without nulls; a path without any length keeps q = 0. Without paths there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinegrid.operators import fda, registration
from kinegrid.operators.registration import WARPED, _of, _with, best_warps, components, group_sums, lists, ready, scored
from kinegrid.sources.state import settled

ROUNDS, TOLERANCE = 15, 1e-3
#: Rotation and warp are found by turns so many times.
TURNS = 2


def velocity(paths: np.ndarray, scale: bool) -> np.ndarray:
    """q of paths (n, 2, p) on a uniform grid over [0, 1]."""
    t = np.linspace(0, 1, paths.shape[2])
    d = np.gradient(paths, t, axis=2)
    q = d / np.sqrt(np.maximum(np.sqrt((d**2).sum(axis=1, keepdims=True)), 1e-12))
    return unit(q) if scale else q


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner product over the grid, a number a row."""
    return np.trapezoid((a * b).sum(axis=-2), dx=1 / (a.shape[-1] - 1), axis=-1)


def unit(q: np.ndarray) -> np.ndarray:
    return q / np.maximum(np.sqrt(dot(q, q)), 1e-12)[..., None, None]


def path_of(q: np.ndarray) -> np.ndarray:
    """The path (.., 2, p) of q, with its middle at the origin."""
    v = q * np.sqrt((q**2).sum(axis=-2, keepdims=True))
    h = 1 / (q.shape[-1] - 1)
    b = np.concatenate([np.zeros_like(v[..., :1]), np.cumsum((v[..., 1:] + v[..., :-1]) / 2 * h, axis=-1)], axis=-1)
    return b - b.mean(axis=-1, keepdims=True)


def rotated(q: np.ndarray, angle: np.ndarray) -> np.ndarray:
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
    return np.stack([c * q[:, 0] - s * q[:, 1], s * q[:, 0] + c * q[:, 1]], axis=1)


def best_angle(q: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The rotation that brings each row of q closest to its mean."""
    return np.arctan2(dot(q[:, :1], mean[:, 1:]) - dot(q[:, 1:], mean[:, :1]), dot(q, mean))


def aligned(q: np.ndarray, mean: np.ndarray, scale: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q turned and warped towards their mean; the whole angle and the warp."""
    t = np.linspace(0, 1, q.shape[2])
    angle = best_angle(q, mean)
    for _ in range(TURNS):
        base = rotated(q, angle)
        gamma = best_warps(mean, base, t)
        rate = np.sqrt(np.maximum(np.gradient(gamma, t, axis=1), 0))
        moved = np.stack([[np.interp(g, t, x[0]) * r, np.interp(g, t, x[1]) * r] for x, g, r in zip(base, gamma, rate, strict=True)])
        more = best_angle(moved, mean)
        angle = angle + more
    now = rotated(moved, more)
    return unit(now) if scale else now, angle, gamma


def tangent(mean: np.ndarray, q: np.ndarray, scale: bool) -> np.ndarray:
    """From the mean to each row: the difference, or on the unit sphere the log map."""
    if not scale:
        return q - mean
    inner = np.clip(dot(mean, q), -1, 1)
    theta = np.arccos(inner)
    factor = np.where(theta > 1e-9, theta / np.where(theta > 1e-9, np.sin(theta), 1), 1.0)
    return factor[:, None, None] * (q - inner[:, None, None] * mean)


def moved_by(mean: np.ndarray, v: np.ndarray, scale: bool) -> np.ndarray:
    """The mean after a step along tangent v (exp map)."""
    if not scale:
        return mean + v
    size = np.sqrt(dot(v, v))[..., None, None]
    return unit(np.cos(size) * mean + np.where(size > 1e-12, np.sin(size) / np.maximum(size, 1e-12), 1.0) * v)


def _square(batch: pa.RecordBatch, name: str) -> np.ndarray:
    flat = _of(batch, name)
    return flat.reshape(len(flat), 2, -1)


def _flat(q: np.ndarray) -> np.ndarray:
    return q.reshape(len(q), -1)


def karcher_means(rows: DataFrame, keys: Sequence[str], *, scale: bool, max_iter: int = ROUNDS, tol: float = TOLERANCE, state: DataFrame | None = None) -> DataFrame:
    """The settled table of mean shapes (``registration.STATE``) of rows (_g, keys, q flat). ``state`` is taken up where it stopped."""

    def step(batch: pa.RecordBatch) -> np.ndarray:
        q, mean = _square(batch, "q"), _square(batch, "template")
        v = tangent(mean, aligned(q, mean, scale)[0], scale)
        return np.column_stack([_flat(v), dot(v, v)])

    if state is None:
        # the first key's shape of each group
        first = rows.groupBy("_g").agg(F.min_by("q", F.to_json(F.struct(*keys))).alias("template"))
        state = settled(first.select("_g", "template", F.lit(0).alias("rounds"), F.lit(None).cast("double").alias("change"), F.array().cast("array<double>").alias("objective"), F.lit(False).alias("done")))

    def update(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            out = []
            for g, mean, rounds, objective, n, s in zip(pdf["_g"], pdf["template"], pdf["rounds"], pdf["objective"], pdf["n"], pdf["s"], strict=True):
                average = np.asarray(s) / n
                mean, v = np.asarray(mean, float).reshape(1, 2, -1), average[:-1].reshape(1, 2, -1)
                change = float(np.sqrt(dot(v, v)[0]) / max(np.sqrt(dot(mean, mean)[0]), 1e-12))
                out.append((g, _flat(moved_by(mean, v, scale))[0].tolist(), int(rounds) + 1, change, [*objective, float(average[-1])], change < tol))
            yield pd.DataFrame(out, columns=["_g", "template", "rounds", "change", "objective", "done"])

    while True:
        moving = state.where(~F.col("done") & (F.col("rounds") < max_iter))
        numbers = moving.select(F.sum(F.size("template"))).first()[0]
        if not numbers:
            return state
        sums = group_sums(_with(rows.select("_g", "q"), moving.select("_g", "template"), numbers), step)
        new = moving.join(sums, "_g").mapInPandas(update, registration.STATE)
        state = settled(state.where(F.col("done") | (F.col("rounds") >= max_iter)).unionByName(new))


def elastic_shapes(
    paths: DataFrame, keys: Sequence[str] = ("session_id", "idx"), by: Sequence[str] = (), *, n: int = 4, scale: bool = False, max_iter: int = ROUNDS, tol: float = TOLERANCE
) -> tuple[DataFrame, DataFrame]:
    """Shape scores of packed paths (keys, by, u, v arrays), and a row a group.

    First (keys, by, scores, angle, warping, distance): ``distance`` is the length of the tangent vector. Then (by, n, mean_u, mean_v, ratio, modes_u, modes_v, rounds):
    the mean path, shares of variance, and for each component the paths 1.5 deviations before and after the mean.
    """
    names = list(dict.fromkeys([*keys, *by]))
    points = ready(paths.select(*names, F.concat("u", "v").alias("y")), keys, by)

    def to_q(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists(_flat(velocity(_square(batch, "y"), scale)))], names=["_g", *names, "q"])

    rows = settled(points.mapInArrow(to_q, points.withColumnRenamed("y", "q").schema))
    if rows.where(F.size("q") < 10).limit(1).count():
        raise ValueError("paths of five points or more are needed")
    means = karcher_means(rows, keys, scale=scale, max_iter=max_iter, tol=tol)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, WARPED):
                part = batch.slice(i, WARPED)
                mean = _square(part, "template")
                q, angle, gamma = aligned(_square(part, "q"), mean, scale)
                v = tangent(mean, q, scale)
                kept = [part.column(part.schema.get_field_index(c)) for c in ("_g", *names)]
                yield pa.RecordBatch.from_arrays([*kept, lists(_flat(v)), pa.array(angle), lists(gamma), pa.array(np.sqrt(dot(v, v)))], names=["_g", *names, "vector", "angle", "warping", "distance"])

    kind = rows.drop("q").withColumns({"vector": F.lit(None).cast("array<double>"), "angle": F.lit(0.0), "warping": F.lit(None).cast("array<double>"), "distance": F.lit(0.0)}).schema
    tangents = settled(_with(rows, means.select("_g", "template")).mapInArrow(vectors, kind))
    model = components(tangents, "vector", n)
    found = settled(scored(tangents, model, "vector", "scores"))
    spread = found.groupBy("_g", *by).agg(F.array(*[F.coalesce(F.stddev_pop(F.get("scores", F.lit(j))), F.lit(0.0)) for j in range(n)]).alias("sd"))
    summary = spread.join(model.select("_g", "n", "comp", "ratio"), "_g").join(means.select("_g", "template", "rounds"), "_g")

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for mean, comp, sd in zip(pdf["template"], pdf["comp"], pdf["sd"], strict=True):
                q = np.asarray(mean, float).reshape(1, 2, -1)
                steps = [sign * 1.5 * s * np.asarray(c, float).reshape(1, 2, -1) for c, s in zip(comp, sd, strict=False) for sign in (-1, 1)]
                at, b = [path_of(moved_by(q, v, scale))[0] for v in steps], path_of(q)[0]
                out.append((b[0].tolist(), b[1].tolist(), [m[0].tolist() for m in at], [m[1].tolist() for m in at]))
            yield pdf.drop(columns=["template", "comp", "sd", "_g"]).assign(**{c: [o[i] for o in out] for i, c in enumerate(("mean_u", "mean_v", "modes_u", "modes_v"))})

    nested = F.lit(None).cast("array<array<double>>")
    out_schema = summary.drop("template", "comp", "sd", "_g").withColumns({"mean_u": F.lit(None).cast("array<double>"), "mean_v": F.lit(None).cast("array<double>"), "modes_u": nested, "modes_v": nested}).schema
    return found.select(*names, "scores", "angle", "warping", "distance"), summary.mapInPandas(drawn, out_schema)


def shape_contrasts(scores: DataFrame, meta: DataFrame, n: int = 4, keys: Sequence[str] = ("session_id", "idx"), *, outcome: str = "error", cue: str = "cue") -> DataFrame:
    """The contrasts of shape scores by outcome and cue (``fda.component_contrasts``)."""
    return fda.component_contrasts(scores.join(meta.select(*keys, outcome, cue), list(keys)), n, outcome=outcome, cue=cue)
