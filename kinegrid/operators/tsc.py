"""Time-series features: dilated two-valued kernels and shapelets. Kernels and shapelets are broadcast (their number is a parameter), curves stay where they are."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinegrid.operators.registration import lists, matrix


#: The 84 choices of three of nine weights that are 2; the others are -1.
TRIPLES = np.array(list(combinations(range(9), 3)))
#: Dilations that one kernel has at most.
DILATIONS = 32
POOLINGS = ("positive_share", "longest_positive", "positive_mean", "positive_place")
SIDE = 64


def dilations(p: int, per_kernel: int) -> list[tuple[int, int]]:
    """(dilation, biases): ``per_kernel`` biases of each kernel dealt over powers of two that fit a curve of p points, spread evenly by exponent."""
    most = min(per_kernel, DILATIONS)
    exponents = np.linspace(0, max(0.0, np.log2(max(1.0, (p - 1) / 8))), most)
    values, counts = np.unique((2**exponents).astype(int), return_counts=True)
    dealt = counts * per_kernel // most
    dealt[: per_kernel - dealt.sum()] += 1  # what is left goes to the small ones
    return [(int(d), int(n)) for d, n in zip(values, dealt, strict=True) if n]


def kernel_outputs(y: np.ndarray, dilation: int) -> np.ndarray:
    """(rows, 84, p) of rows of curves: all kernels at one dilation, the curve padded with zeros."""
    n, p = y.shape
    padded = np.pad(y, ((0, 0), (4 * dilation, 4 * dilation)))
    shifted = np.stack([padded[:, j * dilation : j * dilation + p] for j in range(9)])
    return 3 * (shifted[TRIPLES[:, 0]] + shifted[TRIPLES[:, 1]] + shifted[TRIPLES[:, 2]]).transpose(1, 0, 2) - shifted.sum(axis=0)[:, None, :]


def _pooled(z: np.ndarray, inside: slice) -> np.ndarray:
    """(rows, kernels, 4) of outputs less bias: share, longest run, mean and mean place (-1 without any) of positive values."""
    z = z[:, :, inside]
    positive = z > 0
    count = positive.sum(axis=2)
    some = np.maximum(count, 1)
    run, longest = np.zeros(count.shape), np.zeros(count.shape)
    for j in range(z.shape[2]):
        run = (run + 1) * positive[:, :, j]
        longest = np.maximum(longest, run)
    place = np.where(count > 0, (positive * np.arange(z.shape[2])).sum(axis=2) / some, -1.0)
    return np.stack([count / z.shape[2], longest, np.where(positive, z, 0).sum(axis=2) / some, place], axis=2)


def _forms(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return y, np.diff(y, axis=1)


def multirocket_plan(examples: np.ndarray, n_kernels: int) -> list[list[tuple[int, np.ndarray]]]:
    """For the curve and for its differences: each dilation's biases (biases, 84), quantiles of a kernel's outputs on one example each.

    Quantiles follow multiples of the golden ratio; the examples take turns over dilations and kernels.
    """
    per_kernel, golden, out = max(1, n_kernels // 84), (np.sqrt(5) + 1) / 2, []
    for form in _forms(examples):
        plan, number = [], 0
        for d, n in dilations(form.shape[1], per_kernel):
            outputs = kernel_outputs(form, d)
            of = np.arange(84) % len(form)
            own = outputs[of, np.arange(84)]
            q = (golden * (np.arange(n * 84) + number + 1)) % 1.0
            plan.append((d, np.stack([[np.quantile(own[k], q[b * 84 + k]) for k in range(84)] for b in range(n)])))
            number += n * 84
        out.append(plan)
    return out


def multirocket_rows(y: np.ndarray, plan: list[list[tuple[int, np.ndarray]]]) -> np.ndarray:
    """Features of rows of curves, in the order form, dilation, bias, kernel, pooling. Every second bias looks only where no padding is met."""
    out = []
    for form, steps in zip(_forms(y), plan, strict=True):
        p = form.shape[1]
        for d, biases in steps:
            z = kernel_outputs(form, d)
            for i, bias in enumerate(biases):
                inside = slice(4 * d, p - 4 * d) if i % 2 and p > 8 * d else slice(0, p)
                out.append(_pooled(z - bias[None, :, None], inside).reshape(len(y), -1))
    return np.concatenate(out, axis=1)


def multirocket_features(packed: DataFrame, n_kernels: int = 2000, *, key: str = "idx", y: str = "y", seed: int = 0, examples: int = 84) -> DataFrame:
    """(key, features): four poolings of about ``n_kernels`` fixed two-valued kernels (84 at dilations that fit the length) on each curve and on its differences.

    A bias is a quantile of a kernel's outputs on one curve, as the method has it; these ``examples`` are chosen by a hash of their keys. Every curve is
    transformed where it is read.
    """
    rows = packed.select(F.col(key), F.col(y).cast("array<double>").alias("y"))
    some = [np.asarray(r["y"], float) for r in rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(examples).collect()]
    if not some:
        raise ValueError("no curves")
    if len(some[0]) < 10:
        raise ValueError("curves of ten points or more are needed")
    shared = rows.sparkSession.sparkContext.broadcast(multirocket_plan(np.stack(some), n_kernels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SIDE):
                part = batch.slice(i, SIDE)
                found = multirocket_rows(matrix(part.column(1)), shared.value).astype(np.float32)
                offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(found.reshape(-1)))], names=[key, "features"])

    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, features array<float>")


def _z(x: np.ndarray) -> np.ndarray:
    s = x.std(axis=-1, keepdims=True)
    return np.where(s > 1e-12, (x - x.mean(axis=-1, keepdims=True)) / np.maximum(s, 1e-12), 0.0)


def shapelet_distance(series: np.ndarray, shapelet: np.ndarray) -> float:
    """Least mean squared difference of z-normalised windows."""
    windows = np.lib.stride_tricks.sliding_window_view(series, len(shapelet))
    return float(((_z(windows) - _z(shapelet)) ** 2).mean(axis=1).min())


def window_distance(values: Column, shapelet: list[float]) -> Column:
    """Least squared difference of raw windows, in the JVM."""
    m = len(shapelet)
    starts = F.sequence(F.lit(0), F.size(values) - m)
    fixed = F.array(*[F.lit(float(s)) for s in shapelet])
    one = lambda i: F.aggregate(F.zip_with(F.slice(values, i + 1, F.lit(m)), fixed, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    return F.array_min(F.transform(starts, one))


def shapelet_distances(rows: np.ndarray, shapelets: list[np.ndarray]) -> np.ndarray:
    """(rows, shapelets): least mean squared difference of z-normalised windows, from window sums: 2 less twice the correlation."""
    out, cached = np.empty((len(rows), len(shapelets))), {}
    for j, shape in enumerate(shapelets):
        m = len(shape)
        if m not in cached:
            windows = np.lib.stride_tricks.sliding_window_view(rows, m, axis=1)
            cached[m] = windows, windows.std(axis=2)
        windows, sd = cached[m]
        z = _z(shape)
        flat = (z**2).mean()  # 1, or 0 for a flat shapelet
        d = np.where(sd > 1e-12, 1 + flat - 2 * (windows @ z) / (m * np.maximum(sd, 1e-12)), flat)
        out[:, j] = np.maximum(d, 0).min(axis=1)
    return out


#: Ratings count distances, which lie between 0 and 4, in so many bins.
BINS = 1 << 14


def information_gain(counts: np.ndarray) -> float:
    """The greatest gain of a cut between rows of counts (bins in order, labels)."""
    left = np.cumsum(counts, axis=0)[:-1].astype(float)
    total = counts.sum(axis=0).astype(float)
    right = total - left

    def entropy(c):
        n = c.sum(axis=-1, keepdims=True)
        share = c / np.maximum(n, 1)
        return -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=-1)

    n = total.sum()
    return float((entropy(total) - left.sum(axis=1) / n * entropy(left) - right.sum(axis=1) / n * entropy(right)).max()) if len(left) else 0.0


def shapelet_transform(packed: DataFrame, label: str, candidates: int = 500, keep: int = 20, *, key: str = "idx", y: str = "y", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(key, features) by the kept shapelets' distances, and (shapelet, source, start, length, quality) from the best on.

    Candidates are cut from as many curves, chosen by a hash of their keys. All curves rate them: tasks count (candidate, bin of distance, label), and a candidate's
    quality is the greatest information gain of a cut between its bins. Of equal qualities the first candidate is kept.
    """
    spark = packed.sparkSession
    rows = packed.select(F.col(key), F.col(label).cast("string").alias("label"), F.col(y).cast("array<double>").alias("y"))
    fit = rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(candidates).collect()
    if not fit:
        raise ValueError("no curves")
    rng, p = np.random.default_rng(seed), len(fit[0]["y"])
    cuts = []
    for _ in range(candidates):
        i, m = int(rng.integers(len(fit))), int(rng.integers(min(3, p), max(4, p // 2 + 1)))
        cuts.append((i, int(rng.integers(0, p - m + 1)), m))
    shapes = [np.asarray(fit[i]["y"], float)[s : s + m] for i, s, m in cuts]
    order = sorted(range(candidates), key=lambda c: len(shapes[c]))  # candidates of one length share their windows
    shared = spark.sparkContext.broadcast((order, [shapes[c] for c in order]))

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, shapes = shared.value
        held: dict[str, dict[int, int]] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, SIDE):
                part = batch.slice(i, SIDE)
                bins = np.minimum((shapelet_distances(matrix(part.column(1)), shapes) / 4 * BINS).astype(np.int64), BINS - 1)
                labels = np.array([v if v is not None else "" for v in part.column(0).to_pylist()])
                for name in np.unique(labels):
                    at, n = np.unique(bins[labels == name] + np.array(order) * BINS, return_counts=True)
                    own = held.setdefault(str(name), {})
                    for a, k in zip(at.tolist(), n.tolist(), strict=True):
                        own[a] = own.get(a, 0) + k
        for name, own in held.items():
            at = np.fromiter(own, np.int64, len(own))
            yield pa.RecordBatch.from_arrays([pa.array(at // BINS), pa.array(at % BINS), pa.array([name] * len(at), pa.string()), pa.array(np.fromiter(own.values(), np.int64, len(own)))], names=["c", "bin", "label", "n"])

    def gained(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="bin", columns="label", values="n", aggfunc="sum", fill_value=0).sort_index()
        return pd.DataFrame({"c": [int(pdf["c"].iloc[0])], "q": [information_gain(table.to_numpy())]})

    counts = rows.select("label", "y").mapInArrow(rated, "c long, bin long, label string, n long").groupBy("c", "bin", "label").agg(F.sum("n").alias("n"))
    best = counts.groupBy("c").applyInPandas(gained, "c long, q double").orderBy(F.desc(F.round("q", 9)), "c").limit(keep).collect()  # a group has BINS times labels rows at most
    kept = [(*cuts[r["c"]], r["q"]) for r in best]
    summary = spark.createDataFrame([(n, str(fit[i][key]), s, m, q) for n, (i, s, m, q) in enumerate(kept)], "shapelet int, source string, start int, length int, quality double")
    chosen = spark.sparkContext.broadcast([shapes[r["c"]] for r in best])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SIDE):
                part = batch.slice(i, SIDE)
                yield pa.RecordBatch.from_arrays([part.column(0), lists(shapelet_distances(matrix(part.column(1)), chosen.value))], names=[key, "features"])

    return rows.select(key, "y").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, features array<double>"), summary
