"""k-medoids of curves without a distance matrix.

Medoids (a few curves) are broadcast; every task measures its curves against them. A new medoid is sought in each cluster in two steps: all members are
rated by their distances to a hashed reference of at most ``REFERENCE`` members, and the best ``CANDIDATES`` of them are then measured against all
members. Where a cluster is no larger than the reference its medoid is exact; in larger ones the medoid that stays is the exact best of the
candidates. Tasks send sums and their few best rows, so what reaches the driver depends on k, restarts and these parameters, not on the rows.
All restarts share each pass. Results do not depend on how rows are dealt; a hot cluster is spread over all tasks.

Curves have one length and no nulls; repeated curves count each; k beyond the number of distinct curves raises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinegrid.operators.distances import distances_to
from kinegrid.operators.registration import lists, matrix
from kinegrid.sources.state import settled

REFERENCE, CANDIDATES = 512, 32
#: Curves that are measured together.
BLOCK = 2048


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            part = batch.slice(i, BLOCK)
            yield part.column(0), part.column(1).to_numpy(zero_copy_only=False), matrix(part.column(2))


def _best(rows: DataFrame, rate: Callable[[np.ndarray, np.ndarray], np.ndarray], groups: int, many: int) -> dict[int, list[tuple[float, object, np.ndarray]]]:
    """For each of ``groups`` ratings of the curves the ``many`` rows with the least finite rating, equal ones by key.

    rate(hashes, curves) gives (groups, rows); a task keeps and sends its own ``many`` for each group.
    """
    kind = dict(rows.dtypes)["i"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, list, np.ndarray]] = {}
        for keys, hashes, y in _blocks(batches):
            values = rate(hashes, y)
            names = keys.to_pylist()
            for g in range(groups):
                some = np.flatnonzero(np.isfinite(values[g]))
                if len(some) > many:
                    some = some[values[g][some] <= np.partition(values[g][some], many - 1)[many - 1]]
                v, k, c = held.get(g, (np.zeros(0), [], np.zeros((0, y.shape[1]))))
                v, k, c = np.concatenate([v, values[g][some]]), [*k, *(names[s] for s in some)], np.concatenate([c, y[some]])
                order = sorted(range(len(v)), key=lambda x: (v[x], k[x]))[:many]
                held[g] = v[order], [k[x] for x in order], c[order]
        for g, (v, k, c) in held.items():
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), g)), pa.array(v), pa.array(k, keys.type), lists(c)], names=["g", "v", "i", "y"])

    found = rows.mapInArrow(run, f"g long, v double, i {kind}, y array<double>")
    top = found.groupBy("g").agg(F.slice(F.array_sort(F.collect_list(F.struct("v", "i", "y"))), 1, many).alias("best")).collect()
    return {r["g"]: [(x["v"], x["i"], np.asarray(x["y"], float)) for x in r["best"]] for r in top}


def _sums(rows: DataFrame, values: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sums over all curves of vectors of one width; a task sends its own sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for _, _, y in _blocks(batches):
            total += values(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["at", "v"])

    out = np.zeros(width)
    for r in rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def _uniform(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) from hashes and a salt."""
    with np.errstate(over="ignore"):
        x = hashes.astype(np.uint64) + np.uint64(salt * 2 + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _seeds(rows: DataFrame, k: int, runs: int, seed: int, measure) -> list[list[tuple[object, np.ndarray]]]:
    """k curves for each run: the first at random, each next one with the square of its distance to those before as its weight.

    A draw by weights is a race of exponential times, so it is one minimum over the rows.
    """
    chosen: list[list[tuple[object, np.ndarray]]] = [[] for _ in range(runs)]
    for step in range(k):

        def race(hashes: np.ndarray, y: np.ndarray, step=step) -> np.ndarray:
            out = np.empty((runs, len(y)))
            for r in range(runs):
                time = -np.log(_uniform(hashes, seed * 1_000_003 + r * 1009 + step))
                if step:
                    weight = np.min([measure(y, c) for _, c in chosen[r]], axis=0) ** 2
                    time = np.where(weight > 0, time / np.maximum(weight, 1e-300), np.inf)
                out[r] = time
            return out

        best = _best(rows, race, runs, 1)
        for r in range(runs):
            if r not in best:
                raise ValueError("k is at most the number of distinct curves")
            chosen[r].append(best[r][0][1:])
    return chosen


def kmedoids(packed: DataFrame, k: int, *, key: str = "idx", y: str = "y", distance: str = "euclidean", n_init: int = 10, max_iter: int = 300, seed: int = 0) -> tuple[DataFrame, list, float]:
    """(i, cluster, d) of every curve, the medoids' keys, and the inertia (sum of distances) of the best of ``n_init`` starts."""
    if k < 1:
        raise ValueError("k is 1 or more")
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = settled(packed.select(F.col(key).alias("i"), F.xxhash64(F.lit(seed), F.col(key)).alias("h"), F.col(y).alias("y")).repartition(parts, "i"))
    measure = lambda a, b: distances_to(a, b, distance)
    now = _seeds(rows, k, n_init, seed, measure)
    active = list(range(n_init))

    def labelled(curves: np.ndarray, medoids: list[tuple[object, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        d = np.stack([measure(curves, c) for _, c in medoids])
        return d.argmin(axis=0), d.min(axis=0)

    for _ in range(max_iter):
        if not active:
            break
        these = list(active)

        def sampled(hashes: np.ndarray, curves: np.ndarray, these=these) -> np.ndarray:
            out = np.full((len(these) * k, len(curves)), np.inf)
            for x, r in enumerate(these):
                label = labelled(curves, now[r])[0]
                u = _uniform(hashes, 17)
                out[x * k + label, np.arange(len(curves))] = u
            return out

        reference = _best(rows, sampled, len(these) * k, REFERENCE)
        far = {g: np.stack([c for _, _, c in found]) for g, found in reference.items()}

        def rated(hashes: np.ndarray, curves: np.ndarray, these=these, far=far) -> np.ndarray:
            out = np.full((len(these) * k, len(curves)), np.inf)
            for x, r in enumerate(these):
                label = labelled(curves, now[r])[0]
                for c in range(k):
                    some = np.flatnonzero(label == c)
                    if len(some):
                        out[x * k + c, some] = np.round(np.mean([measure(curves[some], z) for z in far[x * k + c]], axis=0), 9)
            return out

        candidates = _best(rows, rated, len(these) * k, CANDIDATES)

        def confirmed(curves: np.ndarray, these=these, candidates=candidates) -> np.ndarray:
            out = np.zeros((len(these) * k, CANDIDATES))
            for x, r in enumerate(these):
                label = labelled(curves, now[r])[0]
                for c in range(k):
                    own = curves[label == c]
                    if len(own):
                        for j, (_, _, z) in enumerate(candidates[x * k + c]):
                            out[x * k + c, j] = measure(own, z).sum()
            return out.reshape(-1)

        exact = _sums(rows, confirmed, len(these) * k * CANDIDATES).reshape(len(these), k, CANDIDATES)
        for x, r in enumerate(these):
            new = []
            for c in range(k):
                found = candidates.get(x * k + c)
                if not found:
                    new.append(now[r][c])
                    continue
                best = min(range(len(found)), key=lambda j, x=x, c=c: (round(exact[x, c, j], 6), found[j][1]))
                new.append(found[best][1:])
            if [a for a, _ in new] == [a for a, _ in now[r]]:
                active.remove(r)
            now[r] = new
    inertia = _sums(rows, lambda curves: np.array([labelled(curves, m)[1].sum() for m in now]), n_init)
    best = now[int(np.argmin(np.round(inertia, 6)))]
    kind = dict(rows.dtypes)["i"]

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, curves in _blocks(batches):
            c, d = labelled(curves, best)
            yield pa.RecordBatch.from_arrays([keys, pa.array(c.astype(np.int32)), pa.array(d)], names=["i", "cluster", "d"])

    return rows.mapInArrow(label, f"i {kind}, cluster int, d double"), [a for a, _ in best], float(inertia.min())


def silhouettes(packed: DataFrame, labels: DataFrame, *, key: str = "idx", y: str = "y", distance: str = "euclidean", reference: int = 2 * REFERENCE) -> DataFrame:
    """(i, cluster, s): silhouette of each curve by its mean distances to at most ``reference`` hashed members of each cluster (all members of a smaller one).

    Alone in a cluster: 0. The members that are measured against are the same for all curves; a curve is not measured against itself.
    """
    rows = packed.select(F.col(key).alias("i"), F.col(y).alias("y")).join(labels.select("i", "cluster"), "i").where("cluster is not null")
    order = F.struct(F.xxhash64(F.lit(17), "i").alias("h"), "i", "y")
    top = rows.groupBy("cluster", F.pmod(F.xxhash64(F.lit(3), "i"), F.lit(64)).alias("_part")).agg(F.slice(F.array_sort(F.collect_list(order)), 1, reference).alias("r"), F.count(F.lit(1)).alias("n"))
    # 64 parts of a cluster keep their first members; of these the first are taken
    few = top.groupBy("cluster").agg(F.slice(F.array_sort(F.flatten(F.collect_list("r"))), 1, reference).alias("r"), F.sum("n").alias("n")).collect()
    known = {r["cluster"]: (r["n"], [x["i"] for x in r["r"]], np.stack([np.asarray(x["y"], float) for x in r["r"]])) for r in few}
    names = sorted(known)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {c: {x: j for j, x in enumerate(known[c][1])} for c in names}
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                keys, curves, own = part.column(0).to_pylist(), matrix(part.column(1)), part.column(2).to_pylist()
                means = np.full((len(names), len(curves)), np.nan)
                for g, c in enumerate(names):
                    d = np.stack([distances_to(curves, z, distance) for z in known[c][2]])
                    inside = np.array([x in at[c] and o == c for x, o in zip(keys, own, strict=True)])
                    count = len(d) - inside
                    total = d.sum(axis=0) - np.array([d[at[c][x], j] if k else 0.0 for j, (x, k) in enumerate(zip(keys, inside, strict=True))])
                    means[g] = np.where(count > 0, total / np.maximum(count, 1), np.nan)
                mine = np.array([names.index(o) for o in own])
                a = means[mine, np.arange(len(curves))]
                rest = means.copy()
                rest[mine, np.arange(len(curves))] = np.inf
                b = np.where(np.isnan(rest), np.inf, rest).min(axis=0)
                s = np.where(np.isfinite(a) & np.isfinite(b) & (np.maximum(a, b) > 0), (b - a) / np.where(np.maximum(a, b) > 0, np.maximum(a, b), 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.nan_to_num(s))], names=["i", "cluster", "s"])

    return rows.select("i", "y", "cluster").mapInArrow(run, f"i {kinds['i']}, cluster {kinds['cluster']}, s double")


def suggest_k(packed: DataFrame, ks: Sequence[int] = range(2, 7), *, key: str = "idx", y: str = "y", distance: str = "euclidean", **settings) -> dict[int, float]:
    """Mean silhouette of the best k-medoids for each k."""
    out = {}
    for k in ks:
        labels = settled(kmedoids(packed, k, key=key, y=y, distance=distance, **settings)[0])
        out[k] = silhouettes(packed, labels, key=key, y=y, distance=distance).agg(F.avg("s")).first()[0]
    return out


def cluster_timeseries(channels: DataFrame, k: int, *, keys: Sequence[str] = ("session_id", "idx"), distance: str = "msm", z: bool = False, **settings) -> tuple[DataFrame, list, float]:
    """k-medoids of curves (keys, channel, k, y) of one or more channels, end to end, under an elastic distance (summed over channels)."""
    one = channels.groupBy(*keys, "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.col("y").cast("double").alias("y")))), lambda v: v["y"]).alias("c"))
    if z:
        mean = F.aggregate("c", F.lit(0.0), lambda s, v: s + v) / F.size("c")
        sd = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, v: s + (v - F.col("m")) * (v - F.col("m"))) / F.size("c"))
        one = one.withColumn("m", mean).withColumn("sd", sd).withColumn("c", F.transform("c", lambda v: F.when(F.col("sd") > 0, (v - F.col("m")) / F.col("sd")).otherwise(0.0)))
    width = one.agg(F.count_distinct("channel")).first()[0] or 1
    packed = one.groupBy(F.to_json(F.struct(*keys)).alias("idx")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("channel", "c"))), lambda v: v["c"])).alias("y"))
    labels, medoids, inertia = kmedoids(packed, k, distance=f"{distance}:{width}", **settings)
    key = F.from_json("i", one.select(F.struct(*keys).alias("s")).schema["s"].dataType.simpleString())
    return labels.withColumn("_k", key).select("_k.*", "cluster", "d"), medoids, inertia
