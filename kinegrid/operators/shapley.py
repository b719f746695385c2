"""Shapley values of boosted trees, and feature importance for targets of two or more classes.

A fitted model's trees are read from its own table of nodes: values, covers and splits. For each leaf the conditions of its path are grouped
by feature: whether a row meets them, and which share of the training rows at those nodes does. The value of a leaf is then shared out exactly over
the few features of its path, for all rows of a batch side by side, and summed over leaves and trees. Values and the expected value sum to the margin.
"""

from __future__ import annotations

import math
import posixpath
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinegrid.operators.registration import lists, matrix
from kinegrid.sources.state import folder, settled

BLOCK = 4096


@dataclass(frozen=True)
class Leaf:
    """value: the tree's weight times the leaf's prediction; conditions: by feature (low, high, share): low < x <= high, and the share of rows that go on."""

    value: float
    conditions: tuple[tuple[int, float, float, float], ...]


def leaves(nodes: list[dict], weight: float) -> list[Leaf]:
    """The leaves of one tree; nodes: id, prediction, count, left, right, feature, threshold."""
    by_id, out = {n["id"]: n for n in nodes}, []

    def walk(at: int, path: dict[int, tuple[float, float, float]]) -> None:
        node = by_id[at]
        if node["left"] < 0:
            out.append(Leaf(weight * node["prediction"], tuple((f, *c) for f, c in sorted(path.items()))))
            return
        f = node["feature"]
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        for child, bounds in ((node["left"], (low, min(high, node["threshold"]))), (node["right"], (max(low, node["threshold"]), high))):
            walk(child, path | {f: (*bounds, share * by_id[child]["count"] / node["count"])})

    walk(0, {})
    return out


def tree_values(x: np.ndarray, found: list[Leaf]) -> tuple[np.ndarray, float]:
    """(rows, features) of Shapley values, and the expected value."""
    phi, expected = np.zeros(x.shape), 0.0
    for leaf in found:
        m = len(leaf.conditions)
        shares = [c[3] for c in leaf.conditions]
        expected += leaf.value * math.prod(shares)
        meets = [((x[:, f] > low) & (x[:, f] <= high)).astype(float) for f, low, high, _ in leaf.conditions]
        for i, (f, *_) in enumerate(leaf.conditions):
            rest = [j for j in range(m) if j != i]
            total = np.zeros(len(x))
            for size in range(m):
                for chosen in combinations(rest, size):
                    part = np.full(len(x), math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m))
                    for j in rest:
                        part = part * (meets[j] if j in chosen else shares[j])
                    total += part
            phi[:, f] += leaf.value * (meets[i] - shares[i]) * total
    return phi, expected


def model_leaves(model, spark) -> list[Leaf]:
    """All leaves of a fitted model of boosted trees, from the table of nodes that it writes to the shared folder."""
    path = posixpath.join(folder(spark), f"trees-{uuid.uuid4().hex}")
    model.save(path)
    n, split = "nodeData", "nodeData.split"
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", f"{n}.id", f"{n}.prediction", F.col(f"{n}.rawCount").alias("count"), F.col(f"{n}.leftChild").alias("left"), F.col(f"{n}.rightChild").alias("right"),
        F.col(f"{split}.featureIndex").alias("feature"), F.get(f"{split}.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )
    trees: dict[int, list[dict]] = {}
    for r in rows.collect():  # nodes of the model's trees
        trees.setdefault(r["treeID"], []).append(r.asDict())
    return [leaf for t, w in enumerate(model.treeWeights) for leaf in leaves(trees[t], float(w))]


def shapley_values(rows: DataFrame, found: dict[str, list[Leaf]], features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(key, class, phi, expected): a row per row and class, phi in the order of features."""
    shared = rows.sparkSession.sparkContext.broadcast(found)
    packed = rows.select(*key, F.array(*[F.col(f).cast("double") for f in features]).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                x = matrix(part.column(len(key)))
                for name, own in shared.value.items():
                    phi, expected = tree_values(x, own)
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(j) for j in range(len(key))), pa.array([name] * len(x), pa.string()), lists(phi), pa.array(np.full(len(x), expected))], names=[*key, "class", "phi", "expected"]
                    )

    schema = packed.drop("x").withColumns({"class": F.lit(""), "phi": F.lit(None).cast("array<double>"), "expected": F.lit(0.0)}).schema
    return packed.mapInArrow(run, schema)


def classifier_importance(
    df: DataFrame, features: Sequence[str], label: str, key: Sequence[str], *, rounds: int = 200, depth: int = 3, test: float = 0.3, seed: int = 0
) -> tuple[DataFrame, DataFrame, float | None]:
    """(feature, shap_importance, shap_sd) from the largest on; (key, class, phi, expected) of the rows held out; and balanced accuracy on them.

    Boosted trees are fitted on the other rows, classes weighed alike: one model for two classes (values are for the second one), one for each class against the rest
    for more. Importance is the mean absolute value over held-out rows and classes. A target of one class raises.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    from kinegrid.operators.ml import _balanced, stratified_folds

    rows = settled(stratified_folds(df, label, key, 10, seed))
    held = F.col("fold") <= round(10 * test)
    classes = sorted(r[0] for r in rows.select(label).distinct().collect())  # classes of the target
    if len(classes) < 2:
        raise ValueError("two classes or more are needed")
    assemble = VectorAssembler(inputCols=list(features), outputCol="features")
    tested, fits = rows.where(held), {}
    for c in classes if len(classes) > 2 else classes[1:]:
        own = rows.where(~held).withColumn("_is", (F.col(label) == c).cast("double"))
        model = GBTClassifier(labelCol="_is", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=seed).fit(assemble.transform(_balanced(own, "_is")))
        fits[str(c)] = model_leaves(model, df.sparkSession)
    values = settled(shapley_values(tested, fits, features, key))
    at = values.select("class", F.posexplode("phi").alias("i", "v"))
    names = F.array(*[F.lit(f) for f in features])
    importance = at.groupBy("i").agg(F.avg(F.abs("v")).alias("shap_importance"), F.stddev_pop(F.abs("v")).alias("shap_sd"))
    importance = importance.select(F.get(names, F.col("i")).alias("feature"), "shap_importance", "shap_sd").orderBy(F.desc("shap_importance"), "feature")
    margin = F.aggregate("phi", F.col("expected"), lambda s, v: s + v).alias("m")
    best = values.select(*key, "class", margin).groupBy(*key).agg(F.max_by("class", F.struct("m", "class")).alias("best"), F.max("m").alias("m"))
    chosen = F.col("best") if len(classes) > 2 else F.when(F.col("m") > 0, F.lit(str(classes[1]))).otherwise(F.lit(str(classes[0])))
    right = best.join(tested.select(*key, F.col(label).cast("string").alias("_true")), list(key)).withColumn("ok", (chosen == F.col("_true")).cast("double"))
    return importance, values, right.groupBy("_true").agg(F.avg("ok").alias("r")).agg(F.avg("r")).first()[0]
