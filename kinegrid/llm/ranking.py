"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in measures of its whole text. It is learnt from preference pairs
(a document labelled good beats one labelled bad) by logistic loss on the difference of their features,
and a quantile of the training strengths is the threshold. Fitting uses at most ``SAMPLE`` labelled rows, chosen by
a hash of their key; every document is scored where it is read, so scoring needs no shuffle.

Defined cases: a null text is an empty text, which has a score; null keys are scored; labels that are null are not learnt from;
without labels of both kinds every strength is 0 and every score is the threshold's; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinegrid.llm.bytewords import NOT_SPACE, Words, pieces, shingles, word_hashes
from kinegrid.llm.common import residue

#: Bound of the labelled rows that are fitted, chosen by hash from all labelled rows.
SAMPLE = 6000
THRESHOLD = 0.3
PIECE_BYTES = 4 << 20
#: Measures of a text of so many bytes count half.
FEW_BYTES = 200

#: Classes of bytes whose shares are features.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "newline": b"\n",
    "space": b" \t\r\x0b\x0c",
    "exclamation": b"!",
    "bar": b"|",
    "symbol": b"#*$%&<>",
    "stop": b".?",
    "comma": b",;:",
    "bracket": b"()[]{}\"'",
    "link": b"/@_=\\",
}
CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _i, _c in enumerate(CLASSES.values()):
    CLASS_OF[list(_c)] = _i
CLASS_OF[128:] = len(CLASSES) + 1
KINDS = len(CLASSES) + 2
FEATURES = (
    [f"share_{c}" for c in [*CLASSES, "other", "beyond_ascii"]]
    + [f"root_{c}" for c in [*CLASSES, "other", "beyond_ascii"]]
    + ["stutter", "log_words", "word_length", "distinct", "top_word", "repeat_windows", "repeat_lines", "log_line"]
)


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: distinct values, values found twice or more (all their places), places of the most frequent value."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((ids, owner))
    ids, owner = ids[order], owner[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(ids)))
    whose, n = owner[at], len(bounds) - 1
    most = np.zeros(n)
    np.maximum.at(most, whose, runs)
    return np.bincount(whose, minlength=n), np.bincount(whose, weights=runs * (runs > 1), minlength=n), most


def features(texts: pa.Array) -> np.ndarray:
    """One row per text: a column per name in FEATURES, and the text's bytes."""
    words = Words(texts, NOT_SPACE)
    size = np.diff(words.offsets)
    n = len(size)
    kinds = np.zeros((n, KINDS))
    of = CLASS_OF[words.data]
    for k in range(KINDS):
        kinds[:, k] = _per_text(of == k, words.offsets)
    share = kinds / np.maximum(size, 1)[:, None]
    count = words.counts
    some = np.maximum(count, 1)
    hashes = word_hashes(words)
    distinct, _, top = _repeats(hashes, words.first)
    windows, bounds = shingles(hashes, words.first, 3)
    _, twice, _ = _repeats(windows, bounds)
    lines = Words(texts, _LINE)
    line_count = np.maximum(lines.counts, 1)
    _, same, _ = _repeats(word_hashes(lines), lines.first)
    stutter = np.zeros(len(hashes), bool)
    stutter[1:] = hashes[1:] == hashes[:-1]
    stutter[words.first[:-1][count > 0]] = False
    rest = [
        _per_text(stutter, words.first) / some,
        np.log1p(count),
        np.minimum(_per_text(words.ends - words.starts, words.first) / some, 20) / 10,
        np.log((distinct + 1) / (some**0.85 + 1)),
        top / some,
        twice / np.maximum(np.diff(bounds), 1),
        same / line_count,
        np.log1p(size / line_count) / 5,
    ]
    return np.column_stack([share, np.sqrt(share), *rest, size])


_LINE = np.ones(256, bool)
_LINE[10] = False


def standard(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features; what a few bytes measure is drawn towards the mean, as there is little evidence."""
    size = x[:, -1:]
    return np.clip((x[:, :-1] - centre) / scale, -6, 6) * (size / (size + FEW_BYTES))


@dataclass(frozen=True)
class Ranking:
    """Strength = weights . (features - centre) / scale; score = P(good), THRESHOLD at ``cut``."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return standard(x, self.centre, self.scale) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        logit = np.log(THRESHOLD / (1 - THRESHOLD)) + self.slope * (self.strengths(x) - self.cut)
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def fit_ranking(x: np.ndarray, good: np.ndarray, *, opponents: int = 8, ridge: float = 1e-2, rounds: int = 30, seed: int = 5) -> Ranking:
    """Newton steps on the pairwise logistic loss; then the cut, as a quantile of the training strengths."""
    width = len(FEATURES)
    if not len(x) or good.all() or not good.any():
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0)
    centre, scale = x[:, :-1].mean(0), x[:, :-1].std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = standard(x, centre, scale)
    rng = np.random.default_rng(seed)
    winners, losers = np.flatnonzero(good), np.flatnonzero(~good)
    # every row meets opponents of the other kind
    a = np.concatenate([np.repeat(winners, opponents), rng.choice(winners, len(losers) * opponents)])
    b = np.concatenate([rng.choice(losers, len(winners) * opponents), np.repeat(losers, opponents)])
    d = z[a] - z[b]
    w = np.zeros(width)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # P(the worse one wins)
        gradient = -(d * p[:, None]).mean(0) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    # the quantile with the fewest errors, each kind weighed by its number
    levels = np.quantile(s, np.linspace(0, 1, 1001))
    wrong = [((s < c) & good).sum() / good.sum() + ((s >= c) & ~good).sum() / (~good).sum() for c in levels]
    best = np.flatnonzero(np.array(wrong) <= min(wrong) + 1e-12)
    cut = float((levels[best[0]] + levels[best[-1]]) / 2)
    slope = 1.0
    for _ in range(50):  # one calibrated slope, by Newton steps on the logistic loss
        q = 1 / (1 + np.exp(-np.clip(np.log(THRESHOLD / (1 - THRESHOLD)) + slope * (s - cut), -40, 40)))
        slope -= float(((q - good) * (s - cut)).mean() + 1e-3 * slope) / float((q * (1 - q) * (s - cut) ** 2).mean() + 1e-3)
        slope = min(max(slope, 1e-3), 50.0)
    return Ranking(centre, scale, w, cut, slope)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 1, PIECE_BYTES):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(features(part.column(1))), pa.list_(pa.float64()))], names=["good", "x"])


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, train_only=None) -> Ranking:
    """Fits on at most ``sample`` labelled rows; ``train_only(key column)`` says which may be learnt from."""
    rows = labels.select(F.col(key).alias("k"), (F.col(label) == 1).alias("good")).where("k is not null and good is not null")
    if train_only is not None:
        rows = rows.where(train_only(F.col("k")))
    rows = rows.orderBy(F.xxhash64("k"), "k", "good").limit(sample)
    found = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(F.broadcast(rows), "k")
    pdf = found.select("good", "t").mapInArrow(_feature_batches, "good boolean, x array<double>").toPandas()
    if not len(pdf):
        return fit_ranking(np.zeros((0, len(FEATURES) + 1)), np.zeros(0, bool))
    x, good = np.array(pdf["x"].tolist()), pdf["good"].to_numpy(bool)
    order = np.lexsort((*x.T, good))  # the fit does not depend on the order of rows
    return fit_ranking(x[order], good[order])


def score(docs: DataFrame, model: Ranking, *, text: str = "text", into: str = "score") -> DataFrame:
    """All columns of docs and the score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, kept = docs.columns, [c for c in docs.columns if c != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, names.index(text), PIECE_BYTES):
                found = shared.value.scores(features(part.column(names.index(text))))
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(c)) for c in kept), pa.array(found)], names=[*kept, into])

    return docs.mapInArrow(run, docs.select(*kept).withColumn(into, F.lit(0.0)).schema)


def held_out(key, modulus: int = 5):
    return residue(key, modulus) == 0


def agreement(predictions: pd.DataFrame) -> dict[str, float]:
    """Accuracy and area under the ROC curve of columns good, score, predicted."""
    good, s = predictions["good"].to_numpy(bool), predictions["score"].to_numpy()
    ranks = pd.Series(s).rank().to_numpy()
    n1, n0 = good.sum(), (~good).sum()
    auc = (ranks[good].sum() - n1 * (n1 + 1) / 2) / max(1, n1 * n0)
    return {"accuracy": float((predictions["predicted"].to_numpy() == good).mean()), "auc": float(auc)}
