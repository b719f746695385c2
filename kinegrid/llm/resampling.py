"""Importance resampling of documents towards the word distribution of a target set.

Features are the runs of one to ``runs`` words of a text, counted in hashed buckets over both tables. A bucket's gain is the
scaled, floored logarithm of its share in the target over its share in the documents; a document's weight is the floored mean of
its features' gains, read from one array. Gumbel noise of the key makes the highest integer scores a draw without replacement in
proportion to the weights. The draw needs no sort of the table: an exact histogram of the integer scores gives, by suffix
sums, the rank at which each score begins and the score where the quota ends; only rows of surviving scores are then
numbered, each score by itself, in order of the key. Equal rows are counted first and numbered by their count, so a key with
a third of all rows is one row until its ranks are written.

Defined cases: a null or wordless text has no features and weight 0; a null key counts as an empty text in the noise and comes before
other keys; equal rows take successive ranks; an empty target or corpus counts no features; without documents there is no row; with a
quota of none every rank is null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinegrid.llm.bytewords import ALNUM_LOWER, Words, pieces
from kinegrid.llm.common import cut_lineage

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
SCALE = 1000
PIECE_BYTES = 4 << 20
#: Spans up to so many bytes are hashed side by side, a byte of each at a time; longer ones one by one.
SIDE_BY_SIDE = 64
#: Equal rows are written in runs of so many ranks.
RUN = 4096


def _crc_table() -> np.ndarray:
    """The 256 steps of the reflected polynomial 0xEDB88320, by its rule."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> 1) ^ (np.uint32(0xEDB88320) * (c & 1))
    return c


CRC = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each span of the bytes."""
    out = np.empty(len(starts), np.int64)
    size = ends - starts
    for i in np.flatnonzero(size > SIDE_BY_SIDE):
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    some = np.flatnonzero(size <= SIDE_BY_SIDE)
    some = some[np.argsort(-size[some], kind="stable")]  # the longest first: those with a byte left are a prefix
    many = np.bincount(size[some], minlength=SIDE_BY_SIDE + 1)
    left = len(some) - np.cumsum(many)
    state, at = np.full(len(some), 0xFFFFFFFF, np.uint32), starts[some]
    for j in range(SIDE_BY_SIDE):
        n = left[j]
        if not n:
            break
        state[:n] = CRC[(state[:n] ^ data[at[:n] + j]) & 0xFF] ^ (state[:n] >> 8)
    out[some] = state ^ np.uint32(0xFFFFFFFF)
    return out


def feature_buckets(texts: pa.Array, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts' features the buckets, their bounds by text, and the texts' numbers of words."""
    words = Words(texts, ALNUM_LOWER, lower=True)
    starts, ends, counts = words.starts, words.ends, words.counts
    data = words.data
    if runs > 1:  # the words again with one space between, so that a run is a span
        sizes = ends - starts
        new = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        data = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
        data[np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes)] = words.data[words.mask]
        starts, ends = new, new + sizes
    owner = np.repeat(np.arange(len(counts)), counts)
    found, whose = [], []
    for k in range(min(runs, int(counts.max(initial=0)))):
        first = np.flatnonzero(np.arange(len(starts)) + k < words.first[1:][owner])
        found.append(crc32s(data, starts[first], ends[first + k]) % buckets)
        whose.append(owner[first])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(counts) + 1, np.int64), counts
    each, whose = np.concatenate(found), np.concatenate(whose)
    if len(found) > 1:
        order = np.argsort(whose, kind="stable")
        each, whose = each[order], whose[order]
    return each, np.searchsorted(whose, np.arange(len(counts) + 1)), counts


def bucket_counts(rows: DataFrame, text: str, runs: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in the whole table: a task sends its sums, so at most ``buckets`` rows come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in pieces(batch, 0, PIECE_BYTES):
                total += np.bincount(feature_buckets(part.column(0), runs, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = rows.select(F.col(text).cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(buckets, np.int64)
    for r in found:
        total[r["bucket"]] = r["n"]
    return total


def gains(own: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln(share in the target / share in the documents)), one added to each count."""
    s, t = own.astype(float), target.astype(float)
    return np.floor(scale * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, *, key: str, text: str, runs: int) -> DataFrame:
    """(key, n_words, n_features, weight) of each document: the floored mean of its features' gains."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in pieces(batch, 1, PIECE_BYTES):
                each, bounds, counts = feature_buckets(part.column(1), runs, len(table))
                total = np.concatenate([[0], np.cumsum(table[each])])
                n = np.diff(bounds)
                weight = np.where(n > 0, (total[bounds[1:]] - total[bounds[:-1]]) // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.array(n), pa.array(weight)], names=[key, "n_words", "n_features", "weight"])

    schema = rows.select(key).withColumns({c: F.lit(0).cast("long") for c in ("n_words", "n_features", "weight")}).schema
    return rows.mapInArrow(weigh, schema)


def noise(key, seed: int, scale: int = SCALE):
    """Gumbel noise, scaled and floored, of the first 32 bits of the key's digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def rank_offsets(histogram: dict[int, int], quota: int) -> list[tuple[int, int]]:
    """(score, rows above it) of the surviving scores, by suffix sums of the histogram; the last is the cutoff."""
    out, above = [], 0
    for score in sorted(histogram, reverse=True):
        if above >= quota:
            break
        out.append((score, above))
        above += histogram[score]
    return out


def ranked(scored: DataFrame, *, key: str, least_words: int, percent: int) -> DataFrame:
    """scored (key, n_words, n_features, weight, score; settled) and each drawn row's rank."""
    spark = scored.sparkSession
    enough = F.col("n_words") >= least_words
    histogram = {r["score"]: r["n"] for r in scored.where(enough).groupBy("score").agg(F.count("*").alias("n")).collect()}
    quota = percent * sum(histogram.values()) // 100
    offsets = rank_offsets(histogram, quota)
    nothing = F.lit(None).cast("long").alias("rank")
    if not offsets:
        return scored.select("*", nothing)
    cutoff = offsets[-1][0]
    alive = enough & (F.col("score") >= cutoff)
    same = scored.where(alive).groupBy(*scored.columns).agg(F.count("*").alias("_n"))
    above = F.broadcast(spark.createDataFrame(offsets, "score long, _above long"))  # one row a surviving score: bounded by the scores' range
    within = Window.partitionBy("score").orderBy(F.col(key).asc_nulls_first(), "n_features", "weight").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = same.join(above, "score").withColumn("_first", F.col("_above") + F.sum("_n").over(within) - F.col("_n"))
    runs = first.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(RUN).cast("long"))))
    each = runs.withColumn("_i", F.explode(F.sequence(F.col("_run"), F.least(F.col("_run") + RUN, F.col("_n")) - 1)))
    place = F.col("_first") + F.col("_i") + 1
    drawn = each.select(*scored.columns, F.when(place <= quota, place).alias("rank"))
    return drawn.unionByName(scored.where(~alive).select("*", nothing))


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    runs: int = 1,
    buckets: int = BUCKETS,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """Every document's key, n_words, n_features, weight, score and rank (null: not drawn), one row per row of docs."""
    gain = gains(bucket_counts(docs, text, runs, buckets), bucket_counts(target, target_text, runs, buckets))
    scored = weighted(docs, gain, key=key, text=text, runs=runs).withColumn("score", F.col("weight") + noise(F.col(key), seed))
    return ranked(cut_lineage(scored), key=key, least_words=least_words, percent=percent)
