"""Rank statistics and permutation inference.

Ranks over a whole table use one range-partitioned sort: a value's rank comes from counts of smaller values, so no window over
all rows meets in one task. The p-values are computed on the driver from a few numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinegrid.sources.state import settled


def _before(counts: DataFrame, c: str, keys: Sequence[str]) -> DataFrame:
    """Adds _b to (keys, c, _n): the sum of _n of the smaller values of c with the same keys.

    Ranges of (keys, c) are summed up inside and then between ranges, so a key with a third of all rows is spread over many tasks.
    """
    parts = settled(counts.repartitionByRange(*keys, c).withColumn("_p", F.spark_partition_id()))  # the range is a stored column from here on
    inside = Window.partitionBy(*keys, "_p").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    # one row per key and range that holds it
    between = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*keys, "_p").agg(F.sum("_n").alias("_t"))
    offsets = totals.select(*keys, "_p", F.coalesce(F.sum("_t").over(between), F.lit(0)).alias("_o"))
    own = parts.withColumn("_i", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return own.join(offsets, [*keys, "_p"]).withColumn("_b", F.col("_i") + F.col("_o")).drop("_p", "_i", "_o")


def places(df: DataFrame, c: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds _b: how many rows with the same keys have a smaller value of c. Rows with a null key or value drop."""
    counts = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(_before(counts, c, keys).select(*keys, c, "_b"), [*keys, c])


def medians(df: DataFrame, c: str, keys: Sequence[str], into: str) -> DataFrame:
    """(keys, into): exact medians, from counts of distinct values along a range sort: a key with a third of all rows is spread over many tasks. Keys without values have no row."""
    counts = settled(df.where(F.col(c).isNotNull()).groupBy(*keys, F.col(c).cast("double").alias(c)).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"))
    placed = _before(counts, c, keys).join(total, list(keys))
    holds = lambda at: (F.col("_b") <= at) & (at < F.col("_b") + F.col("_n"))
    value = lambda at: F.max(F.when(holds(at), F.col(c)))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    return placed.groupBy(*keys).agg(((value(low) + value(high)) / 2).alias(into))


def mid_ranks(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Adds r_<column>: average ranks from 1, within keys if given. Nulls have no rank; rows with a null key have none.

    Distinct values are counted first (map-side), summed up along a range sort of the distinct values, and joined back.
    """
    out = df
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_n"))
        ranks = _before(counts, c, keys).select(*keys, c, (F.col("_b") + (F.col("_n") + 1) / 2.0).alias(f"r_{c}"))
        out = out.join(ranks, [*keys, c], "left")
    return out


def guarded_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson's r; null instead of an error for a constant column."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, rho) for each pair of columns, a before b in order; rows with a null drop."""
    ranked = mid_ranks(df.dropna(subset=list(columns)), columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = ranked.agg(*[guarded_corr(f"r_{a}", f"r_{b}").alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("rho")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(rows))


def partial_rank_correlation(df: DataFrame, a: str, b: str, c: str) -> DataFrame:
    """One row: r of the ranks of a and b given those of c."""
    ranked = mid_ranks(df.dropna(subset=[a, b, c]), [a, b, c])
    r = ranked.agg(*[guarded_corr(f"r_{x}", f"r_{y}").alias(n) for n, x, y in (("ab", a, b), ("ac", a, c), ("bc", b, c))])
    rest = F.sqrt((1 - F.col("ac") * F.col("ac")) * (1 - F.col("bc") * F.col("bc")))
    return r.select(((F.col("ab") - F.col("ac") * F.col("bc")) / F.nullif(rest, F.lit(0.0))).alias("partial_r"))


def partial_spearman(df: DataFrame, a: str, b: str, c: str) -> tuple[float, float]:
    """Spearman's rho of the residuals of the ranks of a and b on those of c, and its p-value."""
    ranked = mid_ranks(df.dropna(subset=[a, b, c]), [a, b, c])
    fit = ranked.agg(*[f(F.col(f"r_{x}"), F.col(f"r_{c}")).alias(f"{n}{x}") for x in (a, b) for n, f in (("s_", F.regr_slope), ("i_", F.regr_intercept))]).first()
    res = ranked.select(*[F.round(F.col(f"r_{x}") - fit[f"s_{x}"] * F.col(f"r_{c}") - fit[f"i_{x}"], 9).alias(n) for x, n in ((a, "ea"), (b, "eb"))])
    both = mid_ranks(res, ["ea", "eb"]).agg(guarded_corr("r_ea", "r_eb").alias("r"), F.count(F.lit(1)).alias("n")).first()
    return both["r"], spearman_p(both["r"], both["n"])


def rank_biserial(df: DataFrame, value: str, group: str, keys: Sequence[str] = ()) -> DataFrame:
    """n1, n0, U and effect 2U / (n1 n0) - 1 of group 1 against group 0; effect is null for an empty group."""
    ranked = mid_ranks(df.where(F.col(value).isNotNull() & F.col(group).isNotNull()), [value], keys)
    one, r = F.col(group) == 1, F.col(f"r_{value}")
    out = ranked.groupBy(*keys).agg(F.count(F.when(one, 1)).alias("n1"), F.count(F.when(~one, 1)).alias("n0"), F.coalesce(F.sum(F.when(one, r)), F.lit(0.0)).alias("_s"))
    out = out.withColumn("u", F.col("_s") - F.col("n1") * (F.col("n1") + 1) / 2)
    return out.withColumn("effect", 2 * F.col("u") / F.nullif(F.col("n1") * F.col("n0"), F.lit(0)) - 1).drop("_s")


def condition_main_effect(df: DataFrame, value: str, group: str) -> dict[str, float | None]:
    """Mann-Whitney U, two-sided p, effect and both medians. Ties are corrected for from counts of values."""
    row = rank_biserial(df, value, group).first()
    ties = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).cast("double").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t"))).first()[0]
    medians = {r["g"]: r["m"] for r in df.groupBy(F.col(group).alias("g")).agg(F.median(value).alias("m")).collect()}  # two groups
    return {"u": row["u"], "p": mann_whitney_p(row["u"], row["n1"], row["n0"], ties or 0.0), "effect": row["effect"], "median_1": medians.get(1), "median_0": medians.get(0)}


def mann_whitney_p(u: float, n1: int, n0: int, ties: float = 0.0) -> float | None:
    """Two-sided: exact for a group of 8 or fewer without ties, else normal with tie and continuity corrections. ties: sum of t^3 - t."""
    if not n1 or not n0:
        return None
    if min(n1, n0) <= 8 and not ties:
        counts = np.zeros(n1 * n0 + 1)
        counts[0] = 1.0
        small, large = min(n1, n0), max(n1, n0)
        for k in range(1, small + 1):  # coefficients of the Gaussian binomial, by multiplication and division
            for i in range(n1 * n0, large + k - 1, -1):
                counts[i] -= counts[i - large - k]
            for i in range(k, n1 * n0 + 1):
                counts[i] += counts[i - k]
        tail = counts[int(math.ceil(max(u, n1 * n0 - u))) :].sum() / math.comb(n1 + n0, n1)
        return min(1.0, 2 * float(tail))
    n = n1 + n0
    variance = n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1)))
    if variance <= 0:
        return 1.0
    z = (abs(u - n1 * n0 / 2) - 0.5) / math.sqrt(variance)
    return min(1.0, math.erfc(z / math.sqrt(2)))


def _beta_fraction(x: float, a: float, b: float) -> float:
    """The continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(1 - x, b, a) / b


def spearman_p(r: float | None, n: int) -> float | None:
    """Two-sided, from Student's t with n - 2 degrees of freedom."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return incomplete_beta((n - 2) / (n - 2 + t2), (n - 2) / 2, 0.5)


#: Rounds of a shuffle: each swaps a row's place with its mirror image or not, by a hash bit; 6 log2 n mix n places well.
SHUFFLE_ROUNDS = 6


def numbered(df: DataFrame, columns: Sequence[str], into: str = "_at") -> tuple[DataFrame, int]:
    """The rows of the columns numbered from 0 in their order, and how many they are. Equal rows are numbered in any order."""
    # equal rows are counted once and laid out again, so a hot row is a count and not a range of its own
    counts = df.select(*columns).dropna().groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    keyed = counts.withColumn("_key", F.struct(*columns))
    placed = settled(_before(keyed, "_key", ()).drop("_key"))
    n = placed.agg(F.sum("_n")).first()[0] or 0
    return placed.withColumn(into, F.explode(F.sequence(F.col("_b"), F.col("_b") + F.col("_n") - 1))).drop("_b", "_n"), n


def shuffled_place(at: Column, replicate: Column, n: int, seed: int) -> Column:
    """The place of row ``at`` in a random order of 0 to n - 1: a keyed bijection (swap or not), so no replicate is sorted."""
    rounds = F.sequence(F.lit(1), F.lit(SHUFFLE_ROUNDS * max(1, (n - 1).bit_length())))

    def swap(x: Column, k: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(seed), replicate, k), F.lit(n)) - x, F.lit(n))
        return F.when(F.xxhash64(F.lit(seed + 1), replicate, k, F.greatest(x, mirror)) % 2 == 0, x).otherwise(mirror)

    return F.aggregate(rounds, at.cast("long"), swap)


def _with_replicates(rows: DataFrame, n_perm: int) -> DataFrame:
    """Each row under every replicate; 0 is the observed order."""
    return rows.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(n_perm))))


def _against_null(values: DataFrame) -> dict[str, float]:
    """observed (replicate 0) and the share of defined replicates that are as far from 0. values: (_r, v)."""
    observed = values.where("_r = 0").select(F.first("v").alias("o"))
    hit = F.avg(F.when(F.col("_r") > 0, (F.abs("v") >= F.abs("o") - 1e-12).cast("double")))
    one = values.join(F.broadcast(observed)).where("v is not null").agg(F.first(F.col("o")).alias("o"), hit.alias("p")).first()  # a side of one row
    return {"observed": one["o"], "p": one["p"]}


def _partial(ab: Column, ac: Column, bc: Column) -> Column:
    rest = F.sqrt((1 - ac * ac) * (1 - bc * bc))
    return (ab - ac * bc) / F.nullif(rest, F.lit(0.0))


#: A table of so many rows at most is broadcast and its replicates are dealt to the tasks; the replicates of a larger one are rows.
TASK_ROWS = 200_000


def _held(df: DataFrame, columns: Sequence[str]) -> np.ndarray | None:
    """The rows of the columns without nulls, a line a column, in their order; None if they are too many to be broadcast."""
    rows = settled(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna())
    if rows.limit(TASK_ROWS + 1).count() > TASK_ROWS:
        return None
    found = rows.toPandas().to_numpy(float).T
    return found[:, np.lexsort(found[::-1])]


def _replicates(df: DataFrame, n: int, n_perm: int, seed: int, value: Callable[[np.ndarray], float]) -> DataFrame:
    """(_r, v): ``value`` of n places in their order (0) and in ``n_perm`` random orders, which do not depend on the tasks; null if it is not a number."""
    spark = df.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            orders = (np.random.Generator(np.random.Philox(key=[seed, r])).permutation(n) if r else np.arange(n) for r in batch["id"].tolist())
            with np.errstate(invalid="ignore", divide="ignore"):
                yield pd.DataFrame({"_r": batch["id"], "v": [value(order) for order in orders]})

    found = spark.range(0, n_perm + 1, 1, int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(run, "_r long, v double")
    return settled(found.select("_r", F.when(~F.isnan("v"), F.col("v")).alias("v")))


class _Ranked:
    """Average ranks of some of a column's rows, less their mean, from counts of its values."""

    def __init__(self, column: np.ndarray):
        self.code = np.unique(column, return_inverse=True)[1]
        self.values = int(self.code.max(initial=-1)) + 1

    def of(self, rows: np.ndarray) -> np.ndarray:
        code = self.code[rows]
        counts = np.bincount(code, minlength=self.values)
        return (np.cumsum(counts) - (counts - 1) / 2)[code] - (len(rows) + 1) / 2


def _r(a: np.ndarray, b: np.ndarray) -> float:
    return (a @ b) / np.sqrt((a @ a) * (b @ b))


def _partial_r(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    ab, ac, bc = _r(a, b), _r(a, c), _r(b, c)
    rest = np.sqrt((1 - ac * ac) * (1 - bc * bc))
    return (ab - ac * bc) / rest if rest else math.nan


def perm_partial_p(df: DataFrame, a: str, b: str, c: str, n_perm: int = 10_000, seed: int = 0) -> dict[str, float]:
    """Two-sided p of the partial rank correlation of a and b given c; b is shuffled. Results do not depend on the partitions.

    Shuffling keeps the ranks, so each replicate is one sum of products over the rows and their shuffled places.
    """
    held = _held(df, [a, b, c])
    if held is not None:
        n = held.shape[1]
        x, y, z = (_Ranked(v).of(np.arange(n)) for v in held)
        return _against_null(_replicates(df, n, n_perm, seed, lambda order: _partial_r(x, y[order], z)))
    ranked = mid_ranks(df.select(a, b, c).dropna(), [a, b, c]).select(*[F.col(f"r_{x}").alias(n) for x, n in ((a, "x"), (b, "y"), (c, "z"))])
    rows, n = numbered(ranked, ["x", "y", "z"])
    place = F.when(F.col("_r") == 0, F.col("_at")).otherwise(shuffled_place(F.col("_at"), F.col("_r"), max(n, 1), seed))
    moved = _with_replicates(rows.select("_at", "y"), n_perm).select("_r", "y", place.alias("_at")).persist(StorageLevel.DISK_ONLY)  # places are drawn once
    sums = moved.join(rows.select("_at", "x", "z"), "_at").groupBy("_r")
    r = sums.agg(guarded_corr("x", "y").alias("ab"), guarded_corr("x", "z").alias("ac"), guarded_corr("y", "z").alias("bc"))
    out = _against_null(r.select("_r", _partial(F.col("ab"), F.col("ac"), F.col("bc")).alias("v")))
    moved.unpersist()
    return out


def _labelled(df: DataFrame, columns: Sequence[str], condition: str, n_perm: int, seed: int) -> DataFrame:
    """(columns, _r, _g): every row under each replicate with a shuffled condition; as many 1 as there are. Other conditions drop."""
    g = F.col(condition).cast("int").alias("_g")
    rows, n = numbered(df.where(F.col(condition).isin(0, 1)).select(*columns, g), [*columns, "_g"])
    ones = rows.where("_g = 1").count()
    drawn = (shuffled_place(F.col("_at"), F.col("_r"), max(n, 1), seed) < ones).cast("int")
    # each replicate's conditions are drawn once and read by every column's ranks
    return _with_replicates(rows, n_perm).withColumn("_g", F.when(F.col("_r") == 0, F.col("_g")).otherwise(drawn)).drop("_at").persist(StorageLevel.DISK_ONLY)


def _difference(by_group: DataFrame) -> dict[str, float]:
    """Replicates' values of condition 1 less those of 0, held against the observed one. by_group: (_r, _g, v)."""
    of = lambda g: F.max(F.when(F.col("_g") == g, F.col("v")))
    return _against_null(by_group.groupBy("_r").agg((of(1) - of(0)).alias("v")))


def perm_diff_partial(df: DataFrame, a: str, b: str, c: str, condition: str, n_perm: int = 10_000, seed: int = 0) -> dict[str, float]:
    """Difference of the partial rank correlation between conditions 1 and 0; conditions are shuffled, ranks are taken within each."""
    held = _held(df.where(F.col(condition).isin(0, 1)), [a, b, c, condition])
    if held is not None:
        columns, g = [_Ranked(v) for v in held[:3]], held[3] == 1
        inside = lambda rows: _partial_r(*(v.of(rows) for v in columns))
        return _against_null(_replicates(df, len(g), n_perm, seed, lambda order: inside(np.flatnonzero(g[order])) - inside(np.flatnonzero(~g[order]))))
    keys = ["_r", "_g"]
    rows = _labelled(df, [a, b, c], condition, n_perm, seed)
    ranked = mid_ranks(rows, [a, b, c], keys)
    r = ranked.groupBy(*keys).agg(*[guarded_corr(f"r_{x}", f"r_{y}").alias(n) for n, x, y in (("ab", a, b), ("ac", a, c), ("bc", b, c))])
    out = _difference(r.select(*keys, _partial(F.col("ab"), F.col("ac"), F.col("bc")).alias("v")))
    rows.unpersist()
    return out


def perm_diff_biserial(df: DataFrame, value: str, error: str, condition: str, n_perm: int = 10_000, seed: int = 0) -> dict[str, float]:
    """Difference of the rank-biserial effect of correct against wrong between conditions 1 and 0; conditions are shuffled."""
    held = _held(df.where(F.col(condition).isin(0, 1)), [value, error, condition])
    if held is not None:
        values, right, g = _Ranked(held[0]), np.trunc(held[1]) == 0, held[2] == 1

        def inside(rows: np.ndarray) -> float:
            n1 = right[rows].sum()
            u = (values.of(rows)[right[rows]] + (len(rows) + 1) / 2).sum() - n1 * (n1 + 1) / 2
            return 2 * u / (n1 * (len(rows) - n1)) - 1 if 0 < n1 < len(rows) else math.nan

        return _against_null(_replicates(df, len(g), n_perm, seed, lambda order: inside(np.flatnonzero(g[order])) - inside(np.flatnonzero(~g[order]))))
    rows = _labelled(df, [value, error], condition, n_perm, seed)
    effects = rank_biserial(rows.withColumn("_right", 1 - F.col(error).cast("int")), value, "_right", ["_r", "_g"])
    out = _difference(effects.select("_r", "_g", F.col("effect").alias("v")))
    rows.unpersist()
    return out


#: Keys whose replicates a task adds up before it sends them.
HELD_KEYS = 1000


def bootstrap_mean_ci(df: DataFrame, value: str, keys: Sequence[str], n_boot: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(keys, mean, low, high): percentile interval of Poisson-bootstrap means.

    Equal values of a key are counted first; a value met n times gets a Poisson number of mean n in each replicate, drawn from a generator that is seeded by
    the key and the value. So rows need no identity, each is drawn by itself, and an interval does not depend on how the rows are dealt. A task adds up
    its values and sends one row per key and replicate.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("_key") if keys else F.lit("").alias("_key"), "_v", "_n", F.xxhash64(F.lit(seed), *keys, "_v").alias("_id"))

    def draw(batches):
        held: dict[str, np.ndarray] = {}

        def sent() -> pd.DataFrame:
            names = list(held)
            return pd.DataFrame({"_key": np.repeat(names, n_boot), "_r": np.tile(np.arange(n_boot), len(names)), "_w": np.concatenate([held[k][0] for k in names] or [[]]), "_s": np.concatenate([held[k][1] for k in names] or [[]])})

        for batch in batches:
            for k, v, n, i in zip(batch["_key"], batch["_v"], batch["_n"], batch["_id"], strict=True):
                weight = np.random.Generator(np.random.Philox(key=int(i) & (2**64 - 1))).poisson(n, n_boot)
                total = held.setdefault(k, np.zeros((2, n_boot)))
                total[0] += weight
                total[1] += weight * v
            if len(held) > HELD_KEYS:
                yield sent()
                held.clear()
        if held:
            yield sent()

    sums = rows.mapInPandas(draw, "_key string, _r long, _w double, _s double").groupBy("_key", "_r").agg((F.sum("_s") / F.nullif(F.sum("_w"), F.lit(0.0))).alias("_m"))
    tail = (1 - level) / 2
    ci = sums.groupBy("_key").agg(F.percentile("_m", F.lit(tail)).alias("low"), F.percentile("_m", F.lit(1 - tail)).alias("high"))
    means = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    named = means.withColumn("_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit(""))
    return named.join(ci, "_key").drop("_key")
