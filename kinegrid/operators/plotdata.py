"""The tables behind figures: view transforms, panels, bands, limits, histograms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class View:
    """A rotation by quarter turns, then flips."""

    turns: int = 0
    flip_x: bool = False
    flip_y: bool = False

    def matrix(self) -> tuple[float, float, float, float]:
        a, b, c, d = ((1, 0, 0, 1), (0, -1, 1, 0), (-1, 0, 0, -1), (0, 1, -1, 0))[self.turns % 4]
        sx, sy = -1 if self.flip_x else 1, -1 if self.flip_y else 1
        return sx * a, sx * b, sy * c, sy * d

    def apply(self, df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
        """Adds u, v."""
        a, b, c, d = self.matrix()
        return df.withColumns({"u": a * F.col(x) + b * F.col(y), "v": c * F.col(x) + d * F.col(y)})


#: Named views; "paper" takes (x, y) to (y, x).
VIEWS = {"raw": View(), "paper": View(turns=3, flip_y=True)}


def panels(trials: DataFrame, per_panel: int, order: Sequence[str] = ("session_id", "idx"), within: Sequence[str] = ("session_id",)) -> DataFrame:
    """Adds ``panel``: consecutive slices of ``per_panel`` trials in each session."""
    w = Window.partitionBy(*within).orderBy(*order)
    return trials.withColumn("panel", F.floor((F.row_number().over(w) - 1) / per_panel).cast("long"))


def band(values: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """(by, mean, sem, low, high, n): mean and population deviation over the root of the number of values."""
    g = values.where(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n"))
    return g.withColumns({"low": F.col("mean") - F.col("sem"), "high": F.col("mean") + F.col("sem")})


def equal_limits(samples: DataFrame, by: Sequence[str] = (), margin: float = 0.05) -> DataFrame:
    """Limits of equal width on both axes around all samples of a group."""
    g = samples.groupBy(*by).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    half = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) * (0.5 + margin)
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return g.select(*by, (mx - half).alias("x_low"), (mx + half).alias("x_high"), (my - half).alias("y_low"), (my + half).alias("y_high"))


def shared_limit(samples: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """1.1 times the greatest absolute value."""
    return samples.groupBy(*by).agg((1.1 * F.max(F.abs(value))).alias("limit"))


def histogram(df: DataFrame, value: str, bins: int = 25) -> DataFrame:
    """(bin, n) of equal widths between the extremes; the last bin is closed. Absent bins are not listed."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    rows = df.where(F.col(value).isNotNull()).select(value).join(F.broadcast(ends))
    width = F.nullif((F.col("_hi") - F.col("_lo")), F.lit(0.0))
    at = F.least(F.floor(F.coalesce((F.col(value) - F.col("_lo")) * bins / width, F.lit(0.0))), F.lit(bins - 1)).cast("long")
    return rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, value: str, points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, q<place>): percentiles with linear interpolation, such as terciles (1/3, 2/3) or display limits (0.01, 0.99)."""
    each = F.percentile(value, F.array(*[F.lit(p) for p in points]))
    return df.groupBy(*by).agg(each.alias("_q")).select(*by, *[F.get("_q", i).alias(f"q{i}") for i in range(len(points))])


def extreme_trials(table: DataFrame, measure: str, by: Sequence[str] = (), key: str = "idx") -> DataFrame:
    """(by, least, greatest): keys of the trials with the least and the greatest measure, the first one of equals; nulls take no part."""
    rows = table.where(F.col(measure).isNotNull())
    return rows.groupBy(*by).agg(
        F.min_by(key, F.struct(measure, key)).alias("least"), F.max_by(key, F.struct(F.col(measure).alias("v"), (-F.col(key)).alias("k"))).alias("greatest")
    )


def select_trials(table: DataFrame, wanted: Sequence[int], key: str = "idx") -> DataFrame:
    """The named trials in the asked order (column ``place``); absent ones are left out."""
    order = table.sparkSession.createDataFrame([(int(k), i) for i, k in enumerate(wanted)], "_k long, place int")
    return table.join(F.broadcast(order), table[key] == order["_k"]).drop("_k").orderBy("place")


def padded(paths: DataFrame, key: Sequence[str], columns: Sequence[str] = ("x", "y")) -> DataFrame:
    """Arrays of all rows filled with nulls up to the longest one's length."""
    longest = paths.agg(F.coalesce(F.max(F.size(columns[0])), F.lit(0)).alias("_n"))
    rows = paths.join(F.broadcast(longest))
    fill = lambda c: F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.get(c, (i - 1).cast("int")))
    return rows.select(*key, "_n", *[F.when(F.col("_n") > 0, fill(c)).otherwise(F.col(c)).alias(c) for c in columns]).withColumnRenamed("_n", "length")


def local_trend(df: DataFrame, x: str, y: str, *, fraction: float = 2 / 3, n_points: int = 25) -> DataFrame:
    """(k, x, n, y): local linear fits of y at equal steps of x, with tricube weights over the nearest ``fraction`` of the rows.

    The reach of each point is a rank of distances (exact up to 10,000 distinct ones, within a ten-thousandth of the rows beyond), its fit one
    aggregate of weighted sums. Rows with nulls drop; one value of x gives one fit, the mean.
    """
    rows = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    ends = rows.agg(F.min("_x").alias("a"), F.max("_x").alias("b")).where("a is not null")
    at = F.col("a") + (F.col("b") - F.col("a")) * F.col("k") / F.lit(float(max(n_points - 1, 1)))
    points = ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1)))).select("k", at.alias("x")).dropDuplicates(["x"])
    spread = rows.join(F.broadcast(points)).select("k", "x", (F.col("_x") - F.col("x")).alias("u"), "_y")  # n_points rows
    reach = spread.groupBy("k").agg(F.percentile_approx(F.abs("u"), F.lit(fraction), F.lit(10_000)).alias("h"))
    near = F.when(F.col("h") > 0, F.pow(1 - F.pow(F.least(F.abs("u") / F.nullif("h", F.lit(0.0)), F.lit(1.0)), 3), 3)).otherwise((F.col("u") == 0).cast("double"))
    w, u, v = F.col("w"), F.col("u"), F.col("_y")
    sums = spread.join(F.broadcast(reach), "k").withColumn("w", near).groupBy("k", "x").agg(
        F.count(F.when(w > 0, 1)).alias("n"), F.sum(w).alias("s"), F.sum(w * u).alias("su"), F.sum(w * u * u).alias("suu"), F.sum(w * v).alias("sv"), F.sum(w * u * v).alias("suv")
    )
    det = F.col("s") * F.col("suu") - F.col("su") * F.col("su")
    line = (F.col("sv") * F.col("suu") - F.col("su") * F.col("suv")) / F.nullif(det, F.lit(0.0))
    return sums.select("k", "x", "n", F.when(det > 1e-9 * F.col("s") * F.col("s"), line).otherwise(F.col("sv") / F.nullif("s", F.lit(0.0))).alias("y"))


def event_lock_means(packed: DataFrame, columns: Sequence[str], by: Sequence[str] = ("event",)) -> DataFrame:
    """(by, k, n, mean_<column>): the mean of each packed curve column at each place, for a comparison of event locks."""
    rows = packed.select(*by, F.posexplode(F.arrays_zip(*columns)).alias("k", "v"))
    return rows.groupBy(*by, F.col("k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("v")[c]).alias(f"mean_{c}") for c in columns])


def velocity_profiles(samples: DataFrame, marks: DataFrame, value: str = "lin_vel", keys: Sequence[str] = ("session_id", "idx")) -> DataFrame:
    """(keys, k, value, is_peak, is_rest): each profile with its peak and rest marked. marks: ``curves.figure_trials``; a profile without a peak has none marked."""
    rows = samples.join(marks.select(*keys, "lmax_idx", "localmin"), list(keys), "left")
    mark = lambda c: F.coalesce(F.col("k") == F.col(c), F.lit(False))
    return rows.select(*keys, "k", value, mark("lmax_idx").alias("is_peak"), mark("localmin").alias("is_rest"))


def trial_panel(windows: DataFrame, series: DataFrame, ports: DataFrame, signals: Sequence[str] = ("x", "y", "lin_vel")) -> DataFrame:
    """(session_id, idx, k, t_choice, signals, d_left, d_right): what a figure of single trials draws: each frame of a trial's window, its place from the choice, its signals and its distances to both ports."""
    from kinegrid.operators.align import trial_samples

    rows = trial_samples(windows, series, ("session_id", "idx", "ch")).join(ports, "session_id", "left")
    to = lambda side: F.sqrt((F.col("x") - F.col(f"{side}_x")) ** 2 + (F.col("y") - F.col(f"{side}_y")) ** 2).alias(f"d_{side}")
    return rows.select("session_id", "idx", "k", (F.col("frame") - F.col("ch")).alias("t_choice"), *signals, to("left"), to("right"))
