"""Port geometry and the scalar measures of trials.

Samples are rows (session_id, idx, k, x, y, ...), k counted from center exit to choice entry, inclusive. Everything is a window or an
aggregate keyed by the trial; ports and axes are one row per session, joined by session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinegrid.config import RIG
from kinegrid.functions.expr import by, packed, whole

TRIAL = ("session_id", "idx")
#: Half kernels of a Gaussian of the given sigma, from the middle on (radius int(4 sigma + 0.5)).
GAUSS = {
    1.5: (0.26596426, 0.21296753, 0.10934117, 0.03599435, 0.0075974, 0.0010282, 0.0000892),
    1.0: (0.39894347, 0.24197145, 0.05399113, 0.00443186, 0.00013383),
}


def locate_ports(trials: DataFrame, series: DataFrame) -> DataFrame:
    """One row per session: medians of the position at center entry (all trials) and at choice entry, by the chosen side. A side without trials is null."""
    at = lambda c, p: series.select("session_id", F.col("frame").alias(c), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"))
    both = trials.join(at("ce", "c"), ["session_id", "ce"]).join(at("ch", "h"), ["session_id", "ch"])
    side = lambda c, s: F.median(F.when(F.col("choice") == s, F.col(c)))
    return both.groupBy("session_id").agg(
        F.median("cx").alias("center_x"), F.median("cy").alias("center_y"),
        side("hx", 0).alias("left_x"), side("hy", 0).alias("left_y"), side("hx", 1).alias("right_x"), side("hy", 1).alias("right_y"),
    )


def ports_array(ports: DataFrame) -> DataFrame:
    """Adds ``ports``: the present ones of center, left and right, in this order."""
    each = [F.when(F.col(f"{p}_x").isNotNull(), F.struct(F.col(f"{p}_x").alias("x"), F.col(f"{p}_y").alias("y"))) for p in ("center", "left", "right")]
    return ports.withColumn("ports", F.filter(F.array(*each), lambda p: p.isNotNull()))


def decision_axis(ports: DataFrame, spacing_cm: float = RIG.port_spacing_cm, strict: bool = False) -> DataFrame:
    """Unit axis from left to right, both sides' distances along it, and cm per pixel.

    Sessions whose choice ports coincide or are missing drop; with ``strict`` coincident ports raise.
    """
    dx, dy = F.col("right_x") - F.col("left_x"), F.col("right_y") - F.col("left_y")
    rows = ports.withColumn("span", F.sqrt(dx * dx + dy * dy)).where("span is not null")
    if strict:
        rows = rows.withColumn("span", F.when(F.col("span") == 0, F.raise_error(F.lit("choice ports coincide")).cast("double")).otherwise(F.col("span")))
    rows = rows.where("span > 0").withColumn("ux", dx / F.col("span")).withColumn("uy", dy / F.col("span"))
    along = lambda p: (F.col(f"{p}_x") - F.col("center_x")) * F.col("ux") + (F.col(f"{p}_y") - F.col("center_y")) * F.col("uy")
    return rows.select("session_id", "center_x", "center_y", "ux", "uy", along("right").alias("d_right"), along("left").alias("d_left"), (2 * spacing_cm / F.col("span")).alias("scale"))


def movement_samples(trials: DataFrame, series: DataFrame, least: int = 4) -> DataFrame:
    """Samples of each measurable trial: entry at frame 1 or later, choice after it and inside, ``least`` samples or more."""
    ok = trials.where((F.col("ce") >= 1) & (F.col("ch") > F.col("ce")) & (F.col("ch") - F.col("ce") + 1 >= least))
    frames = ok.withColumn("frame", F.explode(F.sequence("ce", "ch")))
    signals = series.select("session_id", "frame", *[c for c in series.columns if c in ("x", "y", "lin_vel", "ang_vel", "head_angle")])
    rows = frames.join(signals, ["session_id", "frame"]).withColumn("k", F.col("frame") - F.col("ce")).withColumn("m", F.col("ch") - F.col("ce") + 1)
    held = F.count(F.lit(1)).over(whole(*TRIAL))
    return rows.withColumn("_held", held).where("_held = m").drop("_held")


def smooth(samples: DataFrame, columns: Sequence[str] = ("x", "y"), sigma: float = 1.5, keys: Sequence[str] = TRIAL) -> DataFrame:
    """Gaussian filter along k, mirrored at both ends (half-sample symmetric). Needs m, the number of samples; fewer than 3 stay as they are.

    A trial's samples are packed once, filtered as arrays and unpacked again: m rows cost m times the taps, and no row carries an array.
    """
    half = GAUSS[sigma]
    radius, n = len(half) - 1, F.col("m")
    others = [c for c in samples.columns if c not in (*keys, "k", "m", *columns)]
    one = samples.groupBy(*keys).agg(F.first("m").alias("m"), *[packed(c).alias(f"_{c}") for c in columns], F.sort_array(F.collect_list(F.struct("k", *others))).alias("_rest"))

    def filtered(array: str) -> Column:
        def tap(i: Column, o: int) -> Column:
            p = F.pmod(i + o, 2 * n)
            return half[abs(o)] * F.get(array, F.when(p >= n, 2 * n - 1 - p).otherwise(p).cast("int"))

        at = lambda x, i: F.when(n >= 3, sum((tap(i, o) for o in range(-radius, radius + 1)), F.lit(0.0))).otherwise(x)
        return F.transform(array, at)

    zipped = F.arrays_zip(*[F.col(f"_s_{c}") for c in columns], "_rest")
    rows = one.select(*keys, "m", "_rest", *[filtered(f"_{c}").alias(f"_s_{c}") for c in columns]).select(*keys, "m", F.explode(zipped).alias("_r"))
    found = {c: F.col(f"_r._s_{c}") for c in columns} | {c: F.col(f"_r._rest.{c}") for c in ("k", *others)}
    return rows.select(*[found.get(c, F.col(c)).alias(c) for c in samples.columns])


def node_samples(trials: DataFrame, nodes: DataFrame, node: str, least: int = 4) -> DataFrame:
    """Samples of one tracked node's path in each measurable trial; nodes: (session_id, frame, node, x, y). A node that is not there gives no rows."""
    return movement_samples(trials, nodes.where(F.col("node") == node).select("session_id", "frame", "x", "y"), least)


def arc_length(samples: DataFrame, keys: Sequence[str] = TRIAL) -> DataFrame:
    """Adds ``arc``: cumulative step length from 0."""
    w = by(*keys, order="k")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    rows = samples.withColumn("_step", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)))
    return rows.withColumn("arc", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def path_measures(samples: DataFrame, axis: DataFrame, keys: Sequence[str] = TRIAL) -> DataFrame:
    """Per trial: length in cm and relative to the chosen side's distance, displacement, tortuosity (null without displacement)."""
    rows = arc_length(samples, keys).groupBy(*keys, "choice").agg(
        F.max("arc").alias("total"), F.max_by(F.struct("x", "y"), "k").alias("b"), F.min_by(F.struct("x", "y"), "k").alias("a")
    )
    rows = rows.join(axis, "session_id").withColumn("disp", F.sqrt((F.col("b.x") - F.col("a.x")) ** 2 + (F.col("b.y") - F.col("a.y")) ** 2))
    d = F.nullif(F.abs(F.when(F.col("choice") == 1, F.col("d_right")).otherwise(F.col("d_left"))), F.lit(0.0))
    return rows.select(
        *keys, (F.col("total") * F.col("scale")).alias("path_len_cm"), (F.col("total") / d).alias("path_len_norm"),
        (F.col("total") / F.nullif("disp", F.lit(0.0))).alias("tortuosity"),
    )


def projected(samples: DataFrame, axis: DataFrame) -> DataFrame:
    """Adds ``along`` (toward the chosen side, from the center), d_chosen, scale and the side ``s``."""
    rows = samples.join(axis, "session_id").withColumn("s", F.when(F.col("choice") == 1, 1.0).otherwise(-1.0))
    p = (F.col("x") - F.col("center_x")) * F.col("ux") + (F.col("y") - F.col("center_y")) * F.col("uy")
    rows = rows.withColumn("along", F.col("s") * p)
    return rows.withColumn("d_chosen", F.abs(F.when(F.col("choice") == 1, F.col("d_right")).otherwise(F.col("d_left"))))


def landmark_measures(samples: DataFrame, axis: DataFrame, *, fps: float = RIG.framerate, keys: Sequence[str] = TRIAL) -> DataFrame:
    """Per trial: greatest excursion to the unchosen side (first of equals), commitment, and the landmark at a fifth of the way."""
    rows = projected(arc_length(samples, keys), axis)
    rows = rows.withColumn("total", F.max("arc").over(whole(*keys)))
    k, away = F.col("k"), -F.col("along")
    out = rows.groupBy(*keys).agg(
        F.max(away).alias("dev"), F.max_by(k, F.struct(away.alias("v"), (-k).alias("k"))).alias("i_dev"), F.max("k").alias("last"),
        F.min(F.when(F.col("along") >= 0.5 * F.col("d_chosen"), k)).alias("commit"), F.min(F.when(F.col("arc") >= 0.2 * F.col("total"), k)).alias("i_land"),
        F.first("scale").alias("scale"), F.first("d_chosen").alias("d_chosen"),
    )
    return out.select(
        *keys, (F.col("dev") * F.col("scale")).alias("dev_unchosen_cm"), (F.col("dev") / F.nullif("d_chosen", F.lit(0.0))).alias("dev_unchosen_norm"), "i_dev",
        (F.col("i_dev") / fps).alias("t_dev"), (F.coalesce("commit", "last") / fps).alias("t_commit"), F.coalesce("i_land", "last").alias("i_land"),
    )


def velocity_measures(samples: DataFrame, series: DataFrame, *, fps: float = RIG.framerate, keys: Sequence[str] = TRIAL) -> DataFrame:
    """Per trial: peak speed (first of equals), its time, the signed angular velocity that is strongest within 0.12 s of it, speed at the choice."""
    k = F.col("k")
    peaks = samples.groupBy(*keys).agg(
        F.max("lin_vel").alias("peak_lin_vel"), F.max_by(k, F.struct(F.col("lin_vel").alias("v"), (-k).alias("k"))).alias("i_peak"),
        F.max_by("lin_vel", k).alias("vel_choice"), F.max(k).alias("last"), F.first("ce").alias("ce"), F.first("w_start").alias("w_start"), F.first("w_end").alias("w_end"),
    )
    return peaks.join(_turn_at_peak(peaks, series, fps), list(keys)).select(
        *keys, "peak_lin_vel", (F.col("i_peak") / fps).alias("t_peak_lin_vel"), "peak_ang_vel", "ang_peak_lag", "vel_choice", (F.col("last") / fps).alias("t_choice"),
    )


LABELS = ("session_id", "idx", "absolute_trial", "session", "subject", "target", "choice", "trial_type", "error")


#: Label and behaviour columns that a measure table takes from the trials, where they are there.
CARRIED = ("subject", "session", "absolute_trial", "target", "choice", "trial_type", "error", "cue", "sampling", "rt")


def smoothed_path(path: Column, sigma: float = 1.5) -> Column:
    """Total length, and displacement from first to last point, of an array of (x, y) after ``smooth``."""
    half = GAUSS[sigma]
    radius, n = len(half) - 1, F.size(path)

    def point(i: Column) -> Column:
        def tap(o: int) -> Column:
            p = F.pmod(i + o, 2 * n)
            return F.get(path, F.when(p >= n, 2 * n - 1 - p).otherwise(p).cast("int"))

        taps = F.array(*[F.struct(F.lit(half[abs(o)]).alias("w"), tap(o).alias("p")) for o in range(-radius, radius + 1)])
        total = lambda c: F.aggregate(taps, F.lit(0.0), lambda acc, t: acc + t["w"] * t["p"][c])
        return F.when(n >= 3, F.struct(total("x").alias("x"), total("y").alias("y"))).otherwise(F.get(path, i))

    step = lambda u, v: F.sqrt((v["x"] - u["x"]) ** 2 + (v["y"] - u["y"]) ** 2)
    start = lambda q: F.struct(F.lit(0.0).alias("total"), F.get(q, 0).alias("at"))
    measure = lambda q: F.aggregate(
        q, start(q), lambda acc, v: F.struct((acc["total"] + step(acc["at"], v)).alias("total"), v.alias("at")), lambda acc: F.struct(acc["total"].alias("total"), step(F.get(q, 0), acc["at"]).alias("disp"))
    )
    return F.get(F.transform(F.array(F.transform(F.sequence(F.lit(0), n - 1), point)), measure), 0)


def build_measure_table(trials: DataFrame, series: DataFrame, axis: DataFrame, *, sigma: float = 1.5, fps: float = RIG.framerate) -> DataFrame:
    """One row per measurable trial: labels and all scalar measures. Trials that cannot be measured drop (see ``exclusions``).

    All but the turn around the speed peak come from one pass over the samples and one aggregate by trial. Measures of heading or angular velocity
    are there if ``series`` has head_angle or ang_vel; w_start and w_end (the trial's window) default to the movement.
    """
    names = set(trials.columns)
    carried = [c for c in CARRIED if c in names]
    bounds = {"w_start": F.col("w_start") if "w_start" in names else F.col("ce"), "w_end": F.col("w_end") if "w_end" in names else F.col("ch") + 1}
    rows = projected(arc_length(movement_samples(trials.withColumns(bounds), series)), axis).withColumn("total", F.max("arc").over(whole(*TRIAL)))
    k, away = F.col("k"), -F.col("along")
    first_max = lambda v: F.max_by(k, F.struct(v.alias("v"), (-k).alias("k")))
    heading = "head_angle" in series.columns
    one = rows.groupBy(*TRIAL).agg(
        *[F.first(c).alias(c) for c in [*carried, "ce", "w_start", "w_end", "s", "ux", "uy", "scale"]], F.first("d_chosen").alias("d"), F.max(k).alias("last"),
        F.transform(F.sort_array(F.collect_list(F.struct("k", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("path"),
        F.max(away).alias("dev"), first_max(away).alias("i_dev"), F.min(F.when(F.col("along") >= 0.5 * F.col("d_chosen"), k)).alias("commit"),
        *([F.min_by("head_angle", F.when(F.col("arc") >= 0.2 * F.col("total"), k)).alias("head")] if heading else []),
        F.max("lin_vel").alias("peak_lin_vel"), first_max(F.col("lin_vel")).alias("i_peak"), F.max_by("lin_vel", k).alias("vel_choice"),
    )
    d = F.nullif("d", F.lit(0.0))
    out = one.withColumn("smoothed", smoothed_path(F.col("path"), sigma)).select(
        *TRIAL, *carried, "ce", "w_start", "w_end", "i_peak", "vel_choice", "peak_lin_vel", (F.col("i_peak") / fps).alias("t_peak_lin_vel"), (F.col("last") / fps).alias("t_choice"),
        (F.coalesce("commit", "last") / fps).alias("t_commit"), (F.col("dev") * F.col("scale")).alias("dev_unchosen_cm"), (F.col("dev") / d).alias("dev_unchosen_norm"),
        "i_dev", (F.col("i_dev") / fps).alias("t_dev"), *([(F.col("s") * (F.cos("head") * F.col("ux") + F.sin("head") * F.col("uy"))).alias("head_to_chosen")] if heading else []),
        (F.col("smoothed.total") / F.nullif("smoothed.disp", F.lit(0.0))).alias("tortuosity"), (F.col("smoothed.total") * F.col("scale")).alias("path_len_cm"), (F.col("smoothed.total") / d).alias("path_len_norm"),
    )
    if "ang_vel" in series.columns:
        out = out.join(_turn_at_peak(out, series, fps), list(TRIAL), "left")
    return out.drop("ce", "w_start", "w_end", "i_peak")


def _turn_at_peak(peaks: DataFrame, series: DataFrame, fps: float) -> DataFrame:
    """Per trial: the signed angular velocity that is strongest within 0.12 s of the speed peak, first of equals, and its lag. peaks: ce, i_peak, w_start, w_end."""
    reach, at = round(0.12 * fps), F.col("ce") + F.col("i_peak")
    near = peaks.select(*TRIAL, at.alias("peak_frame"), F.explode(F.sequence(F.greatest("w_start", at - reach), F.least(F.col("w_end") - 1, at + reach))).alias("frame"))
    near = near.join(series.select("session_id", "frame", "ang_vel"), ["session_id", "frame"])
    best = F.struct(F.abs("ang_vel").alias("v"), (-F.col("frame")).alias("f"))
    return near.groupBy(*TRIAL).agg(F.max_by("ang_vel", best).alias("peak_ang_vel"), (F.max_by(F.col("frame") - F.col("peak_frame"), best) / fps).alias("ang_peak_lag"))


def measure_columns(table: DataFrame) -> list[str]:
    """Numeric columns that are no labels."""
    from pyspark.sql.types import NumericType

    return [f.name for f in table.schema if isinstance(f.dataType, NumericType) and f.name not in LABELS]


def trial_meta(trials: DataFrame, keys: Sequence[str] = TRIAL) -> DataFrame:
    """The keys and those labels of a trial that the table has."""
    labels = ("target", "choice", "trial_type", "error", "cue", "rt")
    return trials.select(*keys, *[c for c in labels if c in trials.columns])


def exclusions(asked: DataFrame, measured: DataFrame, keys: Sequence[str] = TRIAL) -> tuple[DataFrame, DataFrame]:
    """Keys only in the first table, and keys only in the second one."""
    a, b = asked.select(*keys), measured.select(*keys)
    return a.join(b, list(keys), "left_anti"), b.join(a, list(keys), "left_anti")
