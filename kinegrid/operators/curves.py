"""Curves on a common grid from samples (session_id, idx, k, ...), and searches along them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinegrid.config import RIG
from kinegrid.functions.expr import by, lerp_at, packed
from kinegrid.operators.geometry import TRIAL, arc_length, projected, smooth


def packed_curves(samples: DataFrame, values: Sequence[str], keys: Sequence[str] = TRIAL, order: str = "k") -> DataFrame:
    """One row per key with an array per value, sorted."""
    return samples.groupBy(*keys).agg(*[packed(v, order).alias(v) for v in values])


def movement_segments(windows: DataFrame, series: DataFrame, value: str = "lin_vel", *, pad: int = 2, start: str = "ce", end: str = "ch") -> tuple[DataFrame, DataFrame]:
    """(session_id, idx, k, value) over [start - pad, end + pad) of each trial's window, and the keys of clipped trials.

    windows: trials with w_start and w_end. A trial is clipped, and left out, if fewer than ``pad`` frames of its window come before the start or if
    the window ends before or at the end event; a tail that the window cuts off is only shorter.
    """
    inside = (F.col(start) - F.col("w_start") >= pad) & (F.col(end) < F.col("w_end"))
    rows = windows.where(inside).select("session_id", "idx", (F.col(start) - pad).alias("_a"), F.least(F.col("w_end"), F.col(end) + pad).alias("_b"))
    rows = rows.withColumn("frame", F.explode(F.sequence("_a", F.col("_b") - 1)))
    samples = rows.join(series.select("session_id", "frame", value), ["session_id", "frame"]).select("session_id", "idx", (F.col("frame") - F.col("_a")).alias("k"), value)
    return samples, windows.where(~inside).select("session_id", "idx")


def movement_curves(samples: DataFrame, value: str, n_points: int = 50, least: int = 5, keys: Sequence[str] = TRIAL) -> DataFrame:
    """(keys, k, grid, y): a signal resampled uniformly in its index; curves of fewer than ``least`` samples or with nulls drop."""
    rows = packed_curves(samples, [value], keys).where((F.size(value) >= least) & ~F.exists(value, lambda v: v.isNull() | F.isnan(v)))
    grid = rows.select(*keys, value, F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("k"))
    at = F.col("k") * (F.size(value) - 1) / F.lit(float(n_points - 1))
    return grid.select(*keys, F.col("k").cast("long").alias("k"), (F.col("k") / F.lit(float(n_points - 1))).alias("grid"), lerp_at(F.col(value), at).alias("y"))


def keypoint_speed_curves(trials: DataFrame, speeds: DataFrame, n_points: int = 50, pad: int = 2, least: int = 6, start: str = "ce", end: str = "ch") -> DataFrame:
    """(session_id, idx, node, k, grid, y): each node's ``speed`` over [start - pad, end + pad), uniformly resampled.

    speeds: (session_id, frame, node, speed). Trials that start before frame ``pad``, or of which a node lacks a frame, drop with all their nodes.
    """
    rows = trials.where(F.col(start) >= pad).select("session_id", "idx", F.col(start).alias("_a"), (F.col(end) + pad - 1).alias("_b"))
    span = rows.withColumn("frame", F.explode(F.sequence(F.col("_a") - pad, F.col("_b")))).withColumn("k", F.col("frame") - F.col("_a") + pad)
    found = span.join(speeds.select("session_id", "frame", "node", "speed"), ["session_id", "frame"])
    nodes = speeds.where("speed is not null").groupBy("session_id").agg(F.count_distinct("node").alias("_nodes"))
    sizes = found.groupBy("session_id", "idx").agg(F.count("speed").alias("_n"), F.max(F.col("_b") - F.col("_a") + pad + 1).alias("_m")).join(nodes, "session_id")
    full = sizes.where((F.col("_m") >= least) & (F.col("_n") == F.col("_m") * F.col("_nodes"))).select("session_id", "idx")
    return movement_curves(found.join(full, ["session_id", "idx"]), "speed", n_points, least, [*TRIAL, "node"])


def on_arc_grid(rows: DataFrame, values: Sequence[str], n_points: int, keys: Sequence[str] = TRIAL) -> DataFrame:
    """(keys, k, values): interpolated at equal steps of ``arc``; of equal abscissae the last one counts. Paths without length drop."""
    one = packed_curves(rows, ["arc", *values], keys).withColumn("_n", F.size("arc")).withColumn("_total", F.get("arc", F.col("_n") - 1)).where("_total > 0")
    grid = one.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("_k"))
    grid = grid.withColumn("_g", F.when(F.col("_k") == n_points - 1, F.col("_total")).otherwise(F.col("_k") * F.col("_total") / F.lit(float(n_points - 1))))
    lo = F.size(F.filter("arc", lambda a: a <= F.col("_g"))) - 1
    grid = grid.withColumn("_lo", F.least(lo, F.col("_n") - 1)).withColumn("_hi", F.least(lo + 1, F.col("_n") - 1))
    a0, a1 = F.get("arc", F.col("_lo")), F.get("arc", F.col("_hi"))
    share = F.when(a1 > a0, (F.col("_g") - a0) / (a1 - a0)).otherwise(0.0)
    value = lambda v: F.get(v, F.col("_lo")) + (F.get(v, F.col("_hi")) - F.get(v, F.col("_lo"))) * share
    return grid.select(*keys, F.col("_k").cast("long").alias("k"), *[value(v).alias(v) for v in values])


def arclength_resample(samples: DataFrame, n_points: int = 50, keys: Sequence[str] = TRIAL) -> DataFrame:
    return on_arc_grid(arc_length(samples, keys), ["x", "y"], n_points, keys)


def arclength_signal(samples: DataFrame, value: str, n_points: int = 50, keys: Sequence[str] = TRIAL) -> DataFrame:
    return on_arc_grid(arc_length(samples, keys), [value], n_points, keys).withColumnRenamed(value, "y")


def deviation_curves(samples: DataFrame, axis: DataFrame, n_points: int = 50, *, sigma: float = 1.0, normalize: bool = True, toward: str = "unchosen") -> DataFrame:
    """(session_id, idx, k, y): smoothed excursion along the axis, on the arc grid; toward the unchosen side by default."""
    if toward not in ("chosen", "unchosen"):
        raise ValueError("toward is chosen or unchosen")
    rows = projected(arc_length(smooth(samples, sigma=sigma)), axis)
    sign = 1.0 if toward == "chosen" else -1.0
    y = sign * F.col("along") / F.nullif("d_chosen", F.lit(0.0)) if normalize else sign * F.col("along") * F.col("scale")
    return on_arc_grid(rows.withColumn("y_", y), ["y_"], n_points).withColumnRenamed("y_", "y")


def decision_frame_paths(samples: DataFrame, axis: DataFrame, n_points: int = 40, scale: float = 1.0) -> DataFrame:
    """(session_id, idx, k, u, v): paths resampled by arc and turned into the frame across and along the axis."""
    sides = samples.groupBy(*TRIAL).agg(F.first("choice").alias("choice"))
    rows = arclength_resample(samples, n_points).join(sides, list(TRIAL)).join(axis, "session_id")
    x, y = F.col("x") - F.col("center_x"), F.col("y") - F.col("center_y")
    side = F.when(F.col("choice") == 1, 1.0).otherwise(-1.0)
    return rows.select(*TRIAL, "k", (scale * (y * F.col("ux") - x * F.col("uy"))).alias("u"), (scale * side * (x * F.col("ux") + y * F.col("uy"))).alias("v"))


def event_locked_curves(
    events: DataFrame, series: DataFrame, value: str = "lin_vel", *, at: str = "frame", pre_s: float = 0.4, post_s: float = 0.4, fps: float = RIG.framerate, keys: Sequence[str] = TRIAL
) -> DataFrame:
    """(keys, k, t, y): [-pre, post) around each event, of events whose window is whole inside [w_start, w_end). ``keys`` holds session_id; with an event's name among them all events are cut at once."""
    before, after = round(pre_s * fps), round(post_s * fps)
    rows = events.select(*keys, F.col(at).alias("_at"), "w_start", "w_end").where((F.col("_at") - before >= F.col("w_start")) & (F.col("_at") + after <= F.col("w_end")))
    rows = rows.withColumn("offset", F.explode(F.sequence(F.lit(-before), F.lit(after - 1)))).withColumn("frame", F.col("_at") + F.col("offset"))
    found = rows.join(series.select("session_id", "frame", F.col(value).alias("y")), ["session_id", "frame"]).where("y is not null")
    whole_ones = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == before + after).select(*keys)
    return found.join(whole_ones, list(keys)).select(*keys, (F.col("offset") + before).cast("long").alias("k"), (F.col("offset") / fps).alias("t"), "y")


def channel_trials(channels: Sequence[DataFrame], keys: Sequence[str] = TRIAL) -> DataFrame:
    """Keys that every channel has."""
    out = channels[0].select(*keys).distinct()
    for c in channels[1:]:
        out = out.join(c.select(*keys).distinct(), list(keys), "left_semi")
    return out


def assemble_channels(channels: dict[str, DataFrame], keys: Sequence[str] = TRIAL) -> DataFrame:
    """(keys, channel, k, y as float) of the trials that all channels have."""
    if not channels:
        raise ValueError("no channels")
    common = channel_trials(list(channels.values()), keys)
    out = None
    for name, c in channels.items():
        rows = c.join(common, list(keys)).select(*keys, F.lit(name).alias("channel"), "k", F.col("y").cast("float").alias("y"))
        out = rows if out is None else out.unionByName(rows)
    return out


def first_peak(series: DataFrame, value: str = "lin_vel", *, start: str | None = None, floor: float = RIG.peak_floor, reach: int = RIG.peak_search, keys: Sequence[str] = TRIAL) -> DataFrame:
    """(keys, k, peak): the first strict local maximum above the floor in [max(1, start), min(n - 1, start + reach))."""
    w = by(*keys, order="k")
    v, s = F.col(value), F.col(start) if start else F.lit(0)
    rows = series.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w)).withColumn("_k0", F.greatest(F.lit(1), s))
    hit = rows.where((F.col("k") >= F.col("_k0")) & (F.col("k") < s + reach) & (v > F.col("_a")) & (v > F.col("_b")) & (v > floor))
    return hit.groupBy(*keys).agg(F.min("k").alias("peak_k"), F.min_by(value, "k").alias("peak"))


def rest_minimum(series: DataFrame, peaks: DataFrame, value: str = "lin_vel", *, fraction: float = RIG.rest_fraction, floor: float = RIG.rest_floor, reach: int = RIG.rest_search, keys: Sequence[str] = TRIAL) -> DataFrame:
    """(keys, rest_k): the last strict local minimum below the rest floor before the peak, else the first one, else 0; in [1, min(n - 2, reach)).

    The rest floor is a fraction of the trial's peak, or the fixed floor without one.
    """
    w = by(*keys, order="k")
    v = F.col(value)
    rows = series.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w)).withColumn("_c", F.lead(value, 2).over(w)).join(peaks, list(keys), "left")
    limit = F.when(F.col("peak").isNull(), floor).otherwise(fraction * F.col("peak"))
    low = (F.col("k") >= 1) & (F.col("k") < reach) & F.col("_c").isNotNull() & (v < F.col("_a")) & (v < F.col("_b")) & (v < limit)
    out = rows.groupBy(*keys).agg(F.max(F.when(low & (F.col("k") < F.col("peak_k")), F.col("k"))).alias("_before"), F.min(F.when(low, F.col("k"))).alias("_first"))
    return out.select(*keys, F.coalesce("_before", "_first", F.lit(0)).cast("long").alias("rest_k"))


def figure_trials(samples: DataFrame, start: str | None = None, value: str = "lin_vel", keys: Sequence[str] = TRIAL) -> DataFrame:
    """(keys, localmax, lmax_idx, localmin) of each trial for figures: its first peak, the peak's place, and the rest minimum before it (0 without a peak)."""
    peaks = first_peak(samples, value, start=start, keys=keys)
    rests = rest_minimum(samples, peaks, value, keys=keys)
    rows = rests.join(peaks, list(keys), "left")
    return rows.select(*keys, F.col("peak").alias("localmax"), F.col("peak_k").alias("lmax_idx"), F.when(F.col("peak_k").isNull(), F.lit(0)).otherwise(F.col("rest_k")).cast("long").alias("localmin"))


def epoch_peaks(windows: DataFrame, *, window_before: int, fps: float = RIG.framerate, floor: float = RIG.peak_floor, keys: Sequence[str] = TRIAL) -> DataFrame:
    """Per event window (keys, offset, value): peak, its place and time, and the peaks before and after the event; each null below the floor."""
    o = F.col("offset")
    rows = windows.groupBy(*keys).agg(
        F.max("value").alias("p"), F.max_by(o, F.when(F.col("value").isNotNull(), F.struct(F.col("value").alias("v"), (-o).alias("o")))).alias("at"),
        F.max(F.when(o < 0, F.col("value"))).alias("b"), F.max(F.when(o >= 0, F.col("value"))).alias("a"),
    )
    high = F.col("p") >= floor
    return rows.select(
        *keys, F.when(high, F.col("p")).alias("peak_velocity"), F.when(high, F.col("at") + window_before).cast("long").alias("peak_frame"), F.when(high, F.col("at") / fps).alias("peak_time"),
        F.when(F.col("b") >= floor, F.col("b")).alias("pre_event_peak"), F.when(F.col("a") >= floor, F.col("a")).alias("post_event_peak"),
    )
