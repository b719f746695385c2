"""Alignment of events and frames. Range joins are written as exploded frame lists, which makes them equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinegrid.config import EPOCHS, RIG
from kinegrid.functions.expr import by


def session_lengths(series: DataFrame) -> DataFrame:
    return series.groupBy("session_id").agg((F.max("frame") + 1).alias("n_frames"))


def trial_windows(trials: DataFrame, lengths: DataFrame, *, fps: float = RIG.framerate, pre_s: float = RIG.pre_s, post_s: float = RIG.post_s, entry: str = "entry", choice: str = "choice_frame") -> DataFrame:
    """Adds w_start and w_end: [entry - pre, choice + post) within the session; windows of fewer than 3 frames drop."""
    pre, post = round(pre_s * fps), round(post_s * fps)
    rows = trials.join(lengths, "session_id")
    rows = rows.withColumn("w_start", F.greatest(F.col(entry) - pre, F.lit(0))).withColumn("w_end", F.least(F.col(choice) + post, F.col("n_frames")))
    return rows.where("w_end - w_start >= 3").drop("n_frames")


def trial_samples(windows: DataFrame, series: DataFrame, keep: tuple[str, ...] = ("session_id", "idx")) -> DataFrame:
    """The series' rows of each trial window: an equi-join on session and frame, with ``k`` counted from the window's start."""
    frames = windows.select(*keep, "w_start", F.explode(F.sequence("w_start", F.col("w_end") - 1)).alias("frame"))
    return frames.join(series, ["session_id", "frame"]).withColumn("k", F.col("frame") - F.col("w_start"))


def build_trials(trials: DataFrame, series: DataFrame, **settings) -> DataFrame:
    """One row per trial with its samples as an array of structs, sorted by k."""
    windows = trial_windows(trials, session_lengths(series), **settings)
    samples = trial_samples(windows, series)
    fields = ["k", *[c for c in series.columns if c not in ("session_id", "frame")]]
    packed = samples.groupBy("session_id", "idx").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("samples"))
    return windows.join(packed, ["session_id", "idx"])


def aligned_windows(events: DataFrame, series: DataFrame, *, before: int = 25, after: int = 25, at: str = "frame", value: str = "lin_vel") -> DataFrame:
    """(session_id, idx, offset, value): [-before, after) around each event, null outside the session."""
    wanted = events.select("session_id", "idx", F.col(at).alias("_at"), F.explode(F.sequence(F.lit(-before), F.lit(after - 1))).alias("offset"))
    wanted = wanted.withColumn("frame", F.col("_at") + F.col("offset"))
    return wanted.join(series.select("session_id", "frame", F.col(value).alias("value")), ["session_id", "frame"], "left").select("session_id", "idx", "offset", "value")


def epoch_velocities(events: DataFrame, series: DataFrame, epochs: dict[str, tuple[int, int]] | None = None, value: str = "lin_vel") -> DataFrame:
    """(session_id, idx, event, offset, value): the window of each event's epoch (frames before and after it), null outside the session.

    events: (session_id, idx, event, frame); events without an epoch are left out.
    """
    epochs = EPOCHS if epochs is None else epochs
    spans = F.create_map(*[x for e, (before, after) in epochs.items() for x in (F.lit(e), F.sequence(F.lit(-before), F.lit(after - 1)))])
    wanted = events.where(F.col("event").isin(*epochs)).select("session_id", "idx", "event", F.col("frame").alias("_at"), F.explode(spans[F.col("event")]).alias("offset"))
    wanted = wanted.withColumn("frame", F.col("_at") + F.col("offset"))
    return wanted.join(series.select("session_id", "frame", F.col(value).alias("value")), ["session_id", "frame"], "left").select("session_id", "idx", "event", "offset", "value")


def _offset_grid_scores(trials: DataFrame, series: DataFrame, starts: DataFrame, *, fps: float, least: int, move_frames: int | None) -> DataFrame:
    """(session_id, k, f0, n_valid, score). starts: (session_id, low, step, n): candidates low + k step for k from 0 to n."""
    total = F.sum(F.coalesce("lin_vel", F.lit(0.0))).over(by("session_id").rowsBetween(Window.unboundedPreceding, 0))
    prefix = series.select("session_id", F.col("frame") + 1, total).toDF("session_id", "at", "total")
    grid = trials.select("session_id", "idx", "t_entry", "t_exit", "t_choice").join(starts, "session_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n").cast("int"))))
    grid = grid.withColumn("f0", F.col("low") + F.col("k") * F.col("step"))
    frame = lambda c: F.floor((F.col(c) + F.col("f0")) * fps).cast("long")
    grid = grid.withColumns({"fe": frame("t_entry"), "fx": frame("t_exit"), "fc": frame("t_choice")})
    grid = grid.withColumn("fm", F.col("fc") if move_frames is None else F.least(F.col("fc"), F.col("fx") + move_frames))
    grid = grid.join(session_lengths(series), "session_id").where("fe > 1 and fc < n_frames - 1 and fx > fe and fm > fx")
    for c in ("fe", "fx", "fm"):
        grid = grid.join(prefix.select("session_id", F.col("at").alias(c), F.col("total").alias(f"s_{c}")), ["session_id", c])
    move = (F.col("s_fm") - F.col("s_fx")) / (F.col("fm") - F.col("fx"))
    hold = (F.col("s_fx") - F.col("s_fe")) / (F.col("fx") - F.col("fe"))
    scored = grid.groupBy("session_id", "k", "f0").agg(F.count(F.lit(1)).alias("n_valid"), (F.avg(move) - F.avg(hold)).alias("score"))
    return scored.where(F.col("n_valid") >= least)


def offset_scores(
    trials: DataFrame, series: DataFrame, low: float, high: float, step: float, *, fps: float = RIG.framerate, least: int = 5, move_window_s: float | None = None
) -> DataFrame:
    """(session_id, k, f0, n_valid, score) of candidate offsets: mean speed of movements less mean speed of holds.

    trials: times t_entry, t_exit, t_choice from the anchor. A movement lasts from exit to choice, or ``move_window_s`` if that is shorter. Candidates times
    trials is a bounded factor (the grid), not a pair join. Missing speeds count as none.
    """
    starts = trials.select("session_id").distinct().select("session_id", F.lit(low).alias("low"), F.lit(step).alias("step"), F.lit(round((high - low) / step)).alias("n"))
    return _offset_grid_scores(trials, series, starts, fps=fps, least=least, move_frames=None if move_window_s is None else max(1, round(move_window_s * fps)))


def estimate_offset(
    trials: DataFrame, series: DataFrame, *, coarse_step: float = 0.5, fine_step: float = 0.02, move_window_s: float = 0.3, fps: float = RIG.framerate, least: int = 5
) -> DataFrame:
    """(session_id, f0): the best offset of a coarse scan over all that the recording allows, refined by a fine scan around it.

    A scan without a valid candidate gives its first one; of equal scores the first wins. A session without trials has no row.
    """
    frames = max(1, round(move_window_s * fps))
    last = trials.groupBy("session_id").agg(F.max("t_choice").alias("last")).join(session_lengths(series), "session_id")
    high = F.greatest(F.lit(coarse_step), F.col("n_frames") / F.lit(float(fps)) - F.col("last") - 1.0)
    steps = lambda length, step: F.greatest(F.ceil(length / F.lit(step)) - 1, F.lit(0)).cast("int")  # noqa: E731  the end itself is no candidate
    coarse = last.select("session_id", F.lit(0.0).alias("low"), F.lit(coarse_step).alias("step"), steps(high, coarse_step).alias("n"))
    scan = lambda starts: best_offset(_offset_grid_scores(trials, series, starts, fps=fps, least=least, move_frames=frames))
    chosen = lambda starts: starts.join(scan(starts), "session_id", "left").withColumn("f0", F.coalesce("f0", "low"))
    found = chosen(coarse)
    low, end = F.greatest(F.lit(0.0), F.col("f0") - coarse_step), F.col("f0") + coarse_step
    fine = found.select("session_id", low.alias("low"), F.lit(fine_step).alias("step"), steps(end - low, fine_step).alias("n"))
    return chosen(fine).select("session_id", "f0")


def best_offset(scores: DataFrame) -> DataFrame:
    """The offset of the highest score per session, the first one among equals. Scores are compared to nine decimals."""
    place = F.struct(F.round("score", 9).alias("s"), (-F.col("k")).alias("k"))
    return scores.groupBy("session_id").agg(F.max_by("f0", place).alias("f0"), F.max("score").alias("score"))
