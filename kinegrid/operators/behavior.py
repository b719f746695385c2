"""The behavioural log: canonical names, validity filters, event times and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinegrid.config import EVENTS, RIG
from kinegrid.functions.expr import by, whole

#: Other names of the log's columns.
ALIASES = {"sample": "sampling", "latency": "rt", "RT": "rt", "presented": "target", "response": "choice", "trialtype": "trial_type", "itis": "iti"}
KEPT = ("session_id", "idx", "absolute_trial", "time", "sampling", "rt", "target", "choice", "cue", "retrieval", "iti", "trial_type", "error", "name", "date", "session", "t0_anchor")


def canonical_names(log: DataFrame) -> DataFrame:
    """Renames aliases; of columns that get one name the first in file order stays."""
    seen, kept = set(), []
    for c in log.columns:
        name = ALIASES.get(c, c)
        if name not in seen:
            seen.add(name)
            kept.append(F.col(f"`{c}`").alias(name))
    return log.select(*kept)


def clean_behavior(log: DataFrame, *, trial_offset: int = 0, valid_pct: float = RIG.valid_pct) -> DataFrame:
    """Valid trials of each session, renumbered from 0.

    The anchor is the first remaining time before any filter. Percentiles of sampling and rt are both taken over the
    rows with known sides and a sampling of 0 or more; null or NaN sampling and rt drop. An empty log gives no rows.
    """
    rows = canonical_names(log)
    rows = rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in rows.dtypes if kind in ("double", "float")})
    order = by("session_id", order="absolute_trial")
    rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") > trial_offset)
    rows = rows.withColumn("t0_anchor", F.first("time").over(order))
    sides = [c for c in ("target", "choice", "trial_type") if c in rows.columns]
    rows = rows.dropna(subset=sides).withColumn("error", (F.col("target").cast("int") != F.col("choice").cast("int")).cast("int"))
    rows = rows.where("sampling >= 0")
    # The limits belong to this set: an aggregate of its own keeps later filters from slipping below it.
    limits = rows.groupBy("session_id").agg(*[F.percentile(c, F.lit(valid_pct / 100)).alias(f"_{c}") for c in ("sampling", "rt")])
    rows = rows.join(limits, "session_id").where("sampling <= _sampling and rt <= _rt")
    rows = rows.withColumn("idx", F.row_number().over(order) - 1)
    return rows.select(*[c for c in KEPT if c in rows.columns])


def event_times(trials: DataFrame) -> DataFrame:
    """Adds the times of the four events from entry time, sampling, rt and retrieval."""
    exit_ = F.col("time") + F.col("sampling")
    choice = exit_ + F.col("rt")
    return trials.withColumns({"t_center_entry": F.col("time"), "t_center_exit": exit_, "t_choice_entry": choice, "t_reward_entry": choice + F.col("retrieval")})


def to_frame(t, t0, frame0_time: float, fps: float):
    return F.floor((t - t0 + F.lit(frame0_time)) * F.lit(fps)).cast("long")


def event_frames(trials: DataFrame, frame0_time: float, *, fps: float = RIG.framerate, events: tuple[str, ...] = EVENTS, anchor: str = "t0_anchor") -> DataFrame:
    """Adds f_<event>: the frame of each event, counted from the anchor time."""
    unknown = set(events) - set(EVENTS)
    if unknown:
        raise ValueError(f"unknown events {sorted(unknown)}; known: {', '.join(EVENTS)}")
    timed = event_times(trials)
    return timed.withColumns({f"f_{e}": to_frame(F.col(f"t_{e}"), F.col(anchor), frame0_time, fps) for e in events})


def synchronized_frames(times: DataFrame, frame0_time: float, *, fps: float = RIG.framerate, extra: int = 0, decay: bool = False, start: float = 1.0, interval: float = 1.0) -> DataFrame:
    """Adds ``sync_frame`` to (session_id, time).

    Standard: floor((t - first + frame0) * fps) + extra. With ``decay`` the camera's own rate is used, less a count of dropped frames.
    """
    order = by("session_id", order="time")
    t, first = F.col("time"), F.first("time").over(order)
    if not decay:
        return times.withColumn("sync_frame", (F.floor((t - first + frame0_time) * fps) + extra).cast("long"))
    last = F.max("time").over(whole("session_id"))
    fix = lambda x: F.signum(x) * F.floor(F.abs(x))
    dropped = fix(t / (last * start)) * F.rint((t - first) / (interval * 100))
    return times.withColumn("sync_frame", (fix(-F.lit(frame0_time) + t * 29.407498) - 1 + extra - dropped).cast("long"))
