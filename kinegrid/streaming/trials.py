"""Trials closed as a stream: keyed state and event-time timers.

A session's log comes as rows (session_id, ts, kind) with kind entry, exit or choice. A trial opens at an entry and closes at the first choice within ``limit`` of
it (``choice``), at the next entry (``abandoned``), or when the limit passes (``timeout``). ``closed_trials`` works on a stream or a whole table and gives the
same trials. On a stream rows are held until the watermark passes them, so rows in any order within ``late`` of each other count as sorted; a
row that comes behind the watermark is not used, and is counted in the next trial of its session that closes. A session's state is its open trial and the rows within ``late``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OUT = "session_id long, entry timestamp, exit timestamp, choice timestamp, outcome string, n_late long"
STATE = "ts array<long>, kind array<string>, entry long, exit long, n_late long"
NONE = -(1 << 62)


def _micros(stamps: pd.Series) -> list[int]:
    return stamps.astype("datetime64[us]").astype("int64").tolist()


class _Open:
    """The open trial of a session, fed with its rows in order of time."""

    def __init__(self, entry: int, exit_: int, limit: int):
        self.entry, self.exit, self.limit, self.closed = entry, exit_, limit, []

    def close(self, outcome: str, choice: int | None = None) -> None:
        self.closed.append((self.entry, self.exit if self.exit != NONE else None, choice, outcome))
        self.entry = self.exit = NONE

    def expire(self, now: int) -> None:
        if self.entry != NONE and now > self.entry + self.limit:
            self.close("timeout")

    def row(self, ts: int, kind: str) -> None:
        self.expire(ts)
        if kind == "entry":
            if self.entry != NONE:
                self.close("abandoned")
            self.entry = ts
        elif self.entry != NONE and kind == "exit" and self.exit == NONE:
            self.exit = ts
        elif self.entry != NONE and kind == "choice":
            self.close("choice", ts)


def _streamed(feed: DataFrame, limit: int, late: str) -> DataFrame:
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, kinds, entry, exit_, n_late = state.get if state.exists else ([], [], NONE, NONE, 0)
        rows = list(zip(ts, kinds, strict=True))
        mark = state.getCurrentWatermarkMs() * 1000
        for batch in batches:
            came = list(zip(_micros(batch["ts"]), batch["kind"], strict=True))
            n_late += sum(t < mark for t, _ in came)
            rows += [r for r in came if r[0] >= mark]
        rows.sort()
        trial = _Open(entry, exit_, limit)
        for t, kind in [r for r in rows if r[0] < mark]:
            trial.row(t, kind)
        rows = [r for r in rows if r[0] >= mark]
        trial.expire(mark - 1)
        if trial.closed:
            stamp = lambda i: pd.to_datetime([c[i] for c in trial.closed], unit="us")
            yield pd.DataFrame({"session_id": key[0], "entry": stamp(0), "exit": stamp(1), "choice": stamp(2), "outcome": [c[3] for c in trial.closed], "n_late": [n_late] + [0] * (len(trial.closed) - 1)})
            n_late = 0
        if rows or trial.entry != NONE:
            state.update(([t for t, _ in rows], [k for _, k in rows], trial.entry, trial.exit, n_late))
            due = min([t for t, _ in rows] + ([trial.entry + limit] if trial.entry != NONE else []))
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif n_late:
            state.update(([], [], NONE, NONE, n_late))
        elif state.exists:
            state.remove()

    grouped = feed.withWatermark("ts", late).groupBy("session_id")
    return grouped.applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _whole(log: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("session_id").orderBy("ts", "kind")
    rows = log.withColumn("_t", F.unix_micros("ts")).withColumn("_trial", F.sum((F.col("kind") == "entry").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_trial > 0")
    trials = Window.partitionBy("session_id").orderBy("_trial")
    start = rows.groupBy("session_id", "_trial").agg(F.min(F.when(F.col("kind") == "entry", F.col("_t"))).alias("_e")).withColumn("_next", F.lead("_e").over(trials))
    # a row of a trial comes no later than its limit; an exit no later than its choice
    inside = rows.join(start, ["session_id", "_trial"]).where(F.col("_t") <= F.col("_e") + limit)
    place = F.struct("_t", "kind")
    first = lambda kind: F.min(F.when(F.col("kind") == kind, place))
    one = inside.groupBy("session_id", "_trial", "_e", "_next").agg(first("choice").alias("_c"), first("exit").alias("_x"))
    exited = F.when(F.col("_c").isNull() | (F.col("_x") < F.col("_c")), F.col("_x._t"))
    outcome = F.when(F.col("_c").isNotNull(), "choice").when(F.col("_next") <= F.col("_e") + limit, "abandoned").otherwise("timeout")
    stamp = lambda c: F.timestamp_micros(c)
    return one.select("session_id", stamp("_e").alias("entry"), stamp(exited).alias("exit"), stamp("_c._t").alias("choice"), outcome.alias("outcome"), F.lit(0).cast("long").alias("n_late"))


def closed_trials(log: DataFrame, *, limit_s: float = 30.0, late: str = "10 seconds") -> DataFrame:
    """(session_id, entry, exit, choice, outcome, n_late) of log (session_id long, ts timestamp, kind). Of rows at one time an earlier kind by name comes first; other kinds are ignored."""
    rows = log.select(F.col("session_id").cast("long").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), "kind").where(F.col("kind").isin("entry", "exit", "choice"))
    limit = round(limit_s * 1_000_000)
    return _streamed(rows, limit, late) if log.isStreaming else _whole(rows, limit)
