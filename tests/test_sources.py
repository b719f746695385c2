"""Readers, writers and the streamed feed."""

import datetime
import math
import random
import time

from pyspark.sql import functions as F

from kinegrid.sources import io
from kinegrid.streaming import trials
from kinegrid.streaming.feeds import windowed_positions


def test_behavior_csv(spark, tmp_path):
    lines = [",sample,latency,presented,response,cue,time,retrieval,session"]
    lines += [f"{i},{-0.2 if i == 3 else 0.4},{9.0 if i == 7 else 0.5},{i % 2},{i % 2},4,{10 + i},0.3,s" for i in range(20)]
    (tmp_path / "log.csv").write_text("\n".join(lines))
    rows = io.load_behavior(spark, str(tmp_path / "log.csv")).collect()
    assert len(rows) == 18 and {r["session_id"] for r in rows} == {"s"} and {r["t0_anchor"] for r in rows} == {10}


def test_pose_and_sessions(spark, tmp_path):
    rows = [("s", f, "ear", 0, math.nan if f == 2 else float(f), 0.0) for f in range(8)]
    spark.createDataFrame(rows, io.POSE).write.parquet(str(tmp_path / "pose"))
    got = io.load_pose(spark, str(tmp_path / "pose")).orderBy("frame").collect()
    assert [r["x"] for r in got] == [float(f) for f in range(8)]
    a = io.save_session(spark.createDataFrame([("a", 1)], "session_id string, v int"), str(tmp_path / "a"))
    b = io.save_session(spark.createDataFrame([("b", 2, 3)], "session_id string, v int, w int"), str(tmp_path / "b"))
    assert {(r["session_id"], r["v"], r["w"]) for r in io.load_sessions(spark, [a, b]).collect()} == {("a", 1, None), ("b", 2, 3)}


def test_videos(spark, tmp_path):
    for n in ("one.mp4", "one_small.mp4", "note.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r["path"].rsplit("/")[-1] for r in io.list_videos(spark, str(tmp_path)).collect()] == ["one.mp4"]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(40).select(F.lit("s").alias("session_id"), F.timestamp_seconds(F.col("id") / 4).alias("ts"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    rows.write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_positions(feed).writeStream.format("memory").queryName("positions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("positions").collect())) == sorted(map(tuple, windowed_positions(rows).collect()))


def trial_log(spark):
    rng, rows = random.Random(3), []
    for s in range(3):
        t = 0
        for _ in range(40):
            t += rng.randint(1, 20)
            rows.append((s, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t), rng.choice(["entry", "exit", "choice", "other"])))
    return rows


def test_trials_close_on_a_stream_as_on_a_table(spark, tmp_path):
    """The log in files of shuffled order within the watermark, read one by one; a row far ahead lets the last trials close."""
    rows, kind = trial_log(spark), "session_id long, ts timestamp, kind string"
    far = [(s, datetime.datetime(2024, 1, 2), "exit") for s in range(3)] + [(9, datetime.datetime(2024, 1, 3), "exit")]
    want = trials.closed_trials(spark.createDataFrame(rows, kind), limit_s=30.0)
    assert {r["outcome"] for r in want.collect()} == {"choice", "abandoned", "timeout"}
    rng, ordered = random.Random(4), sorted(rows, key=lambda r: r[1])
    parts = [ordered[i : i + 20] for i in range(0, len(ordered), 20)] + [far[:3], far[3:]]
    for i, part in enumerate(parts):
        rng.shuffle(part)
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        time.sleep(0.02 if i else 0)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    run = trials.closed_trials(stream, limit_s=30.0, late="10 minutes").writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    assert run.awaitTermination(240)
    got = spark.table("closed").where("session_id < 9").drop("n_late").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want.drop("n_late").collect()), key=repr)


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    kind = "session_id long, ts timestamp, kind string"
    for part in ([(1, at(0), "entry")], [(1, at(1000), "entry")], [(1, at(5), "choice")], [(1, at(1010), "choice")], [(1, at(9000), "exit")], [(2, at(99000), "exit")]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        time.sleep(0.02)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    run = trials.closed_trials(stream, limit_s=30.0, late="10 seconds").writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    assert run.awaitTermination(240)
    got = sorted(map(tuple, spark.table("late").where("session_id = 1").select("entry", "choice", "outcome", "n_late").collect()))
    assert [(r[2], r[1]) for r in got] == [("timeout", None), ("choice", at(1010))] and sum(r[3] for r in got) <= 1


def test_tables_and_bundles_are_written(spark, tmp_path):
    table = spark.createDataFrame([("s", 1, 0.5)], "session_id string, idx long, v double")
    assert spark.read.csv(io.write_table(table, str(tmp_path / "t")), header=True).first()["v"] == "0.5"
    curves = spark.createDataFrame([("s", 1, [1.0, 2.0]), ("s", 2, [3.0])], "session_id string, idx long, y array<double>")
    back = spark.read.parquet(io.save_curves(curves, table, str(tmp_path / "c"))).orderBy("idx").collect()
    assert [(r["y"], r["v"]) for r in back] == [([1.0, 2.0], 0.5), ([3.0], None)]
