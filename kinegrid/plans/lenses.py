"""Views of the driver's tables as sessions, trials, curves and measures; each with its SQL twin.

frames: a user's events in order of time; trials: from each view to the user's next purchase. Curves: embeddings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FPS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        (F.row_number().over(w) - 1).cast("long").alias("frame"),
        "event_id",
        "event_type",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("time"),
        F.col("value").alias("x"),
        F.get_json_object("props", "$.k").cast("double").alias("y"),
        F.col("value").alias("lin_vel"),
    )


FRAMES = """frames AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_id, event_type,
 epoch_us(ts) / 1e6 AS "time", value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, value AS lin_vel FROM events)"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ce: frame of the view; ch: of the next purchase; sides, cue and reaction time."""
    ahead = Window.partitionBy("session_id").orderBy("frame").rowsBetween(1, Window.unboundedFollowing)
    bought = F.when(F.col("event_type") == "purchase", F.struct("frame", "time"))
    rows = frames(spark, sf_dir).withColumn("next", F.first(bought, True).over(ahead)).where("event_type = 'view' and next is not null")
    order = Window.partitionBy("session_id").orderBy("frame")
    return rows.select(
        "session_id",
        (F.row_number().over(order) - 1).cast("long").alias("idx"),
        F.col("frame").alias("ce"),
        F.col("next.frame").alias("ch"),
        "time",
        F.col("next.time").alias("t_choice"),
        (F.col("event_id") % 2).cast("int").alias("choice"),
        (F.col("y").cast("long") % 2).cast("int").alias("target"),
        (F.col("event_id") % 2 != F.col("y").cast("long") % 2).cast("int").alias("error"),
        F.pow(F.lit(4), F.col("event_id") % 3).cast("int").alias("cue"),
        ((F.col("next.time") - F.col("time")) / 1000).alias("rt"),
    )


TRIALS = (
    FRAMES
    + """, nexts AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN frame END) OVER a AS ch, min(CASE WHEN event_type = 'purchase' THEN "time" END) OVER a AS t_choice
 FROM frames WINDOW a AS (PARTITION BY session_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
trials AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY frame) - 1 AS idx, frame AS ce, ch, "time", t_choice, CAST(event_id % 2 AS INT) AS choice,
 CAST(CAST(y AS BIGINT) % 2 AS INT) AS target, CAST(event_id % 2 <> CAST(y AS BIGINT) % 2 AS INT) AS error, CAST(power(4, event_id % 3) AS INT) AS cue, (t_choice - "time") / 1000 AS rt
 FROM nexts WHERE event_type = 'view' AND ch IS NOT NULL)"""
)


def ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kinegrid.operators.geometry import locate_ports

    return locate_ports(trials(spark, sf_dir), frames(spark, sf_dir))


PORTS = (
    TRIALS
    + """, ports AS (SELECT t.session_id, median(e.x) AS center_x, median(e.y) AS center_y, median(h.x) FILTER (t.choice = 0) AS left_x, median(h.y) FILTER (t.choice = 0) AS left_y,
 median(h.x) FILTER (t.choice = 1) AS right_x, median(h.y) FILTER (t.choice = 1) AS right_y
 FROM trials t JOIN frames e ON e.session_id = t.session_id AND e.frame = t.ce JOIN frames h ON h.session_id = t.session_id AND h.frame = t.ch GROUP BY t.session_id),
axes AS (SELECT *, sqrt((right_x - left_x) * (right_x - left_x) + (right_y - left_y) * (right_y - left_y)) AS span FROM ports),
axis AS (SELECT session_id, center_x, center_y, (right_x - left_x) / span AS ux, (right_y - left_y) / span AS uy,
 (right_x - center_x) * ((right_x - left_x) / span) + (right_y - center_y) * ((right_y - left_y) / span) AS d_right,
 (left_x - center_x) * ((right_x - left_x) / span) + (left_y - center_y) * ((right_y - left_y) / span) AS d_left, 8.0 / span AS scale FROM axes WHERE span > 0)"""
)


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, label, k, grid, y): the embeddings as curves, in long form."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "label", F.posexplode("embedding").alias("k", "v"))
    return rows.select("idx", "label", F.col("k").cast("long").alias("k"), (F.col("k") / 63.0).alias("grid"), F.col("v").cast("double").alias("y"))


def packed_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), "label", F.col("embedding").cast("array<double>").alias("y"))


CURVES = """curves AS (SELECT vec_id AS idx, label, k, k / 63.0 AS grid, CAST(embedding[k + 1] AS DOUBLE) AS y FROM embeddings, (SELECT unnest(range(64)) AS k))"""
