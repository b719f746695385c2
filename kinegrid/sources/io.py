"""Readers and writers. Schemas are explicit; sessions are Parquet partitions, so a filter on the session prunes files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSE = "session_id string, frame long, node string, track int, x double, y double"


def read_pose(spark: SparkSession, path: str, track: int = 0) -> DataFrame:
    """Landed pose rows of one track; NaN positions become null. The landing format is Parquet with the columns of ``POSE``."""
    rows = spark.read.schema(POSE).parquet(path).where(F.col("track") == track)
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "y")})


def load_pose(spark: SparkSession, path: str, threshold: float = 90.0) -> DataFrame:
    """Pose with gaps filled and jumps removed, per node."""
    from kinegrid.operators.pose import clean_outliers, fill_missing

    keys = ("session_id", "node")
    filled = fill_missing(read_pose(spark, path), ["x", "y"], keys)
    return clean_outliers(filled.where("x is not null and y is not null"), threshold, keys)


def read_behavior(spark: SparkSession, path: str, session_id: str | None = None) -> DataFrame:
    """A behavioural log with a header; its first, unnamed column is the original trial number. Names are made canonical.

    The session is the given one, else the log's own column, else the file's name.
    """
    from kinegrid.operators.behavior import canonical_names

    raw = spark.read.csv(path, header=True, inferSchema=True)
    rows = canonical_names(raw.withColumnRenamed(raw.columns[0], "absolute_trial"))
    rows = rows.withColumn("absolute_trial", F.col("absolute_trial").cast("long"))
    own = F.lit(session_id) if session_id else F.col("session") if "session" in rows.columns else F.element_at(F.split(F.input_file_name(), "/"), -1)
    return rows.withColumn("session_id", own.cast("string"))


def load_behavior(spark: SparkSession, path: str, **settings) -> DataFrame:
    from kinegrid.operators.behavior import clean_behavior

    return clean_behavior(read_behavior(spark, path), **settings)


def save_session(df: DataFrame, path: str, mode: str = "append") -> str:
    df.write.mode(mode).partitionBy("session_id").parquet(path)
    return path


def load_sessions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Union of stored sessions; columns that one lacks are null."""
    found = [spark.read.parquet(p) for p in paths]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def list_videos(spark: SparkSession, path: str, done_suffix: str = "_small") -> DataFrame:
    """(path, length) of videos that were not processed yet; contents are not read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").load(path).select("path", "length")
    return rows.where(~F.col("path").endswith(f"{done_suffix}.mp4"))


def write_table(df: DataFrame, path: str) -> str:
    """A measure table as CSV with a header."""
    df.write.mode("overwrite").csv(path, header=True)
    return path


def save_curves(packed: DataFrame, meta: DataFrame, path: str, keys: Sequence[str] = ("session_id", "idx")) -> str:
    """A curve bundle: arrays and labels in one Parquet table keyed by trial, so no row stands for another by its place. Curves without labels stay."""
    packed.join(meta, list(keys), "left").write.mode("overwrite").parquet(path)
    return path
