"""Session defaults shared by tests, the bench and scripts."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, partitions: int = 8, name: str = "kinegrid", **extra: str) -> SparkSession:
    """A local session with the library's defaults; a cluster brings its own session."""
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions)} | extra
    return SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=conf).getOrCreate()
