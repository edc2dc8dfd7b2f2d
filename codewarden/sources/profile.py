"""Saving and loading learned profiles."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from codewarden.schemas import PROFILE


def save_profile(learned: DataFrame, path: str) -> None:
    """One row, so one file."""
    learned.coalesce(1).write.mode("overwrite").json(path)


def load_profile(spark: SparkSession, path: str) -> DataFrame | None:
    """The saved profile, or None when nothing is stored there."""
    fields = spark.range(0).selectExpr(f"cast(NULL AS {PROFILE}) AS p").select("p.*").schema
    try:
        loaded = spark.read.schema(fields).json(path)
    except AnalysisException:
        return None
    return None if loaded.isEmpty() else loaded
