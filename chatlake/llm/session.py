"""What the operators need of a Spark session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import forget, new_path, ready, shared_folder, written

__all__ = ["forget", "new_path", "ready", "shared_folder", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")
