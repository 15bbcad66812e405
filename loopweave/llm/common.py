"""What the training-data operators share with the rest of the package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import components
from ..storage import discard, keep, scratch, shared_dir, written

__all__ = ["components", "discard", "keep", "scratch", "shared_dir", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
