"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernstone import ship
from quernstone.tables import shared_dir, stored

__all__ = ["scalar", "shared_dir", "ship", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scalar(df: DataFrame):
    """The single value of a one-row, one-column result."""
    return df.first()[0]
