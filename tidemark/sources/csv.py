"""Signals from delimited text, and tables of measures to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.series import series


def read_csv(spark: SparkSession, path: str, value: str, order: list[str], key: str | None = None, sep: str = ",", header: bool = True, lowest: float | None = None, highest: float | None = None) -> DataFrame:
    """series_id, idx, value. Fields that aren't numbers are left out, as are values outside the limits. Without a key
    column every file is a signal."""
    df = spark.read.csv(path, sep=sep, header=header)
    df = df.withColumn("_key", F.col(key) if key else F.input_file_name()).withColumn("_value", F.col(value).try_cast("double"))
    if lowest is not None:
        df = df.filter(F.col("_value") >= lowest)
    if highest is not None:
        df = df.filter(F.col("_value") <= highest)
    return series(df, "_key", order, "_value")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)
