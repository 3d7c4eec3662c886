"""Contents pages as HTML files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_contents_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: ``url`` is its path, ``html`` its whole text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")
    )
