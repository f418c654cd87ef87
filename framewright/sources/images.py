"""Frame images: each is decoded once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.images import image_measures


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and the measures of each image; files that can't be decoded keep their row, with nulls."""
    raw = spark.read.format("image").option("dropInvalid", False).load(path)
    return raw.select(F.col("image.origin").alias("path"), image_measures().alias("m")).select("path", "m.*")
