"""Exact order statistics and histograms from counts per distinct value, so no group is gathered or sorted whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import aspect_bucket, unusual_size


def order_statistics(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group: ``n, low, upper_median, high``; the upper median is the value at place n div 2 from 0. Nulls are left
    out. The window runs over distinct values with their counts, not over rows."""
    c = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    upto = c.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    at = F.floor(F.col("n") / 2) + 1
    return upto.groupBy(*by).agg(F.max("n").alias("n"), F.min(value).alias("low"), F.min(F.when(F.col("upto") >= at, F.col(value))).alias("upper_median"), F.max(value).alias("high"))


def image_summary(images: DataFrame, split: str) -> DataFrame:
    """Per split: readable and unreadable images, distinct sizes, unusual sizes."""
    ok = (F.col("width") > 0) & (F.col("height") > 0)
    size = F.when(ok, F.concat_ws("x", "width", "height"))
    return images.groupBy(split).agg(
        F.count(F.when(ok, 1)).alias("n_readable"), F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias("n_unreadable"), F.countDistinct(size).alias("n_sizes"),
        F.count(F.when(ok & unusual_size(F.col("width"), F.col("height")), 1)).alias("n_unusual"),
    )


def top_sizes(images: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most frequent sizes, ties by width, then height: a top-k, so the limit is the feature."""
    g = images.where("width > 0 and height > 0").groupBy("width", "height").agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "width", "height").limit(k)


def aspect_histogram(images: DataFrame) -> DataFrame:
    rows = images.where("width > 0 and height > 0")
    return rows.groupBy(aspect_bucket(F.col("width"), F.col("height")).alias("bucket")).agg(F.count("*").alias("n"))


def numeric_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Per group ``(n, low, middle, high)``, null values left out. ``middle`` is the median, halfway between the two middle values of
    an even number; it is merged from counts per distinct value, which partial aggregation makes before the shuffle."""
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.percentile(value, F.lit(0.5)).alias("middle"), F.max(value).alias("high"))


def index_rollup(rows: DataFrame, by: list[str], size: str) -> DataFrame:
    """``(by, n, size)``: entries and their total size per combination of keys; null keys are ''."""
    return rows.groupBy(*[F.coalesce(k, F.lit("")).alias(k) for k in by]).agg(F.count("*").alias("n"), F.sum(size).alias(size))
