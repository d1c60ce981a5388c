"""Images and labels joined by stem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stem_counts(images: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: number of images and labels, pairs (their product) and whether the key is ambiguous.

    Both sides are counted before the join, so a key with many rows is one row on either side.
    """
    i = images.groupBy(*keys).agg(F.count("*").alias("n_images"))
    b = labels.groupBy(*keys).agg(F.count("*").alias("n_labels"))
    zero = F.lit(0).cast("bigint")
    j = i.join(b, keys, "full_outer").select(*keys, F.coalesce("n_images", zero).alias("n_images"), F.coalesce("n_labels", zero).alias("n_labels"))
    return j.withColumn("n_pairs", F.col("n_images") * F.col("n_labels")).withColumn("ambiguous", F.greatest("n_images", "n_labels") > 1)


def pairing_status(counts: DataFrame, by: list[str]) -> DataFrame:
    """Per group: pairs, unmatched images and labels, ambiguous stems, and the status in words."""
    g = counts.groupBy(*by).agg(
        F.sum("n_pairs").alias("n_pairs"),
        F.sum(F.when(F.col("n_labels") == 0, F.col("n_images")).otherwise(0)).alias("images_without_label"),
        F.sum(F.when(F.col("n_images") == 0, F.col("n_labels")).otherwise(0)).alias("labels_without_image"),
        F.sum(F.col("ambiguous").cast("bigint")).alias("ambiguous_stems"),
    )
    clean = (F.col("images_without_label") == 0) & (F.col("labels_without_image") == 0) & (F.col("ambiguous_stems") == 0)
    return g.withColumn("status", F.when(F.col("n_pairs") == 0, "unverified").when(clean, "verified").otherwise("holds with exceptions"))


def without_partner(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` whose key isn't in ``right``; null keys have no partner."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def last_wins(rows: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """One row per key: the values of the last row by ``order``. Aggregated, so a key of many rows is no window."""
    last = F.max(F.struct(*order, *[c for c in values if c not in order])).alias("last")
    return rows.groupBy(key).agg(last).select(key, *[F.col(f"last.{c}").alias(c) for c in values])
