"""A fixed benchmark: its manifest is written once, crops are checked against it whenever they are read, scores come out per field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import error_counts, error_rate

MANIFEST = "sample_id STRING, field STRING, path STRING, sha256 STRING, n_bytes BIGINT"


def freeze(samples: DataFrame, crops: DataFrame, path: str) -> None:
    """Writes the manifest of ``samples (sample_id, field, path)`` with length and digest of each crop ``(path, content)``. A manifest
    that is there is never changed: writing again raises. So does a sample without a crop."""
    facts = crops.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("bigint").alias("n_bytes"))
    j = samples.select("sample_id", "field", "path").join(facts, "path", "left")
    whole = F.when(F.col("sha256").isNull(), F.raise_error(F.concat(F.lit("no crop for sample "), F.col("sample_id")))).otherwise(F.col("sha256"))
    j.select("sample_id", "field", "path", whole.alias("sha256"), "n_bytes").write.mode("error").parquet(path)


def read_frozen(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(path)


def verified_crops(manifest: DataFrame, crops: DataFrame) -> DataFrame:
    """``(sample_id, path, status, content)`` of each sample of ``manifest (sample_id, path, sha256)``: ok with the content, or
    missing_crop or digest_mismatch without it. Of several crops at one path any with the right digest will do."""
    c = crops.select("path", "content", F.sha2("content", 256).alias("_sha"))
    j = manifest.select("sample_id", "path", "sha256").join(c, "path", "left")
    right = F.col("_sha") == F.col("sha256")
    g = j.groupBy("sample_id", "path").agg(F.max(F.when(right, F.col("content"))).alias("content"), F.bool_or(F.coalesce(right, F.lit(False))).alias("ok"), F.count("_sha").alias("n"))
    status = F.when(F.col("ok"), "ok").when(F.col("n") == 0, "missing_crop").otherwise("digest_mismatch")
    return g.select("sample_id", "path", status.alias("status"), "content")


def evaluate(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """Scores of ``predictions (sample_id, prediction)`` against ``references (sample_id, field, reference)``, overall (field null) and
    per field: counts as in ``error_counts`` and the rates of them. A sample without a prediction counts as an empty one; where a
    sample has several, the greatest is taken."""
    one = predictions.groupBy("sample_id").agg(F.max("prediction").alias("prediction"))
    n = error_counts(references.join(one, "sample_id", "left"), "field")
    return n.withColumns({"cer": error_rate(F.col("edits"), F.col("ref_chars")), "folded_cer": error_rate(F.col("folded_edits"), F.col("ref_chars")), "exact_share": F.try_divide("exact", "n")})
