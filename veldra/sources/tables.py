"""Readers and writers of the domain's files. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .feeds import MANIFEST

BOX = "STRUCT<bbox: ARRAY<DOUBLE>, polygon: ARRAY<ARRAY<DOUBLE>>, is_normalized: BOOLEAN>"
DOCUMENT = (
    "document_id STRING, document_type STRING, image_path STRING, image_size STRUCT<width: INT, height: INT>, "
    f"fields ARRAY<STRUCT<field_name: STRING, geometry: {BOX}, transcription: STRUCT<text: STRING, status: STRING, confidence: DOUBLE>>>, "
    "provenance STRUCT<source_dataset: STRING, source_split: STRING, source_group_id: STRING, sha256: STRING>, metadata MAP<STRING, STRING>"
)
SAMPLE = "image_path STRING, text STRING, field_name STRING, document_type STRING, source STRING, split STRING"
#: Format versions of a benchmark manifest that can be read.
VERSIONS = (1,)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Nested documents of JSON lines; blank lines are no documents, lines that don't parse have null columns."""
    return spark.read.schema(DOCUMENT).json(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON object per line, nulls written."""
    documents.select(F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SAMPLE).json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with its header; all columns stay strings."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in MANIFEST])
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_manifest(rows: DataFrame, path: str, files: int = 1) -> None:
    """The fourteen columns in order with a header, sorted by group and file name; dhash as 16 hex digits or nothing.
    ``files`` parts, range-partitioned, so that reading them in order gives the sorted whole."""
    dhash = F.when(F.col("dhash").isNotNull(), F.lower(F.lpad(F.hex("dhash"), 16, "0"))).otherwise("") if dict(rows.dtypes)["dhash"] == "bigint" else F.col("dhash")
    out = rows.withColumn("dhash", dhash).select(*[F.col(c).cast("string") for c in MANIFEST])
    out.repartitionByRange(files, "source_group_id", "filename").sortWithinPartitions("source_group_id", "filename").write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_by_split(rows: DataFrame, path: str, split: str = "target_split") -> None:
    """A dataset laid out by split; writing a split again replaces that split alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(split).parquet(path)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """A benchmark manifest; raises if its format version isn't known."""
    m = spark.read.option("multiLine", True).schema("format_version INT, name STRING, seed BIGINT, target_per_field INT, queues MAP<STRING, ARRAY<STRING>>").json(path)
    got = [r.format_version for r in m.select("format_version").distinct().limit(len(VERSIONS) + 1).collect()]
    if not got or any(v not in VERSIONS for v in got):
        raise ValueError(f"format versions {VERSIONS} can be read, not {got}")
    return m


def append_decisions(decisions: DataFrame, folder: str) -> None:
    """Appends ``(line_no, sample_id, status, text, recorded_at)`` to the log. A verified decision needs a text, others
    must have none: a row that breaks this fails the write before anything is added."""
    verified = F.col("status") == "verified"
    has = F.coalesce(F.col("text") != "", F.lit(False))
    ok = F.assert_true(F.col("status").isin("verified", "skipped", "unreadable") & (verified == has), "a text belongs to verified decisions, and to no others")
    checked = decisions.select(F.when(ok.isNull(), F.to_json(F.struct(*decisions.columns))).alias("value"))
    checked.write.mode("append").text(folder)
