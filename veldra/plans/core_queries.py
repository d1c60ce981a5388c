"""Queries p2 and p5."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction
from ..sources import feeds
from ..storage import Scratch
from .sql import NUM as _NUM
from .sql import PLACE as _PLACE


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    labels = feeds.parse_label_lines(_table(spark, d, "label_lines")).where("problem is not null")
    rows = feeds.parse_manifest(_table(spark, d, "manifest_raw")).where("problem is not null")
    return labels.select(F.lit("label_lines").alias("feed"), "row_id", "problem").unionByName(rows.select(F.lit("manifest_raw").alias("feed"), "row_id", "problem"))


def p2_annotations(spark: SparkSession, d: str) -> DataFrame:
    a = feeds.parse_label_lines(_table(spark, d, "label_lines")).where("problem is null")
    return a.select("row_id", F.col("class_id").try_cast("bigint").alias("class_id"), "kind", F.size("coords").cast("bigint").alias("n_values"))


def p2_manifest(spark: SparkSession, d: str) -> DataFrame:
    r = feeds.parse_manifest(_table(spark, d, "manifest_raw")).where("problem is null")
    return r.select("row_id", *[F.col(c).try_cast("bigint").alias(c) if c in ("dhash", "width", "height", "annotation_count") else c for c in feeds.MANIFEST])


def p2_feed(spark: SparkSession, d: str) -> DataFrame:
    """The manifest as text files, whose record starts aren't known, read by blocks: every record or problem with its place."""
    scratch = Scratch(spark, "p2")
    at = scratch.path("feed")
    _table(spark, d, "manifest_raw").select(F.coalesce("raw", F.lit("")).alias("value")).write.text(at)
    r = feeds.read_manifest_feed(spark, at, scratch)
    return r.select("problem", "line", "col", *[F.col(c).try_cast("bigint").alias(c) if c in ("dhash", "width", "height", "annotation_count") else c for c in feeds.MANIFEST])


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = _table(spark, d, "small_files")
    return files, Scratch(spark, "p5").keep(compaction.bundles(files), "bundles")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.bundled_pairs(*_packed(spark, d))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return compaction.relisted_groups(*_packed(spark, d))


def p5_written(spark: SparkSession, d: str) -> DataFrame:
    """The bundles as text files of the shared folder, checked against what was read back of each."""
    _, packed = _packed(spark, d)
    return compaction.store_bundles(packed, Scratch(spark, "p5").path("files")).select("bundle", "kind", "n_bytes", "ok")


def p5_frames(spark: SparkSession, d: str) -> DataFrame:
    """The same members as complete zstandard frames."""
    packed = Scratch(spark, "p5").keep(compaction.bundles(_table(spark, d, "small_files"), fmt="zstd"), "frames")
    return packed.select("bundle", "kind", "n_bytes", "sha256", F.size("members").cast("bigint").alias("n_members"), "valid")


def p5_bundles(spark: SparkSession, d: str) -> DataFrame:
    _, packed = _packed(spark, d)
    return packed.select("bundle", "kind", "n_bytes", "sha256", F.size("members").cast("bigint").alias("n_members"), "valid")


def p5_index(spark: SparkSession, d: str) -> DataFrame:
    return compaction.index(*_packed(spark, d))


def p5_latest(spark: SparkSession, d: str) -> DataFrame:
    """The index without the places in the bundles, which depend on how rows are spread."""
    return compaction.index(*_packed(spark, d)).select("file_id", "place", "length", "latest")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_annotations, p2_manifest, p2_feed, p5_found, p5_groups, p5_bundles, p5_written, p5_frames, p5_index, p5_latest)}

_FIELD = r'([^",]*|"([^"]|"")*")'

_LABELS = f"""
  WITH t AS (SELECT row_id, list_filter(regexp_split_to_array(raw, '\\s+'), lambda x: x <> '') AS k FROM label_lines),
  n AS (SELECT row_id, k, len(list_filter(k, lambda x: NOT regexp_full_match(x, '{_NUM}'))) AS bad,
          list_transform(k, lambda x: TRY_CAST(regexp_replace(x, '^\\+', '') AS DOUBLE)) AS v FROM t WHERE len(k) > 0),
  l AS (SELECT row_id, v, CASE WHEN bad > 0 THEN 'malformed_line'
      WHEN isnan(v[1]) OR isinf(v[1]) OR v[1] <> floor(v[1]) OR v[1] < 0 THEN 'invalid_class_id'
      WHEN len(v) <> 5 AND (len(v) < 7 OR len(v) % 2 = 0) THEN 'invalid_token_count'
      WHEN len(v) = 5 AND ((NOT isnan(v[4]) AND v[4] <= 0) OR (NOT isnan(v[5]) AND v[5] <= 0)) THEN 'zero_or_negative_size'
      WHEN len(list_filter(v[2:], lambda x: NOT isnan(x) AND (x < -1e-6 OR x > 1 + 1e-6))) > 0 THEN 'coord_out_of_range' END AS problem FROM n)"""

_MANIFEST = f"""
  WITH t AS (SELECT row_id, regexp_replace(raw, '\\r$', '') AS raw FROM manifest_raw),
  f AS (SELECT row_id, regexp_full_match(raw, '{_FIELD}(,{_FIELD})*', 's') AS ok, regexp_extract_all(raw || ',', '{_FIELD},', 1, 's') AS f FROM t),
  g AS (SELECT row_id, ok, list_transform(f, lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS f FROM f),
  m AS (SELECT row_id, f, CASE WHEN NOT ok THEN 'broken_quoting' WHEN len(f) <> 14 THEN 'column_count'
      WHEN f[1] NOT IN ('aadhaar', 'pan', 'driving_license') OR f[4] NOT IN ('train', 'valid', 'test') OR f[5] NOT IN ('train', 'valid', 'test')
        OR f[7] NOT IN ('roboflow_source_stem', 'exact_byte_duplicate', 'near_duplicate', 'single_source') OR f[8] NOT IN ('high', 'possible', 'unmatched')
        OR NOT regexp_full_match(f[9], '[0-9a-fA-F]{{64}}') OR NOT regexp_full_match(f[10], '([0-9a-fA-F]{{16}})?')
        OR NOT regexp_full_match(f[11], '[0-9]+') OR NOT regexp_full_match(f[12], '[0-9]+') OR NOT regexp_full_match(f[13], '[0-9]+') THEN 'invalid_value' END AS problem FROM g)"""

SQL: dict[str, str] = {
    "p2_found": f"""SELECT 'label_lines' AS feed, row_id, problem FROM ({_LABELS} SELECT * FROM l) WHERE problem IS NOT NULL
        UNION ALL SELECT 'manifest_raw', row_id, problem FROM ({_MANIFEST} SELECT * FROM m) WHERE problem IS NOT NULL""",
    "p2_annotations": f"""{_LABELS} SELECT row_id, CAST(v[1] AS BIGINT) AS class_id, CASE WHEN len(v) = 5 THEN 'bbox' ELSE 'polygon' END AS kind, len(v) - 1 AS n_values
        FROM l WHERE problem IS NULL""",
    "p2_manifest": f"""{_MANIFEST} SELECT row_id, f[1] AS dataset, f[2] AS image_rel_path, f[3] AS filename, f[4] AS raw_split, f[5] AS target_split, f[6] AS source_group_id,
        f[7] AS grouping_method, f[8] AS confidence, f[9] AS sha256,
        CASE WHEN f[10] = '' THEN NULL ELSE CAST(CASE WHEN CAST('0x' || f[10] AS UBIGINT) >= 9223372036854775808 THEN CAST('0x' || f[10] AS HUGEINT) - 18446744073709551616 ELSE CAST('0x' || f[10] AS HUGEINT) END AS BIGINT) END AS dhash,
        CAST(f[11] AS BIGINT) AS width, CAST(f[12] AS BIGINT) AS height, CAST(f[13] AS BIGINT) AS annotation_count, f[14] AS notes FROM m WHERE problem IS NULL""",
    "p5_groups": f"""WITH m AS (SELECT DISTINCT file_id, {_PLACE} AS place, content FROM small_files), g AS (SELECT place, content, min(file_id) AS member, count(*) AS n FROM m GROUP BY ALL HAVING count(*) > 1)
        SELECT file_id, member, n FROM m JOIN g USING (place, content)""",
    "p5_latest": f"""WITH m AS (SELECT file_id, coalesce(kind, '') AS kind, {_PLACE} AS place, content, modified_at FROM small_files),
        l AS (SELECT kind, place, content FROM (SELECT *, row_number() OVER (PARTITION BY kind, place ORDER BY modified_at DESC NULLS LAST, file_id DESC) AS n FROM m) WHERE n = 1)
        SELECT file_id, place, CAST(strlen(m.content) AS BIGINT) AS length, m.content = l.content AS latest FROM m JOIN l USING (kind, place)""",
    "p5_found": f"""WITH m AS (SELECT file_id, {_PLACE} AS place, content FROM small_files)
        SELECT a.file_id AS file_id_a, b.file_id AS file_id_b FROM m a JOIN m b ON a.place = b.place AND a.content = b.content AND a.file_id < b.file_id""",
}
