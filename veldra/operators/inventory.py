"""Listings of files: what there is, by kind, place and split, and how listings differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, extension_of, parent, redact_token
from ..vocab import IGNORED_FILES, SPLITS


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length, modificationTime)`` of the regular files below ``root``, housekeeping files left out. The
    content column isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    return files.where(~basename(F.col("path")).isin(IGNORED_FILES))


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """``(path, sha256, length, modificationTime)`` of the files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(~basename(F.col("path")).isin(IGNORED_FILES)).select("path", F.sha2("content", 256).alias("sha256"), "length", "modificationTime")


def count_by_extension(files: DataFrame, path: str = "path") -> DataFrame:
    """``(dir, ext, n_files)``: per extension (dir null) and per directory and extension, in one pass."""
    rows = files.where(F.col(path).isNotNull()).select(parent(F.col(path)).alias("dir"), extension_of(F.col(path)).alias("ext"))
    return rows.groupingSets([["ext"], ["dir", "ext"]], "dir", "ext").agg(F.count("*").alias("n_files"))


def split_names_in_paths(files: DataFrame, path: str = "path", names: list[str] | None = None) -> DataFrame:
    """``(name, n_files)``: path components that read like split names."""
    parts = files.select(F.explode(F.array_distinct(F.transform(F.split(parent(F.col(path)), "/"), F.lower))).alias("name"))
    return parts.where(F.col("name").isin(names or SPLITS)).groupBy("name").agg(F.count("*").alias("n_files"))


def count_present(records: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """``(name, present, n_rows)`` of each expected value, absent ones with 0."""
    dim = records.sparkSession.createDataFrame([(x,) for x in expected], "name STRING")
    have = records.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))
    return dim.join(have, "name", "left").select("name", F.col("n").isNotNull().alias("present"), F.coalesce("n", F.lit(0)).alias("n_rows"))


def detect_layout(files: DataFrame, path: str = "path") -> DataFrame:
    """``(split, has_images, has_labels, n_files)`` of each top-level directory that has an images or labels
    directory; other top-level entries are ``unexpected_entries``."""
    parts = F.split(F.col(path), "/")
    rows = files.select(F.get(parts, F.lit(0)).alias("split"), F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).alias("kind"))
    flags = rows.groupBy("split").agg(F.coalesce(F.bool_or(F.col("kind") == "images"), F.lit(False)).alias("has_images"), F.coalesce(F.bool_or(F.col("kind") == "labels"), F.lit(False)).alias("has_labels"), F.count("*").alias("n_files"))
    return flags.where("has_images or has_labels")


def unexpected_entries(files: DataFrame, path: str = "path") -> DataFrame:
    """``(path)`` of the files that aren't below ``<split>/images`` or ``<split>/labels`` of a known split."""
    parts = F.split(F.col(path), "/")
    fits = (F.size(parts) > 2) & F.get(parts, F.lit(0)).isin(SPLITS) & F.get(parts, F.lit(1)).isin("images", "labels")
    return files.where(~fits).select(F.col(path).alias("path"))


def preview(files: DataFrame, key: str, content: str, max_lines: int = 3) -> DataFrame:
    """``(key, preview)``: the first lines of each text, every token redacted."""
    lines = F.slice(F.split(F.col(content), r"\r\n|[\n\r]"), 1, max_lines)
    shown = F.transform(lines, lambda x: F.array_join(F.transform(F.split(x, " "), redact_token), " "))
    return files.select(key, F.array_join(shown, "\n").alias("preview"))


def case_collisions(files: DataFrame, path: str = "path") -> DataFrame:
    """``(dir, names)``: names in one directory that differ in letter case only, sorted and joined by a bar."""
    rows = files.where(F.col(path).isNotNull()).select(F.lower(parent(F.col(path))).alias("dir"), basename(F.col(path)).alias("name")).distinct()
    g = rows.groupBy("dir", F.lower("name").alias("k")).agg(F.sort_array(F.collect_list("name")).alias("names"))
    return g.where(F.size("names") > 1).select("dir", F.array_join("names", "|").alias("names"))


def compare_listings(before: DataFrame, after: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``(key, change)``: added, removed or changed (any of ``values`` differs, null-safe)."""
    b = before.select(F.col(key), F.struct(*values).alias("b"))
    a = after.select(F.col(key), F.struct(*values).alias("a"))
    j = b.join(a, key, "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return j.select(key, change.alias("change")).where("change is not null")


#: Line ends as text readers know them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def preview_files(files: DataFrame, key: str, content: str, max_lines: int = 3, max_bytes: int = 2000, redact: bool = True) -> DataFrame:
    """``(key, size_bytes, encoding, lines, truncated)`` of binary contents. Only the first ``max_bytes`` are looked at, which is the
    feature of a preview: ``encoding`` is utf-8 or binary by them, and a binary file has no lines. Tokens are redacted and
    one blank apart, whatever white space there was."""
    data = F.col(content)
    head = F.substring(data, 1, max_bytes).cast("string")
    text = F.is_valid_utf8(head)
    lines = F.split(F.regexp_replace(head, f"(?:{LINE_END})\\z", ""), LINE_END)
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda y: y != "")
    shown = F.transform(F.slice(lines, 1, max_lines), lambda x: F.array_join(F.transform(words(x), redact_token), " ") if redact else x)
    none = F.array().cast("array<string>")
    size = F.octet_length(data)
    return files.select(
        key, size.cast("bigint").alias("size_bytes"), F.when(text, "utf-8").otherwise("binary").alias("encoding"),
        F.when(text & (F.length(head) > 0), shown).when(text, none).alias("lines"), F.when(text, size > max_bytes).alias("truncated"),
    )


def top_level(files: DataFrame, path: str = "path") -> DataFrame:
    """``(path)`` of the entries right below the root that aren't splits with an images or labels folder."""
    first = F.get(F.split(path, "/"), F.lit(0)).alias("path")
    return files.select(first).distinct().join(detect_layout(files, path).select(F.col("split").alias("path")), "path", "left_anti")


def misplaced_files(files: DataFrame, path: str = "path", image_kinds: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")) -> DataFrame:
    """``(path)`` of the files right below a split's images folder that aren't images, and below its labels folder that are."""
    parts = F.split(F.col(path), "/")
    image = extension_of(F.col(path)).isin(*image_kinds)
    rows = files.select(F.col(path).alias("path"), F.get(parts, F.lit(0)).alias("split"), F.get(parts, F.lit(1)).alias("kind"), image.alias("image"), F.size(parts).alias("depth")).distinct()
    odd = rows.where("depth = 3 and ((kind = 'images' and not image) or (kind = 'labels' and image))")
    return odd.join(F.broadcast(detect_layout(files, path).select("split")), "split", "left_semi").select("path")
