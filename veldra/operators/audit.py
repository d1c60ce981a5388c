"""The audit of a dataset: its sections as DataFrames, and all issues as one flat table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grouping, inventory, labels, pairing, statistics


def audit(images: DataFrame, label_files: DataFrame, checked: DataFrame, min_px: float = 4.0) -> dict[str, DataFrame]:
    """Sections of ``images (image_id, rel_path, split, stem, sha, width, height, label_path)``, ``label_files (path, split,
    stem)`` and checked label lines. Nothing runs until a section is used; ``issues (code, subject)`` holds the issues of
    all sections."""
    counts = pairing.stem_counts(images.where("split is not null"), label_files, ["split", "stem"])
    dups = grouping.exact_duplicates(images, "sha", "split")
    sizes = images.where("label_path is not null and width > 0").groupBy("label_path").agg(F.max("width").alias("w"), F.max("height").alias("h"))
    side = F.least(F.get("v", F.lit(3)) * F.col("w"), F.get("v", F.lit(4)) * F.col("h"))
    tiny = checked.where("kind = 'bbox'").join(sizes, "label_path").where((side > 0) & (side < min_px))
    collisions = inventory.case_collisions(images, "rel_path")
    at = F.concat_ws("/", "split", "stem")
    row = lambda df, code, subject: df.select(F.lit(code).alias("code"), subject.alias("subject"))
    parts = [
        row(counts.where("n_labels = 0"), "image_without_label", at), row(counts.where("n_images = 0"), "label_without_image", at),
        row(images.where("coalesce(width, 0) <= 0 or coalesce(height, 0) <= 0"), "corrupted_image", F.col("rel_path")), row(dups.where("n_splits > 1"), "exact_duplicate_across_splits", F.col("digest")),
        row(collisions, "case_insensitive_name_collision", F.concat_ws("/", "dir", "names")), row(tiny, "tiny_box", F.concat_ws(":", "label_path", F.col("line").cast("string"))),
        checked.select(F.explode("issues").alias("code"), F.concat_ws(":", "label_path", F.col("line").cast("string")).alias("subject")),
    ]
    issues = parts[0]
    for p in parts[1:]:
        issues = issues.unionByName(p)
    return {
        "pairing": pairing.pairing_status(counts, ["split"]), "images": statistics.image_summary(images, "split"), "sizes": statistics.top_sizes(images), "duplicates": dups,
        "label_issues": labels.issue_counts(checked), "classes": labels.instances_per_file(checked), "presence": labels.class_presence(checked), "issues": issues,
    }


def issue_summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code").agg(F.count("*").alias("n"))


def file_issues(files: DataFrame, images: DataFrame) -> DataFrame:
    """``(code, subject)`` of what shows in the files themselves. ``files (path, content BINARY)``, one row per place; ``images (image_id,
    rel_path, sha, label_path[, orientation])``, label paths as places.

    unexpected_entry (right below the root, no split), unexpected_file (no image among images, an image among labels),
    empty_label_file (no line but blank ones), encoding_error (a label file that isn't UTF-8), exif_orientation_not_normal,
    duplicate_images_conflicting_labels (images of one digest whose label files differ as bags of lines; a label that can't be
    read is a content of its own, images without a label file say nothing)."""
    text = F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    at = F.split("path", "/")
    labels_ = files.where((F.size(at) == 3) & (F.get(at, F.lit(1)) == "labels"))
    row = lambda df, code, subject: df.select(F.lit(code).alias("code"), subject.alias("subject"))
    known = labels_.select(F.col("path").alias("label_path"), F.when(valid, text).alias("content"))
    # a label that can't be read is told from all readable ones by a line that none of them has
    known = known.withColumn("content", F.coalesce("content", F.lit("\u0000")))
    conflicts = grouping.label_conflicts(images.join(known.select("label_path"), "label_path", "left_semi").select("sha", "label_path").distinct(), known, "sha", "label_path")
    parts = [
        row(inventory.top_level(files), "unexpected_entry", F.col("path")), row(inventory.misplaced_files(files), "unexpected_file", F.col("path")),
        row(labels_.where(valid & ~text.rlike(r"\S")), "empty_label_file", F.col("path")), row(labels_.where(~valid), "encoding_error", F.col("path")),
        row(conflicts.where("n_contents > 1"), "duplicate_images_conflicting_labels", F.col("digest")),
    ]
    if "orientation" in images.columns:
        parts.append(row(images.where("orientation is not null and orientation <> 1"), "exif_orientation_not_normal", F.col("rel_path")))
    issues = parts[0]
    for p in parts[1:]:
        issues = issues.unionByName(p)
    return issues
