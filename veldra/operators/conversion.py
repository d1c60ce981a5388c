"""Checked label lines to documents, candidates and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import points_of
from ..functions.text import sample_id, stem_of
from .documents import vocabulary_rows
from .labels import NUMBER, coordinates, number_value


def convert_files(checked: DataFrame, mapping: DataFrame, file: str = "label_path", line: str = "line") -> DataFrame:
    """``(file, ok, n_fields, n_excluded, fields)``, one document per file: the fields in line order. A class mapped to
    null is left out and counted; a line that doesn't load or a class that isn't mapped rejects the whole file, which
    then has no fields and counts nothing."""
    m = mapping.withColumn("_known", F.lit(True))
    j = checked.join(F.broadcast(m), "class_id", "left")
    bad = ~F.col("kept") | F.col("_known").isNull()
    field = F.when(~bad & F.col("target").isNotNull(), F.struct(F.col(line).alias("line"), "target", "kind", coordinates(F.col("v")).alias("coords")))
    g = j.groupBy(file).agg(F.bool_or(bad).alias("bad"), F.count(field).alias("f"), F.count(F.when(~bad & F.col("target").isNull(), 1)).alias("x"), F.array_sort(F.collect_list(field)).alias("fields"))
    zero = F.lit(0).cast("bigint")
    some = ~F.col("bad")
    return g.select(file, some.alias("ok"), F.when(some, F.col("f")).otherwise(zero).alias("n_fields"), F.when(some, F.col("x")).otherwise(zero).alias("n_excluded"), F.when(some, F.col("fields")).alias("fields"))


def candidates(checked: DataFrame, images: DataFrame, names: Column, file: str = "label_path", line: str = "line", least: float = 2.0) -> DataFrame:
    """Boxes of label files with ``reason``: missing_image, unknown_class, degenerate_box (a side under ``least`` pixels after
    clipping), null for a candidate, which has ``field`` and ``sample_id``. ``images (file, width, height)``, one per file."""
    j = checked.where("kept").join(images.withColumn("_seen", F.lit(True)), file, "left")
    v, w, h = F.col("v"), F.col("width"), F.col("height")
    cx, cy, bw, bh = (F.get(v, F.lit(i)) for i in range(1, 5))
    side = lambda c, s, full: F.least(full.cast("double"), (c + s / 2) * full) - F.greatest(F.lit(0.0), (c - s / 2) * full)
    box = F.col("kind") == "bbox"
    field = F.try_element_at(names, F.col("class_id"))
    reason = F.when(F.col("_seen").isNull(), "missing_image").when(field.isNull(), "unknown_class").when(box & ((side(cx, bw, w) < least) | (side(cy, bh, h) < least)), "degenerate_box")
    return j.withColumn("reason", reason).withColumn("field", field).withColumn("sample_id", F.when(reason.isNull(), sample_id(F.col(file), F.col(line), field))).drop("_seen")


def captions(checked: DataFrame, file: str = "label_path") -> DataFrame:
    """``(file, caption)``: classes in order, with ``x`` and the number where it is above one."""
    per = checked.where("kept").groupBy(file, "class_id").agg(F.count("*").alias("n"))
    part = F.concat(F.col("class_id").cast("string"), F.when(F.col("n") > 1, F.concat(F.lit("x"), F.col("n"))).otherwise(""))
    g = per.groupBy(file).agg(F.array_sort(F.collect_list(F.struct("class_id", part.alias("p")))).alias("p"))
    return g.select(file, F.array_join(F.transform("p", lambda x: x["p"]), ", ").alias("caption"))


def collate(rows: DataFrame, batch: str, order: str, target: str) -> DataFrame:
    """``(batch, targets, lengths)``: the variable-length targets of a batch end to end, and their lengths. A batch is a
    fixed number of rows, so its arrays are bounded by it."""
    g = rows.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(order, target))).alias("r"))
    parts = F.transform("r", lambda x: x[target])
    return g.select(batch, F.flatten(parts).alias("targets"), F.transform(parts, F.size).alias("lengths"))


def split_report(records: DataFrame, group: str, split: str, digest: str, label: str) -> DataFrame:
    """``(check, n)``: groups in several splits, digests in several splits, records without a label."""
    several = lambda key: records.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(split).alias("s")).where("s > 1").agg(F.count("*").alias("n"))
    parts = [several(group).select(F.lit("groups_in_several_splits").alias("check"), "n"), several(digest).select(F.lit("digests_in_several_splits").alias("check"), "n")]
    parts.append(records.agg(F.count(F.when(F.col(label).isNull(), 1)).alias("n")).select(F.lit("records_without_label").alias("check"), "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def convert_documents(images: DataFrame, lines: DataFrame, mapping: DataFrame, manifest: DataFrame | None = None, file: str = "label_path") -> DataFrame:
    """One document per image: ``(image_id, ok, error, n_lines, n_excluded, split, source_group_id, sha256, width, height, document_type,
    fields)``.

    ``images (image_id, rel_path, document_type, width, height, label_path[, split, source_group_id, sha256])``; ``lines (label_path,
    line, raw)``; ``mapping (document_type, class_id, field_name)``, a null field for a class that is left out on purpose, which is
    counted for class 4 only; ``manifest (stem, target_split, source_group_id, sha256)``, one row per stem. ``fields`` in line order:
    ``line, field_name, class_id, status (missing: nothing is read yet), kind, x1, y1, x2, y2, points``.

    The first line that fails rejects its image with an error: malformed_line (the first token isn't an integer or a later one no
    number), unmapped_class, field_not_of_type, coordinate_count, reversed_box. Images without a size are ``missing_image``. An image
    without label lines is a document without fields. The split is the given one, else that of the manifest, else the name of
    the folder above the image's folder.
    """
    t = lines.withColumn("_t", F.filter(F.split("raw", r"\s+"), lambda x: x != "")).where(F.size("_t") > 0).select(file, "line", "_t").distinct()
    of = images.select("image_id", "document_type", file)
    j = of.join(t, file).withColumn("class_id", F.when(F.get("_t", F.lit(0)).rlike(r"^[+-]?[0-9]+$"), F.get("_t", F.lit(0)).try_cast("bigint")))
    words = F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0)))
    j = j.withColumn("c", F.when(F.forall(words, lambda x: x.rlike(NUMBER)), F.transform(words, number_value)))
    j = j.join(F.broadcast(mapping.withColumn("_known", F.lit(True))), ["document_type", "class_id"], "left")
    vocabulary = vocabulary_rows(images.sparkSession).withColumn("_own", F.lit(True))
    j = j.join(F.broadcast(vocabulary), ["document_type", "field_name"], "left")
    c, n = F.col("c"), F.size("c")
    box, polygon = n == 4, (n >= 6) & (n % 2 == 0)
    at = lambda i: F.get("c", F.lit(i))
    reads = F.col("_known") & F.col("field_name").isNotNull()
    error = (
        F.when(F.col("class_id").isNull() | c.isNull(), "malformed_line").when(F.col("_known").isNull(), "unmapped_class").when(reads & F.col("_own").isNull(), "field_not_of_type")
        .when(reads & ~box & ~polygon, "coordinate_count").when(reads & box & ((at(2) < 0) | (at(3) < 0)), "reversed_box")
    )
    j = j.withColumn("error", error)
    points = points_of(F.when(polygon, c))
    px, py = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    side = lambda i, k, sign, of_points: F.when(box, at(i) + sign * at(k) / 2).otherwise(of_points)
    field = F.struct(
        "line", "field_name", "class_id", F.lit("missing").alias("status"), F.when(box, "bbox").otherwise("polygon").alias("kind"),
        side(0, 2, -1, F.array_min(px)).alias("x1"), side(1, 3, -1, F.array_min(py)).alias("y1"), side(0, 2, 1, F.array_max(px)).alias("x2"), side(1, 3, 1, F.array_max(py)).alias("y2"), points.alias("points"),
    )
    left_out = F.col("_known") & F.col("field_name").isNull() & (F.col("class_id") == 4)
    g = j.groupBy("image_id").agg(
        F.min_by("error", F.when(F.col("error").isNotNull(), F.struct("line", "_t"))).alias("error"), F.count("*").alias("n_lines"), F.count(F.when(left_out, 1)).alias("x"),
        F.array_sort(F.collect_list(F.when(F.col("error").isNull() & F.col("field_name").isNotNull(), field))).alias("fields"),
    )
    d = images.withColumn("_stem", stem_of(F.col("rel_path")))
    given = [F.col(k) if k in images.columns else F.lit(None).cast("string").alias(k) for k in ("split", "source_group_id", "sha256")]
    d = d.select("image_id", "rel_path", "document_type", "width", "height", "_stem", *given)
    if manifest is not None:
        m = manifest.select(F.col("stem").alias("_stem"), F.col("target_split").alias("_split"), F.col("source_group_id").alias("_group"), F.col("sha256").alias("_sha"))
        d = d.join(m, "_stem", "left")
    else:
        d = d.withColumns({k: F.lit(None).cast("string") for k in ("_split", "_group", "_sha")})
    folder = F.get(F.reverse(F.split("rel_path", "/")), F.lit(2))
    out = d.join(g, "image_id", "left")
    error = F.when(~F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False)), "missing_image").otherwise(F.col("error"))
    ok, zero = error.isNull(), F.lit(0).cast("bigint")
    none = F.array().cast(g.schema["fields"].dataType)
    return out.select(
        "image_id", ok.alias("ok"), error.alias("error"), F.coalesce("n_lines", zero).alias("n_lines"), F.when(ok, F.coalesce("x", zero)).otherwise(zero).alias("n_excluded"),
        F.coalesce(F.nullif("split", F.lit("")), F.nullif("_split", F.lit("")), folder).alias("split"), F.coalesce("_group", "source_group_id").alias("source_group_id"), F.coalesce("_sha", "sha256").alias("sha256"),
        "width", "height", "document_type", F.when(ok, F.coalesce("fields", none)).alias("fields"),
    )


def conversion_stats(documents: DataFrame) -> DataFrame:
    """Per document type: images, documents, and of those the lines, fields and lines left out; errors by code come of the documents
    themselves."""
    ok = F.col("ok")
    return documents.groupBy("document_type").agg(
        F.count("*").alias("input_images"), F.count(F.when(ok, 1)).alias("converted_documents"), F.coalesce(F.sum(F.when(ok, F.col("n_lines"))), F.lit(0)).alias("input_annotations"),
        F.coalesce(F.sum(F.when(ok, F.size("fields").cast("bigint"))), F.lit(0)).alias("included_fields"), F.coalesce(F.sum("n_excluded"), F.lit(0)).alias("excluded_class_4"),
    )
