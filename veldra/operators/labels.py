"""Label lines in the JVM: every issue of every line, profiles of what loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import points_of, twice_area
from ..storage import Scratch

NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[nN][aA][nN]|[iI][nN][fF])$"
EPS = 1e-6


def number_value(t: Column) -> Column:
    special = F.lower(F.regexp_replace(t, r"^[+-]", ""))
    return F.when(special == "nan", F.lit(float("nan"))).when(special == "inf", F.when(t.startswith("-"), float("-inf")).otherwise(float("inf"))).otherwise(t.try_cast("double"))


def tokenize(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """``lines`` with ``tokens`` and, where all are numbers, ``v`` (their values); lines without tokens are dropped."""
    t = lines.withColumn("tokens", F.filter(F.split(F.col(raw), r"\s+"), lambda x: x != "")).where(F.size("tokens") > 0)
    number = F.forall("tokens", lambda x: x.rlike(NUMBER))
    return t.withColumn("v", F.when(number, F.transform("tokens", number_value)))


def coordinates(v: Column) -> Column:
    """All values after the class id."""
    return F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0)))


def _outside(x: Column) -> Column:
    return ~F.isnan(x) & ((x < -EPS) | (x > 1 + EPS))


def _with_first(t: DataFrame, file: str, order: str) -> DataFrame:
    """Tokenized lines with ``first_at``, the smallest ``order`` of equal lines of a file; a null file is a file as well."""
    first = t.groupBy(F.col(file).alias("_file"), F.col("norm").alias("_norm")).agg(F.min(order).alias("first_at"))
    return t.join(first, F.col(file).eqNullSafe(F.col("_file")) & (F.col("norm") == F.col("_norm"))).drop("_file", "_norm")


def with_issues(lines: DataFrame, file: str = "label_path", order: str = "line", raw: str = "raw", duplicates: bool = True) -> DataFrame:
    """Each line with ``issues`` (codes in order of the checks) and ``kept`` (whether an annotation comes of it).

    A line that repeats an earlier one of its file, white space aside, is told by the smallest ``order`` of equal
    lines: an aggregation by file and text, so that a file of any length needs no sorting in one task. It is the only thing that
    moves the lines; without ``duplicates`` repeated lines aren't told and each line is looked at where it is read. A class id that no
    BIGINT holds loads like any other, but ``class_id`` is null, which is a class of its own that nothing maps.
    """
    t = tokenize(lines, raw)
    if duplicates:
        t = _with_first(t.withColumn("norm", F.array_join("tokens", " ")), file, order)
    v, c = F.col("v"), coordinates(F.col("v"))
    n = F.size("v") - 1
    whole = ~F.isnan(F.get(v, F.lit(0))) & (F.abs(F.get(v, F.lit(0))) != float("inf")) & (F.get(v, F.lit(0)) == F.floor(F.get(v, F.lit(0)))) & (F.get(v, F.lit(0)) >= 0)
    loads = v.isNotNull() & whole
    box, poly = loads & (n == 4), loads & (n >= 6) & (n % 2 == 0)
    out = F.exists(c, _outside)
    nn = lambda x: ~F.isnan(x)
    edge = lambda p, s: (nn(p - s / 2) & (p - s / 2 < -EPS)) | (nn(p + s / 2) & (p + s / 2 > 1 + EPS))
    checks = [("duplicate_annotation", F.col(order) > F.col("first_at"))] if duplicates else []
    checks += [
        ("malformed_line", v.isNull()),
        ("invalid_class_id", v.isNotNull() & ~whole),
        ("zero_or_negative_size", box & ((nn(F.get(v, F.lit(3))) & (F.get(v, F.lit(3)) <= 0)) | (nn(F.get(v, F.lit(4))) & (F.get(v, F.lit(4)) <= 0)))),
        ("coord_out_of_range", (box | poly) & out),
        ("bbox_outside_image", box & ~out & (edge(F.get(v, F.lit(1)), F.get(v, F.lit(3))) | edge(F.get(v, F.lit(2)), F.get(v, F.lit(4))))),
        ("zero_area_polygon", poly & (twice_area(points_of(F.when(poly, c))) / 2 <= EPS)),
        ("invalid_token_count", loads & ~box & ~poly),
    ]
    issues = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), code) for code, test in checks]), lambda x: x.isNotNull())
    return t.withColumn("issues", issues).withColumn("kept", F.coalesce(box | poly, F.lit(False))).withColumn("kind", F.when(box, "bbox").when(poly, "polygon")).withColumn("class_id", F.when(F.col("kept"), F.get(v, F.lit(0)).try_cast("bigint")))


def issue_counts(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("issues").alias("code")).groupBy("code").agg(F.count("*").alias("n_lines"))


def instances_per_file(checked: DataFrame, file: str = "label_path") -> DataFrame:
    """``(class_id, n_instances, n_files)`` with the files that have none of a class under 0."""
    kept = checked.where("kept")
    per = kept.groupBy("class_id", file).agg(F.count("*").alias("n_instances"))
    some = per.groupBy("class_id", "n_instances").agg(F.count("*").alias("n_files"))
    have = per.groupBy("class_id").agg(F.count("*").alias("h"))
    total = checked.agg(F.countDistinct(file).alias("t"))
    none = have.crossJoin(F.broadcast(total)).select("class_id", F.lit(0).cast("bigint").alias("n_instances"), (F.col("t") - F.col("h")).alias("n_files")).where("n_files > 0")
    return some.unionByName(none)


def class_presence(checked: DataFrame, file: str = "label_path") -> DataFrame:
    """``(class_id, n_files, of_files)``: numerator and denominator of the share of files that have a class."""
    have = checked.where("kept").groupBy("class_id").agg(F.countDistinct(file).alias("n_files"))
    return have.crossJoin(F.broadcast(checked.agg(F.countDistinct(file).alias("of_files"))))


def anomalies(checked: DataFrame, scratch: Scratch, file: str = "label_path", core_share: float = 0.5, rare_share: float = 0.1) -> DataFrame:
    """``(label_path, kind)``: tags of each file that stands out: a core class missing, a rare class present, a
    class several times, a polygon, problems, or an annotation count other than the usual one (the smallest of
    equally frequent ones). The lines are read once into counts per file and class; the thresholds are one row."""
    per = checked.where("kept").groupBy(file, "class_id").agg(F.count("*").alias("n"), F.max((F.col("kind") == "polygon").cast("int")).alias("poly"))
    per = scratch.keep(per, "per")
    files = checked.groupBy(file).agg(F.count(F.when(F.col("kept"), 1)).alias("n_ann"), F.max((~F.forall("issues", lambda x: x == "duplicate_annotation")).cast("int")).alias("bad"))
    files = scratch.keep(files, "files")
    share = per.groupBy("class_id").agg(F.count("*").alias("n_files")).crossJoin(F.broadcast(files.agg(F.count("*").alias("of_files"))))
    core = share.where(F.col("n_files") >= F.col("of_files") * core_share).select("class_id")
    rare = share.where(F.col("n_files") < F.col("of_files") * rare_share).select("class_id")
    usual = files.groupBy("n_ann").agg(F.count("*").alias("c")).agg(F.max_by("n_ann", F.struct("c", -F.col("n_ann"))).alias("usual"))
    n_core = core.agg(F.count("*").alias("n_core"))
    core_have = per.join(F.broadcast(core), "class_id").groupBy(file).agg(F.count("*").alias("have"))
    tags = [
        files.join(core_have, file, "left").crossJoin(F.broadcast(n_core)).where(F.coalesce("have", F.lit(0)) < F.col("n_core")).select(file, F.lit("missing_core_class").alias("kind")),
        per.join(F.broadcast(rare), "class_id").select(file, F.concat(F.lit("rare_class_"), F.col("class_id")).alias("kind")),
        per.where("n > 1").select(file, F.explode(F.array(F.lit("duplicate_class_instances"), F.concat(F.lit("duplicate_class_"), F.col("class_id")))).alias("kind")).distinct(),
        per.where("poly = 1").select(file, F.lit("polygon_annotation").alias("kind")).distinct(),
        files.where("bad = 1").select(file, F.lit("malformed_annotation").alias("kind")),
        files.crossJoin(F.broadcast(usual)).where("n_ann <> usual").select(file, F.concat(F.lit("annotation_count_"), F.col("n_ann")).alias("kind")),
    ]
    out = tags[0]
    for t in tags[1:]:
        out = out.unionByName(t)
    return out


def remap_classes(checked: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """``checked`` with ``target`` and ``reason``: null reason for a box that maps; excluded (mapped to null on
    purpose), unmapped_class, not_a_box, out_of_bounds (centre or size outside [0, 1], no tolerance), malformed."""
    m = mapping.withColumn("_known", F.lit(True))
    j = checked.join(F.broadcast(m), keys, "left")
    v = F.col("v")
    inside = F.forall(F.slice(v, 2, 4), lambda x: ~F.isnan(x) & (x >= 0) & (x <= 1)) & (F.get(v, F.lit(3)) > 0) & (F.get(v, F.lit(4)) > 0)
    reason = (
        F.when(~F.col("kept"), "malformed").when(F.col("_known").isNull(), "unmapped_class").when(F.col("target").isNull(), "excluded")
        .when(F.col("kind") != "bbox", "not_a_box").when(~inside, "out_of_bounds")
    )
    return j.withColumn("reason", reason).drop("_known")


def records_with_labels(images: DataFrame, lines: DataFrame, file: str = "label_path") -> DataFrame:
    """Images with ``n_lines`` (different lines of their label file that aren't blank) and ``issue``: missing_label_file for
    a null path."""
    n = lines.select(file, "line", "raw").distinct().where(F.regexp_replace("raw", r"^[ \t\n\r]+|[ \t\n\r]+$", "") != "").groupBy(file).agg(F.count("*").alias("n"))
    return images.join(n, file, "left").withColumn("n_lines", F.coalesce("n", F.lit(0))).withColumn("issue", F.when(F.col(file).isNull(), "missing_label_file")).drop("n")


def line_fits(v: Column) -> Column:
    """Whether the values of a line may be a class id and coordinates: numbers, at least five, the first of them whole."""
    first = F.get(v, F.lit(0))
    return F.coalesce(v.isNotNull() & (F.size(v) >= 5) & ~F.isnan(first) & (F.abs(first) != float("inf")) & (first == F.floor(first)) & (first >= 0), F.lit(False))


def format_fits(checked: DataFrame) -> DataFrame:
    """``(fits, n_lines)``: whether every line fits; null without lines, as nothing tells the format then."""
    return checked.agg(F.bool_and(line_fits(F.col("v"))).alias("fits"), F.count("*").alias("n_lines"))


def files_fit(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``(path, fits)`` of each file: a ``.txt`` file with at least one line, of which each fits."""
    lines = F.filter(F.transform(F.split(F.col(content), r"\r\n|[\n\r]"), lambda x: F.filter(F.split(x, r"\s+"), lambda y: y != "")), lambda x: F.size(x) > 0)
    number = lambda x: F.forall(x, lambda y: y.rlike(NUMBER))
    each = F.forall(lines, lambda x: number(x) & line_fits(F.when(number(x), F.transform(x, number_value))))
    return files.select(path, F.coalesce(F.lower(path).endswith(".txt") & (F.size(lines) > 0) & each, F.lit(False)).alias("fits"))


def companions(checked: DataFrame, class_id: int = 4, core: tuple[int, ...] = (0, 1, 2, 3), lone: int = 0, file: str = "label_path") -> DataFrame:
    """``(companions, n_files)`` of the files that have a class, by what else they have: ``alone``, ``with all`` of the core, ``with``
    the lone class and nothing else, or ``other``. Flags per file, no list of its classes."""
    own = F.col("class_id") == class_id
    flags = [F.bool_or(F.col("class_id") == i).alias(f"_{i}") for i in core]
    odd = F.bool_or(~own & (F.col("class_id") != lone)).alias("_odd")
    k = checked.where("kept and class_id is not null").groupBy(file).agg(F.bool_or(own).alias("_own"), F.bool_or(~own).alias("_any"), odd, *flags).where("_own")
    every = F.col(f"_{core[0]}")
    for i in core[1:]:
        every = every & F.col(f"_{i}")
    kind = F.when(~F.col("_any"), "alone").when(every, "with all").when(~F.col("_odd"), f"with {lone}").otherwise("other")
    return k.groupBy(kind.alias("companions")).agg(F.count("*").alias("n_files"))


def box_spread(checked: DataFrame) -> DataFrame:
    """Per class, over its boxes: ``n_boxes`` and how far centres, sizes and aspects spread (standard deviations of the whole),
    with the median aspect. Boxes without height have no aspect."""
    at = lambda i: F.get("v", F.lit(i))
    b = checked.where("kind = 'bbox' and class_id is not null").select("class_id", at(1).alias("cx"), at(2).alias("cy"), at(3).alias("w"), at(4).alias("h"))
    b = b.where("not (isnan(cx) or isnan(cy) or isnan(w) or isnan(h) or abs(cx) > 1e9 or abs(cy) > 1e9 or abs(w) > 1e9 or abs(h) > 1e9)").withColumn("aspect", F.expr("try_divide(w, h)"))
    spread = [F.stddev_pop(k).alias(f"{k}_std") for k in ("cx", "cy", "w", "h", "aspect")]
    return b.groupBy("class_id").agg(F.count("*").alias("n_boxes"), *spread, F.percentile("aspect", F.lit(0.5)).alias("aspect_median"))


def crop_shapes(checked: DataFrame, sizes: DataFrame, class_id: int = 4, file: str = "label_path") -> DataFrame:
    """One row over the boxes of a class in images of known size: crops in whole pixels within the image, their least, median and
    largest width and height, and how many are tall (aspect below 1), mid or wide (above 4). ``sizes (file, width, height)``, one
    row per file."""
    at = lambda i: F.get("v", F.lit(i))
    b = checked.where((F.col("kind") == "bbox") & (F.col("class_id") == class_id)).join(sizes, file)
    edge = lambda c, s, full, sign: F.least(F.greatest((c + sign * s / 2) * full, F.lit(0.0)).cast("bigint"), full.cast("bigint"))
    w = edge(at(1), at(3), F.col("width"), 1) - edge(at(1), at(3), F.col("width"), -1)
    h = edge(at(2), at(4), F.col("height"), 1) - edge(at(2), at(4), F.col("height"), -1)
    fine = b.where(F.forall(F.slice("v", 2, 4), lambda x: ~F.isnan(x) & (F.abs(x) < 1e9))).select(w.alias("w"), h.alias("h"), F.when(at(4) > 0, at(3) / at(4)).otherwise(0.0).alias("aspect"))
    n = lambda test: F.count(F.when(test, 1))
    stats = [f(k).alias(f"{name}_{k}") for k in ("w", "h") for name, f in (("least", F.min), ("median", lambda x: F.percentile(x, F.lit(0.5))), ("most", F.max))]
    a = F.col("aspect")
    return fine.agg(F.count("*").alias("n"), *stats, n(a < 1).alias("tall"), n((a >= 1) & (a <= 4)).alias("mid"), n(a > 4).alias("wide"))
