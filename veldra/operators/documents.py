"""Detected regions to fields, document types, issues and validation; nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import account_number_problem, birth_date_problem, card_number_problem
from ..vocab import DETECTOR, FIELDS


def exclusive_fields(vocabulary: dict[str, list[str]] | None = None) -> dict[str, set[str]]:
    """Fields of each type that no other type has."""
    v = vocabulary or FIELDS
    return {t: set(f) - {x for u, g in v.items() if u != t for x in g} for t, f in v.items()}


def vocabulary_rows(spark, vocabulary: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(t, f) for t, fs in (vocabulary or FIELDS).items() for f in fs]
    return spark.createDataFrame(rows, "document_type STRING, field_name STRING")


def outside_vocabulary(rows: DataFrame) -> DataFrame:
    """Rows whose field isn't one of their document type; null types and fields are outside."""
    return rows.join(F.broadcast(vocabulary_rows(rows.sparkSession)), ["document_type", "field_name"], "left_anti")


def best_per_field(regions: DataFrame, fields: list[str], doc: str = "doc_id") -> DataFrame:
    """Per document and field the region with readable text of the highest detection and then recognition
    confidence, the first of equals; ``fields`` without one are null. Aggregated with a total order, not sorted.

    ``regions (doc, idx, field, text, det, rec)``. The confidence is the product of both.
    """
    readable = regions.where((F.trim(F.col("text")) != "") & F.col("field").isin(fields))
    rank = F.struct("det", "rec", (-F.col("idx")).alias("i"), "text", "idx")
    best = readable.groupBy(doc, "field").agg(F.max(rank).alias("b"))
    grid = regions.select(doc).distinct().select(doc, F.explode(F.array(*map(F.lit, fields))).alias("field"))
    return grid.join(best, [doc, "field"], "left").select(doc, "field", F.col("b.text").alias("value"), F.col("b.idx").alias("idx"), (F.col("b.det") * F.col("b.rec")).alias("confidence"))


def infer_type(regions: DataFrame, exclusive: dict[str, set[str]], doc: str = "doc_id") -> DataFrame:
    """``(doc, document_type, score, issue)``: the type with the highest confidence among its exclusive fields, the first
    listed of equals; unknown without one above 0, ambiguous with several."""
    types = [t for t in exclusive if exclusive[t]]
    g = regions.groupBy(doc).agg(*[F.coalesce(F.max(F.when(F.col("field").isin(sorted(exclusive[t])), F.col("det"))), F.lit(0.0)).alias(f"s{i}") for i, t in enumerate(types)])
    scores = [F.col(f"s{i}") for i in range(len(types))]
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    name = F.when(top <= 0, "unknown")
    for t, s in zip(types, scores):
        name = name.when(s == top, t)
    found = sum(((s > 0).cast("int") for s in scores), F.lit(0))
    issue = F.when(found == 0, "unknown_document_type").when(found > 1, "ambiguous_document_type")
    return g.select(doc, name.alias("document_type"), top.alias("score"), issue.alias("issue"))


def region_problem(class_id: Column, class_name: Column, expected: Column, width: Column, height: Column, least: int = 2) -> Column:
    """Why a region isn't read: its class id and name don't belong together, or it is less than ``least`` wide or high
    after clipping. Regions of no class pass."""
    plain = (class_id == -1) & class_name.isNull()
    return F.when(~plain & ~expected.eqNullSafe(class_name), "unknown_class").when((width < least) | (height < least), "empty_crop")


def field_issues(regions: DataFrame, doc_types: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``(doc, field, issue)``: missing_field (of the type, with no readable region), unexpected_field (not of the type),
    duplicate_field (of the type, several regions)."""
    spark = regions.sparkSession
    vocab = vocabulary_rows(spark).select("document_type", F.col("field_name").alias("field"))
    seen = regions.where("field is not null").groupBy(doc, "field").agg(F.count("*").alias("n"), F.max((F.trim(F.col("text")) != "").cast("int")).alias("readable"))
    want = doc_types.join(F.broadcast(vocab), "document_type").select(doc, "field", F.lit(True).alias("expected"))
    j = want.join(seen, [doc, "field"], "full_outer")
    missing = F.when(F.col("expected") & (F.coalesce("readable", F.lit(0)) == 0), "missing_field")
    other = F.when(F.col("expected").isNull(), "unexpected_field").when(F.col("n") > 1, "duplicate_field")
    return j.select(doc, "field", F.explode(F.filter(F.array(missing, other), lambda x: x.isNotNull())).alias("issue"))


def document_problems(fields: Column, kind: str, today: Column) -> Column:
    """Codes for a map of field to value: the type's number must be there and valid; a date of birth is looked at
    only if the map has the key, and is missing if its value is null."""
    number = {"aadhaar": ("aadhaar_number", card_number_problem), "pan": ("pan_number", account_number_problem)}[kind]
    key, test = number
    codes = F.array(test(F.try_element_at(fields, F.lit(key))), F.when(F.map_contains_key(fields, "date_of_birth"), birth_date_problem(F.try_element_at(fields, F.lit("date_of_birth")), today)))
    return F.filter(codes, lambda x: x.isNotNull())


def nest(parents: DataFrame, children: DataFrame, key: str, order: list[str], name: str = "items") -> DataFrame:
    """Each parent with the sorted array of its children; a parent without any has an empty one."""
    cols = order + [c for c in children.columns if c != key and c not in order]
    g = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    j = parents.join(g, key, "left")
    return j.withColumn(name, F.coalesce(name, F.array().cast(j.schema[name].dataType)))


def to_json(document: Column) -> Column:
    """A nested document as JSON, nulls written."""
    return F.to_json(document, {"ignoreNullFields": "false"})


def detector_id(field: Column) -> Column:
    """The detector's class of a field; null for a field that it doesn't know."""
    return F.try_element_at(F.create_map(*[x for i, f in enumerate(DETECTOR) for x in (F.lit(f), F.lit(i))]), field)


def detector_name(class_id: Column) -> Column:
    """The field of a detector class; null for a class that there isn't."""
    return F.try_element_at(F.create_map(*[x for i, f in enumerate(DETECTOR) for x in (F.lit(i), F.lit(f))]), class_id.try_cast("int"))
