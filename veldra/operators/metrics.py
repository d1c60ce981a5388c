"""Scores of predictions against references. Numerators and denominators come out beside each other, so that they
add up over any partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def error_counts(pairs: DataFrame, by: str) -> DataFrame:
    """``(by, n, edits, ref_chars, exact, folded_edits, folded_exact)`` overall (``by`` null) and per group, for
    ``pairs (by, prediction, reference)``. A null prediction is an empty one."""
    p, r = F.coalesce("prediction", F.lit("")), F.col("reference")
    rows = pairs.where("reference is not null").select(
        by, F.levenshtein(p, r).alias("e"), F.length(r).alias("l"), (p == r).cast("int").alias("x"), F.levenshtein(F.lower(p), F.lower(r)).alias("fe"), (F.lower(p) == F.lower(r)).cast("int").alias("fx")
    )
    big = lambda c: F.sum(c).cast("bigint")
    return rows.groupingSets([[], [by]], by).agg(F.count("*").alias("n"), big("e").alias("edits"), big("l").alias("ref_chars"), big("x").alias("exact"), big("fe").alias("folded_edits"), big("fx").alias("folded_exact"))


def error_rate(edits, length):
    """Corpus error rate: 0 for no references and no edits, 1 for edits without references."""
    return F.when(length > 0, edits / length).when(edits > 0, 1.0).otherwise(0.0)


def _edits(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(diag + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def word_edits(pairs: DataFrame, key: str) -> DataFrame:
    """``(key, edits, ref_words)``: edit distance over white-space tokens, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, r = ([(x or "").split() for x in b.column(i).to_pylist()] for i in (1, 2))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_edits(x, y) for x, y in zip(p, r)], pa.int64()), pa.array([len(y) for y in r], pa.int64())], names=[key, "edits", "ref_words"])

    schema = f"{key} {pairs.schema[key].dataType.simpleString()}, edits BIGINT, ref_words BIGINT"
    return pairs.select(key, "prediction", "reference").mapInArrow(run, schema)


def field_hits(references: DataFrame, predictions: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``(field, n, correct)`` over documents whose reference has the field: null equals null, and a missing
    prediction is null. Both sides ``(doc, field, value)``."""
    j = references.withColumnRenamed("value", "r").join(predictions.withColumnRenamed("value", "p"), [doc, "field"], "left")
    return j.groupBy("field").agg(F.count("*").alias("n"), F.sum(F.col("r").eqNullSafe(F.col("p")).cast("bigint")).alias("correct"))


def document_hits(references: DataFrame, predictions: DataFrame, documents: DataFrame, doc: str = "doc_id") -> DataFrame:
    """``(n, correct)``: documents, and those with every reference field right; one without fields is right."""
    j = references.withColumnRenamed("value", "r").join(predictions.withColumnRenamed("value", "p"), [doc, "field"], "left")
    g = j.groupBy(doc).agg(F.bool_and(F.col("r").eqNullSafe(F.col("p"))).alias("ok"))
    return documents.select(doc).distinct().join(g, doc, "left").agg(F.count("*").alias("n"), F.count(F.when(F.coalesce("ok", F.lit(True)), 1)).alias("correct"))


def detection_counts(matches: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to ``(tp, fp, fn)``, 0 on empty denominators."""
    z = F.lit(0.0)
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), z), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), z)
    return matches.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), z))


def _greedy(predicted: list[dict], truth: list[dict], least: float) -> int:
    box = lambda t: (t["x1"], t["y1"], t["x2"], t["y2"])
    free, hits = [box(t) for t in sorted(truth, key=lambda t: (t["idx"], *box(t)))], 0
    for p in sorted(predicted, key=lambda p: (-p["confidence"], p["idx"], *box(p))):
        best, at = least, None
        for i, (x1, y1, x2, y2) in enumerate(free):
            inter = max(min(p["x2"], x2) - max(p["x1"], x1), 0) * max(min(p["y2"], y2) - max(p["y1"], y1), 0)
            union = (p["x2"] - p["x1"]) * (p["y2"] - p["y1"]) + (x2 - x1) * (y2 - y1) - inter
            if union > 0 and inter / union >= best:
                best, at = inter / union, i
        if at is not None:
            free.pop(at)
            hits += 1
    return hits


def match_detections(predicted: DataFrame, truth: DataFrame, image: str = "image_id", least: float = 0.5) -> DataFrame:
    """``(image, tp, fp, fn)``: predictions in falling confidence each take the free true box of the highest overlap of
    at least ``least``, the last of equals. Equal confidences go by ``idx`` and then by the corners, so that the order of rows doesn't matter. The boxes of one image (a page of fields, some dozens) are one row of two
    arrays; images are spread over all tasks and matched in Arrow batches."""
    box = ["idx", "x1", "y1", "x2", "y2"]
    p = predicted.groupBy(image).agg(F.collect_list(F.struct("confidence", *box)).alias("p"))
    t = truth.groupBy(image).agg(F.collect_list(F.struct(*box)).alias("t"))
    key = predicted.schema[image].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps, ts = ([x or [] for x in b.column(i).to_pylist()] for i in (1, 2))
            hits = [_greedy(x, y, least) for x, y in zip(ps, ts)]
            rest = [[h for h in hits], [len(x) - h for x, h in zip(ps, hits)], [len(y) - h for y, h in zip(ts, hits)]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in rest)], names=[image, "tp", "fp", "fn"])

    return p.join(t, image, "full_outer").select(image, "p", "t").mapInArrow(run, f"{image} {key}, tp BIGINT, fp BIGINT, fn BIGINT")


def letter_counts(rows: DataFrame, by: str, text: str = "text", outside: str = "[^A-Za-z0-9/ ]") -> DataFrame:
    """Per group ``(n, with_letter, out_of_vocabulary)`` of the texts that aren't null: those with a letter of any script, and
    those with a character that the recogniser doesn't know."""
    r, t = rows.where(F.col(text).isNotNull()), F.col(text)
    return r.groupBy(by).agg(F.count("*").alias("n"), F.count(F.when(t.rlike(r"\p{L}"), 1)).alias("with_letter"), F.count(F.when(t.rlike(outside), 1)).alias("out_of_vocabulary"))


def class_report(rows: DataFrame, names: list[str], name: str, last: str) -> DataFrame:
    """``(class_name, n, last)`` of each of ``names``: numbers are null for a class that no row has, which isn't a count of 0."""
    dim = rows.sparkSession.createDataFrame([(f,) for f in names], "class_name STRING")
    m = rows.groupBy(F.col(name).alias("class_name")).agg(F.count("*").alias("n"), F.max(last).alias("last"))
    return dim.join(m, "class_name", "left")
