import collections
import datetime

import duckdb
from pyspark.sql import functions as F

from veldra.operators import conversion, labels
from veldra.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return collections.Counter(tuple(r) for r in df.collect())


def whole(sql, table, d=SMALL):
    """Rows of ``sql`` over one table in DuckDB."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{d}/{table}.parquet'")
    return collections.Counter(con.execute(sql).fetchall())


def test_ellipsized_keeps_every_text(spark, tmp_path):
    sql, cut = catalogue.SQL["ellipsized"].split(" WHERE ")
    assert cut == "regexp_full_match(text, '[ -~]*')"
    assert rows(catalogue.ellipsized(spark, SMALL)) == whole(sql, "documents")
    texts = [(1, "क" * 31), (2, "a\tb\nc" * 10), (3, "नाम"), (4, None), (5, "𝒳" * 30), (6, "x" * 31)]
    spark.createDataFrame(texts, "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.short for r in catalogue.ellipsized(spark, str(tmp_path)).collect()}
    assert got == {1: "क" * 14 + "…" + "क" * 15, 2: ("a\tb\nc" * 3)[:14] + "…" + ("a\tb\nc" * 3), 3: "नाम", 4: None, 5: "𝒳" * 30, 6: "x" * 14 + "…" + "x" * 15}


def test_field_issues_has_more_documents_in_larger_tables(spark):
    sql = catalogue.SQL["field_issues"]
    assert sql.count("sample_id % 40") == 1
    for d, n in ((SMALL, 15), ("/root/testdata/sf0.01", 150)):
        got = catalogue.field_issues(spark, d)
        assert rows(got) == whole(sql.replace("sample_id % 40", "(sample_id - 1) // 4"), "recognition_samples", d)
        kinds = {r.issue: r.n for r in got.groupBy("issue").agg(F.countDistinct("doc_id").alias("n")).collect()}
        assert kinds["missing_field"] >= n / 2 and set(kinds) == {"missing_field", "unexpected_field", "duplicate_field"}


def test_label_conflicts_by_place_and_last_version(spark, tmp_path):
    sha = [x * 64 for x in "abc"]
    images = [(1, "1.jpg", sha[0], "l/1.txt"), (2, "2.jpg", sha[0], "l/2.txt"), (3, "3.jpg", sha[1], "l/3.txt"), (4, "4.jpg", sha[1], "l/4.txt"), (5, "5.jpg", sha[2], "l/5.txt"), (6, "6.jpg", sha[2], "./l//5.txt")]
    cols = "image_id BIGINT, rel_path STRING, raw_split STRING, sha256 STRING, dhash BIGINT, width INT, height INT, label_path STRING"
    spark.createDataFrame([(i, r, "train", h, 0, 1, 1, p) for i, r, h, p in images], cols).write.parquet(f"{tmp_path}/image_records.parquet")
    day = [datetime.datetime(2025, 1, i) for i in (1, 2)]
    files = [(1, "./l/1.txt", "0 a", day[0]), (2, "l//2.txt", "0 b", day[0]), (3, "l/3.txt", "0 z", day[1]), (4, "l/3.txt", "0 a", day[0]), (5, "l/4.txt", "0 y", day[0]), (6, "l/4.txt", "0 z", day[0])]
    spark.createDataFrame(files, "file_id BIGINT, file_path STRING, content STRING, modified_at TIMESTAMP").write.parquet(f"{tmp_path}/small_files.parquet")
    assert rows(catalogue.label_conflicts(spark, str(tmp_path))) == {(sha[0], 2, 2): 1, (sha[1], 2, 1): 1}


def test_label_lines_of_any_length_and_without_a_path(spark, tmp_path):
    long = "0 " + "0.1 0.2 " * 500_000 + "0.9 1.5"
    lines = [(1, None, 1, "0 .5 .5 .2 .1"), (2, None, 2, "0  .5 .5 .2 .1"), (3, "f", 1, "1 .5 .5 .2 .1"), (4, "f", 2, "1 x"), (5, "g", 1, "0 .1 .1 .9 .1 .9 .9")]
    df = spark.createDataFrame(lines, "row_id BIGINT, label_path STRING, line INT, raw STRING")
    df.write.parquet(f"{tmp_path}/label_lines.parquet")
    for name in ("label_issue_counts", "label_class_profile", "class_presence", "label_anomalies", "converted_files"):
        assert rows(catalogue.QUERIES[name](spark, str(tmp_path))) == whole(catalogue.SQL[name], "label_lines", tmp_path), name
    assert rows(catalogue.label_issue_counts(spark, str(tmp_path))) == {("duplicate_annotation", 1): 1, ("malformed_line", 1): 1}
    one = labels.with_issues(spark.createDataFrame([(1, "f", 1, long)], df.schema))
    assert one.select("issues", "kind").first() == (["coord_out_of_range", "zero_area_polygon"], "polygon")
    fields = conversion.convert_files(one, spark.createDataFrame([(0, 1)], "class_id BIGINT, target INT"))
    assert fields.selectExpr("size(fields[0].coords)", "fields[0].coords[1000001]").first() == (1_000_002, 1.5)


def test_polygon_boxes_of_all_points(spark):
    at = "list_transform(range({}, 65, 2), lambda i: CAST(floor(embedding[i] * 100) AS DOUBLE))"
    sql = f"""SELECT vec_id, list_min(xs), list_min(ys), list_max(xs), list_max(ys), abs(list_sum(list_transform(range(1, 33), lambda i: xs[i] * ys[i % 32 + 1] - xs[i % 32 + 1] * ys[i])))
        FROM (SELECT vec_id, {at.format(1)} AS xs, {at.format(2)} AS ys FROM embeddings)"""
    got = catalogue.polygon_boxes(spark, SMALL)
    assert got.columns == ["vec_id", "x1", "y1", "x2", "y2", "twice_area"] and rows(got) == whole(sql, "embeddings")
