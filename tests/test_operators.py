import random

import pytest
from pyspark.sql import functions as F

from veldra.operators import documents, grouping, inventory, labels, metrics, pairing, queues, statistics
from veldra.storage import Scratch
from veldra.vocab import FIELDS


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()} if cols else {tuple(r) for r in df.collect()}


def test_pairing(spark):
    i = spark.createDataFrame([("t", "a"), ("t", "a"), ("t", "b"), ("v", "a")], "split STRING, stem STRING")
    b = spark.createDataFrame([("t", "a"), ("t", "z"), ("v", "a")], "split STRING, stem STRING")
    n = pairing.stem_counts(i, b, ["split", "stem"])
    assert rows(n) == {("t", "a", 2, 1, 2, True), ("t", "b", 1, 0, 0, False), ("t", "z", 0, 1, 0, False), ("v", "a", 1, 1, 1, False)}
    assert rows(pairing.pairing_status(n, ["split"]), "split", "status") == {("t", "holds with exceptions"), ("v", "verified")}
    assert rows(pairing.without_partner(b, i, ["split", "stem"])) == {("t", "z")}
    assert pairing.pairing_status(n.limit(0), ["split"]).count() == 0


def test_listings(spark):
    f = spark.createDataFrame([("d/A.jpg",), ("d/a.jpg",), ("d/b.jpg",), ("e/A.jpg",), (None,)], "path STRING")
    assert rows(inventory.case_collisions(f)) == {("d", "A.jpg|a.jpg")}
    assert rows(inventory.count_by_extension(f)) == {(None, ".jpg", 4), ("d", ".jpg", 3), ("e", ".jpg", 1)}
    a, b = (spark.createDataFrame(x, "k INT, v STRING") for x in ([(1, "x"), (2, None), (3, "y")], [(2, "z"), (3, "y"), (4, None)]))
    assert rows(inventory.compare_listings(a, b, "k", ["v"])) == {(1, "removed"), (2, "changed"), (4, "added")}
    assert rows(inventory.count_present(f, "path", ["d/b.jpg", "none"])) == {("d/b.jpg", True, 1), ("none", False, 0)}


def test_files(spark, tmp_path):
    (tmp_path / "train" / "labels").mkdir(parents=True)
    for n in (".gitkeep", "a.txt"):
        (tmp_path / "train" / "labels" / n).write_text("0 .5 .5 .1 .1")
    assert inventory.list_files(spark, str(tmp_path)).count() == 1
    now = inventory.snapshot(spark, str(tmp_path))
    before = spark.createDataFrame(now.collect(), now.schema)
    (tmp_path / "train" / "labels" / "a.txt").write_text("changed")
    assert [r.change for r in inventory.compare_listings(before, inventory.snapshot(spark, str(tmp_path)), "path", ["sha256"]).collect()] == ["changed"]


LINES = ["0 0.5 0.5 0.2 0.1", "0  0.5 0.5 0.2 0.1", "0 0.5 abc 0.1", "1.5 .5 .5 .1 .1", "1 1.5 .5 .1 .1", "1 .95 .5 .2 .1", "1 .5 .5 0 .1", "2 .1 .1 .2 .2 .3 .3", "3 .1 .1 .2", "", "1 .1 .1 .9 .1 .9 .9"]


def test_label_issues(spark):
    df = spark.createDataFrame([(i, "f", i, x, "clash") for i, x in enumerate(LINES)], "row_id INT, label_path STRING, line INT, raw STRING, issue STRING")
    got = {r.line: (r.issues, r.kept) for r in labels.with_issues(df).collect()}
    assert got == {
        0: ([], True), 1: (["duplicate_annotation"], True), 2: (["malformed_line"], False), 3: (["invalid_class_id"], False), 4: (["coord_out_of_range"], True), 5: (["bbox_outside_image"], True),
        6: (["zero_or_negative_size"], True), 7: (["zero_area_polygon"], True), 8: (["invalid_token_count"], False), 10: ([], True),
    }
    assert labels.with_issues(df.limit(0)).count() == 0
    k = labels.with_issues(df)
    assert rows(labels.class_presence(k)) == {(0, 1, 1), (1, 1, 1), (2, 1, 1)}
    assert ("f", "polygon_annotation") in rows(labels.anomalies(k, Scratch(spark, "t")))


def test_duplicates(spark):
    r = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train"), ("b", "train"), (None, "x"), (None, "y")], "h STRING, split STRING")
    assert rows(grouping.exact_duplicates(r, "h", "split")) == {("a", 2, 2), ("b", 2, 1)}
    rnd = random.Random(1)
    hs = [rnd.getrandbits(63) for _ in range(30)]
    hs += [h ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)) for h in hs] + [0, 0]
    df = spark.createDataFrame([(h,) for h in hs] + [(None,)], "h BIGINT")
    want = {(min(a, b), max(a, b), bin(a ^ b).count("1")) for a in set(hs) for b in set(hs) if a != b and bin(a ^ b).count("1") <= 3}
    assert rows(grouping.near_duplicates(df, 3)) == want and want


def test_groups_and_splits(spark):
    r = spark.createDataFrame([(1, "b", "x"), (2, "b", "x"), (3, "a", "y"), (4, "c", "z"), (5, "c", "w")], "image_id INT, key STRING, sha STRING")
    assert rows(grouping.source_groups(r, Scratch(spark, "t")), "key", "number", "method") == {("a", 1, "single_source"), ("b", 2, "exact_byte_duplicate"), ("c", 3, "roboflow_source_stem")}
    g = spark.range(100).selectExpr("id AS key", "1 AS n")
    one = rows(grouping.greedy_split(g))
    assert one == rows(grouping.greedy_split(g.repartition(7))) and sorted([x[2] for x in one].count(s) for s in ("train", "valid", "test")) == [15, 15, 70]
    with pytest.raises(ValueError):
        grouping.greedy_split(g, (0.5, 0.5, 0.5))
    assert grouping.greedy_split(g.limit(0)).count() == 0
    ranked = grouping.global_rank(spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v")), ["v"], Scratch(spark, "t")).collect()
    assert [r.v for r in sorted(ranked, key=lambda r: r.rank)] == sorted(r.v for r in ranked) and {r.rank for r in ranked} == set(range(1, 1001))


def test_statistics(spark):
    r = spark.createDataFrame([("a", 1), ("a", 4), ("a", 2), ("a", 3), ("b", 5), ("a", None)], "g STRING, v INT")
    assert rows(statistics.order_statistics(r, ["g"], "v")) == {("a", 4, 1, 3, 4), ("b", 1, 5, 5, 5)}


def test_best_region_and_type(spark):
    reg = spark.createDataFrame(
        [(1, 0, "pan_number", "X", 0.6, 0.5), (1, 1, "pan_number", "Y", 0.9, 0.5), (1, 2, "pan_number", "Z", 0.9, 0.5), (1, 3, "name", " ", 0.8, 0.5), (2, 0, "aadhaar_number", "A", 0.7, 1.0), (2, 1, "pan_number", "B", 0.9, 1.0), (3, 0, "name", "N", 0.5, 0.5), (4, 0, None, None, None, None)],
        "doc_id INT, idx INT, field STRING, text STRING, det DOUBLE, rec DOUBLE",
    )
    best = documents.best_per_field(reg, ["name", "pan_number"])
    assert rows(best, "doc_id", "field", "value") >= {(1, "pan_number", "Y"), (1, "name", None), (4, "name", None)}
    got = rows(documents.infer_type(reg, documents.exclusive_fields()), "doc_id", "document_type", "issue")
    assert got == {(1, "pan", None), (2, "pan", "ambiguous_document_type"), (3, "unknown", "unknown_document_type"), (4, "unknown", "unknown_document_type")}
    types = spark.createDataFrame([(1, "pan")], "doc_id INT, document_type STRING")
    issues = rows(documents.field_issues(reg.where("doc_id = 1"), types))
    assert issues == {(1, "name", "missing_field"), (1, "fathers_name", "missing_field"), (1, "date_of_birth", "missing_field"), (1, "pan_number", "duplicate_field")}


def test_vocabulary(spark):
    assert documents.exclusive_fields()["aadhaar"] == {"gender", "aadhaar_number"} and documents.exclusive_fields()["unknown"] == set()
    df = spark.createDataFrame([("pan", "gender"), ("pan", "name"), (None, "name"), ("aadhaar", "class_4")], "document_type STRING, field_name STRING")
    assert rows(documents.outside_vocabulary(df)) == {("pan", "gender"), (None, "name"), ("aadhaar", "class_4")}
    assert all(len(v) == len(set(v)) for v in FIELDS.values())


def test_document_problems(spark):
    today = F.to_date(F.lit("2025-01-01"))
    df = spark.createDataFrame([({},), ({"pan_number": "ABCPK1234F", "date_of_birth": None},), ({"pan_number": "abcxk1234f", "date_of_birth": "01/01/2099"},), ({"pan_number": "ABCPK1234F"},)], "f MAP<STRING, STRING>")
    assert [r[0] for r in df.select(documents.document_problems(F.col("f"), "pan", today)).collect()] == [["missing_field"], ["missing_field"], ["invalid_pan_format", "future_date"], []]


def test_scores(spark):
    p = spark.createDataFrame([("n", "Ravi kumar", "RAVI KUMAR"), ("i", "1234 5678 9012", "1234 5678 9012"), ("n", "x", "y"), ("n", None, "ab")], "field STRING, prediction STRING, reference STRING")
    got = {r.field: (r.n, r.edits, r.ref_chars, r.exact, r.folded_edits, r.folded_exact) for r in metrics.error_counts(p, "field").collect()}
    assert got == {None: (4, 11, 27, 1, 3, 2), "n": (3, 11, 13, 0, 3, 1), "i": (1, 0, 14, 1, 0, 1)}
    w = spark.createDataFrame([(1, "a x c", "a b c"), (2, None, "a"), (3, "", "")], "k INT, prediction STRING, reference STRING")
    assert rows(metrics.word_edits(w, "k")) == {(1, 1, 3), (2, 1, 1), (3, 0, 0)}
    ref = spark.createDataFrame([(1, "id", "a"), (1, "name", None), (2, "id", "b"), (2, "name", "n")], "doc_id INT, field STRING, value STRING")
    pred = spark.createDataFrame([(1, "id", "a"), (2, "id", "c"), (2, "name", "n")], "doc_id INT, field STRING, value STRING")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id INT")
    assert rows(metrics.field_hits(ref, pred)) == {("id", 2, 1), ("name", 2, 2)} and rows(metrics.document_hits(ref, pred, docs)) == {(3, 2)}


def test_detections(spark):
    cols = "image_id BIGINT, idx INT, confidence DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
    p = spark.createDataFrame([(1, 0, 0.5, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.9, 1.0, 0.0, 11.0, 10.0), (3, 0, 0.1, 0.0, 0.0, 1.0, 1.0)], cols)
    t = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0, 10.0, 10.0), (1, 1, 1.0, 50.0, 50.0, 60.0, 60.0), (2, 0, 1.0, 0.0, 0.0, 1.0, 1.0)], cols)
    m = metrics.match_detections(p, t)
    assert rows(m) == {(1, 1, 1, 1), (2, 0, 0, 1), (3, 0, 1, 0)}
    assert {r.f1 for r in metrics.detection_counts(m).collect()} == {0.5, 0.0}


def test_queues(spark):
    log = spark.createDataFrame([("s1", 1, "skipped"), ("s1", 2, "verified"), ("s2", 1, "skipped")], "id STRING, line_no INT, status STRING")
    last = queues.latest(log, "id", ["line_no"], ["status", "line_no"])
    assert rows(last, "id", "status") == {("s1", "verified"), ("s2", "skipped")}
    q = spark.createDataFrame([("f", "s1", 1), ("f", "s3", 2), ("g", "s2", 1), ("g", "s4", 2), ("g", "s5", 3)], "field STRING, id STRING, pos INT")
    state = queues.progress(q, last, "field", "id", ["verified", "skipped"], "verified", 2)
    assert rows(state) == {("f", 1, 0, 1, False, False), ("g", 0, 1, 2, False, False)}
    assert rows(queues.next_item(q, last, state, "field", "id", "verified")) == {("g", "s4")}
    items = spark.createDataFrame([(s, i) for s in "abc" for i in range(4)], "source STRING, id INT")
    three = queues.representative_sample(items, "source", "id", 3)
    assert {r.source for r in three.collect()} == set("abc") and rows(three) == rows(queues.representative_sample(items.repartition(5), "source", "id", 3))
    assert queues.representative_sample(items, "source", "id", 99).count() == 12 and queues.representative_sample(items, "source", "id", 0).count() == 0
    assert queues.kth_per_group(items, "source", ["id"], 3).count() == 3 and queues.first_rows(items, "source", ["id"], 2).count() == 6
