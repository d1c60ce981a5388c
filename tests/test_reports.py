import pytest

from veldra.operators import audit, conversion, inventory, labels, queues
from veldra.storage import Scratch

FILES = "path STRING, content BINARY"


def test_issues_of_files(spark):
    rows = [
        ("train/labels/a.txt", b"0 .5 .5 .1 .1\n1 .3 .3 .1 .1"), ("valid/labels/b.txt", b"0 .5  .5 .1 .1\r\n"), ("valid/labels/c.txt", b"1 .3 .3 .1 .1\n\n0 .5 .5 .1 .1\n"), ("train/labels/empty.txt", b" \n\t\n"), ("train/labels/none.txt", b""),
        ("train/labels/bad.txt", b"0 \xff\xfe"), ("train/images/a.jpg", b"x"), ("train/images/notes.txt", b"x"), ("train/labels/odd.PNG", b"x"), ("README.extra", b"x"), ("stray/deep/x.txt", b"x"), ("train/images/deep/x.txt", b"x"),
    ]
    images = [(1, "train/images/a.jpg", "s1", "train/labels/a.txt", None), (2, "valid/images/b.jpg", "s1", "valid/labels/b.txt", 1), (3, "x/c.jpg", "s2", "valid/labels/c.txt", 6), (4, "x/d.jpg", "s2", "train/labels/a.txt", None), (5, "x/e.jpg", "s3", "train/labels/bad.txt", None), (6, "x/f.jpg", "s3", "train/labels/none.txt", None), (7, "x/g.jpg", "s2", "not there", None), (8, "x/h.jpg", None, None, None)]
    f, i = spark.createDataFrame(rows, FILES), spark.createDataFrame(images, "image_id BIGINT, rel_path STRING, sha STRING, label_path STRING, orientation INT")
    got = {(r.code, r.subject) for r in audit.file_issues(f, i).collect()}
    assert got == {
        ("unexpected_entry", "README.extra"), ("unexpected_entry", "stray"), ("unexpected_file", "train/images/notes.txt"), ("unexpected_file", "train/labels/odd.PNG"), ("empty_label_file", "train/labels/empty.txt"), ("empty_label_file", "train/labels/none.txt"),
        ("encoding_error", "train/labels/bad.txt"), ("exif_orientation_not_normal", "x/c.jpg"), ("duplicate_images_conflicting_labels", "s1"), ("duplicate_images_conflicting_labels", "s3"),
    }
    assert audit.file_issues(f.limit(0), i.limit(0)).count() == 0


def test_previews(spark):
    rows = [(1, b"AADHAAR  1234\t56\r\nSecret 0.5\n\nx"), (2, b"\xff\xfe\x00"), (3, b""), (4, "é".encode() * 3), (5, None), (6, b"a\n")]
    got = {r.k: (r.size_bytes, r.encoding, r.lines, r.truncated) for r in inventory.preview_files(spark.createDataFrame(rows, "k INT, c BINARY"), "k", "c", 3, 40).collect()}
    assert got[1] == (31, "utf-8", ["XXXXXXX #### 56", "Xxxxxx 0.5", ""], False) and got[2] == (3, "binary", None, None) and got[3] == (0, "utf-8", [], False) and got[6] == (2, "utf-8", ["x"], False)
    assert {r.k: r.encoding for r in inventory.preview_files(spark.createDataFrame(rows, "k INT, c BINARY"), "k", "c", 3, 3).collect()}[4] == "binary"


MAP = [("aadhaar", 0, "aadhaar_number"), ("aadhaar", 1, "name"), ("aadhaar", 3, "pan_number"), ("aadhaar", 4, None), ("aadhaar", 5, None)]
IMAGES = "image_id BIGINT, rel_path STRING, document_type STRING, width INT, height INT, label_path STRING, split STRING"


@pytest.mark.parametrize(
    "text,error",
    [
        ("0 .5 .5 .2 .1\n\n 1 .1 .1 .2 .2 .3 .1", None), ("9 .5 .5 .2 .1", "unmapped_class"), ("0 .5 .5 .2", "coordinate_count"), ("3 .5 .5 .2 .1", "field_not_of_type"), ("x .5 .5 .2 .1", "malformed_line"), ("1.0 .5 .5 .2 .1", "malformed_line"),
        ("0 .5 .5 y .1", "malformed_line"), ("0 .5 .5 -.2 .1", "reversed_box"), ("4 .5", None), ("5 .5 .5 .1 .1", None), ("1 .5 .5 .1 .1\n9 .5 .5 .1 .1\n0 x", "unmapped_class"), ("", None), (None, None), ("0 1.5 .5 .2 .1", None),
    ],
)
def test_converted_documents(spark, text, error):
    lines = [("f", i, x, "clash") for i, x in enumerate((text or "").split("\n"), 1)] + [("f", 1, (text or "").split("\n")[0], "again")]
    m = spark.createDataFrame([("a", "valid", "g", "h")], "stem STRING, target_split STRING, source_group_id STRING, sha256 STRING")
    images = [(1, "train/images/a.jpg", "aadhaar", 100, 50, "f" if text is not None else None, None), (2, "train/images/b.jpg", "aadhaar", 0, 0, "f", None), (3, "x.jpg", "aadhaar", 9, 9, None, "test"), (4, "train/images/c.jpg", "aadhaar", 9, 9, None, "")]
    args = (spark.createDataFrame(images, IMAGES), spark.createDataFrame(lines, "label_path STRING, line INT, raw STRING, error STRING").drop("error"), spark.createDataFrame(MAP, "document_type STRING, class_id BIGINT, field_name STRING"))
    got = {r.image_id: r for r in conversion.convert_documents(*args, m).collect()}
    assert (got[1].ok, got[1].error) == (error is None, error) and got[2].error == "missing_image" and got[3].ok and got[3].fields == []
    assert (got[1].split, got[1].source_group_id, got[1].sha256, got[3].split, got[4].split) == ("valid", "g", "h", "test", "train")
    if text and text.startswith("0 .5 .5 .2 .1"):
        a, b = got[1].fields
        assert (a.field_name, a.class_id, a.status, a.kind, round(a.x1, 6), round(a.y2, 6), a.points) == ("aadhaar_number", 0, "missing", "bbox", 0.4, 0.55, None)
        assert (b.kind, b.x1, b.y1, b.x2, b.y2, len(b.points)) == ("polygon", 0.1, 0.1, 0.3, 0.2, 3)
    if text and text[0] in "45":
        assert got[1].n_excluded == (text[0] == "4") and got[1].fields == []
    s = conversion.conversion_stats(conversion.convert_documents(*args, m)).first()
    assert (s.input_images, s.converted_documents) == (4, 2 + (error is None))


def test_queue_with_a_hot_source(spark):
    rows = [(i, "big" if i % 2 else f"s{i % 5}", "x", i) for i in range(200)] + [(900, None, "x", 1), (901, "", "x", 1)]
    df = spark.createDataFrame(rows, "id BIGINT, src STRING, depth STRING, n INT").drop("depth")
    got = queues.round_robin(df, "src", "id", scratch=Scratch(spark, "t")).collect()
    by = {}
    for r in got:
        by.setdefault(r.src, []).append(r.depth)
    assert all(sorted(d) == list(range(1, len(d) + 1)) for d in by.values()) and len(got) == 202 and by[None] == by[""] == [1]
    few = queues.representative_sample(df, "src", "id", 16).collect()
    assert len(few) == 16 and [r.depth for r in few] == sorted(r.depth for r in few) and {r.depth for r in few} == {1, 2, 3}
    assert queues.round_robin(df.limit(0), "src", "id").count() == 0


def test_files_fit(spark):
    rows = [("a.txt", "0 .5 .5 .1 .1\n\n"), ("a.csv", "0 .5 .5 .1 .1"), ("b.txt", ""), ("c.txt", "0 .5\n"), ("D.TXT", "1 .5 .5 .1 .1 .2 .2"), ("e.txt", "1.5 .5 .5 .1 .1"), ("f.txt", None)]
    got = {r.path: r.fits for r in labels.files_fit(spark.createDataFrame(rows, "path STRING, content STRING")).collect()}
    assert got == {"a.txt": True, "a.csv": False, "b.txt": False, "c.txt": False, "D.TXT": True, "e.txt": False, "f.txt": False}
