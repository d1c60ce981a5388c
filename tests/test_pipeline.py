import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veldra.operators import benchmark
from veldra.plans import extension as E
from veldra.sources import images


def test_truncated_and_turned_images():
    head = b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03" + b"\0" * 11
    scan = b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00abc"
    whole, cut = images.inspect(head + scan + b"\xff\xd9"), images.inspect(head + scan)
    assert (whole["ok"], whole["width"], whole["height"]) == (True, 32, 16) and (cut["ok"], cut["error"]) == (False, "Truncated")
    a = np.arange(6).reshape(2, 3)
    want = {None: a, 1: a, 2: a[:, ::-1], 3: a[::-1, ::-1], 4: a[::-1], 5: a.T, 6: np.rot90(a, -1), 7: np.rot90(a, 2).T, 8: np.rot90(a, 1), 9: a}
    assert all((images.upright(a, k) == v).all() for k, v in want.items())
    assert images.as_rgb(a).shape == (2, 3, 3) and images.as_rgb(np.zeros((2, 2, 4))).shape == (2, 2, 3)


def models():
    """Classes made in a function go to the workers by value."""

    class Boxes(E.Detector):
        schema, max_regions = "doc_id BIGINT, idx BIGINT, field STRING, det DOUBLE", 3

        def detect(self, batches):
            for b in batches:
                rows = [(d, i, f, s) for d in b.column(0).to_pylist() for i, (f, s) in enumerate([("name", 0.2), ("aadhaar_number", 0.9), ("date_of_birth", 0.8), ("gender", 0.1), ("name", 0.7)])]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.float64()))], names=["doc_id", "idx", "field", "det"])

    class Texts(E.Recognizer):
        schema = "doc_id BIGINT, idx BIGINT, field STRING, det DOUBLE, text STRING, rec DOUBLE"

        def recognize(self, batches):
            for b in batches:
                said = {"aadhaar_number": " 1234 5678 9012\t", "date_of_birth": "31/02/2000", "name": "A"}
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([said.get(f) for f in b.column(2).to_pylist()]), pa.array([0.5] * b.num_rows)], names=["doc_id", "idx", "field", "det", "text", "rec"])

    return Boxes(), Texts()


def test_pipeline_validates(spark):
    out = E.run(spark.createDataFrame([(7, b""), (8, b"")], "doc_id BIGINT, content BINARY"), *models())
    kept = [(r.idx, r.field) for r in out["texts"].where("doc_id = 7").orderBy("idx").collect()]
    assert kept == [(0, "aadhaar_number"), (1, "date_of_birth"), (2, "name")]
    assert {(r.doc_id, r.document_type) for r in out["types"].collect()} == {(7, "aadhaar"), (8, "aadhaar")}
    assert {r.field: r.value for r in out["fields"].where("doc_id = 7").collect()} == {"aadhaar_number": "1234 5678 9012", "date_of_birth": "31/02/2000", "name": "A", "gender": None}
    assert {(r.doc_id, r.code) for r in out["problems"].collect()} == {(d, c) for d in (7, 8) for c in ("aadhaar_checksum_mismatch", "invalid_date")}
    assert {(r.field, r.issue) for r in out["issues"].where("doc_id = 7").collect()} == {("gender", "missing_field")}

    class Odd(E.DocumentValidator):
        def problems(self, fields, today):
            return F.array(F.lit("odd"))

    assert E.validate(out["fields"], {"aadhaar": Odd()}).count() == 2 and E.validate(out["fields"], {}).count() == 0


def test_converter_class(spark):
    m = spark.createDataFrame([("aadhaar", 0, "name")], "document_type STRING, class_id BIGINT, field_name STRING")
    i = spark.createDataFrame([(1, "train/images/a.jpg", "aadhaar", 9, 9, "f")], "image_id BIGINT, rel_path STRING, document_type STRING, width INT, height INT, label_path STRING")
    r = E.LineConverter(m).convert(i, spark.createDataFrame([("f", 1, "0 .5 .5 .1 .1")], "label_path STRING, line INT, raw STRING")).first()
    assert r.ok and len(r.fields) == 1 and r.split == "train"


def test_benchmark(spark, tmp_path):
    crops = spark.createDataFrame([("a", b"1"), ("b", b"2"), ("b", b"3")], "path STRING, content BINARY")
    samples = spark.createDataFrame([("s1", "name", "a"), ("s2", "name", "b")], "sample_id STRING, field STRING, path STRING")
    at = str(tmp_path / "m")
    benchmark.freeze(samples.where("path = 'a'"), crops, at)
    with pytest.raises(Exception):
        benchmark.freeze(samples.where("path = 'a'"), crops, at)
    with pytest.raises(Exception):
        benchmark.freeze(samples, crops.where("path = 'a'"), str(tmp_path / "n"))
    m = benchmark.read_frozen(spark, at).select("sample_id", "path", "sha256").union(spark.createDataFrame([("s2", "b", "0"), ("s3", "c", "0")], "sample_id STRING, path STRING, sha256 STRING"))
    got = {r.sample_id: (r.status, r.content) for r in benchmark.verified_crops(m, crops).collect()}
    assert got == {"s1": ("ok", bytearray(b"1")), "s2": ("digest_mismatch", None), "s3": ("missing_crop", None)}
    refs = spark.createDataFrame([("s1", "name", "ab"), ("s2", "gender", "x"), ("s3", "gender", None)], "sample_id STRING, field STRING, reference STRING")
    r = {x.field: x for x in benchmark.evaluate(spark.createDataFrame([("s1", "ab"), ("s1", "aa"), ("s9", "z")], "sample_id STRING, prediction STRING"), refs).collect()}
    assert (r["name"].cer, r["gender"].cer, r[None].n, r[None].exact_share) == (0, 1, 2, 0.5)
