import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldra.functions import kernels
from veldra.plans import extension
from veldra.sources import images, tables
from veldra.streaming import decisions


def png(pixels: np.ndarray, kind: int = 0) -> bytes:
    h, w = pixels.shape[:2]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    p, out = pixels.reshape(h, -1).astype(int), b""
    c = 1 if pixels.ndim == 2 else 3
    for y in range(h):
        up = p[y - 1] if y else np.zeros_like(p[0])
        left = np.concatenate([np.zeros(c, int), p[y][:-c]])
        corner = np.concatenate([np.zeros(c, int), up[:-c]])
        q = left + up - corner
        paeth = np.where((abs(q - left) <= abs(q - up)) & (abs(q - left) <= abs(q - corner)), left, np.where(abs(q - up) <= abs(q - corner), up, corner))
        guess = [0, left, up, (left + up) // 2, paeth][kind]
        out += bytes([kind]) + ((p[y] - guess) % 256).astype(np.uint8).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0 if c == 1 else 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_png_round_trip_for_each_filter():
    rnd = np.random.default_rng(1)
    for shape in ((20, 30), (9, 7, 3)):
        a = rnd.integers(0, 256, shape, dtype=np.uint8)
        for kind in range(5):
            assert (images.decode_png(png(a, kind)).reshape(shape) == a).all()


def test_png_writer(spark):
    a = np.arange(60, dtype=np.uint8).reshape(5, 12)
    assert (images.decode_png(images.encode_png(a))[..., 0] == a).all() and images.decode_png(images.encode_png(np.stack([a] * 3, 2))).shape == (5, 12, 3)
    df = spark.createDataFrame([(1, 5, 12, bytearray(a.tobytes()))], "index BIGINT, height INT, width INT, pixels BINARY")
    assert bytes(images.encode_lines(df).first().content) == images.encode_png(a)
    with pytest.raises(ValueError):
        images.encode_png(np.zeros((2, 2, 4)))


def test_facts_of_images(spark):
    ramp = np.tile(np.arange(200, 0, -2, dtype=np.uint8), (50, 1))
    jpeg = b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03" + b"\0" * 20
    df = spark.createDataFrame([("a.png", png(ramp)), ("b.jpg", jpeg), ("c", b"no image"), ("d", None), ("e.png", png(ramp)[:40])], "path STRING, content BINARY")
    r = {x.path: x for x in images.inspect_images(df).collect()}
    assert (r["a.png"].width, r["a.png"].height, r["a.png"].dhash, r["a.png"].ok) == (100, 50, -1, True)
    assert (r["b.jpg"].format, r["b.jpg"].width, r["b.jpg"].height) == ("JPEG", 32, 16) and not r["c"].ok and not r["d"].ok and not r["e.png"].ok


def test_documents_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("d1", "pan", "a.png", (3, 4), [("name", ([0.1, 0.2, 0.3, 0.4], None, True), (None, "missing", None))], ("pan", "train", None, None), {"k": "v"})], tables.DOCUMENT)
    tables.write_documents(df, str(tmp_path / "d"))
    assert tables.read_documents(spark, str(tmp_path / "d")).collect() == df.collect()


def test_manifest_round_trip(spark, tmp_path):
    rows = [("pan", "b", f"f{i}", "train", "train", f"g{i}", "single_source", "high", "hash", -1 if i else None, 1, 2, 3, 'say "x", twice') for i in range(3)]
    schema = "dataset STRING, image_rel_path STRING, filename STRING, raw_split STRING, target_split STRING, source_group_id STRING, grouping_method STRING, confidence STRING, sha256 STRING, dhash BIGINT, width INT, height INT, annotation_count INT, notes STRING"
    tables.write_manifest(spark.createDataFrame(rows, schema), str(tmp_path / "m"))
    got = tables.read_manifest(spark, str(tmp_path / "m")).collect()
    assert [r.source_group_id for r in got] == ["g0", "g1", "g2"] and got[1].dhash == "f" * 16 and not got[0].dhash and got[1].notes == 'say "x", twice' and got[1].width == "1"


def test_benchmark_versions(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"format_version": 1, "name": "x", "queues": {"f": ["s1"]}}')
    (tmp_path / "b.json").write_text('{"format_version": 9}')
    assert tables.read_benchmark(spark, str(tmp_path / "a.json")).first().queues == {"f": ["s1"]}
    with pytest.raises(ValueError):
        tables.read_benchmark(spark, str(tmp_path / "b.json"))


def test_by_split(spark, tmp_path):
    p = str(tmp_path / "s")
    df = spark.createDataFrame([(1, "train"), (2, "test")], "x INT, target_split STRING")
    tables.write_by_split(df, p)
    tables.write_by_split(df.where("x = 2").withColumn("x", F.lit(5)), p)
    assert {tuple(r) for r in spark.read.parquet(p).collect()} == {(1, "train"), (5, "test")}


def test_log_stream(spark, tmp_path):
    log, table = str(tmp_path / "log"), str(tmp_path / "table")
    schema = "line_no BIGINT, sample_id STRING, status STRING, text STRING, recorded_at TIMESTAMP"
    tables.append_decisions(spark.createDataFrame([(1, "a", "skipped", None, None), (2, "b", "verified", "x", None)], schema), log)
    (tmp_path / "log" / "torn.txt").write_text('{"line_no": 9, "sample_id": "b", "sta\n{"line_no": 8, "sample_id": "b", "status": "odd"}\n')
    run = lambda: decisions.keep_latest(decisions.read_log(spark, log), table, str(tmp_path / "cp")).awaitTermination()
    run()
    tables.append_decisions(spark.createDataFrame([(3, "a", "verified", "y", None)], schema), log)
    run()
    last = max((tmp_path / "table").iterdir(), key=lambda p: int(p.name[1:]))
    assert {(r.sample_id, r.status, r.line_no) for r in spark.read.parquet(str(last)).collect()} == {("a", "verified", 3), ("b", "verified", 2)}
    with pytest.raises(Exception):
        tables.append_decisions(spark.createDataFrame([(4, "a", "verified", None, None)], schema), log)
    batch = decisions.parse_log(spark.read.text(log))
    assert decisions.latest_stream(batch).count() == 2 and decisions.counts_by_window(batch.withColumn("recorded_at", F.current_timestamp())).count() == 2


def test_kernels():
    a = np.full((30, 60), 255, np.uint8)
    a[10:20, 5:50] = 0
    assert kernels.fit_line(a).shape[0] == 48 and kernels.ink_rows(a) == (10, 20) and kernels.ink_rows(np.full((3, 3), 255)) is None
    steps = [(0.9, k) for k in (kernels.horizontal_scale(), kernels.margin_jitter(), kernels.edge_line(), kernels.contrast_remap(), kernels.illumination(), kernels.paper_texture(), kernels.downsample(), kernels.blur(), kernels.noise())]
    one = kernels.compose(steps)(a, kernels.generator(1, 2, 3))
    assert (one == kernels.compose(steps)(a, kernels.generator(1, 2, 3))).all() and one.dtype == np.uint8
    assert kernels.line_statistics(a, "abc")["px_per_char"] == 20
    with pytest.raises(ValueError):
        kernels.fit_line(a, height=8, pad_y=4)


def test_augmented_lines(spark):
    a = np.full((48, 120), 255, np.uint8)
    a[15:35, 10:100] = 10
    df = spark.createDataFrame([(i, "abc", 48, 120, bytearray(a.tobytes())) for i in range(12)], "index BIGINT, text STRING, height INT, width INT, pixels BINARY")
    one = {r["index"]: bytes(r.pixels) for r in kernels.augment_lines(df, 1, 0).collect()}
    assert one == {r["index"]: bytes(r.pixels) for r in kernels.augment_lines(df.repartition(5), 1, 0).collect()} and len(set(one.values())) > 1
    for k in (kernels.small_affine(), kernels.color_tint(), kernels.glyph_scale(text="abc")):
        assert k(a, kernels.generator(1, 1, 1)).dtype == np.uint8
    assert kernels.augment_lines(df.limit(0), 1, 0).count() == 0


def test_extension_points(spark):
    good = spark.createDataFrame([(1, "f", 1, "0 .5 .5 .1 .1")], "row_id INT, label_path STRING, line INT, raw STRING")
    assert extension.inspector_for(good).inspect(good).first().kept and extension.inspector_for(good.withColumn("raw", F.lit("x"))) is None

    def detect(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pylist([{"doc_id": i, "idx": 0, "field": "pan_number", "det": 0.9} for i in b.column(0).to_pylist()], schema=pa.schema([("doc_id", pa.int64()), ("idx", pa.int32()), ("field", pa.string()), ("det", pa.float64())]))

    def read(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(["ABCPK1234F"] * b.num_rows), pa.array([0.5] * b.num_rows)], names=[*b.schema.names, "text", "rec"])

    s = "doc_id BIGINT, idx INT, field STRING, det DOUBLE"
    out = extension.run_pipeline(spark.createDataFrame([(7, b"")], "doc_id BIGINT, content BINARY"), detect, read, s, s + ", text STRING, rec DOUBLE")
    assert out["types"].first().document_type == "pan" and {r.field for r in out["fields"].collect()} == set(extension.documents.FIELDS["pan"]) and out["issues"].count() == 3
