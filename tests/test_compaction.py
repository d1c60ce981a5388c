import datetime
import hashlib

import pytest
import zstandard
from pyspark.sql import functions as F

from veldra.operators import compaction

SCHEMA = "file_id BIGINT, kind STRING, file_path STRING, n_bytes BIGINT, content STRING, modified_at TIMESTAMP, bundle STRING"
T = [datetime.datetime(2025, 1, i) for i in range(1, 9)]


def files(spark):
    rows = [
        (1, "label", "a/b.txt", 3, "x 1", T[0], "clash"), (2, "label", "./a//b.txt", None, "x 1", T[1], None), (3, "label", "a/b.txt", 4, "x 2\n", T[2], None), (4, "label", "A/b.txt", 3, "x 1", T[0], None),
        (5, "label", "c.txt", 0, "", T[0], None), (6, "sample", "s.png", 9, '{"a": "é"}\n', T[0], None), (6, "sample", "s.png", 9, '{"a": "é"}\n', T[0], None), (7, "label", "long.txt", None, "y" * 5000, T[0], None), (8, None, None, None, "z", None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_pairs(spark):
    got = {(r[0], r[1]) for r in compaction.relisted_pairs(files(spark)).collect()}
    assert got == {(1, 2)}
    assert compaction.relisted_pairs(files(spark).limit(0)).count() == 0


def test_every_listed_row_is_in_one_member(spark):
    f = files(spark)
    for fmt in ("lines", "zstd"):
        b = compaction.bundles(f, 1000, fmt).cache()
        data = {r.bundle: bytes(r.data) for r in b.collect()}
        assert all(r.valid and hashlib.sha256(r.data).hexdigest() == r.sha256 and r.n_bytes == len(r.data) for r in b.collect())
        want = {r.file_id: (r.content or "").encode() for r in f.collect()}
        idx = compaction.index(f, b).collect()
        assert {r.file_id for r in idx} == set(want)
        for r in idx:
            piece = data[r.bundle][r.start : r.start + r.length]
            assert (zstandard.ZstdDecompressor().decompress(piece) if fmt == "zstd" else piece) == want[r.file_id]
        assert {r.file_id: r.latest for r in idx}[3] and not {r.file_id: r.latest for r in idx}[1]
        members = [m for r in b.collect() for m in r.members]
        assert len(members) == len({(m.place, m.digest) for m in members}) == 7


def test_lines_don_t_run_together(spark):
    b = compaction.bundles(files(spark).where("kind = 'label' and file_id < 5"), 1000).collect()
    assert sorted(b"".join(bytes(r.data) for r in b).decode().split()) == sorted("x 1 x 2 x 1".split())


def test_headers_once(spark):
    rows = [(i, "csv", f"{i}.csv", None, f"a,b\n{i},{i}\n", None, None) for i in range(4)]
    b = compaction.bundles(spark.createDataFrame(rows, SCHEMA), 1000, header=True).collect()
    assert bytes(b[0].data).decode().count("a,b") == 1 and b[0].valid


def test_written_files(spark, tmp_path):
    b = compaction.bundles(files(spark), 1000)
    got = compaction.write_bundles(b, str(tmp_path)).collect()
    assert all(r.ok for r in got) and len(list(tmp_path.iterdir())) == len(got)
    assert compaction.bundles(files(spark).limit(0)).count() == 0


def test_pairs_come_of_the_bundles(spark, tmp_path, monkeypatch):
    from veldra.plans import core_queries

    f = files(spark).union(spark.createDataFrame([(9, "sample", "a/b.txt", 3, "x 1", T[3], None)], SCHEMA))
    f.write.parquet(f"{tmp_path}/small_files.parquet")
    made, bundles = [], compaction.bundles
    monkeypatch.setattr(compaction, "bundles", lambda *a: made.append(a) or bundles(*a))
    got = {tuple(r) for r in core_queries.p5_found(spark, str(tmp_path)).collect()}
    assert len(made) == 1 and got == {(1, 2), (1, 9), (2, 9)} == {tuple(r) for r in compaction.relisted_pairs(f).collect()}
    broken = bundles(f).withColumn("valid", F.lit(False))
    with pytest.raises(Exception, match="invalid bundle"):
        compaction.bundled_pairs(f, broken).collect()
