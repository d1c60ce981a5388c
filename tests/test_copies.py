import random

from veldra import skew
from veldra.operators import compaction
from veldra.storage import Scratch

from test_compaction import files


def test_pairs_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_PAIRS", 50)
    rnd = random.Random(2)
    a = [(i, "hot" if i % 3 == 0 else rnd.choice("xyz")) for i in range(90)] + [(1, None)]
    b = [(i, "hot" if i % 2 == 0 else rnd.choice("xyw")) for i in range(40)] + [(2, None)]
    for left, right in ((a, b), (b, a)):
        x, y = spark.createDataFrame(left, "p BIGINT, k STRING"), spark.createDataFrame(right, "q BIGINT, k STRING")
        got = sorted((r.p, r.q) for r in skew.hot_expand(x, y, "k", Scratch(spark, "t")).collect())
        assert got == sorted((i, j) for i, k in left for j, m in right if k and k == m)
        assert skew.hot_expand(x.limit(0), y, "k", Scratch(spark, "t")).count() == 0


def test_groups_and_stored_bundles(spark, tmp_path):
    f = files(spark)
    b = Scratch(spark, "t").keep(compaction.bundles(f, 1000), "b")
    assert {tuple(r) for r in compaction.relisted_groups(f, b).collect()} == {(1, 1, 2), (2, 1, 2)}
    got = compaction.store_bundles(b, str(tmp_path / "out")).collect()
    assert len(got) == b.where("n_bytes > 0").count() and all(r.ok for r in got)
    data = {r.bundle: bytes(r.data) for r in b.collect()}
    for p in (tmp_path / "out").glob("kind=*/bundle=*/part-*"):
        assert p.read_bytes().rstrip(b"\n") == data[p.parent.name.split("=")[1]].rstrip(b"\n")
    next((tmp_path / "out").glob("kind=*/bundle=*/part-*")).unlink()
    assert compaction.store_bundles(compaction.bundles(f.limit(0)), str(tmp_path / "none")).count() == 0
