import random

import pytest
from pyspark.sql import functions as F

from veldra.llm import incremental, overlap
from veldra.storage import Scratch


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def family(n=60, seed=3):
    rnd, out = random.Random(seed), []
    for _ in range(n):
        h = rnd.getrandbits(64)
        out += [h] + [h ^ sum(1 << b for b in rnd.sample(range(64), k)) for k in (1, 2, 3, 4)]
    return [signed(x) for x in out] + [0, None, -1, 1]


def bits(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")


@pytest.mark.parametrize("hot", [2_000, 2])
def test_near_hashes_lose_nothing(spark, monkeypatch, hot):
    monkeypatch.setattr(overlap, "HOT_GRAM", hot)
    monkeypatch.setattr(overlap.hot_grams, "__defaults__", (hot,))
    hs = family() + [signed(0xAAAA_BBBB_0000_0000 | (i * 2654435761 & 0xFFFFFFFF)) for i in range(40)] + [signed(0xAAAA_BBBB_0000_0000 | (1 << i)) for i in range(32)]
    hs = [h for h in hs if h is not None]
    left, right = hs[::2], hs[1::2]
    a, b = (spark.createDataFrame([(h,) for h in x], "h BIGINT") for x in (left, right))
    got = {(r.e, r.t): r for r in overlap.near_hashes(a, b, Scratch(spark, "t")).collect()}
    assert set(got) == {(x, y) for x in left for y in right if bits(x, y) <= 2}
    assert all(r.bits == bits(*k) and r.hits >= 1 and (r.bits or r.containment == 1) for k, r in got.items())


SCHEMA = "image_id BIGINT, raw_split STRING, sha256 STRING, dhash BIGINT, roboflow_source STRING, h STRING"
S = ["%064x" % i for i in range(9)]


def test_overlaps(spark):
    rows = [
        (1, "train", S[1], 7 << 40, "a", "x"), (2, "test", "SHA256-" + S[1].upper(), None, "b", None), (3, "val", S[2], (7 << 40) ^ 3, "B", None), (4, "valid", S[3], (7 << 40) ^ 7, None, None), (5, "TRAIN ", S[4], 0, None, None),
        (6, "test", S[5], 0, None, None), (7, None, S[1], 7 << 40, None, None), (1, "train", S[1], 7 << 40, "a", "x"), (8, "test", None, None, None, None), (9, "train", None, None, None, None), (10, "test", S[1], 7 << 40, "b", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in overlap.overlap_pairs(df, Scratch(spark, "t")).collect()} == {(1, 2), (1, 3), (1, 10)}
    got = {(r.split, r.source): (r.n_images, r.n_same, r.n_like, r.n_overlap) for r in overlap.overlap_report(df, Scratch(spark, "t")).collect()}
    assert got == {("test", "b"): (2, 2, 1, 2), ("valid", "b"): (1, 0, 1, 1), ("valid", ""): (1, 0, 0, 0), ("test", ""): (2, 0, 0, 0)}
    assert overlap.overlap_pairs(df.limit(0), Scratch(spark, "t")).count() == overlap.overlap_report(df.limit(0), Scratch(spark, "t")).count() == 0


def test_pivot_probe_equals_brute_force_batch_by_batch(spark):
    hs = [h for h in family(40, 8) if h]
    old, batches = hs[:80], [hs[80:120], hs[120:]]
    index = incremental.PivotIndex(spark, Scratch(spark, "t").path("p"))
    index.append(spark.createDataFrame([(h, 0) for h in old], "h BIGINT, first BIGINT"))
    seen, n = list(old), 0
    for batch in batches:
        got = {r.q for r in index.probe(spark.createDataFrame([(h,) for h in batch], "h BIGINT")).collect()}
        assert got == {h for h in batch if any(bits(h, x) <= 2 for x in seen)}
        index.append(spark.createDataFrame([(h, n + i + 1) for i, h in enumerate(batch)], "h BIGINT, first BIGINT"))
        seen, n = seen + batch, n + len(batch)


def test_triangle_keys(spark):
    d = spark.createDataFrame([(h,) for h in family(5) if h is not None], "h BIGINT").withColumn("first", F.lit(0).cast("bigint"))
    r = incremental.keyed(d).collect()
    assert len(r) == 6 * d.count() and all(0 <= x.r < 24 and 0 <= x.key for x in r)


def test_repeats(spark):
    history = spark.createDataFrame([(S[1], 5 << 30), (None, None), (S[2], 0)], "sha256 STRING, dhash BIGINT")
    rows = [(1, 1, "sha256:" + S[1], None), (2, 1, S[3], (5 << 30) ^ 3), (3, 1, S[4], (5 << 30) ^ 7), (4, 2, S[4], 0), (5, 2, None, None), (6, 2, S[6], 9 << 50), (7, 3, S[7], 9 << 50), (7, 3, S[7], 9 << 50), (8, 3, S[8], 0)]
    new = spark.createDataFrame(rows, "incoming_id BIGINT, batch_no INT, sha256 STRING, dhash BIGINT")
    got = {r.incoming_id: r.known for r in incremental.repeats(history, new, Scratch(spark, "t")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 7: False}
