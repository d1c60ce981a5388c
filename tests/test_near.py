import random

import pytest

from veldra.operators import grouping


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("most,k,hot", [(0, 1, 2000), (1, 1, 2), (2, 2, 2000), (3, 3, 1), (5, 2, 2000), (5, 3, 2), (5, 4, 1)])
def test_near_duplicates_lose_nothing(spark, monkeypatch, most, k, hot):
    monkeypatch.setattr(grouping, "_key_bands", lambda n, m: k)
    monkeypatch.setattr(grouping, "HOT_KEY", hot)
    rnd, hs = random.Random(most * 10 + k), [0, (1 << 64) - 1, 1]
    for _ in range(25):
        h = rnd.getrandbits(64)
        hs += [h ^ sum(1 << b for b in rnd.sample(range(64), n)) for n in range(most + 2)]
    hs += [rnd.getrandbits(12) | 0xABCD << 48 for _ in range(40)]
    hs = [signed(h) for h in hs]
    got = {(r.a, r.b): r.bits for r in grouping.near_duplicates(spark.createDataFrame([(h,) for h in hs + [None]], "h BIGINT"), most).collect()}
    dist = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    assert got == {(a, b): dist(a, b) for a in set(hs) for b in set(hs) if a < b and dist(a, b) <= most}


def test_keys_follow_the_number_of_hashes(spark):
    assert [grouping._key_bands(n, 5) for n in (100, 10_000, 1_000_000, 10**9)] == [1, 2, 3, 5] and grouping._key_bands(10**9, 2) == 2
    assert grouping.near_duplicates(spark.createDataFrame([], "h BIGINT"), 3).count() == 0
