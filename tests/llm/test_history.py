import random

from pyspark.sql import functions as F

from veldra.llm import incremental
from veldra.storage import Scratch, delete_path

S = ["%064x" % (i * 0x1234567 + i) for i in range(400)]


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def bits(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")


def rows_of(seed):
    rnd, out = random.Random(seed), []
    pool = [rnd.getrandbits(64) for _ in range(25)]
    for i in range(120):
        h = rnd.choice(pool) ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice((0, 1, 2, 3, 12))))
        out.append((rnd.choice((None, S[rnd.randrange(400)])), rnd.choice((None, 0, signed(h), signed(h)))))
    return out


def brute(history, batches):
    seen, found = [(0, *x) for x in history], {}
    for no, rows in batches.items():
        for i, sha, h in rows:
            hit = [f for f, s, g in seen if (sha and s == sha) or (h and g and bits(h, g) <= 2)]
            if hit:
                found[i] = min(hit) == 0
            seen.append((i, sha, h))
    return found


def incoming(spark, no, rows):
    return spark.createDataFrame([(i, no, sha, h, "clash") for i, sha, h in rows], "incoming_id BIGINT, batch_no INT, sha256 STRING, dhash BIGINT, first STRING")


def test_batches_against_a_stored_index(spark):
    scratch = Scratch(spark, "t")
    history, path = rows_of(1), scratch.path("index")
    batches = {no: [(1000 * no + i, *x) for i, x in enumerate(rows_of(no))] for no in (2, 3, 4)}
    index = incremental.PivotIndex(spark, path)
    index.append(incremental.read_records(spark.createDataFrame(history, "sha256 STRING, dhash BIGINT")), 0)
    want, got = brute(history, batches), {}
    for no, rows in batches.items():
        index = incremental.PivotIndex(spark, path)  # opened anew for each batch
        for _ in range(2):  # a batch that runs again changes nothing
            one = {r.incoming_id: r.known for r in incremental.accept(index, incoming(spark, no, rows), Scratch(spark, "t")).collect()}
            assert one == {i: k for i, k in want.items() if i // 1000 == no}
        got |= one
    assert got == want and index.batches() == [0, 2, 3, 4]
    n = index.table().count()
    delete_path(spark, f"{path}/done/4")  # as if its appending had been cut off
    assert index.table().count() < n and index.batches() == [0, 2, 3]
    assert {r.incoming_id for r in incremental.accept(index, incoming(spark, 4, batches[4]), Scratch(spark, "t")).collect()} == {i for i in want if i // 1000 == 4}
    assert index.table().count() == n
    at_once = incremental.repeats(spark.createDataFrame(history, "sha256 STRING, dhash BIGINT"), incoming(spark, 2, sum(batches.values(), [])), Scratch(spark, "t"))
    assert {r.incoming_id: r.known for r in at_once.collect()} == want


def test_a_batch_reads_the_ranges_that_it_has_keys_in(spark, monkeypatch):
    monkeypatch.setattr(incremental, "SMALL_BATCH", 10)
    index = incremental.PivotIndex(spark, Scratch(spark, "t").path("index"), ranges=16)
    index.append(spark.createDataFrame([(x, 0) for _, x in rows_of(1) + rows_of(2) if x], "h BIGINT, first BIGINT"), 0)
    q = incremental.keyed(spark.createDataFrame([(5, 0)], "h BIGINT, first BIGINT"), 16)
    touched = [r.r for r in q.select("r").distinct().collect()]
    read, there = set(index.table(touched).select("_metadata.file_path").distinct().toPandas().file_path), set(index.table().select("_metadata.file_path").distinct().toPandas().file_path)
    assert len(touched) <= 6 and len(there) > 20 and read < there and len(read) < len(there) / 4


def test_hot_keys_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(incremental, "HOT_KEY", 3)
    rnd = random.Random(4)
    hs = [signed(0xAAAA_BBBB << 32 | rnd.getrandbits(5) << 20 | rnd.getrandbits(3)) for _ in range(150)]
    index = incremental.PivotIndex(spark, Scratch(spark, "t").path("index"))
    index.append(spark.createDataFrame([(h, 0) for h in hs[:80]], "h BIGINT, first BIGINT"))
    asked = spark.createDataFrame([(h,) for h in hs[80:]], "h BIGINT")
    assert {r.q for r in index.probe(asked).collect()} == {h for h in hs[80:] if any(bits(h, x) <= 2 for x in hs[:80])}
    assert "f" in index._split(incremental.keyed(asked.withColumn("first", F.lit(0))).withColumnRenamed("h", "q"), index.table())[2]


def test_empty(spark):
    index = incremental.PivotIndex(spark, Scratch(spark, "t").path("index"))
    none = incoming(spark, 1, [(1, None, None)])
    assert incremental.accept(index, none.limit(0), Scratch(spark, "t")).count() == 0 and index.batches() == []
    assert incremental.accept(index, none, Scratch(spark, "t")).count() == 0 and index.batches() == [1]
