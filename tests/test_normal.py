from pyspark.sql import functions as F

from veldra.functions import normal


def one(spark, f, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r.x for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_names(spark):
    got = one(spark, normal.name_key, ["Scan_01_Jpg\t", "scan-01.JPG", "scan 01 jpg.rf." + "0a" * 16, "scan_01b_jpg", " ", "N/A", "?", "Unknown", None])
    assert got == ["scan01jpg"] * 3 + ["scan01bjpg"] + [None] * 5


def test_splits(spark):
    assert one(spark, normal.split_name, [" trn", "TRAIN", "dev-valid", "val", "tst", "Testing ", "", None, "other"]) == ["train", "train", "valid", "valid", "test", "test", None, None, None]


def test_hashes(spark):
    h = "ab" * 32
    assert one(spark, normal.sha_key, [h, " " + h.upper(), "sha256:" + h, "SHA256-" + h, h[:-1], None, ""]) == [h] * 4 + [None] * 3
    assert one(spark, normal.dhash_key, [0, None, -1], "BIGINT") == [None, None, -1]


def test_places(spark):
    got = one(spark, normal.place_key, ["a/b.txt", "./a//b.txt ", ".\\a\\b.txt", "a/x/../b.txt", "/a/./b.txt", "a/B.txt", None, "", "../a/b.txt"])
    assert got == ["a/b.txt"] * 5 + ["a/B.txt", None, "", "a/b.txt"]
