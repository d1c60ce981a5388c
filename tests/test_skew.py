from pyspark.sql import functions as F

from veldra import skew
from veldra.storage import Scratch, scratch_root


def test_hot_join_is_the_plain_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_LEAST", 5)
    monkeypatch.setattr(skew, "HOT_PARTS", 4)
    big = spark.range(100).select(F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 10 == 1, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    uniq = spark.range(0, 80).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    counted = big.where("k is not null").groupBy("k").agg(F.count("*").alias("n")).join(uniq, "k")
    for how in ("inner", "left_semi"):
        want = sorted(map(str, big.join(uniq, "k", how).collect()))
        assert sorted(map(str, skew.hot_join(big, counted, "k", "n", 100, how=how).collect())) == want
        assert sorted(map(str, skew.hot_lookup(big, uniq, "k", Scratch(spark, "t"), how).collect())) == want


def test_scratch_tables(spark):
    s = Scratch(spark, "t")
    a = s.keep(spark.range(3).toDF("a"), "x")
    b = s.keep(a.where("a > 0"), "x", replaces=a)
    assert b.count() == 2 and scratch_root(spark)
    c = s.keep(b, "x")
    s.only(c)
    assert c.count() == 2 and s._paths == {c._veldra_scratch[1]}
    assert s.keep(spark.range(0).toDF("a"), "empty").count() == 0
