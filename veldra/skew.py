"""Joins on keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than total / HOT_PARTS rows, so there are fewer than HOT_PARTS hot keys
#: whatever the data: the hot part of the unique side may be broadcast, its size doesn't grow.
HOT_PARTS = 512
#: Below this many rows a key is never hot: one task reads them easily.
HOT_LEAST = 20_000


def hot_limit(total: int) -> int:
    return max(HOT_LEAST, total // HOT_PARTS)


def hot_join(big: DataFrame, unique: DataFrame, key: str, n: str, total: int, most: int | None = None, how: str = "inner") -> DataFrame:
    """``big`` joined to ``unique`` (one row per key, ``n`` = rows of the key in ``big``) without a hot task.

    Rows of hot keys never move: they meet the at most HOT_PARTS hot rows of ``unique`` by broadcast. All
    other keys are shuffled. ``total`` is the number of rows of ``big``, ``most`` the largest ``n`` if known:
    with no hot key the plain join is planned. ``how``: inner, left or left_semi. Null keys match nothing.
    """
    limit = hot_limit(total)
    if most is not None and most <= limit:
        return big.join(unique.drop(n), key, how)
    hot = F.broadcast(unique.where(F.col(n) > limit))
    cold = big.join(hot.select(key), key, "left_anti").join(unique.where(F.col(n) <= limit).drop(n), key, how)
    inner = "left_semi" if how == "left_semi" else "inner"
    return cold.unionByName(big.join(hot.drop(n), key, inner))


def hot_keys(rows: DataFrame, key: str, total: int, n: str | None = None, most: int | None = None) -> list:
    """The fewer than HOT_PARTS keys with more than ``hot_limit(total)`` of the ``total`` rows. ``n``: ``rows`` are keys with their
    numbers of rows, of which ``most`` is the largest; otherwise ``rows`` are counted, if any key can be hot at all."""
    limit = hot_limit(total)
    if total <= limit or (most is not None and most <= limit):
        return []
    counted = rows.select(key, F.col(n).alias("_n")) if n else rows.groupBy(key).agg(F.count("*").alias("_n"))
    return [r[0] for r in counted.where(F.col("_n") > limit).select(key).collect()]


def keyed_join(big: DataFrame, unique: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """``big`` joined to ``unique`` (one row per key) on a number ``key`` whose hot values are known: rows of those stay where they
    are and meet the hot rows of ``unique`` by broadcast. ``how``: inner, left, left_semi or left_anti; null keys match nothing
    and are kept by left and left_anti."""
    if not hot:
        return big.join(unique, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = big.where(~is_hot).join(unique.where(~is_hot), key, how)
    return cold.unionByName(big.where(is_hot).join(F.broadcast(unique.where(is_hot)), key, how))


def salt(parts: int, *cols: Column | str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(parts)).cast("int")


#: Classes of keys by hash. No key has more rows than its class, so small classes show at little cost that there is no hot key.
CLASSES = 1 << 14


def _by_class(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(F.pmod(F.xxhash64(key), F.lit(CLASSES)).alias("_c")).agg(F.count("*").alias(name))


def hot_lookup(big: DataFrame, unique: DataFrame, key: str, scratch, how: str = "inner") -> DataFrame:
    """``hot_join`` that counts the rows of each key of ``big`` itself; ``scratch`` keeps the counted table.
    ``how``: inner or left_semi. Null keys match nothing and take no part."""
    rows = big.where(F.col(key).isNotNull())
    total, most = _by_class(rows, key, "_n").agg(F.sum("_n"), F.max("_n")).first()
    if (most or 0) <= hot_limit(total or 0):
        return rows.join(unique, key, how)
    counted, f = scratch.measured(rows.groupBy(key).agg(F.count("*").alias("_n")).join(unique, key), "counted", total=F.sum("_n"), most=F.max("_n"))
    return hot_join(rows, counted, key, "_n", f["total"] or 0, f["most"] or 0, how)


#: Rows of a result that one task makes for a key.
TASK_PAIRS = 1 << 20
HOT_PAIRS = 100_000


def hot_expand(a: DataFrame, b: DataFrame, key: str, scratch, sizes: DataFrame | None = None) -> DataFrame:
    """All pairs of rows of ``a`` and ``b`` with an equal ``key`` that isn't null, without a hot task. For joins whose result is
    the pairs of copies themselves: where a key makes more than TASK_PAIRS of them, its rows of the larger side are cut into
    blocks and those of the smaller side go to each, so the work is spread in proportion to the result. A plain join otherwise.
    Rows of a side differ; ``sizes (key, _a, _b)``: rows per key of both sides, if known. At most the HOT_PAIRS largest keys are cut, so
    that they may be broadcast: any other makes less than that part of all pairs."""
    a, b = a.where(F.col(key).isNotNull()), b.where(F.col(key).isNotNull())
    if sizes is None:
        most = _by_class(a, key, "_a").join(_by_class(b, key, "_b"), "_c").agg(F.max(F.col("_a") * F.col("_b").cast("double"))).first()[0]
        if (most or 0) <= TASK_PAIRS:
            return a.join(b, key)
    n = sizes if sizes is not None else a.groupBy(key).agg(F.count("*").alias("_a")).join(b.groupBy(key).agg(F.count("*").alias("_b")), key)
    pairs = F.col("_a") * F.col("_b").cast("double")
    hot = scratch.keep(n.where(pairs > TASK_PAIRS).orderBy(pairs.desc()).limit(HOT_PAIRS), "hot")
    if hot.isEmpty():
        return a.join(b, key)
    blocks = hot.select(key, F.least(F.greatest("_a", "_b"), F.ceil(F.col("_a") * F.col("_b").cast("double") / TASK_PAIRS).cast("bigint")).alias("_n"), (F.col("_a") >= F.col("_b")).alias("_cut"))

    def placed(side: DataFrame, cut: bool) -> DataFrame:
        j = side.join(F.broadcast(blocks), key, "left")
        own = F.when(F.col("_n").isNull(), F.array(F.lit(0).cast("bigint")))
        one = F.array(F.pmod(F.xxhash64(*side.columns), F.col("_n")))
        every = F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)
        return j.withColumn("_block", F.explode(own.when(F.col("_cut") == F.lit(cut), one).otherwise(every))).drop("_n", "_cut")

    return placed(a, True).join(placed(b, False), [key, "_block"]).drop("_block")
