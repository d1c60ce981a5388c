"""Decision logs, queues and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import Scratch
from ..vocab import SAMPLE_SOURCES, SPLITS
from .grouping import global_rank

# Decisions that a log may hold.
STATUSES = ["verified", "skipped", "unreadable"]


def latest(log: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last row of each key by ``order``. An aggregate with map-side combine, so a key with a long history costs
    no more than its last row."""
    rest = [c for c in values if c not in order]
    return log.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("l")).select(key, *[F.col(f"l.{c}").alias(c) for c in values])


def progress(queue: DataFrame, decided: DataFrame, field: str, item: str, statuses: list[str], done: str, target: int) -> DataFrame:
    """Per field: items by status, pending ones, ``complete`` (``done`` reached the target) and ``exhausted`` (it
    didn't and nothing is pending)."""
    j = queue.join(decided.select(item, "status"), item, "left")
    g = j.groupBy(field).agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in statuses], F.count(F.when(F.col("status").isNull(), 1)).alias("pending"))
    return g.withColumn("complete", F.col(done) >= target).withColumn("exhausted", (F.col(done) < target) & (F.col("pending") == 0))


def next_item(queue: DataFrame, decided: DataFrame, state: DataFrame, field: str, item: str, done: str) -> DataFrame:
    """The first undecided item, in queue order ``pos``, of the open field with the fewest done, ties by field."""
    open_ = state.where("not complete and pending > 0").agg(F.min_by(field, F.struct(done, field)).alias(field))
    left = queue.join(decided.select(item), item, "left_anti").join(F.broadcast(open_), field)
    return left.groupBy(field).agg(F.min(F.struct("pos", item)).alias("m")).select(field, F.col(f"m.{item}").alias(item))


def keyed_order(seed: int, *cols: Column | str) -> Column:
    """A shuffle that depends on the key alone, not on the order of rows."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]), 256)


def round_robin(items: DataFrame, source: str, key: str, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """``items`` with ``depth`` (place within the source, from 1) and ``source_order``: reading by both takes one item
    of each source per round.

    All items are range-partitioned by source and order at once and numbered by the sizes of the partitions, so a source that holds
    a third of them is spread over a third of the tasks; its first number (one row per source) is taken off."""
    scratch = scratch or Scratch(items.sparkSession, "queue")
    name = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit(""))  # null is a source of its own
    keyed = items.withColumn("_src", name).withColumn("_o", keyed_order(seed, source, key))
    ranked = scratch.keep(global_rank(keyed, ["_src", "_o", key], scratch, "_n"), "ranked")
    first = ranked.groupBy("_src").agg(F.min("_n").alias("_first"))
    out = ranked.join(F.broadcast(first) if first.count() <= SOURCES else first, "_src")
    return out.withColumn("depth", F.col("_n") - F.col("_first") + 1).withColumn("source_order", keyed_order(seed, source)).drop("_src", "_o", "_n", "_first")


#: Sources up to which the table of first numbers is broadcast.
SOURCES = 100_000


def representative_sample(items: DataFrame, source: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` items, one per source and round; all items if there are fewer. The size is the feature: of a source no more than ``n``
    can be in it, and a task keeps only those before anything is shuffled."""
    w = Window.partitionBy(source).orderBy("_o", key)
    few = items.withColumn("_o", keyed_order(seed, source, key)).withColumn("depth", F.row_number().over(w)).where(F.col("depth") <= n)
    return few.withColumn("source_order", keyed_order(seed, source)).drop("_o").orderBy("depth", "source_order").limit(n)


def kth_per_group(rows: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """The row at place ``k`` (from 0) of each group that has as many."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") == k + 1).drop("_n")


def first_rows(rows: DataFrame, group: str, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group: Spark keeps only ``k`` per task before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def balance(rows: DataFrame, a: str, b: str, expect_a: list[str], expect_b: list[str]) -> DataFrame:
    """Counts over the whole grid of expected values, 0 where there are none."""
    spark = rows.sparkSession
    x = spark.createDataFrame([(i, j) for i in expect_a for j in expect_b], f"{a} STRING, {b} STRING")
    return x.join(rows.groupBy(a, b).agg(F.count("*").alias("n")), [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def in_both(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """The distinct values, null left out, that both sides have."""
    one = lambda df: df.where(F.col(column).isNotNull()).select(column)
    return one(a).intersect(one(b))


def sample_problems(text: Column, source: Column, split: Column) -> Column:
    """Codes of what keeps a sample from being taken: empty_text, invalid_source, invalid_split. Nulls are invalid."""
    bad = lambda test, code: F.when(F.coalesce(test, F.lit(True)), code)
    codes = [bad(F.trim(text) == "", "empty_text"), bad(~source.isin(SAMPLE_SOURCES), "invalid_source"), bad(~split.isin(SPLITS), "invalid_split")]
    return F.filter(F.array(*codes), lambda x: x.isNotNull())
