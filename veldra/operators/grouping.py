"""Duplicates, groups by source, and splits of groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import hamming
from ..skew import hot_lookup
from ..storage import Scratch
from ..vocab import SPLITS


def exact_duplicates(records: DataFrame, digest: str, split: str) -> DataFrame:
    """``(digest, n_rows, n_splits)`` of the digests that several rows have; null digests say nothing."""
    g = records.where(F.col(digest).isNotNull()).groupBy(F.col(digest).alias("digest"))
    return g.agg(F.count("*").alias("n_rows"), F.countDistinct(split).alias("n_splits")).where("n_rows > 1")


#: A key with more hashes than this is split if it is among the HOT_KEYS largest.
HOT_KEY, HOT_KEYS = 2_000, 10_000


def _key_bands(n: int, most: int) -> int:
    """Bands that a key is made of: as few as give about as many keys as there are hashes, so a hash meets few others by chance."""
    return next((k for k in range(1, 5) if 2 ** (64 * k / (most + k)) >= n), 5)


class _Bands:
    """A 64-bit hash cut into ``most + k`` bands. Hashes that differ in at most ``most`` bits agree in ``k`` bands at least, so they
    share the key of one combination of ``k``. Of what is left, cut into halves of bands and those into ``most + 1`` groups, they
    agree in one group at least: its bits split a hot key."""

    def __init__(self, most: int, k: int):
        n = most + k
        self.edges = [64 * i // (2 * n) for i in range(2 * n + 1)]
        self.combos = list(combinations(range(n), k))
        self.groups = []
        for c in self.combos:
            rest = [j for i in range(n) if i not in c for j in (2 * i, 2 * i + 1)]
            cuts = [len(rest) * i // (most + 1) for i in range(most + 2)]
            self.groups.append([rest[x:y] for x, y in zip(cuts, cuts[1:])])

    def _bits(self, h: str, halves: str) -> str:
        """SQL for the bits of the halves in a list, put behind each other."""
        starts, widths = (f"array({', '.join(map(str, x))})" for x in (self.edges[:-1], [b - a for a, b in zip(self.edges, self.edges[1:])]))
        return f"aggregate({halves}, 0L, (acc, i) -> shiftleft(acc, {widths}[i]) | (shiftrightunsigned({h}, {starts}[i]) & (shiftleft(1L, {widths}[i]) - 1)))"

    def keys(self, h: str) -> Column:
        each = [f"shiftleft({p}L, 40) | {self._bits(h, 'array(' + ', '.join(str(j) for i in c for j in (2 * i, 2 * i + 1)) + ')')}" for p, c in enumerate(self.combos)]
        return F.expr(f"array({', '.join(each)})")

    def fine(self, h: str, key: str) -> Column:
        of = ", ".join("array(" + ", ".join("array(" + ", ".join(map(str, g)) + ")" for g in groups) + ")" for groups in self.groups)
        bits = self._bits(h, "g")
        return F.expr(f"transform(array({of})[int(shiftrightunsigned({key}, 40))], (g, no) -> shiftleft(bigint(no + 1), 48) | {bits})")


def near_duplicates(hashes: DataFrame, most: int) -> DataFrame:
    """``(a, b, bits)`` of the pairs of distinct hashes ``(h)`` at most ``most`` bits apart, a < b.

    Lossless: such hashes share a key of several bands (``_Bands``); the more hashes there are, the more bands a key has, so the
    pairs to look at grow with the hashes and not with their square. Keys that very many hashes share are split by the other
    bits. Equal hashes are one value here, so groups of copies are never expanded into pairs.
    """
    d = hashes.where("h is not null").select("h").distinct()
    bands = _Bands(most, _key_bands(d.count(), most))
    x = d.select("h", F.explode(bands.keys("h")).alias("key"))
    hot = [r.key for r in x.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_KEY).orderBy(F.desc("n")).limit(HOT_KEYS).collect()]
    on = ["key"]
    if hot:
        known = F.broadcast(d.sparkSession.createDataFrame([(k, True) for k in hot], "key BIGINT, hot BOOLEAN"))
        f = F.when(F.col("hot"), bands.fine("h", "key")).otherwise(F.array(F.lit(0).cast("bigint")))
        x, on = x.join(known, "key", "left").withColumn("f", F.explode(f)).drop("hot"), ["key", "f"]
    near = x.withColumnRenamed("h", "a").join(x.withColumnRenamed("h", "b"), on).where(F.col("a") < F.col("b")).withColumn("bits", hamming(F.col("a"), F.col("b"))).where(F.col("bits") <= most)
    return near.select("a", "b", "bits").distinct()


def label_conflicts(images: DataFrame, labels: DataFrame, digest: str, key: str) -> DataFrame:
    """``(digest, n_images, n_contents)`` of the images that share a digest, with the number of different label
    contents: bags of lines, white space made one blank, order ignored; no label is a content of its own."""
    lines = F.filter(F.transform(F.split("content", r"\r\n|[\n\r]"), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"^$", "")), lambda x: x != "")
    bags = labels.select(key, F.sha2(F.array_join(F.array_sort(lines), "\n"), 256).alias("bag"))
    rows = images.where(F.col(digest).isNotNull()).select(F.col(digest).alias("digest"), key).join(bags, key, "left")
    g = rows.groupBy("digest").agg(F.countDistinct(key).alias("n_images"), F.countDistinct(F.coalesce("bag", F.lit("-"))).alias("n_contents"))
    return g.where("n_images > 1")


def global_rank(keys: DataFrame, order: list[str], scratch: Scratch, name: str = "rank") -> DataFrame:
    """``keys`` numbered from 1 by ``order`` without a window over all rows in one task: rows are range-partitioned,
    numbered within the partition, and the partitions' sizes (one number each) are added up."""
    n = keys.sparkSession.conf.get("spark.sql.shuffle.partitions")
    p = keys.repartitionByRange(int(n), *order).sortWithinPartitions(*order)
    p = p.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1).cast("bigint")))
    p = scratch.keep(p, "ranked")
    sizes = sorted((r._p, r.c) for r in p.groupBy("_p").agg(F.count("*").alias("c")).collect())
    starts, at = [], 0
    for part, c in sizes:
        starts.append((part, at))
        at += c
    base = keys.sparkSession.createDataFrame(starts, "_p INT, _s BIGINT")
    return p.join(F.broadcast(base), "_p").select("*", (F.col("_i") + F.col("_s") + 1).alias(name)).drop("_p", "_i", "_s")


def source_groups(records: DataFrame, scratch: Scratch, prefix: Column | None = None) -> DataFrame:
    """``(key, number, n_rows, method, confidence)`` of records ``(image_id, key, sha)``: one group per key, numbered
    by sorted key; several rows of one content are byte duplicates, of several contents variants of a source."""
    g = records.groupBy("key").agg(F.countDistinct("image_id").alias("n_rows"), F.countDistinct("sha").alias("n_sha"))
    method = F.when(F.col("n_rows") == 1, "single_source").when(F.col("n_sha") == 1, "exact_byte_duplicate").otherwise("roboflow_source_stem")
    g = g.withColumn("method", method).withColumn("confidence", F.when(F.col("n_rows") == 1, "unmatched").otherwise("high"))
    return global_rank(g.select("key", "n_rows", "method", "confidence"), ["key"], scratch, "number")


def source_naming(records: DataFrame, key: str, split: str) -> DataFrame:
    """``(splits, n_sources, n_multi)``: sources by the sorted names of the splits that they are in, and those of
    them with several rows. Sources without a name or split are left out."""
    g = records.where(F.col(key).isNotNull() & F.col(split).isNotNull()).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(split)), " + ").alias("splits"), F.count("*").alias("n"))
    return g.groupBy("splits").agg(F.count("*").alias("n_sources"), F.sum((F.col("n") > 1).cast("bigint")).alias("n_multi"))


def in_several_splits(records: DataFrame, key: str, split: str) -> DataFrame:
    """``(key, n_splits)`` of the keys whose rows are in more than one split."""
    g = records.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.countDistinct(split).alias("n_splits"))
    return g.where("n_splits > 1")


def greedy_split(groups: DataFrame, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """``(key, n, split)`` of groups ``(key, n)``: in the order of a keyed hash, each whole group goes to train if it
    fits, else to valid if it fits, else to test; what fits nowhere goes where there is room at all.

    The order matters and a skipped group takes no room, so the groups (not their rows) pass one task as a sorted stream
    that keeps three sums and nothing else. ``veldra.llm`` has a split without any such pass.
    """
    if abs(sum(ratios) - 1) > 1e-5:
        raise ValueError("ratios must sum to 1")
    total = groups.agg(F.sum("n")).first()[0] or 0
    room = (int(total * ratios[0]), int(total * ratios[1]))
    room = (*room, total - sum(room))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = [0, 0, 0]
        for b in batches:
            names = []
            for n in b.column(1).to_pylist():
                if used[0] + n <= room[0] or (used[1] >= room[1] and used[2] >= room[2]):
                    to = 0
                else:
                    to = 1 if used[1] + n <= room[1] or used[2] >= room[2] else 2
                used[to] += n
                names.append(SPLITS[to])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string())], names=["key", "n", "split"])

    stream = groups.select("key", F.col("n").cast("bigint").alias("n"), order.alias("o")).repartition(1).sortWithinPartitions("o")
    return stream.select("key", "n").mapInArrow(run, f"key {groups.schema['key'].dataType.simpleString()}, n BIGINT, split STRING")


def manifest(records: DataFrame, groups: DataFrame, scratch: Scratch, key: str = "group_id") -> DataFrame:
    """Records with the split of their group, one row per record; a group may hold any number of records."""
    return hot_lookup(records, groups.select(F.col("key").alias(key), F.col("split").alias("target_split")), key, scratch)
