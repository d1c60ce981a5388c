"""Splits that keep related records together.

Method: records that share a group or a source, however written, are one component (alternating large-star and
small-star over the keys); a hash of the component's id falls into one of the proportional split ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import name_key, split_name
from ..skew import hot_join, hot_keys, keyed_join
from ..storage import Scratch
from .graph import star_components

SPLITS = ("train", "valid", "test")


def record_components(records: DataFrame, scratch: Scratch, keys: tuple[str, ...] = ("group_id", "roboflow_source")) -> DataFrame:
    """``(image_id, component)``, one row per record id: the smallest id tied to it through equal keys.

    Copies of an id are one record that has the keys of all its copies. Null ids are left out; null and
    stand-in keys tie nothing, so such a record is its own component. Only the named columns are read.
    """
    rows = records.where("image_id is not null")
    named = [F.struct(F.lit(i).alias("k"), name_key(F.col(c)).alias("name")) for i, c in enumerate(keys)]
    pairs = rows.select("image_id", F.explode(F.array(*named)).alias("x")).select("image_id", "x.k", "x.name").where("name is not null")
    pairs = scratch.keep(pairs.distinct().select("image_id", F.struct("k", "name").alias("key")), "pairs")
    # the least id that has a key stands for the key: exact, no hash of names is taken for an id
    heads, f = scratch.measured(pairs.groupBy("key").agg(F.min("image_id").alias("node"), F.count("*").alias("n")), "heads", total=F.sum("n"), most=F.max("n"))
    tied = hot_join(pairs, heads, "key", "n", f["total"] or 0, f["most"] or 0).select("image_id", "node")
    # at most one group and one source of each delivery: deliveries of one id are pre-aggregated to its distinct nodes
    nodes, f = scratch.measured(tied.groupBy("image_id", "node").agg(F.lit(1).alias("one")).select("image_id", "node"), "nodes", pairs, total=F.count("*"))
    first, g = scratch.measured(nodes.groupBy("image_id").agg(F.min("node").alias("v"), F.max("node").alias("u"), F.count("*").alias("c")), "first", most=F.max("c"))
    edges = first.where("u <> v").select("u", "v")
    if (g["most"] or 0) > 2:
        hot = hot_keys(first, "image_id", f["total"], "c", g["most"])
        edges = edges.unionByName(keyed_join(nodes, first.where("c > 2").select("image_id", "v"), "image_id", hot).select(F.col("node").alias("u"), "v"))
    stars = star_components(edges, scratch)
    # a record's component is that of any of its nodes; a node without edges is its own
    uses, f = scratch.measured(first.groupBy("v").agg(F.count("*").alias("n")).join(stars.select(F.col("id").alias("v"), "component"), "v", "left").select("v", F.coalesce("component", "v").alias("component"), "n"), "uses", total=F.sum("n"), most=F.max("n"))
    tied = hot_join(first.select("image_id", "v"), uses, "v", "n", f["total"] or 0, f["most"] or 0).select("image_id", "component")
    alone = rows.select("image_id").distinct().join(first.select("image_id"), "image_id", "left_anti").select("image_id", F.col("image_id").alias("component"))
    out = scratch.keep(tied.unionByName(alone), "components")
    scratch.only(out)
    return out


def assign_splits(components: DataFrame, proportions: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """``components`` with ``split``: all of a component fall into the range that the hash of its id hits.

    Proportions must be of 0 or more and sum to 1. Equal ids, components and seeds give equal splits whatever
    the order or partitioning of the rows.
    """
    if min(proportions) < 0 or abs(sum(proportions) - 1) > 1e-5:
        raise ValueError("proportions must be at least 0 and sum to 1")
    at = F.pmod(F.xxhash64(F.lit(seed), "component"), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    a, b = proportions[0], proportions[0] + proportions[1]
    return components.withColumn("split", F.when(at < a, SPLITS[0]).when(at < b, SPLITS[1]).otherwise(SPLITS[2]))


def straddling_records(records: DataFrame, scratch: Scratch, keys: tuple[str, ...] = ("group_id", "roboflow_source")) -> DataFrame:
    """``(image_id)`` of the records in components whose ``raw_split`` values name two or more splits."""
    comps = record_components(records, scratch, keys)
    bit = F.coalesce(*[F.when(split_name(F.col("raw_split")) == s, F.lit(1 << i)) for i, s in enumerate(SPLITS)], F.lit(0))
    marks = records.where("image_id is not null").groupBy("image_id").agg(F.bit_or(bit).alias("bits"))
    rows = comps.join(marks, "image_id")
    tied, f = scratch.measured(rows.groupBy("component").agg(F.bit_or("bits").alias("bits"), F.count("*").alias("n")), "bits", total=F.sum("n"), most=F.max("n"))
    return hot_join(comps, tied.where("bit_count(bits) >= 2").select("component", "n"), "component", "n", f["total"] or 0, f["most"] or 0, "left_semi").select("image_id")


def split_shares(assigned: DataFrame, proportions: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """``(split, target_share, n_records, actual_share, largest_component)`` of ``assign_splits``: components stay whole, so a large
    one can keep a split from its share, which shows here."""
    goal = assigned.sparkSession.createDataFrame(list(zip(SPLITS, map(float, proportions))), "split STRING, target_share DOUBLE")
    sizes = assigned.groupBy("component", "split").agg(F.count("*").alias("n")).groupBy("split").agg(F.sum("n").alias("n_records"), F.max("n").alias("largest_component"))
    everything = sizes.agg(F.sum("n_records").alias("of"))
    zero = F.lit(0).cast("bigint")
    j = goal.join(sizes, "split", "left").join(F.broadcast(everything), how="cross")
    return j.select("split", "target_share", F.coalesce("n_records", zero).alias("n_records"), F.coalesce(F.try_divide(F.coalesce("n_records", zero), "of"), F.lit(0.0)).alias("actual_share"), F.coalesce("largest_component", zero).alias("largest_component"))
