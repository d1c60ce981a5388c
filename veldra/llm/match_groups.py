"""Consolidating pairwise matches into groups.

Method: breadth-first search from the vertex of highest degree takes the giant component out of the graph, and
minimum propagation labels the rest (``graph.peeled_components``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..skew import hot_join
from ..storage import Scratch
from .graph import peeled_components


def match_edges(images: DataFrame, pairs: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """``(u, v)`` from the matches with ``is_match`` true and from images that one ``members`` list names.

    A list becomes a star around its least member that exists, so it adds as many edges as members and never
    all pairs. Ids that aren't in ``images``, null ends, null verdicts and null lists tie nothing.
    """
    known = images.where("image_id is not null").select("image_id").distinct()
    known = scratch.keep(known, "known")
    a, b = known.withColumnRenamed("image_id", "u"), known.withColumnRenamed("image_id", "v")
    said = pairs.where("is_match").select(F.col("image_id_a").alias("u"), F.col("image_id_b").alias("v")).where("u <> v").distinct()
    said = said.join(a, "u", "left_semi").join(b, "v", "left_semi")
    lists = groups.where("members is not null").select(F.struct(F.coalesce("group_id", F.lit("")).alias("g"), F.xxhash64("members").alias("h")).alias("key"), F.explode(F.array_distinct("members")).alias("u"))
    lists = scratch.keep(lists.where("u is not null").distinct().join(a, "u", "left_semi"), "lists")
    heads, f = scratch.measured(lists.groupBy("key").agg(F.min("u").alias("v"), F.count("*").alias("n")), "heads", total=F.sum("n"), most=F.max("n"))
    listed = hot_join(lists, heads, "key", "n", f["total"] or 0, f["most"] or 0).select("u", "v").where("u <> v")
    return said.unionByName(listed)


def _components(images: DataFrame, pairs: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    out = scratch.keep(peeled_components(match_edges(images, pairs, groups, scratch), scratch), "components")
    scratch.only(out)
    return out


def consolidate(images: DataFrame, pairs: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """``(image_id, group_key)``: every image once, with the smallest id tied to it directly or through others
    (itself if nothing is tied to it)."""
    comps = _components(images, pairs, groups, scratch).withColumnRenamed("id", "image_id")
    known = images.where("image_id is not null").select("image_id").distinct()
    return known.join(comps, "image_id", "left").select("image_id", F.coalesce("component", "image_id").alias("group_key"))


def tied_images(images: DataFrame, pairs: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """``(image_id, group_key)`` of the images that are tied to another image."""
    return _components(images, pairs, groups, scratch).select(F.col("id").alias("image_id"), F.col("component").alias("group_key"))
