"""Same or near-same records across splits.

Method: the evaluation side's grams are hashed once and partitioned (or broadcast, where Spark's own size check
allows), the training side is scanned for hits, and the containment of each evaluation record in each training
record is the share of its grams that hit. A record here is the 64-bit dhash of an image, read as four words of
16 bits; its grams are the six pairs of words with their places. Two hashes that differ in at most two bits
leave at least two words untouched, so they share a gram: the search loses nothing. An exact check of the
distance follows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import dhash_key, name_key, sha_key, split_name
from ..skew import hot_expand, hot_lookup
from ..storage import Scratch

MAX_BITS = 2
WORD_PAIRS = list(combinations(range(4), 2))
#: Distinct hashes of one gram above which the gram is split by the bytes of its other two words.
HOT_GRAM = 2_000


def word(h: Column, i: int) -> Column:
    return F.shiftrightunsigned(h, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("bigint"))


def grams(h: Column) -> Column:
    """The six word pairs of a hash, each as one BIGINT (place, word, word): equal numbers are equal grams."""
    one = [F.lit(p << 32).cast("bigint").bitwiseOR(F.shiftleft(word(h, i), 16)).bitwiseOR(word(h, j)) for p, (i, j) in enumerate(WORD_PAIRS)]
    return F.array(*one)


def fine_keys(h: Column, place: Column) -> Column:
    """Keys that split a hot word pair: its other two words are four bytes, of which two flipped bits leave two
    untouched, so two such hashes share one of six byte pairs. ``place`` is the number of the word pair."""
    byte = lambda w, k: F.shiftrightunsigned(word(h, w), 8 * k).bitwiseAND(F.lit(0xFF).cast("bigint"))
    out = None
    for p, pair in enumerate(WORD_PAIRS):
        rest = [byte(w, k) for w in range(4) if w not in pair for k in (0, 1)]
        keys = F.array(*[F.lit((q + 1) << 16).cast("bigint").bitwiseOR(F.shiftleft(rest[i], 8)).bitwiseOR(rest[j]) for q, (i, j) in enumerate(combinations(range(4), 2))])
        out = F.when(place == p, keys) if out is None else out.when(place == p, keys)
    return out


def gram_rows(hashes: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``(h, g, f)`` of ``hashes (h)``; ``f`` is 0 for a gram, and a byte pair for a hot one."""
    rows = hashes.select("h", F.explode(grams(F.col("h"))).alias("g"))
    if hot is None:
        return rows.withColumn("f", F.lit(0).cast("bigint"))
    marked = rows.join(F.broadcast(hot.select("g", F.lit(True).alias("hot"))), "g", "left")
    return marked.select("h", "g", F.explode(F.when(F.col("hot"), fine_keys(F.col("h"), F.shiftrightunsigned("g", 32).cast("int"))).otherwise(F.array(F.lit(0).cast("bigint")))).alias("f"))


def hot_grams(a: DataFrame, b: DataFrame, limit: int = HOT_GRAM) -> DataFrame | None:
    """Grams that more than ``limit`` and more than a ten-thousandth of all hashes have: at most 60,000 rows."""
    both = a.unionByName(b).distinct()
    n = both.count()
    hot = both.select(F.explode(grams(F.col("h"))).alias("g")).groupBy("g").count().where(F.col("count") > max(limit, n // 10_000)).select("g")
    return None if hot.isEmpty() else hot


def near_hashes(evaluation: DataFrame, training: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS) -> DataFrame:
    """``(e, t, hits, containment, bits)`` of all pairs of distinct hashes ``(h)`` of the two sides that differ in
    at most ``max_bits`` (0 to 2) of 64 bits. ``hits``: shared grams of six; null hashes are left out."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the grams find differences of up to 2 bits")
    ev = scratch.keep(evaluation.where("h is not null").distinct(), "ev")
    tr = scratch.keep(training.where("h is not null").distinct(), "tr")
    hot = hot_grams(ev, tr)
    if hot is not None:
        hot = scratch.keep(hot, "hot")
    left, right = gram_rows(ev, hot).withColumnRenamed("h", "e"), gram_rows(tr, hot).withColumnRenamed("h", "t")
    hit = left.join(right, ["g", "f"]).where(F.bit_count(F.col("e").bitwiseXOR(F.col("t"))) <= max_bits)
    same = [F.expr(f"int({word_sql('e', i)} = {word_sql('t', i)})") for i in range(4)]
    n = sum(same[1:], same[0])
    pairs = hit.select("e", "t").distinct().withColumn("hits", (n * (n - 1) / 2).cast("int"))
    return pairs.withColumn("containment", F.col("hits") / F.lit(float(len(WORD_PAIRS)))).withColumn("bits", F.bit_count(F.col("e").bitwiseXOR(F.col("t"))))


def word_sql(name: str, i: int) -> str:
    return f"(shiftrightunsigned({name}, {16 * i}) & 65535L)"


def _sides(images: DataFrame, scratch: Scratch) -> DataFrame:
    """``(image_id, split, sha, h, source)``, each reading of an image once; copies of an id are one image."""
    rows = images.where("image_id is not null").select(
        "image_id", split_name(F.col("raw_split")).alias("split"), sha_key(F.col("sha256")).alias("sha"), dhash_key(F.col("dhash")).alias("h"), F.coalesce(name_key(F.col("roboflow_source")), F.lit("")).alias("source")
    )
    return scratch.keep(rows.where("split is not null").distinct(), "sides")


def _near(rows: DataFrame, scratch: Scratch, max_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    tr, ev = rows.where("split = 'train'"), rows.where("split <> 'train'")
    return tr, ev, scratch.keep(near_hashes(ev.select("h"), tr.select("h"), scratch, max_bits), "near")


def overlap_pairs(images: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS) -> DataFrame:
    """``(image_id_a, image_id_b)``, the smaller id first: an image of train and one of valid or test with the
    same sha256 or with dhash values at most ``max_bits`` apart. Null hashes and dhash 0 say nothing, null splits
    are on neither side."""
    tr, ev, near = _near(_sides(images, scratch), scratch, max_bits)
    a = tr.select(F.col("image_id").alias("x"), "sha", F.col("h").alias("t"))
    b = ev.select(F.col("image_id").alias("y"), "sha", F.col("h").alias("e"))
    exact = hot_expand(a.select("x", "sha").distinct(), b.select("y", "sha").distinct(), "sha", scratch).select("x", "y")
    mine = hot_lookup(b.select("y", F.col("e").alias("h")).distinct(), near.select(F.col("e").alias("h")).distinct(), "h", scratch, "left_semi")
    # each near training hash of an evaluation hash, then the images of both
    sides = hot_expand(mine.withColumnRenamed("h", "e"), near.select("e", "t"), "e", scratch)
    like = hot_expand(a.select("x", "t").distinct(), sides.select("y", "t"), "t", scratch).select("x", "y")
    pairs = exact.unionByName(like).where("x <> y").select(F.least("x", "y").alias("image_id_a"), F.greatest("x", "y").alias("image_id_b"))
    out = scratch.keep(pairs.distinct(), "pairs")
    scratch.only(out)
    return out


def overlap_classes(images: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """``(pairs, members)``, the same overlaps by classes of copies, so that no group of copies becomes pairs.

    ``pairs (evaluation, training, bits, hits, containment)``: distinct dhashes of both sides, each by the smallest image that has
    it on that side; containment is the share of the evaluation record's grams that the training record has. ``members
    (side, representative, image_id)``: the images of each hash in a pair. Equal digests are found by ``overlap_report``."""
    tr, ev, near = _near(_sides(images, scratch), scratch, max_bits)
    least = lambda df, name: df.where("h is not null").groupBy("h").agg(F.min("image_id").alias(name))
    e, t = scratch.keep(least(ev, "evaluation"), "e"), scratch.keep(least(tr, "training"), "t")
    pairs = near.join(e.withColumnRenamed("h", "e"), "e").join(t.withColumnRenamed("h", "t"), "t").select("evaluation", "training", "bits", "hits", "containment")
    own = lambda df, heads, name, key, side: hot_lookup(
        df.select("image_id", "h").distinct(), heads.join(near.select(F.col(key).alias("h")).distinct(), "h"), "h", scratch
    ).select(F.lit(side).alias("side"), F.col(name).alias("representative"), "image_id")
    return pairs, own(ev, e, "evaluation", "e", "evaluation").unionByName(own(tr, t, "training", "t", "training"))


def overlap_report(images: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS) -> DataFrame:
    """Per evaluation split and source: images, those also in train by sha256, by dhash, by either. Counted on
    distinct hashes, so groups of copies are never expanded into pairs. A source that names nothing is ''."""
    tr, ev, near = _near(_sides(images, scratch), scratch, max_bits)
    ids = ["split", "source", "image_id"]
    same = hot_lookup(ev.select(*ids, "sha"), tr.where("sha is not null").select("sha").distinct(), "sha", scratch, "left_semi")
    like = hot_lookup(ev.select(*ids, "h"), near.select(F.col("e").alias("h")).distinct(), "h", scratch, "left_semi")
    zero = F.lit(0)
    marks = ev.select(*ids, zero.alias("same"), zero.alias("like"))
    marks = marks.unionByName(same.select(*ids, F.lit(1).alias("same"), zero.alias("like"))).unionByName(like.select(*ids, zero.alias("same"), F.lit(1).alias("like")))
    one = marks.groupBy(*ids).agg(F.max("same").alias("same"), F.max("like").alias("like"))
    return one.groupBy("split", "source").agg(
        F.count("*").alias("n_images"), F.sum("same").cast("bigint").alias("n_same"), F.sum("like").cast("bigint").alias("n_like"), F.sum(F.greatest("same", "like")).cast("bigint").alias("n_overlap")
    )
