"""Deduplicating new batches against all history.

Method: a pivot-distance table. The 64-bit Hamming metric is the sum of the metrics of four 16-bit words. For each
word and each of eight fixed pivots the table stores the distance of every accepted hash to the pivot. By the
triangle inequality |d(h, p) - d(q, p)| <= d(h, q) per word, and of four words that together differ in at most two
bits at least two differ in none: their pivot distances must be equal. The distances of a word pair, read as one
number, are the key; keys fall into fixed ranges by which the table is laid out, sorted and joined, so a batch reads only
the ranges that it has keys in. What is left must satisfy the triangle inequality in all words together, then the
true distance is checked. The sha256 values are stored beside them, by ranges of their first byte.

The index stays on a path of its own. A batch is appended as folders of its number: nothing stored is ever rewritten, a batch
that is appended again replaces only itself, and one whose appending was cut off isn't seen before it is complete. A large
batch has keys in every range and reads the whole key column once; history is never keyed, grouped or written again.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import dhash_key, sha_key
from ..skew import hot_lookup
from ..storage import Scratch, delete_path, exists, list_names, touch
from .overlap import fine_keys

MAX_BITS = 2
#: Pivots of each word: the eight words in which one pair of neighbouring bits is set.
PIVOTS = [3 << (2 * j) for j in range(8)]
WORD_PAIRS = list(combinations(range(4), 2))
#: A word's eight distances follow from the ones among eight bit pairs, each 0 to 2: 3^8 keys a word.
WORD_KEYS = 3 ** len(PIVOTS)
#: Fixed ranges of keys per pair of words.
RANGES = 4


def _word(h: Column, i: int) -> Column:
    return F.shiftrightunsigned(h, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("bigint"))


def pivot_distances(h: Column) -> Column:
    """The 32 distances of a hash: word by word, to each pivot."""
    return F.array(*[F.bit_count(_word(h, i).bitwiseXOR(F.lit(p).cast("bigint"))).cast("tinyint") for i in range(4) for p in PIVOTS])


def _word_key(d: Column, i: int) -> Column:
    """A word's distances as one number. The eight distances sum to 6 * ones + 16, which gives the ones of each
    bit pair: (ones + 2 - distance) / 2."""
    own = [d[8 * i + j].cast("int") for j in range(8)]
    ones = (sum(own[1:], own[0]) - F.lit(16)) / F.lit(6)
    key = F.lit(0).cast("bigint")
    for x in own:
        key = key * 3 + ((ones + 2 - x) / 2).cast("bigint")
    return key


def keyed(values: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``values (h, first)`` with distances, one row per word pair: ``(r, key, h, first, d)``; ``r`` is the range."""
    d = values.withColumn("d", pivot_distances(F.col("h")))
    w = d.select("h", "first", "d", *[_word_key(F.col("d"), i).alias(f"w{i}") for i in range(4)])
    cells = F.array(*[F.struct(F.lit(p).alias("p"), (F.col(f"w{i}") * WORD_KEYS + F.col(f"w{j}")).alias("k")) for p, (i, j) in enumerate(WORD_PAIRS)])
    x = w.select("h", "first", "d", F.explode(cells).alias("x"))
    width = WORD_KEYS * WORD_KEYS // ranges + 1
    return x.select((F.col("x.p") * ranges + (F.col("x.k") / width).cast("int")).cast("int").alias("r"), (F.col("x.p") * (WORD_KEYS * WORD_KEYS) + F.col("x.k")).alias("key"), "h", "first", "d")


class PivotIndex:
    """All accepted records on ``path``. ``first`` is the order of acceptance (0 for history); ``append`` adds a batch,
    ``probe`` and ``probe_digests`` find the earliest accepted record like each of a batch's values. ``ranges``: key ranges
    per pair of words; more of them let small batches read less of a large history."""

    def __init__(self, spark: SparkSession, path: str, ranges: int = RANGES):
        self.spark, self.path, self.ranges = spark, path.rstrip("/"), ranges

    def batches(self) -> list[int]:
        """Numbers of the batches that are complete."""
        return sorted(int(n) for n in list_names(self.spark, f"{self.path}/done") if n.isdigit())

    def append(self, values: DataFrame, batch: int | None = None) -> None:
        """``values (h, first[, sha])`` as batch ``batch`` (the next number by default); null values are left out."""
        have = self.batches()
        self.append_all(values.withColumn("batch", F.lit(max(have, default=-1) + 1 if batch is None else batch)))

    def append_all(self, values: DataFrame) -> None:
        """``values (h, first, batch[, sha])`` of one or several batches, each of which replaces itself if it is there."""
        sizes = {r.batch: r.n for r in values.where("batch is not null").groupBy("batch").agg(F.count("*").alias("n")).collect()}
        for n in sizes:
            for part in (f"done/{n}", f"hashes/batch={n}", f"digests/batch={n}"):
                delete_path(self.spark, f"{self.path}/{part}")
        large = [n for n, k in sizes.items() if k > SMALL_BATCH]
        one = values.where("h is not null and batch is not null").groupBy("batch", "h").agg(F.min("first").alias("first"))
        rows = keyed(one.withColumn("first", F.struct("first", "batch")), self.ranges).select("key", "h", "first.first", "d", "r", "first.batch")
        self._lay_out(rows, "key", large, "hashes")
        if "sha" in values.columns:
            shas = values.where("sha is not null and batch is not null").groupBy("batch", "sha").agg(F.min("first").alias("first"))
            self._lay_out(shas.select("sha", "first", _digest_range(F.col("sha")).alias("r"), "batch"), "sha", large, "digests")
        for n in sizes:
            touch(self.spark, f"{self.path}/done/{n}")

    def _lay_out(self, rows: DataFrame, key: str, large: list[int], part: str) -> None:
        """A folder per batch; in a large one a folder per range (a small one's files are all in folder -1), sorted by key."""
        placed = rows.withColumn("part", F.when(F.col("batch").isin(large), F.col("r")).otherwise(-1) if large else F.lit(-1))
        order = ("batch", "part", "r", key)
        spread_ = placed.repartitionByRange(*order) if large else placed.repartition("batch")
        spread_.sortWithinPartitions(*order).write.mode("append").partitionBy("batch", "part").parquet(f"{self.path}/{part}")

    def _stored(self, part: str, schema: str, touched: list[int]) -> DataFrame:
        done, at = self.batches(), f"{self.path}/{part}"
        if not touched or not done or not exists(self.spark, at):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(at).where(F.col("batch").isin(done) & F.col("part").isin([-1, *touched]) & F.col("r").isin(touched))

    def table(self, touched: list[int] | None = None) -> DataFrame:
        """The stored rows of complete batches in the ranges ``touched``, all by default; other ranges' files aren't read."""
        return self._stored("hashes", "key BIGINT, h BIGINT, first BIGINT, d ARRAY<TINYINT>, r INT, batch BIGINT, part INT", list(range(self.ranges * len(WORD_PAIRS))) if touched is None else touched)

    def digests(self, touched: list[int]) -> DataFrame:
        return self._stored("digests", "sha STRING, first BIGINT, r INT, batch BIGINT, part INT", touched)

    def probe(self, hashes: DataFrame, max_bits: int = MAX_BITS, scratch: Scratch | None = None) -> DataFrame:
        """``(q, first)``: for each distinct hash ``(h)`` with any accepted hash at most ``max_bits`` away, the
        smallest ``first`` of those. Each gives at most one row, whatever number of near hashes there is. Hashes that have
        a ``first`` themselves count as accepted beside the stored ones. With ``scratch`` the keyed batch is kept, not made again."""
        if not 0 <= max_bits <= 2:
            raise ValueError("two of four words stay untouched by up to 2 bits")
        beside = "first" in hashes.columns
        asked = keyed(hashes.where("h is not null").groupBy("h").agg((F.min("first") if beside else F.lit(0).cast("bigint")).alias("first")), self.ranges)
        if scratch:
            asked = scratch.keep(asked, "asked")
        touched = [r.r for r in asked.select("r").distinct().collect()]  # at most six times ``ranges``
        rows = self.table(touched).select("r", "key", "h", "first", "d")
        rows = rows.unionByName(asked) if beside else rows
        q = asked.select("r", "key", F.col("h").alias("q"), F.col("d").alias("dq"))
        q, rows, on = self._split(q, rows)
        near = q.join(rows, on)
        bound = F.lit(0)
        for i in range(4):
            gaps = [F.abs(F.col("d")[8 * i + j].cast("int") - F.col("dq")[8 * i + j].cast("int")) for j in range(8)]
            bound = bound + F.greatest(*gaps)
        near = near.where(bound <= max_bits).where(F.bit_count(F.col("q").bitwiseXOR(F.col("h"))) <= max_bits)
        return near.groupBy("q").agg(F.min("first").alias("first"))

    @staticmethod
    def _split(q: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
        """Both sides with the keys that most rows have split by the bytes of the other two words, without loss. A key that isn't
        among the HOT_KEYS largest holds at most that part of all rows."""
        hot = _heavy_keys(q, rows)
        if not hot:
            return q, rows, ["r", "key"]
        known = F.broadcast(q.sparkSession.createDataFrame([(k, True) for k in hot], "key BIGINT, hot BOOLEAN"))

        def fine(df: DataFrame, h: str) -> DataFrame:
            place = F.expr(f"int(key div {WORD_KEYS * WORD_KEYS})")
            f = F.when(F.col("hot"), fine_keys(F.col(h), place)).otherwise(F.array(F.lit(0).cast("bigint")))
            return df.join(known, "key", "left").withColumn("f", F.explode(f)).drop("hot")

        return fine(q, "q"), fine(rows, "h"), ["r", "key", "f"]

    def probe_digests(self, shas: DataFrame, beside: DataFrame | None = None) -> DataFrame:
        """``(sha, first)``: the smallest ``first`` of each of the digests ``(sha)`` that is accepted."""
        asked = shas.where("sha is not null").select("sha").distinct()
        touched = [r.r for r in asked.select(_digest_range(F.col("sha")).alias("r")).distinct().collect()]
        rows = self.digests(touched).select("sha", "first")
        rows = rows if beside is None else rows.unionByName(beside.where("sha is not null").select("sha", "first"))
        return rows.groupBy("sha").agg(F.min("first").alias("first")).join(asked, "sha", "left_semi")


def _heavy_keys(q: DataFrame, rows: DataFrame) -> list[int]:
    """The HOT_KEYS largest of the asked keys that have more than HOT_KEY rows. Rows are counted by a hash of their key first, in so
    many classes that a class is small without such a key: then nothing but those counts is shuffled."""
    classes = min(max(1 << max(rows.count() // 500, 1).bit_length(), 1 << 12), 1 << 22)
    keys = rows.select("key", F.pmod(F.xxhash64("key"), F.lit(classes)).alias("c"))
    heavy = [(r.c,) for r in keys.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > HOT_KEY).select("c").limit(HOT_KEYS + 1).collect()]
    if not heavy:
        return []
    if len(heavy) <= HOT_KEYS:
        keys = keys.join(F.broadcast(q.sparkSession.createDataFrame(heavy, "c BIGINT")), "c", "left_semi")
    sizes = keys.join(q.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
    return [r.key for r in sizes.where(F.col("n") > HOT_KEY).orderBy(F.desc("n")).limit(HOT_KEYS).collect()]


#: A key with more rows than this is split if it is among the HOT_KEYS largest.
HOT_KEY, HOT_KEYS = 2_000, 10_000
#: A batch of at most this many rows is put in order by one task and isn't spread over folders.
SMALL_BATCH = 200_000
#: Number of the layout of a stored index; a change of its files or columns raises it.
LAYOUT = 1
#: Ranges of digests.
DIGEST_RANGES = 16


def _digest_range(sha: Column) -> Column:
    return (F.conv(F.substring(sha, 1, 2), 16, 10).cast("int") * DIGEST_RANGES / 256).cast("int")


def read_records(history: DataFrame) -> DataFrame:
    """``(sha, h, first)`` of history, which comes before every batch."""
    return history.select(sha_key(F.col("sha256")).alias("sha"), dhash_key(F.col("dhash")).alias("h"), F.lit(0).cast("bigint").alias("first"))


def read_incoming(incoming: DataFrame) -> DataFrame:
    """``(incoming_id, batch_no, sha, h, first, batch)``; rows without an id are left out, a null batch is batch 1."""
    rows = incoming.where("incoming_id is not null").select("incoming_id", "batch_no", sha_key(F.col("sha256")).alias("sha"), dhash_key(F.col("dhash")).alias("h"))
    return rows.withColumn("first", F.col("incoming_id")).withColumn("batch", F.coalesce(F.col("batch_no").cast("bigint"), F.lit(1)))


def new_repeats(index: PivotIndex, new: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS) -> DataFrame:
    """``(incoming_id, batch_no, known)`` of the rows ``new`` (as of ``read_incoming``, kept) that repeat an accepted record or
    another of them with a smaller id; ``known`` tells whether history has it.

    All batches that wait are probed in one pass in which a row counts only rows that came before it, so the result is that of
    batch after batch, and the same if some are in the index already. Copies are looked up as one value: no pairs of
    copies are made. Null hashes and dhash 0 repeat nothing.
    """
    near = index.probe(new.select("h", "first"), max_bits, scratch).select(F.col("q").alias("h"), "first")
    shas = index.probe_digests(new.select("sha"), new.select("sha", "first"))
    hits = [hot_lookup(new.select("incoming_id", "batch_no", key), earliest, key, scratch).select("incoming_id", "batch_no", "first") for key, earliest in (("h", near), ("sha", shas))]
    hit = hits[0].unionByName(hits[1]).where("first < incoming_id")
    return hit.groupBy("incoming_id").agg(F.min("batch_no").alias("batch_no"), F.max(F.col("first") == 0).alias("known"))


def accept(index: PivotIndex, incoming: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS) -> DataFrame:
    """``new_repeats`` of the batches of ``incoming``, which are appended to the index then. Batches that run again give the
    same rows and replace themselves."""
    new = scratch.keep(read_incoming(incoming), "new")
    out = scratch.keep(new_repeats(index, new, scratch, max_bits), "repeats")
    index.append_all(new.where("batch > 0"))
    scratch.only(out)
    return out


def repeats(history: DataFrame, incoming: DataFrame, scratch: Scratch, max_bits: int = MAX_BITS) -> DataFrame:
    """``new_repeats`` against a ``history`` that no index holds yet: it is indexed below ``scratch`` for this call only."""
    index = PivotIndex(history.sparkSession, scratch.path("pivots"))
    index.append(read_records(history), 0)
    return new_repeats(index, scratch.keep(read_incoming(incoming), "new"), scratch, max_bits)
