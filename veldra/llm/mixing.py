"""Mixing sources to target weights.

Method: iterative proportional fitting. Token totals of the cells source x language x topic are raked to the
target shares of the sources and to the languages' and topics' own target shares of the sources and to the languages' and topics' own shares of the pool; the fitted weight of a cell
is the expected number of copies of each of its documents. Documents are then drawn by those calibrated
probabilities: systematically along their size within each source, long texts first, so what is drawn stays close to what is
expected, and no document is drawn more often than its source allows. The order of drawing, the size of the shards in which a
source is put in order, and which texts count as long change which documents are drawn, not how many tokens.

The table has no topics, so they are learned here: clusters of token counts, fitted on all documents. One pass encodes the
texts and writes how many tokens of each document fall to each place; the passes of the fit and the one that tells the topics
read that table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..storage import Scratch
from .tokens import encoder, spread, vocabulary_folder

#: Topics, and the places of hashed tokens.
TOPICS, PLACES = 6, 512
#: How places and their numbers are written, documents that are worked on at a time, and the steps of directions.
PLACE, VALUE, BLOCK, STEPS = np.dtype("<u2"), np.dtype("<i4"), 1_000, 2.0**24
#: Logarithms of small numbers of tokens.
LOGS = np.log1p(np.arange(4096.0))
#: Documents of one source that one task puts in order.
SHARD = 50_000
ROUNDS = 500
#: Starts of the drawing that are tried for each source.
STARTS = 8
#: Texts of more than this part of their source's target are drawn first, so that the others can make up for them.
LONG = 0.005


def source_key(c: Column) -> Column:
    """A source's name however written: lower case, separators as one underscore; null if nothing is left."""
    k = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")
    return F.when(k != "", k)


def language_key(c: Column) -> Column:
    """A language tag in lower case; what isn't one names no language, so there are as many languages as tags are in use."""
    k = F.lower(F.trim(c))
    return F.when(k.rlike("^[a-z]{2,3}([-_][a-z0-9]{2,8})*$"), F.translate(k, "_", "-")).otherwise("")


@dataclass
class Lists:
    """A list of numbers for each of several documents: how long each is, and the places and values of all, end to end."""

    sizes: np.ndarray
    place: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(places: pa.Array, values: pa.Array) -> Lists:
        """From two binary columns, without copying them."""

        def flat(col: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
            if not len(col):
                return np.zeros(0, np.int64), np.zeros(0, kind)
            _, ends, data = col.buffers()
            ends = np.frombuffer(ends, np.int64 if pa.types.is_large_binary(col.type) else np.int32)[col.offset : col.offset + len(col) + 1]
            data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
            return np.diff(ends).astype(np.int64) // kind.itemsize, data.view(kind)

        sizes, place = flat(places, PLACE)
        return Lists(sizes, place, flat(values, VALUE)[1])

    def columns(self) -> list[pa.Array]:
        def binary(x: np.ndarray) -> pa.Array:
            ends = np.concatenate([[0], np.cumsum(self.sizes)]) * x.itemsize
            return pa.Array.from_buffers(pa.binary(), len(self.sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(x)])

        return [binary(np.ascontiguousarray(self.place, PLACE)), binary(np.ascontiguousarray(self.value, VALUE))]

    def blocks(self) -> Iterator[tuple[int, Lists]]:
        """BLOCK documents at a time, with the number of the first."""
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        for i in range(0, len(self.sizes), BLOCK):
            j = min(i + BLOCK, len(self.sizes))
            yield i, Lists(self.sizes[i:j], self.place[ends[i] : ends[j]], self.value[ends[i] : ends[j]])


def _counts(ids: list[list[int]]) -> Lists:
    """The places of each document's tokens, in order, and how many tokens fall to each."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    at = np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())) % PLACES + np.repeat(np.arange(len(ids)) * PLACES, sizes)
    n = np.bincount(at, minlength=len(ids) * PLACES)
    some = np.flatnonzero(n)
    return Lists(np.bincount(some // PLACES, minlength=len(ids)), some % PLACES, n[some])


@dataclass
class Topics:
    """Directions of topics over hashed tokens, and the weight of each place.

    Directions, of topics as of documents, are whole multiples of 2^-24: as whole numbers, their products and the sums of these
    stay below 2^53 and are exact in doubles, so what is nearest doesn't hang on the order of adding, nor on how documents are
    spread over tasks."""

    centres: np.ndarray
    weights: np.ndarray

    def directions(self, counts: Lists) -> Lists:
        """Of each document, in steps; without places for a document that has none, as it has no tokens or all have those it has."""
        n = counts.value.astype(np.int64)
        v = LOGS[np.minimum(n, len(LOGS) - 1)]
        if len(many := np.flatnonzero(n >= len(LOGS))):
            v[many] = np.log1p(n[many])
        v *= self.weights[counts.place]
        sizes, place = counts.sizes, counts.place
        rows = np.flatnonzero(sizes)
        length = np.zeros(len(sizes))
        if len(rows):
            length[rows] = np.sqrt(np.add.reduceat(v * v, (np.cumsum(sizes) - sizes)[rows]))
        long = np.repeat(length, sizes)
        if not (keep := long > 0).all():
            place, v, long, sizes = place[keep], v[keep], long[keep], np.where(length > 0, sizes, 0)
        return Lists(sizes, place, np.rint(v / long * STEPS).astype(VALUE))

    def nearness(self, x: Lists) -> tuple[np.ndarray, np.ndarray]:
        """The documents that have a direction, and how near each is to each centre, a row per centre."""
        rows = np.flatnonzero(x.sizes)
        starts, place, v = (np.cumsum(x.sizes) - x.sizes)[rows], x.place.astype(np.intp), x.value.astype(np.float64)
        one, out = np.empty(len(v)), np.empty((len(self.centres), len(rows)))
        for j, c in enumerate(self.centres * STEPS if len(rows) else ()):
            np.take(c, place, out=one, mode="clip")  # places are below PLACES; this mode doesn't copy
            np.add.reduceat(np.multiply(one, v, out=one), starts, out=out[j])
        return rows, out

    def told(self, counts: Lists) -> np.ndarray:
        """The number of the topic nearest by angle, the first of equals; -1 for documents without tokens."""
        out = np.where(counts.sizes > 0, 0, -1)
        if not len(self.centres):
            return np.full(len(out), -1)
        rows, near = self.nearness(self.directions(counts))
        out[rows] = np.argmax(near, axis=0)
        return out

    def of(self, ids: list[int]) -> str:
        """The topic of one document; ``none`` for a text without tokens."""
        return _topic_name(int(self.told(_counts([ids]))[0]))


def _topic_name(j: int) -> str:
    return f"t{j}" if j >= 0 else "none"


def _totals(lists: DataFrame, add: Callable[[Lists], np.ndarray], slots: int) -> np.ndarray:
    """Sums over all documents of the whole numbers in ``slots`` places that ``add`` gives for a block of them. They are added by
    Spark, so the driver receives ``slots`` numbers however many tasks there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(slots, np.int64)
        for b in batches:
            for _, x in Lists.of(*b.columns).blocks():
                out += add(x)
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(out[some], pa.int64())], names=["slot", "total"])

    got = lists.select("places", "numbers").mapInArrow(run, "slot INT, total BIGINT").groupBy("slot").agg(F.sum("total").alias("total")).collect()
    out = np.zeros(slots, np.int64)
    out[[r.slot for r in got]] = [r.total for r in got]
    return out


def _farthest(directions: DataFrame, topics: Topics) -> np.ndarray:
    """The direction of the document that is farthest from the nearest of the centres, of equals the one with the least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, x in Lists.of(*b.columns[1:]).blocks():
                rows, near = topics.nearness(x)
                if len(rows):
                    near, rows = near.max(0), rows + i
                    rows = rows[near == near.min()]
                    one = min((float(near.min()), int(ids[r]), *(c[int(r)].as_py() for c in b.columns[1:])) for r in rows[ids[rows] == ids[rows].min()])
                    best = one if best is None else min(best, one)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(best, (pa.float64(), pa.int64(), pa.binary(), pa.binary()))], names=["near", *b.schema.names])

    got = directions.mapInArrow(run, "near DOUBLE, doc_id BIGINT, places BINARY, numbers BINARY").orderBy("near", "doc_id", "places", "numbers").first()
    out = np.zeros(PLACES)
    out[np.frombuffer(bytes(got.places), PLACE)] = np.frombuffer(bytes(got.numbers), VALUE) / STEPS
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return np.rint(x / max(float(np.sqrt((x * x).sum())), 1e-12) * STEPS) / STEPS


def cluster(counts: DataFrame, scratch: Scratch, k: int = TOPICS, rounds: int = 25) -> Topics:
    """Spherical k-means of all documents of a stored table ``(doc_id, places, numbers)`` of their counts, places weighted by how
    few documents have them. The first centre is the document farthest from the mean, each further one the document farthest from
    all before: equal input gives equal topics. Each step is a pass over a table of directions; the driver holds the centres only."""
    counts = counts.select("doc_id", "places", "numbers")
    df = _totals(counts, lambda x: np.append(np.bincount(x.place, minlength=PLACES), np.count_nonzero(x.sizes)), PLACES + 1)
    topics = Topics(np.zeros((0, PLACES)), np.log((1 + df[-1]) / (1 + df[:-1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in Lists.of(*b.columns[1:]).blocks():
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(x.sizes)), *topics.directions(x).columns()], names=b.schema.names)

    directions = scratch.keep(counts.mapInArrow(run, counts.schema), "directions")

    def sums(t: Topics) -> tuple[np.ndarray, np.ndarray]:
        """The sum of the directions nearest to each centre, and how many these are."""
        m = len(t.centres)

        def add(x: Lists) -> np.ndarray:
            rows, near = t.nearness(x)
            at = np.zeros(len(x.sizes), np.int64)
            at[rows] = np.argmax(near, axis=0)
            total = np.bincount(np.repeat(at * PLACES, x.sizes) + x.place, x.value, m * PLACES)
            return np.append(total.astype(np.int64), np.bincount(at[rows], minlength=m))

        got = _totals(directions, add, m * (PLACES + 1))
        return got[: m * PLACES].reshape(m, PLACES).astype(np.float64), got[m * PLACES :]

    total, n = sums(Topics(np.zeros((1, PLACES)), topics.weights))  # of all documents
    if n[0]:
        near, chosen, most = Topics(_unit(total[0])[None], topics.weights), [], min(k, int(n[0]))
        while len(chosen) < most:
            chosen.append(_farthest(directions, near))
            near = Topics(np.stack(chosen), topics.weights)
        topics = near
        for _ in range(rounds):
            total, n = sums(topics)
            new = np.stack([_unit(x) if m else c for x, m, c in zip(total, n, topics.centres)])
            if np.array_equal(new, topics.centres):
                break
            topics = Topics(new, topics.weights)
    scratch.drop(directions)
    return topics


def _counted(rows: DataFrame, folder: str, name: str) -> DataFrame:
    """``rows``, whose last column is ``text``, with ``n_tokens``, ``places`` and ``numbers`` (of tokens at each) in place of it."""
    names = [*rows.columns[:-1], "n_tokens", "places", "numbers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(folder, name)
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                part = b.slice(i, BLOCK)
                ids = [enc.encode(t) if t else [] for t in part.columns[-1].to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(map(len, ids), pa.int64()), *_counts(ids).columns()], names=names)

    more = [T.StructField("n_tokens", T.LongType()), T.StructField("places", T.BinaryType()), T.StructField("numbers", T.BinaryType())]
    return spread(rows).mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *more]))


def learn_topics(rows: DataFrame, folder: str, name: str, seed: int = 42, k: int = TOPICS, fit_docs: int | None = None) -> Topics:
    """Topics of ``rows (doc_id, text)`` learned from all of them. A caller may ask for about ``fit_docs`` of them instead, drawn by
    a hash of the id; no query does."""
    some = rows.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if fit_docs is not None and (n := some.count()) > fit_docs:
        some = some.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(fit_docs / n * (1 << 30)))
    scratch = Scratch(rows.sparkSession, "topics")
    counts = scratch.keep(_counted(some, folder, name), "counted")
    topics = cluster(counts, scratch, k)
    scratch.drop(counts)
    return topics


def _tell(topics: Topics):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [_topic_name(j) for _, x in Lists.of(*b.columns[4:]).blocks() for j in topics.told(x).tolist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(told, pa.string()), b.column(3)], names=["doc_id", "source", "lang", "topic", "n_tokens"])

    return run


@dataclass
class Fit:
    """Weights of the cells (expected copies per document), the size that they add up to, the sources whose caps set that size,
    and the largest part of it by which a language's or topic's total differs from its margin."""

    weights: dict[tuple[str, str, str], float]
    total: float
    bound_by: tuple[str, ...] = ()
    residual: float = 0.0


def rake(cells: list[tuple[str, str, str, float]], shares: dict[str, float], repeats: dict[str, int], total: float | None = None) -> Fit:
    """Fits ``cells (source, language, topic, tokens)`` to the sources' shares and to the pool's language and topic
    shares, with no weight above the source's ``repeats``.

    Shares of sources without tokens can't be reached; the others' are taken relative to each other. ``total``
    is the size aimed at; by default the largest at which every source that has tokens reaches its share within
    its repeats. The source margin is fitted last in each round, and capped cells hand their excess to the
    other cells of their source, so sources come out exactly where the caps allow it; where the caps or missing cells keep the
    languages and topics from their margins, ``residual`` says by how much. Only cells that exist are kept.
    """
    src = sorted({c[0] for c in cells if c[3] > 0 and shares.get(c[0], 0) > 0 and repeats.get(c[0], 0) > 0})
    if not src:
        return Fit({}, 0.0)
    sums: dict[tuple[str, str, str], float] = {}
    for s, g, t, n in cells:
        if s in shares and n > 0:
            sums[s, g, t] = sums.get((s, g, t), 0.0) + n
    keys = sorted(k for k in sums if k[0] in set(src))
    have = np.array([sums[k] for k in keys])
    names = [src, sorted({k[1] for k in keys}), sorted({k[2] for k in keys})]
    axes = [np.array([{n: i for i, n in enumerate(x)}[k[a]] for k in keys]) if len(x) < 50 else np.searchsorted(x, [k[a] for k in keys]) for a, x in enumerate(names)]
    add = lambda a, x: np.bincount(axes[a], x, len(names[a]))
    cap = np.array([repeats[s] for s in src], dtype=float)
    share = np.array([shares[s] for s in src])
    share = share / share.sum()
    own = add(0, have)
    most_size = cap * own / share
    size = float(most_size.min()) if total is None else float(total)
    want = np.minimum(share * size, cap * own)
    bound = tuple(s for s, m in zip(src, most_size) if m <= size * (1 + 1e-12))
    margins = [want, *(add(a, have) / have.sum() * want.sum() for a in (1, 2))]
    x, most = have * (want / own)[axes[0]], have * cap[axes[0]]
    for _ in range(ROUNDS):
        before = x.copy()
        for a in (1, 2, 0):
            now = add(a, x)
            x = x * np.divide(margins[a], now, out=np.ones_like(now), where=now > 0)[axes[a]]
        for _ in range(len(x)):  # excess over the cap goes to the source's other cells
            x = np.minimum(x, most)
            lack, free = want - add(0, x), (x < most) & (x > 0)
            room = add(0, x * free)
            lift = (lack > 1e-9 * want) & (room > 0)
            if not lift.any():
                break
            x = np.where(free & lift[axes[0]], x * (1 + np.divide(lack, room, out=np.zeros_like(lack), where=lift))[axes[0]], x)
        if np.abs(x - before).max() <= 1e-9 * x.max():
            break
    w = np.minimum(x / have, cap[axes[0]])
    residual = max(float(np.abs(add(a, x) - margins[a]).max()) for a in (1, 2)) / max(float(x.sum()), 1e-12)
    return Fit(dict(zip(keys, map(float, w))), float(x.sum()), bound, residual)


def sized(docs: DataFrame, scratch: Scratch, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """``(doc_id, source, lang, topic, n_tokens)`` of each row with an id. Null sources and languages are ''."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), F.coalesce(source_key(F.col("source")), F.lit("")).alias("source"), F.coalesce(language_key(F.col("lang")), F.lit("")).alias("lang"), "text")
    counted = scratch.keep(_counted(rows, folder or vocabulary_folder(), name), "counted")
    told = counted.mapInArrow(_tell(cluster(counted, scratch)), "doc_id BIGINT, source STRING, lang STRING, topic STRING, n_tokens BIGINT")
    return scratch.keep(told, "sized", counted)


def _systematic(rows: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """``(doc_id, source, n_tokens, copies)`` of the rows drawn: weights ``w`` are added up along size within each source
    and shard from a start, and a row gets a copy for each whole number that it passes. Of STARTS evenly spaced starts, the first
    by a hash, each source takes the one whose tokens come closest to what its weights promise: few long texts otherwise miss it
    by the size of one."""
    order = Window.partitionBy("source", "shard").orderBy("n_tokens", "lang", "topic", "doc_id")
    base = F.pmod(F.xxhash64("source", "shard", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0) + 1e-9
    cum = scratch.keep(rows.withColumn("at", base + F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))), "sums")

    def copies(start) -> Column:
        return F.least(F.floor(F.col("at") + start) - F.floor(F.col("at") + start - F.col("w")), F.col("cap").cast("bigint")).cast("int")

    sums = [F.sum(F.col("n_tokens") * copies(F.lit(k / STARTS))).alias(f"s{k}") for k in range(STARTS)]
    best = [(r.source, min(range(STARTS), key=lambda k: (abs(r[f"s{k}"] - r.want_tokens), k)) / STARTS) for r in cum.groupBy("source").agg(F.sum(F.col("w") * F.col("n_tokens")).alias("want_tokens"), *sums).collect()]
    starts = rows.sparkSession.createDataFrame(best, "source STRING, start DOUBLE")
    out = cum.join(F.broadcast(starts), "source").withColumn("copies", copies(F.col("start")))
    return out.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def draw(docs: DataFrame, targets: DataFrame, scratch: Scratch, total: float | None = None, seed: int = 42, name: str = "byte_bpe_50k", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(sample, report)``.

    ``sample (doc_id, source, n_tokens, copies)``: the documents drawn, ``copies`` at most the source's ``max_repeats``.
    ``report``: one row per listed source: ``target_share, max_repeats, n_docs, available_tokens, drawn_docs,
    drawn_tokens, actual_share, most_copies, sets_total, total_tokens, residual``; sources without documents have zeros.
    ``sets_total``: the source's repeats keep the whole from being larger; ``total_tokens`` and ``residual`` are those of the
    whole: the tokens aimed at, and by what part of them a language or topic misses its margin at most.

    Documents of sources that aren't listed, without tokens, or of sources with no share or no repeats aren't
    drawn. The table of targets lists sources by hand and is read to the driver, as are the totals of the cells, at most
    listed sources x language tags in use x (TOPICS + 1); documents never are.
    """
    spark = docs.sparkSession
    listed = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    listed = listed.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    goals = {r.source: (r.target_share or 0.0, r.max_repeats or 0) for r in listed.collect()}
    size = sized(docs, scratch, name, folder)
    mine = size.where(F.col("source").isin(list(goals)) & (F.col("n_tokens") > 0)) if goals else size.limit(0)
    cells = mine.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()
    fit = rake([(r.source, r.lang, r.topic, float(r.t)) for r in cells], {s: g[0] for s, g in goals.items()}, {s: g[1] for s, g in goals.items()}, total)
    count: dict[str, int] = {}
    for r in cells:
        count[r.source] = count.get(r.source, 0) + r.n
    want: dict[str, float] = {}
    for r in cells:
        want[r.source] = want.get(r.source, 0.0) + fit.weights.get((r.source, r.lang, r.topic), 0.0) * r.t
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("source", "lang", "topic")] + [T.StructField(c, T.DoubleType()) for c in ("w", "want", "cap")] + [T.StructField("shards", T.IntegerType())])
    weights = spark.createDataFrame([(s, g, t, w, want[s], float(goals[s][1]), -(-count[s] // SHARD)) for (s, g, t), w in fit.weights.items()], schema)
    rows = mine.join(F.broadcast(weights), ["source", "lang", "topic"]).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shards")))
    long = F.col("n_tokens") > F.col("want") * LONG
    first = scratch.keep(_systematic(rows.where(long), seed, scratch), "first")
    # what the long texts came to is made up for by the others
    drawn = {r.source: float(r.t) for r in first.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()}
    left = {r.source: r.t for r in rows.where(~long).groupBy("source").agg(F.sum(F.col("w") * F.col("n_tokens")).alias("t")).collect()}
    scale = spark.createDataFrame([(s, max(0.0, want[s] - drawn.get(s, 0.0)) / t if t else 0.0) for s, t in left.items()], "source STRING, f DOUBLE")
    rest = rows.where(~long).join(F.broadcast(scale), "source").withColumn("w", F.least(F.col("w") * F.col("f"), F.col("cap")))
    sample = scratch.keep(first.unionByName(_systematic(rest, seed + 1, scratch)), "sample")
    pool = mine.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("available_tokens"))
    drawn = sample.groupBy("source").agg(F.count("*").alias("drawn_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("most_copies"))
    zero = F.lit(0).cast("bigint")
    report = listed.join(pool, "source", "left").join(drawn, "source", "left").select(
        "source", "target_share", "max_repeats", *[F.coalesce(c, zero).alias(c) for c in ("n_docs", "available_tokens", "drawn_docs", "drawn_tokens")], F.coalesce("most_copies", F.lit(0)).alias("most_copies")
    )
    everything = F.sum("drawn_tokens").over(Window.partitionBy())
    report = report.withColumn("actual_share", F.coalesce(F.try_divide("drawn_tokens", everything), F.lit(0.0)))
    report = report.withColumn("sets_total", F.col("source").isin(list(fit.bound_by)) if fit.bound_by else F.lit(False)).withColumn("total_tokens", F.lit(round(fit.total))).withColumn("residual", F.lit(fit.residual))
    report = scratch.keep(report, "report")
    scratch.only(sample, report)
    return sample, report
