"""Far too many small files: consolidated into few files of good size, byte by byte.

Method: byte-level concatenation without parsing. Newline-delimited files are joined end to end, a line break
added where a file lacks its last one, a repeated header line dropped; complete zstandard frames are joined as they are,
which any zstandard reader reads as one stream. Every member's length and sha256 are checked against the bytes
in the bundle before it leaves the task.

A listing may name one file several times: rows with the same place and the same content are one member. Each
distinct content of a place is kept (a rewritten file has several versions, ``latest`` marks the last), so every
listed row points at exactly one member and no content is lost or stored twice for a place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import place_key
from ..skew import hot_expand
from ..storage import Scratch

TARGET_BYTES = 32 << 20


def list_members(files: DataFrame) -> DataFrame:
    """``files (file_id, kind, file_path, content)`` with ``place`` and ``digest`` (sha256 of the bytes).

    ``n_bytes`` of the listing may be null or wrong and isn't used. A null path is the place ''; a null content
    is an empty file.
    """
    content = F.coalesce("content", F.lit("")).cast("binary")
    return files.where("file_id is not null").select(
        "file_id", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce(place_key(F.col("file_path")), F.lit("")).alias("place"), F.sha2(content, 256).alias("digest"), content.alias("content"), "modified_at"
    )


def relisted_pairs(files: DataFrame) -> DataFrame:
    """``(file_id_a, file_id_b)``, a < b, of rows that list the same place with the same content. The contents
    themselves never move, only their digests."""
    m = list_members(files).select("file_id", "place", "digest")
    a, b = m.withColumnRenamed("file_id", "file_id_a"), m.withColumnRenamed("file_id", "file_id_b")
    return a.join(b, ["place", "digest"]).where("file_id_a < file_id_b").select("file_id_a", "file_id_b").distinct()


def _packer(target: int, fmt: str, header: bool):
    """Packs the members of a task, in order, into bundles of about ``target`` bytes."""
    import zstandard

    schema = pa.schema([("bundle", pa.string()), ("kind", pa.string()), ("data", pa.binary()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("members", pa.list_(pa.struct([("place", pa.string()), ("digest", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))), ("valid", pa.bool_())])

    def frame(x: bytes) -> bytes:
        return zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True).compress(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no, kind, buf, members, head = TaskContext.get().partitionId(), 0, None, bytearray(), [], None

        def close() -> pa.RecordBatch:
            nonlocal no, buf, members, head
            data, valid = bytes(buf), True
            for m in members:
                piece = data[m["start"] : m["start"] + m["length"]]
                if fmt == "zstd":
                    piece = zstandard.ZstdDecompressor().decompress(piece) if piece else b""
                body = m.pop("check")
                valid &= len(piece) == body[0] and hashlib.sha256(piece).hexdigest() == body[1]
            rows = [[f"{kind or 'none'}-{part:05d}-{no:05d}"], [kind], [data], [len(data)], [hashlib.sha256(data).hexdigest()], [members], [valid]]
            no, buf, members, head = no + 1, bytearray(), [], None
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema)], schema=schema)

        for b in batches:
            for k, place, digest, content in zip(*(b.column(i).to_pylist() for i in range(4))):
                if members and (k != kind or len(buf) + len(content) > target):
                    yield close()
                kind = k
                body = content
                if fmt == "zstd":
                    check, body = (len(body), digest), frame(body)
                else:
                    if header and members:
                        first, _, rest = body.partition(b"\n")
                        if first.rstrip(b"\r") == head:
                            body = rest
                    elif header:
                        head = body.partition(b"\n")[0].rstrip(b"\r")
                    check = (len(body), digest if body is content else hashlib.sha256(body).hexdigest())
                    if buf and buf[-1:] != b"\n" and body:
                        buf += b"\n"
                members.append({"place": place, "digest": digest, "start": len(buf), "length": len(body), "check": check})
                buf += body
        if members:
            yield close()

    return run


BUNDLE = "bundle STRING, kind STRING, data BINARY, n_bytes BIGINT, sha256 STRING, members ARRAY<STRUCT<place: STRING, digest: STRING, start: BIGINT, length: BIGINT>>, valid BOOLEAN"


def bundles(files: DataFrame, target_bytes: int = TARGET_BYTES, fmt: str = "lines", header: bool = False) -> DataFrame:
    """Bundles ``(bundle, kind, data, n_bytes, sha256, members, valid)`` of about ``target_bytes`` each; a file that is
    larger than that has its own. ``members``: where each member's bytes are. ``fmt``: lines (newline-delimited,
    a line break between members where one lacks it) or zstd (one frame per member). ``header``: members begin
    with a header line, kept once per bundle.

    Contents move once: copies of a member meet before the shuffle (partial aggregation), and the shuffled partitions
    are merged without another shuffle until each task fills several bundles. A task holds one bundle at a time. An
    empty listing gives no bundle.
    """
    if fmt not in ("lines", "zstd"):
        raise ValueError("fmt is lines or zstd")
    one = list_members(files).groupBy("kind", "place", "digest").agg(F.any_value("content").alias("content"))
    total = files.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    packed = one.coalesce(max(1, total // (4 * target_bytes))).sortWithinPartitions("kind", "place", "digest")
    return packed.select("kind", "place", "digest", "content").mapInArrow(_packer(target_bytes, fmt, header), BUNDLE)


def _pointed(files: DataFrame, packed: DataFrame) -> DataFrame:
    """Each listed row with the member that holds it."""
    m = list_members(files).select("file_id", "kind", "place", "digest", "modified_at")
    at = packed.select("kind", "bundle", "valid", F.explode("members").alias("m")).select("kind", "bundle", "valid", "m.place", "m.digest", "m.start", "m.length")
    return m.join(at, ["kind", "place", "digest"])


def index(files: DataFrame, packed: DataFrame) -> DataFrame:
    """``(file_id, place, bundle, start, length, latest)``: one row per listed row, the member that holds it.
    ``latest``: no later version of the place is listed (by ``modified_at``, then ``file_id``)."""
    m = _pointed(files, packed)
    last = list_members(files).groupBy("kind", "place").agg(F.max(F.struct("modified_at", "file_id", "digest"))["digest"].alias("last"))
    return m.join(last, ["kind", "place"]).select("file_id", "place", "bundle", "start", "length", (F.col("digest") == F.col("last")).alias("latest"))


def bundled_pairs(files: DataFrame, packed: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(file_id_a, file_id_b)``, a < b, of rows that the bundles hold by members of the same place and digest: the same
    member, or one of each kind where a place is listed under several. Raises if a bundle didn't pass its validation."""
    valid = F.when(F.col("valid"), F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("invalid bundle "), F.col("bundle"))))
    scratch = scratch or Scratch(files.sparkSession, "pairs")
    m = scratch.keep(_pointed(files, packed).select("file_id", F.struct("place", valid.alias("digest")).alias("member")), "pointed")
    several = scratch.keep(m.groupBy("member").agg(F.count("*").alias("_a")).where("_a > 1").withColumn("_b", F.col("_a")), "several")
    m = m.join(several.select("member"), "member", "left_semi")
    pairs = hot_expand(m.withColumnRenamed("file_id", "file_id_a"), m.withColumnRenamed("file_id", "file_id_b"), "member", scratch, several)
    return pairs.where("file_id_a < file_id_b").select("file_id_a", "file_id_b").distinct()


def relisted_groups(files: DataFrame, packed: DataFrame) -> DataFrame:
    """``(file_id, member, n)``: each row that lists a member that other rows list too, with the smallest ``file_id`` of them and
    their number. What ``bundled_pairs`` says, but a member with a million rows is a million rows here, not all their pairs."""
    m = _pointed(files, packed).select("file_id", "place", "digest").distinct()
    g = m.groupBy("place", "digest").agg(F.min("file_id").alias("member"), F.count("*").alias("n")).where("n > 1")
    return m.join(g, ["place", "digest"]).select("file_id", "member", "n")


def write_bundles(packed: DataFrame, folder: str, suffix: str = ".txt") -> DataFrame:
    """Writes each bundle as one file of a folder that all executors mount, by a temporary name and a rename, so
    a task that runs twice leaves one file; returns ``(bundle, path, n_bytes, ok)`` read back from the files. For other file
    systems see ``store_bundles``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for name, data, digest in zip(*(b.column(i).to_pylist() for i in range(3))):
                path = os.path.join(folder, name + suffix)
                with open(tmp := f"{path}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(data)
                    f.flush()
                    os.fsync(f.fileno())
                os.replace(tmp, path)
                with open(path, "rb") as f:
                    ok = hashlib.sha256(f.read()).hexdigest() == digest
                yield pa.RecordBatch.from_pylist([{"bundle": name, "path": path, "n_bytes": len(data), "ok": ok}], schema=pa.schema([("bundle", pa.string()), ("path", pa.string()), ("n_bytes", pa.int64()), ("ok", pa.bool_())]))

    return packed.select("bundle", "data", "sha256").mapInArrow(run, "bundle STRING, path STRING, n_bytes BIGINT, ok BOOLEAN")


def store_bundles(packed: DataFrame, folder: str) -> DataFrame:
    """Writes newline-delimited bundles as text files through Spark's own committer, so the folder may be on any file system that
    Spark writes to and lost tasks leave nothing; returns ``(bundle, kind, path, n_bytes, ok)`` read back from the files.

    A bundle is cut at line breaks into the rows of one partition and comes out as one file, in a folder of its kind and name: no
    task holds more than a bundle. ``ok``: length and sha256 of the file are those of the bundle. Bytes that aren't UTF-8 and bundles
    of zstandard frames can't be text: they fail here and are written by ``write_bundles``."""
    text = F.col("data").cast("string")
    body = F.when(text.endswith("\n"), F.expr("substring(string(data), 1, char_length(string(data)) - 1)")).otherwise(text)
    # the writer ends the text with a line break, which a bundle whose last member lacks one doesn't have
    rows = packed.where("n_bytes > 0").select(body.alias("value"), F.coalesce("kind", F.lit("")).alias("kind"), "bundle")
    rows.write.mode("overwrite").option("lineSep", "\n").partitionBy("kind", "bundle").text(folder)
    spark = packed.sparkSession
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where("path like '%/bundle=%'")
    stored = found.select(F.regexp_extract("path", "/bundle=([^/]+)/", 1).alias("bundle"), "path", "length", F.sha2("content", 256).alias("sha"), F.sha2(F.expr("substring(content, 1, length - 1)"), 256).alias("bare"))
    j = packed.where("n_bytes > 0").select("bundle", "kind", "n_bytes", "sha256").join(stored, "bundle", "left")
    exact = (F.col("length") == F.col("n_bytes")) & (F.col("sha") == F.col("sha256"))
    ended = (F.col("length") == F.col("n_bytes") + 1) & (F.col("bare") == F.col("sha256"))
    return j.select("bundle", "kind", "path", "n_bytes", F.coalesce(exact | ended, F.lit(False)).alias("ok"))
