"""The decision log as a stream: lines are appended to a folder, the latest decision per item is kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.queues import STATUSES
from ..storage import delete_path, exists, list_names

SCHEMA = "line_no BIGINT, sample_id STRING, status STRING, text STRING, recorded_at TIMESTAMP"


def parse_log(lines: DataFrame) -> DataFrame:
    """Decisions of ``lines (value)``: torn lines, lines without an id and unknown statuses are left out."""
    d = lines.select(F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("d")).select("d.*")
    return d.where(F.col("sample_id").isNotNull() & F.col("status").isin(STATUSES))


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return parse_log(spark.readStream.schema("value STRING").text(folder))


def latest_stream(decisions: DataFrame) -> DataFrame:
    """The decision with the highest line number of each item; state is one row per item."""
    return decisions.groupBy("sample_id").agg(F.max(F.struct("line_no", "status", "text")).alias("l")).select("sample_id", "l.line_no", "l.status", "l.text")


def counts_by_window(decisions: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Decisions by status per time window; rows later than ``late`` are dropped with the window's state."""
    return decisions.withWatermark("recorded_at", late).groupBy(F.window("recorded_at", width), "status").agg(F.count("*").alias("n"))


def _newest(batch: DataFrame) -> DataFrame:
    g = batch.groupBy("sample_id").agg(F.max(F.struct("line_no", "status", "text")).alias("l"))
    return g.select("sample_id", "l.line_no", "l.status", "l.text")


def keep_latest(decisions: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Upserts each micro-batch into a Parquet table by writing the next version beside the last; the version is
    the batch number, so a batch that runs again overwrites only itself. The version before stays for readers, older
    ones are deleted. A version that is there but can't be read stops the stream. For large tables see
    ``keep_latest_by_bucket``."""

    def upsert(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        new = batch.select("sample_id", "line_no", "status", "text")
        versions = sorted(int(v[1:]) for v in list_names(spark, table) if v[1:].isdigit() and exists(spark, f"{table}/{v}/_SUCCESS"))
        if before := [v for v in versions if v < no]:
            new = spark.read.parquet(f"{table}/v{before[-1]}").unionByName(new)
        _newest(new).write.mode("overwrite").parquet(f"{table}/v{no}")
        for v in before[:-1]:
            delete_path(spark, f"{table}/v{v}")

    return decisions.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _current(spark: SparkSession, table: str, below: int | None = None) -> dict[str, list[int]]:
    """The complete versions of each bucket, in order; at most BUCKETS names with two versions each."""
    out: dict[str, list[int]] = {}
    for v in list_names(spark, table):
        if v[1:].isdigit() and exists(spark, f"{table}/{v}/_SUCCESS") and (below is None or int(v[1:]) < below):
            for b in list_names(spark, f"{table}/{v}"):
                if b.startswith("bucket="):
                    out.setdefault(b, []).append(int(v[1:]))
    return {b: sorted(x) for b, x in out.items()}


#: Parts of a table kept by bucket.
BUCKETS = 64


def keep_latest_by_bucket(decisions: DataFrame, table: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Like ``keep_latest`` for tables of any size: a micro-batch reads and rewrites only the buckets of the ids that it has.
    A version that is complete isn't written again, so a batch may run twice; the version of a bucket before its last
    stays until the bucket is written again. ``read_latest`` reads the table."""

    def upsert(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        if exists(spark, f"{table}/v{no}/_SUCCESS"):
            return
        new = _newest(batch).withColumn("bucket", F.pmod(F.xxhash64("sample_id"), F.lit(buckets)).cast("int")).persist()
        touched = {f"bucket={r.bucket}" for r in new.select("bucket").distinct().collect()}
        have = {b: v for b, v in _current(spark, table, no).items() if b in touched}
        both = new
        if have:
            both = _read(spark, [f"{table}/v{v[-1]}/{b}" for b, v in have.items()], buckets).unionByName(new)
        _newest(both).withColumn("bucket", F.pmod(F.xxhash64("sample_id"), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v{no}")
        new.unpersist()
        for b, v in have.items():
            for old in v[:-1]:
                delete_path(spark, f"{table}/v{old}/{b}")

    return decisions.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _read(spark: SparkSession, paths: list[str], buckets: int) -> DataFrame:
    rows = spark.read.schema("sample_id STRING, line_no BIGINT, status STRING, text STRING").parquet(*paths)
    return rows.withColumn("bucket", F.pmod(F.xxhash64("sample_id"), F.lit(buckets)).cast("int"))


def read_latest(spark: SparkSession, table: str) -> DataFrame:
    """``(sample_id, line_no, status, text)`` of a table kept by bucket; empty if nothing was written yet."""
    paths = [f"{table}/v{v[-1]}/{b}" for b, v in _current(spark, table).items()]
    schema = "sample_id STRING, line_no BIGINT, status STRING, text STRING"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
