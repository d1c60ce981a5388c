"""Written tables that cut lineage, in the shared folder of the cluster.

Iterative operators write each round as a Parquet table below ``spark.checkpoint.dir`` and read it back, so a
lost executor costs a re-read and never a recomputation of all earlier rounds. Nothing is kept in executor
memory or on executor-local disk only.
"""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder for written tables: the session's ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder is made for a local master only; any other master raises, as a
    machine-local folder can't be read by other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        app = spark.sparkContext.applicationId
        if app not in _ROOTS:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            _ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="veldra-")
        root = _ROOTS[app]
    return root.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder; anything that keeps this from being known raises."""
    p, fs = _at(spark, path)
    return fs.exists(p)


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    p, fs = _at(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, which marks that something is complete."""
    p, fs = _at(spark, path)
    fs.create(p, True).close()


def stamp(spark: SparkSession, *paths: str) -> str:
    """A name for the present content of files or folders, by the names, lengths and times of their files."""
    said = []
    for path in paths:
        p, fs = _at(spark, path)
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            said.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(said)).encode()).hexdigest()[:16]


class Scratch:
    """Tables of one run of an operator. ``keep`` writes a table and returns it read back; with ``replaces`` the
    table that it was made of is deleted once the new one is complete."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/veldra-{name}-{uuid.uuid4().hex}"
        self._paths: set[str] = set()
        atexit.register(self._forget)

    def path(self, tag: str) -> str:
        return f"{self.base}/{tag}-{uuid.uuid4().hex[:8]}"

    def keep(self, df: DataFrame, tag: str, replaces: DataFrame | None = None) -> DataFrame:
        path = self.path(tag)
        df.write.option("compression", "lz4").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths.add(path)
        out._veldra_scratch = (self, path)  # for drop and only; a table that neither deletes stays until the session ends
        if replaces is not None:
            self.drop(replaces)
        return out

    def measured(self, df: DataFrame, tag: str, replaces: DataFrame | None = None, **facts: Column) -> tuple[DataFrame, dict]:
        """``keep`` with aggregates of the table, collected by the tasks that write it: no other pass reads it. What the tasks
        of the last stage observe counts once whatever is run again."""
        seen = Observation(f"veldra-{uuid.uuid4().hex}")
        aggregates = [c.alias(k) for k, c in facts.items()]
        out = self.keep(df.observe(seen, *aggregates), tag, replaces)
        got = dict(seen.get)
        return out, got if got.keys() >= facts.keys() else out.agg(*aggregates).first().asDict()

    def drop(self, df: DataFrame) -> None:
        at = getattr(df, "_veldra_scratch", None)
        if at and at[1] in self._paths:
            delete_path(self.spark, at[1])
            self._paths.discard(at[1])

    def only(self, *kept: DataFrame) -> None:
        """Deletes all tables of this run but ``kept``; for the end of an operator whose result is one of them."""
        stay = {df._veldra_scratch[1] for df in kept}
        for path in self._paths - stay:
            delete_path(self.spark, path)
        self._paths &= stay

    def _forget(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                delete_path(self.spark, self.base)
        except Exception:  # the JVM may be gone by now
            pass
