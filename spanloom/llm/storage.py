"""Shared-folder helpers: written intermediate tables, lookups by row number, binary files.

Everything that more than one task reads goes to the folder named by
``spark.checkpoint.dir``, which driver and executors share.  Tables are written
by Spark's own writers; binary files go through ``pyarrow.fs``, which resolves
``file:``, ``hdfs:``, ``s3:`` and ``gs:`` addresses alike.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FALLBACK: list[str] = []
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one is made only where none is set and all runs in
    one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _FALLBACK:
        _FALLBACK.append(tempfile.mkdtemp(prefix="spanloom-shared-"))
    return f"file://{_FALLBACK[0]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/spanloom-{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def _tidy(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends."""
    before = spark.conf.get(_CLEANUP_KEY, None)
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP_KEY) if before is None else spark.conf.set(_CLEANUP_KEY, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and return its rereading; cuts lineage and lets go
    of the shuffle files that made it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spanloom_path = path
    return out


class Beside:
    """Rows that tasks look up by the number of the row they are at (``rid``, made by
    monotonically_increasing_id: the partition in the upper bits, the place in the lower
    ones), so a wide table meets a narrow one without being shuffled."""

    FOLDERS = 4096

    def __init__(self, spark: SparkSession, path: str):
        self.sparkSession, self._spanloom_path = spark, path

    def __getstate__(self):
        return {"_spanloom_path": self._spanloom_path}

    def of(self, rids: np.ndarray) -> dict[int, list[tuple]]:
        """The other columns of the rows that belong to rids, in column order."""
        import pyarrow.dataset as ds

        fs, root = fs_of(normal_uri(self._spanloom_path))
        rids = np.asarray(rids, np.int64)
        out: dict[int, list[tuple]] = {}
        for part in np.unique(rids >> 33).tolist():
            own = rids[rids >> 33 == part]
            folder = f"{root}/_g={part % self.FOLDERS}"
            if fs.get_file_info(folder).type.name == "NotFound":
                continue
            rid = ds.field("rid")
            t = ds.dataset(folder, format="parquet", filesystem=fs).to_table(filter=(rid >= int(own.min())) & (rid <= int(own.max())))
            names = [c for c in t.column_names if c != "rid"]
            for r, *rest in zip(*(t.column(c).to_pylist() for c in ("rid", *names)), strict=True):
                out.setdefault(r, []).append(tuple(rest))
        return out


def beside(rows: DataFrame, name: str) -> Beside:
    """rows (rid and more) written for lookups: at most FOLDERS folders, sorted by rid."""
    spark = rows.sparkSession
    path = fresh_path(spark, name)
    folder = F.pmod(F.shiftright("rid", 33), F.lit(Beside.FOLDERS)).cast("int")
    with _tidy(spark):
        dealt = rows.withColumn("_g", folder).repartition(shuffle_parts(spark), "_g").sortWithinPartitions("_g", "rid")
        dealt.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).partitionBy("_g").parquet(path)
    return Beside(spark, path)


def discard(*tables: DataFrame | Beside) -> None:
    """Delete written tables that no later step reads."""
    for t in tables:
        path = getattr(t, "_spanloom_path", None)
        if path:
            delete_path(t.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def fs_of(uri: str):
    """(file system, path) of an address, usable on driver and executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def normal_uri(uri: str) -> str:
    """file:/x and file:///x name one place; pyarrow wants the longer form."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        return "file://" + uri[5:]
    return uri


def make_dir(uri: str) -> None:
    f, p = fs_of(uri)
    f.create_dir(p, recursive=True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to Python workers that could not import it otherwise, and bound the
    bytes of a batch that goes to Python where the session has no bound of its own."""
    if spark.conf.get(_BATCH_KEY) == "67108864b":
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = [os.path.abspath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)] + [os.getcwd()]
    app = spark.sparkContext.applicationId
    if root not in known and app not in _SHIPPED:
        folder = tempfile.mkdtemp(prefix="spanloom-ship-")
        name = os.path.join(folder, "spanloom_package.zip")
        with zipfile.ZipFile(name, "w") as z:
            for d, _, files in os.walk(os.path.join(root, "spanloom")):
                for f in files:
                    if f.endswith((".py", ".csv")):
                        full = os.path.join(d, f)
                        z.write(full, os.path.relpath(full, root))
        spark.sparkContext.addPyFile(name)
        shutil.rmtree(folder, ignore_errors=True)
        _SHIPPED.add(app)
    return spark
