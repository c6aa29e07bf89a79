"""Session helpers: shipping the package to executors and the folder that all nodes share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of input files to a partition, where a task sorts all its rows for several windows.
DEALT_BYTES = 8_000_000
#: Texts that a Python worker holds as Python objects at a time, with what is made of them.
SLICE_ROWS = 256
#: Spark's setting by which a query's shuffle files are removed at its end.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: dict[str, str] = {}
_own_shared: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run (once per application)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="quantloom-"), "quantloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    sc.addPyFile(target)
    _shipped[sc.applicationId] = target


def by_slices(run: Callable[[list], pa.Array], forget: Callable[[], None] | None = None):
    """A function for ``arrow_udf``: ``run`` gets the values of few rows at a time, and ``forget`` runs at a task's end.

    Spark's tasks take their Python workers in turn, and workers that wait count as an executor's memory, too. So a
    worker keeps neither a batch's values as Python objects nor, when its task is over, what would only save time."""

    def some_at_a_time(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            for at in range(0, len(values), SLICE_ROWS):
                yield run(values.slice(at, SLICE_ROWS).to_pylist())
            del values
        if forget:
            forget()
        _give_back()

    return some_at_a_time


def _give_back() -> None:
    """Return what this process has freed to the system, where its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``. Where neither is
    set, as in tests, a single machine gets a folder of its own; a cluster is refused, as its machines do
    not see each other's."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if sc.applicationId not in _own_shared:
        _own_shared[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="quantloom-shared-")
    return _own_shared[sc.applicationId]


def _application_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quantloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder, in that of this application."""
    return f"{_application_dir(spark)}/{uuid.uuid4().hex[:12]}-{tag}"


def clear_written(spark: SparkSession) -> None:
    """Delete all tables and files that this application has written below the shared folder. Call it when
    no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_application_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tag: str, tidy: bool = False) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it again.

    Unlike a cached or locally checkpointed frame the table outlives lost executors. It stays until
    :func:`clear_written`. With ``tidy`` the shuffle files behind it go as soon as it is there; else Spark removes
    them when the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true" if tidy else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def _called_for(df: DataFrame) -> int:
    """Partitions of ``DEALT_BYTES`` that the files which a frame reads call for."""
    spark = df.sparkSession
    size, systems = 0, {}
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        root = tuple(name.split("/", 3)[:3])
        if root not in systems:
            systems[root] = path.getFileSystem(spark._jsc.hadoopConfiguration())
        size += systems[root].getFileStatus(path).getLen()
    return -(-size // DEALT_BYTES)


def partitions_for(df: DataFrame) -> int:
    """As many partitions as the files that a frame reads call for, so that a task's rows do not grow with them;
    not fewer than ``spark.sql.shuffle.partitions``. Frames that read no files get those."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), _called_for(df))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key in one partition; of partitions there are more for larger inputs.

    Their number is given, however many shuffle partitions are set: without it Spark puts partitions together up
    to 64 MB of shuffled bytes, which are millions of rows. Only files that are one partition's are left to Spark."""
    spark, n = df.sparkSession, _called_for(df)
    if n <= 1:
        return df.repartition(*keys)
    return df.repartition(max(n, min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)), *keys)
