"""Intermediate tables that survive the loss of an executor.

``staged`` cuts a plan's lineage by writing it as a table into the folder named by
``spark.checkpoint.dir``, which all executors share, and reading it back. ``join_checked`` is the
one place where a join side may be broadcast: it counts the side first and falls back to a shuffled join.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side of at most so many bytes may be broadcast.
BROADCAST_BYTES = 32 << 20

#: Setting by which Spark drops the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder; a temporary one is made only where none is set and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="helixmill-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` into the shared folder and return the table read back from there."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/stage-{tag}-{uuid.uuid4().hex}"
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for files other than tables; ``release`` deletes it too."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends: its result stands in the shared folder, nothing reads them again."""
    before = spark.conf.get(_CLEANUP, None)
    if before is not None:
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)


def release(spark: SparkSession) -> None:
    """Delete every staged table of this session. Results that still read one must be written before."""
    mine = [p for s, p in _written if s is spark]
    _written[:] = [x for x in _written if x[0] is not spark]
    for path in mine:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        try:
            release(spark)
        except Exception:  # the JVM may be gone already; the folder's owner then clears it
            pass


#: Inputs of fewer bytes than this a core are dealt out anew before a kernel runs over them.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if Spark takes it for small: a few small files would keep a few cores busy.
    Larger inputs have more splits than cores by themselves and aren't moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a staged table's rows, at ``row_bytes`` each, stay under ``limit``. Counts at most limit rows."""
    most = max(1, limit // max(1, row_bytes))
    return df.limit(most + 1).count() <= most


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", row_bytes: int = 64, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join that broadcasts ``right`` (a staged table) only after its size was checked, else shuffles."""
    return left.join(F.broadcast(right) if small_enough(right, row_bytes, limit) else right, on, how)
