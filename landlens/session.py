"""Session helpers: settings, parallelism and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "landlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, skew-join splitting and UTC timestamps; extra settings by keyword (dots as ``__``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    defaults.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition before a step that multiplies rows, so one input split never feeds one huge task.

    The partition count is explicit, otherwise AQE would size it by the (small) rows before the fan-out.
    """
    return df.repartition(parallelism(df.sparkSession), *keys)


def widen(df: DataFrame) -> DataFrame:
    """Deal rows over all tasks before costly expressions per row, whatever the number of input splits."""
    return df.repartition(parallelism(df.sparkSession))


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach: the one named in ``spark.checkpoint.dir``, else the context's own.

    Only a local session without any setting (as in tests) gets a temporary folder.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="landlens-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute once, write to the shared folder and read back.

    A written table survives the loss of executors, and unlike a cached or checkpointed plan it gives later steps real
    sizes to choose joins by and lets them read only the columns they use.
    """
    path = f"{shared_folder(df.sparkSession)}/landlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[written] = path
    return written


#: Where each table of :func:`cut_lineage` lies, as long as someone holds it.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`cut_lineage` that no frame still to be computed reads; other frames are left alone."""
    for table in tables:
        path = _PATHS.pop(table, None)
        if path is not None:
            context = table.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile remove their shuffle files when they end, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def lookup_join(left: DataFrame, lookup: DataFrame, on: list[str]) -> DataFrame:
    """LEFT join to a lookup table with one row per key, one plan at every size.

    Spark broadcasts the lookup where its measured size allows. Otherwise both sides are shuffled by the key, and adaptive
    execution splits the left side's partitions that hold a hot key, or the rows without a key, over several tasks.
    """
    return left.join(lookup, on, "left")
