"""Session helpers: the settings the library expects and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "carefold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and a fixed time zone. On a cluster leave ``master``
    unset: spark-submit supplies it, together with memory, cores and ``spark.checkpoint.dir``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Session setting that names the current scratch area.
_AREA = "carefold.scratch.area"


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may go without one; a cluster job that has no shared folder fails here
    rather than writing to a disk the other machines cannot see. Inside ``scratch_area`` it is that area."""
    folder = spark.conf.get(_AREA, None)
    if folder:
        return folder
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="carefold-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


@contextmanager
def scratch_area(spark: SparkSession) -> Iterator[str]:
    """A folder of its own below the shared one for all that operators write inside the block. It goes at the end, after an
    error too, so a job leaves nothing behind. Results are tables over these files: write or collect them inside the block.

    Areas may be nested; a job that is killed outright leaves its area behind."""
    outer = spark.conf.get(_AREA, None)
    folder = f"{work_dir(spark)}/area-{uuid.uuid4().hex}"
    spark.conf.set(_AREA, folder)
    try:
        yield folder
    finally:
        if outer:
            spark.conf.set(_AREA, outer)
        else:
            spark.conf.unset(_AREA)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: iterative jobs keep a short plan and
    survive the loss of executors. ``options`` go to the Parquet writer."""
    path = scratch_path(df.sparkSession, "stage")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task sorts or groups at most where tables are dealt by their size.
TASK_ROWS = 1_000_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into parts of about ``TASK_ROWS`` of its at most ``rows`` rows, for a window or aggregate by
    these keys that follows; as it is if the session's own shuffle partitions are that small."""
    parts = -(-rows // TASK_ROWS)
    return df if parts <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(parts, *keys)


#: Bytes of a file that a task reads where rows grow in memory: a row of a training table takes up to 20 times its size in the file.
SMALL_SPLIT = 16 << 20


@contextmanager
def small_splits(spark: SparkSession) -> Iterator[None]:
    """Scans that start inside the block read at most ``SMALL_SPLIT`` bytes a task, or less if the session says so."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    if int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)) <= SMALL_SPLIT:
        yield
        return
    spark.conf.set(name, str(SMALL_SPLIT))
    try:
        yield
    finally:
        spark.conf.set(name, before)
