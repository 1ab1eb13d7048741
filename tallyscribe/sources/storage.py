"""Where intermediate tables go: the shared folder of the cluster, never a machine's own disk."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
#: Sessions that are writing a stage: how many threads do, and the setting that they found.
_WRITING: dict[int, list] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the checkpoint folder of the context.

    A session in one process (tests) with neither gets a temporary folder; any cluster, also one on this machine, must
    name a folder that all its processes reach.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses, under the application's part of the shared folder.

    Everything an application stored can be dropped with that one folder when it has ended.
    """
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a query that starts in here has shuffled is deleted as soon as it has ended, and not when the driver next collects its garbage."""
    with _LOCK:
        mine = _WRITING.setdefault(id(spark), [0, spark.conf.get(CLEANUP, None)])
        mine[0] += 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            mine[0] -= 1
            if not mine[0]:
                del _WRITING[id(spark)]
                spark.conf.unset(CLEANUP) if mine[1] is None else spark.conf.set(CLEANUP, mine[1])


def save_stage(df: DataFrame, path: str, partition_by: str | None = None) -> str:
    """Write one stage of the analysis as Parquet. Only the files stay: readers start from them, so nothing needs the shuffles again."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    with shuffles_dropped(df.sparkSession):
        writer.parquet(path)
    return path


def load_stage(spark: SparkSession, path: str) -> DataFrame:
    """Read a stage back."""
    return spark.read.parquet(path)


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, for frames that many jobs start from."""
    spark = df.sparkSession
    return load_stage(spark, save_stage(df, new_path(spark, name)))


def drop_stage(spark: SparkSession, path: str) -> None:
    """Delete a stage that nothing reads any more, by the file system that its path names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
