"""Session settings and the places where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning decides broadcasts from measured sizes and splits hot join keys.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


# Shuffle data per task aimed at when a cluster job is sized.
TASK_BYTES = 128 * 1024 * 1024


def settings_for(shuffle_bytes: int) -> dict[str, str]:
    """Settings for a job whose largest shuffle writes about ``shuffle_bytes``.

    The first number of shuffle partitions is set so that each holds ``TASK_BYTES``; Spark
    merges partitions that turn out smaller. The default of 200 would put hundreds of
    gigabytes into one task at 100 TB.
    """
    partitions = max(200, -(-shuffle_bytes // TASK_BYTES))
    return {
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * TASK_BYTES),
    }


def build_session(app_name: str = "fibrelens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's ``spark.checkpoint.dir``.

    Only when none is set and the session is a local one (tests) is a temporary folder used.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(sc, "_own_folder"):
        sc._own_folder = tempfile.mkdtemp(prefix="fibrelens-")
    return sc._own_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder, so that several reports can
    read it and a lost executor does not force a recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def new_table_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def with_conf(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings that hold in here only; ``conf`` keys use ``__`` for dots."""
    keys = {key.replace("__", "."): value for key, value in conf.items()}
    before = {key: spark.conf.get(key, None) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def shuffles_dropped(spark: SparkSession):
    """Shuffle files of a job in here go when it ends, not when the driver happens to collect its garbage."""
    return with_conf(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: unlike a checkpoint, the table has a
    known size, by which Spark decides on broadcasts, and filters reach its scan."""
    return _keep(df, new_table_path(df.sparkSession, name))


def _keep(df: DataFrame, path: str) -> DataFrame:
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``kept`` for tables that are needed in here only: their files go at the end."""
    paths = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        paths.append(new_table_path(spark, name))
        return _keep(df, paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete the files under ``path``, if there are any."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
