"""The cluster's shared folder, intermediate tables in it, and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session may go without the setting."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not hasattr(context, "_corpus_dir"):
            context._corpus_dir = "file://" + tempfile.mkdtemp(prefix="corpus-")
        found = context._corpus_dir
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job in here go when it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs do not repeat its work."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept_rows(docs: DataFrame, key: Column, kept: DataFrame, kept_key: str) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, ``key``) is that of a row (doc_id, ``kept_key``) of ``kept``, one
    of each, with all their columns. Join and grouping share one key that holds a null doc_id as a
    value, so texts are shuffled once.
    """
    own, other = unused("_own", docs), unused("_other", docs)
    # One type on both sides, nulls allowed: else the join would cast, and deal by the cast.
    kind = f"struct<id:{docs.schema['doc_id'].dataType.simpleString()},key:bigint>"
    keyed = docs.withColumn(own, F.struct(F.col("doc_id"), key).cast(kind))
    wanted = kept.select(F.struct("doc_id", kept_key).cast(kind).alias(other))
    rows = keyed.join(wanted, F.col(own) == F.col(other), "left_semi")
    return rows.dropDuplicates([own]).select(*docs.columns)


def unused(name: str, df: DataFrame) -> str:
    """``name``, with underscores put before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that they need no copy of their own."""
    context = spark.sparkContext
    if getattr(context, "_corpus_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="corpus-code-"), "corpus_code.zip")
    root = PACKAGE.parent
    with zipfile.ZipFile(archive, "w") as out:
        out.write(root / "__init__.py", f"{root.name}/__init__.py")
        for source in sorted(PACKAGE.glob("*.py")):
            out.write(source, f"{root.name}/{PACKAGE.name}/{source.name}")
    context.addPyFile(archive)
    context._corpus_shipped = True
