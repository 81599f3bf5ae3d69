"""Logical tables laid out by day, so that a report over some days lists and reads only these.

``write_days`` writes a table partitioned by the day of its time column; ``load_days`` reads it
with the fixed schema and, beside it, the partition column. The operators' time windows
(``functions.times.within``) put their bounds on that column too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fibrelens.functions.times import EVENT_DAY, AsOf, within
from fibrelens.sources.schemas import DAY_COLUMNS
from fibrelens.sources.tables import conform


def write_days(df: DataFrame, name: str, path: str) -> None:
    """Write the days of ``df`` under ``path``, in place of what is there for these days; other days
    stay as they are.

    Rows are brought together by day, small days share a task, and Spark splits a day that holds much
    of the table at run time, by measured sizes; so files are neither tiny nor huge.
    """
    column = DAY_COLUMNS[name]
    rows = conform(df, name)
    dated = rows.withColumn(EVENT_DAY, F.col(column).cast("date"))
    dealt = df.sparkSession.sql(f"SELECT /*+ REBALANCE({EVENT_DAY}) */ * FROM {{dated}}", dated=dated)
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(EVENT_DAY).parquet(path)


def load_days(spark: SparkSession, name: str, path: str, start: AsOf | None = None, end: AsOf | None = None) -> DataFrame:
    """Read a table written by ``write_days``: its columns and ``event_day``; rows of
    start <= time < end if bounds are given."""
    raw = spark.read.parquet(path)
    typed = conform(raw, name, keep=[EVENT_DAY])
    return within(typed, DAY_COLUMNS[name], start, end)
