"""Joins on keys that many rows lack, and reductions of large tables to asked-for keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts over which rows without a key are dealt.
SPREAD = 1 << 16

Ids = DataFrame | Sequence[int]


def left_join_spread(df: DataFrame, other: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``df`` left-joined with ``other`` on ``keys``, rows that lack a key dealt evenly.

    A plain left join sends all rows with the same NULL key to one task, though none can match.
    Here a second key column is 0 for rows with all keys and, for the others, a number out of the
    columns ``by``, which should tell rows apart; on the other side it is always 0. So rows without
    a key are spread over all tasks of the join's one shuffle, in one pass over ``df`` (dividing the
    table and uniting the parts again would compute ``df`` twice), and rows with a key meet as
    before. The number depends on the row alone: a repeated task deals alike.
    """
    lacks = F.lit(False)
    for key in keys:
        lacks = lacks | F.col(key).isNull()
    part = F.pmod(F.xxhash64(*by), F.lit(SPREAD)).cast("int") + 1
    dealt = df.withColumn("_part", F.when(lacks, part).otherwise(0))
    return dealt.join(other.withColumn("_part", F.lit(0)), [*keys, "_part"], "left").drop("_part")


def of_ids(df: DataFrame, ids: Ids, column: str = "partner_id") -> DataFrame:
    """Rows whose ``column`` is among ``ids``: a filter that reaches the scan for a list, a
    semi-join for a table."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(column)), column, "left_semi")
    return df.filter(F.col(column).isin(*ids))


def of_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` occurs in ``keys``, before anything is aggregated.

    ``keys`` should be a stored table (``session.kept``), so that its size is known: a small one is
    broadcast, and rows go in the task that reads them; for a larger one Spark puts a Bloom filter
    of the keys above the scan, and only what passes is shuffled.
    """
    return df.join(keys.select(column), column, "left_semi")
