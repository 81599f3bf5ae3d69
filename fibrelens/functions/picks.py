"""One-row and few-rows-per-key selections that keep hot keys harmless.

The one-row forms are aggregates, so every map task sends at most one row per key to
the shuffle. The few-rows form ranks inside salted sub-groups first.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOP_N_SALTS = 32

# Microseconds from 1970 to the first and last moment of the years 1 to 9999.
_FIRST_MICROS, _LAST_MICROS = -62_135_596_800_000_000, 253_402_300_799_999_999
_SHIFT = Decimal(10) ** 20
_ZERO = Decimal(2**63 + 1)


def newest(*cols: Column) -> Column:
    """Aggregate: the row with the largest leading column, NULLs last, later columns break ties."""
    return F.max(F.struct(*cols))


def oldest(first: Column, *rest: Column) -> Column:
    """Aggregate: the row with the smallest leading column, NULLs last, later columns break ties."""
    return F.min(F.struct(first.isNull().alias("_missing"), first, *rest))


def newest_per(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str], among: DataFrame | None = None
) -> DataFrame:
    """Newest row per key (of ``among``). ``carry`` columns follow ``order`` as tie-breaks.

    The semi-join stands right on the aggregation, where Spark can move it below if ``among`` is
    known to be small.
    """
    cols = [F.col(c) for c in [*order, *carry]]
    picked = df.groupBy(*keys).agg(newest(*cols).alias("_row"))
    if among is not None:
        picked = picked.join(among, list(keys), "left_semi")
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in [*order, *carry]])


def packed(moment: Column, amount: Column) -> Column:
    """A moment and a whole number in one decimal(38,0) that sorts like the pair, NULLs first.

    A maximum over structs keeps its state outside the fixed-width buffer that hash aggregation
    needs, so Spark sorts the raw rows; a maximum over this number is a hash aggregate. The 18
    upper digits hold the microseconds since the year 1, the 20 lower ones the number, moved up so
    that it is not negative; a 0 stands for NULL in either. Moments beyond the years 1 to 9999 count
    as the nearest moment within. The session zone is UTC, as everywhere here.
    """
    micros = F.unix_micros(moment.cast("timestamp"))
    inside = F.least(F.greatest(micros, F.lit(_FIRST_MICROS)), F.lit(_LAST_MICROS))
    upper = F.when(moment.isNotNull(), inside - F.lit(_FIRST_MICROS - 1)).otherwise(F.lit(0)).cast("decimal(18,0)")
    lower = F.coalesce(amount.cast("decimal(20,0)") + F.lit(_ZERO), F.lit(Decimal(0))).cast("decimal(20,0)")
    return (upper * F.lit(_SHIFT) + lower).cast("decimal(38,0)")


def unpacked(pair: Column, kind: T.DataType) -> tuple[Column, Column]:
    """The moment (of type ``kind``) and the number of a ``packed`` pair."""
    upper = F.floor(pair / F.lit(_SHIFT)).cast("bigint")
    lower = (pair - upper.cast("decimal(18,0)") * F.lit(_SHIFT)).cast("decimal(20,0)")
    moment = F.when(upper > 0, F.timestamp_micros(upper + F.lit(_FIRST_MICROS - 1)).cast(kind))
    return moment, F.when(lower > 0, (lower - F.lit(_ZERO)).cast("bigint"))


def salted_top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """A superset of the n first rows per key with at most ``n * TOP_N_SALTS`` rows per key.

    Rows are ranked within (key, salt); whatever the split, the true top n survive, and no
    task sees more of a hot key than its share. The salt is the input partition, so a map
    task forwards at most n rows per key (Spark prunes there for n up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``, 1000 unless set).
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(TOP_N_SALTS)))
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    return (
        salted.withColumn("_rank", F.row_number().over(within))
        .filter(F.col("_rank") <= n)
        .drop("_rank", "_salt")
    )
