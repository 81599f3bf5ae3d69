"""Wide-to-long reshaping without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stack_months(df: DataFrame, keys: Sequence[str], rows: Sequence[dict[str, Column]]) -> DataFrame:
    """One output row per element of ``rows``, all of which name the same columns."""
    structs = [F.struct(*[value.alias(name) for name, value in row.items()]) for row in rows]
    return df.select(*keys, F.inline(F.array(*structs)))
