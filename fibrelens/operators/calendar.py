"""Months relative to ``as_of``: M0 is its month, M1..M3 the three before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fibrelens.functions.times import AsOf, as_datetime, month_of, month_start


def month_offset(moment: Column, as_of: AsOf) -> Column:
    """0 for the month of ``as_of``, 1 for the month before, negative for later months."""
    now = as_datetime(as_of)
    base = now.year * 12 + now.month
    return (F.lit(base) - (F.year(moment) * 12 + F.month(moment))).cast("int")


def month_keys(df: DataFrame, time_col: str, as_of: AsOf) -> DataFrame:
    """Attach month start, 'YYYY-MM' key, 'Mon YYYY' label and offset, for rows of M0..M3."""
    moment = F.col(time_col)
    month = month_of(moment)
    window = (moment >= F.lit(month_start(as_of, 3).date())) & (moment < F.lit(month_start(as_of, -1).date()))
    return df.filter(window).withColumns(
        {
            "month": month,
            "month_key": F.date_format(month, "yyyy-MM"),
            "month_label": F.date_format(month, "MMM yyyy"),
            "month_off": month_offset(moment, as_of),
        }
    )
