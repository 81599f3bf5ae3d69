"""Time helpers. "Now" is always the caller's ``as_of``; nothing reads the clock.

``as_of`` is taken apart in Python, so month starts reach the plan as literals and
comparisons on plain columns can be pushed down to the scan.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AsOf = datetime | date | str


def as_datetime(as_of: AsOf) -> datetime:
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    if isinstance(as_of, datetime):
        if as_of.tzinfo is not None:
            raise ValueError("as_of must be a naive UTC time")
        return as_of
    return datetime(as_of.year, as_of.month, as_of.day)


def ts_lit(moment: AsOf) -> Column:
    """Zone-free timestamp literal; compares with both timestamp types."""
    return F.lit(as_datetime(moment).isoformat(sep=" ")).cast("timestamp_ntz")


def date_lit(moment: AsOf) -> Column:
    return F.lit(as_datetime(moment).date())


#: Partition column of tables laid out by day (see ``fibrelens.sources.layout``).
EVENT_DAY = "event_day"


def within(df: DataFrame, column: str, start: AsOf | None = None, end: AsOf | None = None) -> DataFrame:
    """Rows with start <= column < end, either bound left out if None.

    A table that is laid out by the day of ``column`` gets the same bounds on its partition column,
    so that Spark lists only the days in question.
    """
    is_day = dict(df.dtypes)[column] == "date"
    literal = date_lit if is_day else ts_lit
    rows = df
    if start is not None:
        rows = rows.filter(F.col(column) >= literal(start))
    if end is not None:
        rows = rows.filter(F.col(column) < literal(end))
    if EVENT_DAY in df.columns:
        if start is not None:
            rows = rows.filter(F.col(EVENT_DAY) >= date_lit(start))
        if end is not None:
            last = as_datetime(end) if is_day else as_datetime(end) - timedelta(microseconds=1)
            day = F.col(EVENT_DAY)
            rows = rows.filter(day < date_lit(last) if is_day else day <= date_lit(last))
    return rows


def days_before(as_of: AsOf, days: int) -> datetime:
    """Midnight ``days`` days before the day of ``as_of``."""
    now = as_datetime(as_of)
    return datetime(now.year, now.month, now.day) - timedelta(days=days)


def month_start(as_of: AsOf, back: int = 0) -> datetime:
    """First moment of the month ``back`` months before that of ``as_of``."""
    now = as_datetime(as_of)
    months = now.year * 12 + now.month - 1 - back
    return datetime(months // 12, months % 12 + 1, 1)


def month_label(as_of: AsOf, back: int = 0) -> str:
    return month_start(as_of, back).strftime("%b %Y")


def month_key(as_of: AsOf, back: int = 0) -> str:
    return month_start(as_of, back).strftime("%Y-%m")


def month_of(moment: Column) -> Column:
    """Month of a timestamp, as the date of its first day."""
    return F.trunc(moment.cast("date"), "MM")


def add_seconds(moment: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, moment)


def shift_minutes(moment: Column, minutes: int) -> Column:
    if minutes == 0:
        return moment
    return F.timestamp_add("MINUTE", F.lit(minutes), moment)


def day_gap(later: Column, earlier: Column) -> Column:
    """Number of calendar-day boundaries between two moments (not elapsed 24-hour spans)."""
    return F.datediff(later.cast("date"), earlier.cast("date"))
