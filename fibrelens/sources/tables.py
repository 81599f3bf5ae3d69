"""Loading a logical table: any Spark source in, the fixed schema out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fibrelens.functions.values import to_long
from fibrelens.sources.schemas import ALIASES, TABLES

_TIMES = (T.TimestampType, T.TimestampNTZType)
_UTC = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def _fit(value: Column, have: T.DataType, want: T.DataType, strict: bool) -> Column:
    """Cast only where the type differs, so that filters on the column still reach the scan.

    Of the two timestamp types either will do, as long as the session zone is UTC (see ``conform``).
    """
    if have == want or (isinstance(have, _TIMES) and isinstance(want, _TIMES)):
        return value
    if strict:
        return value.cast(want)
    if isinstance(want, T.LongType) and not isinstance(have, (T.IntegralType, T.DecimalType)):
        return to_long(value)
    return value.try_cast(want)


def conform(
    df: DataFrame,
    name: str,
    aliases: dict[str, str] | None = None,
    strict: bool = False,
    keep: Sequence[str] = (),
    lost: Observation | None = None,
) -> DataFrame:
    """Find the needed columns in any letter case or under an alias, and type them.

    ``aliases`` maps a deployment's own column names to ours, beside the known ones. Values that
    do not fit a type become NULL, or raise an error if ``strict``. ``keep`` names columns beside the
    schema's that stay. ``lost`` is told, while the table is read for whatever purpose, how many
    values of each converted column became NULL (``lost.get``, after an action); this takes no pass
    of its own. It names every converted column, also if nothing was lost.
    """
    found = {field.name.lower(): field for field in df.schema}
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    names = {new: old for old, new in ALIASES.get(name, {}).items()}
    names |= {new: old.lower() for old, new in (aliases or {}).items()}
    picked, missing, losses = [], [], []
    for want in table_schema(name):
        have = found.get(want.name) or found.get(names.get(want.name, ""))
        if have is None:
            missing.append(want.name)
        elif isinstance(have.dataType, T.TimestampType) and zone not in _UTC:
            raise ValueError(f"{name}.{want.name} has a zone and the session zone is {zone}; set it to UTC")
        else:
            raw = F.col(f"`{have.name}`")
            typed = _fit(raw, have.dataType, want.dataType, strict)
            picked.append(typed.alias(want.name))
            if typed is not raw:
                losses.append(F.count_if(raw.isNotNull() & typed.isNull()).alias(want.name))
    if missing:
        raise ValueError(f"table {name} lacks columns: {', '.join(missing)}")
    if lost is not None:
        df = df.observe(lost, F.count(F.lit(1)).alias("rows"), *losses)
    return df.select(*picked, *keep)


def load_table(
    spark: SparkSession,
    name: str,
    path: str,
    fmt: str = "parquet",
    aliases: dict[str, str] | None = None,
    strict: bool = False,
    lost: Observation | None = None,
) -> DataFrame:
    """Read one logical table from files; for ``lost`` see ``conform``."""
    return conform(spark.read.format(fmt).load(path), name, aliases, strict, lost=lost)


def load_catalog_table(
    spark: SparkSession, name: str, identifier: str, aliases: dict[str, str] | None = None, strict: bool = False
) -> DataFrame:
    """Read one logical table from the session catalog."""
    return conform(spark.table(identifier), name, aliases, strict)


def load_tables(
    spark: SparkSession,
    root: str,
    names: list[str] | None = None,
    fmt: str = "parquet",
    aliases: dict[str, dict[str, str]] | None = None,
    strict: bool = False,
) -> dict[str, DataFrame]:
    """Read logical tables stored as ``root/<name>``; ``aliases`` by table."""
    return {n: load_table(spark, n, f"{root}/{n}", fmt, (aliases or {}).get(n), strict) for n in names or TABLES}
