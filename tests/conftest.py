from __future__ import annotations

import sys
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from fibrelens.session import build_session  # noqa: E402
from fibrelens.sources.tables import table_schema  # noqa: E402

CASTS = {"timestamp": datetime.fromisoformat, "date": date.fromisoformat}


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """table(name, [row dicts]): a logical table; columns left out are NULL, times are text."""

    def build(name, rows):
        schema = table_schema(name)
        data = []
        for row in rows:
            unknown = set(row) - set(schema.fieldNames())
            assert not unknown, f"{name} has no {unknown}"
            values = []
            for field in schema:
                value, kind = row.get(field.name), field.dataType.simpleString()
                if isinstance(value, str) and kind in CASTS:
                    value = CASTS[kind](value)
                elif value is not None and kind.startswith("decimal"):
                    value = Decimal(str(value))
                values.append(value)
            data.append(tuple(values))
        return spark.createDataFrame(data, schema)

    return build


@pytest.fixture
def frame(spark):
    return lambda rows, ddl: spark.createDataFrame(rows, ddl)
