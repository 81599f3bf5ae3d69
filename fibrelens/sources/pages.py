"""Saved result pages as a Spark data source.

A page is a JSON file as the query service answers: column names and rows of values, either at the
top or under ``data``. All pages of a table lie under one folder. Each page is one partition; filters
that Spark hands down are applied to a row as soon as the filtered values are converted; of rows that
go, no other value is converted or sent to Spark. A page that says ``failed`` raises its error.

Values are converted as the loader does it: numbers out of text and the other way, cut towards zero
for whole numbers; what does not fit becomes NULL.
"""

from __future__ import annotations

import json
import operator
import sys
from collections.abc import Callable, Iterator
from datetime import UTC, date, datetime
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation
from typing import Any

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition

BATCH = 4096
#: Rows that a saved page holds on average at most, and characters at which it is full.
PAGE_ROWS, PAGE_BYTES = 1 << 15, 1 << 23


def _long(value: Any) -> int | None:
    if isinstance(value, float):
        return int(value)
    try:
        return int(value)
    except ValueError:
        return int(float(value))


def _text(value: Any) -> str:
    if isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _decimal(kind: T.DecimalType) -> Callable[[Any], Decimal | None]:
    unit, limit = Decimal(1).scaleb(-kind.scale), Decimal(10) ** (kind.precision - kind.scale)

    def convert(value: Any) -> Decimal | None:
        number = Decimal(str(value)).quantize(unit, ROUND_HALF_UP)
        return number if abs(number) < limit else None

    return convert


def _boolean(value: Any) -> bool | None:
    if isinstance(value, bool | int | float):
        return bool(value)
    return {"true": True, "t": True, "1": True, "yes": True, "y": True, "false": False, "f": False, "0": False, "no": False, "n": False}.get(
        value.strip().lower()
    )


def _time(value: Any) -> datetime:
    moment = datetime.fromisoformat(value.strip())
    return moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment.astimezone(UTC)


def _date(value: Any) -> date:
    return date.fromisoformat(value.strip()[:10])


def converter(kind: T.DataType) -> tuple[Callable[[Any], Any], pa.DataType]:
    """Conversion of a page's value, and the Arrow type of the result. NULL and misfits give None."""
    if isinstance(kind, T.DecimalType):
        convert, arrow = _decimal(kind), pa.decimal128(kind.precision, kind.scale)
    else:
        convert, arrow = {
            "bigint": (_long, pa.int64()),
            "int": (_long, pa.int32()),
            "double": (float, pa.float64()),
            "string": (_text, pa.string()),
            "boolean": (_boolean, pa.bool_()),
            "date": (_date, pa.date32()),
            "timestamp": (_time, pa.timestamp("us", tz="UTC")),
        }[kind.simpleString()]
    bits = {"bigint": 63, "int": 31}.get(kind.simpleString())

    def safe(value: Any) -> Any:
        if value is None:
            return None
        try:
            found = convert(value)
        except (ValueError, TypeError, AttributeError, OverflowError, InvalidOperation):
            return None
        return None if bits and not -(1 << bits) <= found < 1 << bits else found

    return safe, arrow


def page_parts(text: str) -> tuple[list[str], list[list]]:
    """Column names and rows of a page."""
    page = json.loads(text)
    if isinstance(page, dict) and page.get("status") == "failed":
        raise RuntimeError(f"page holds a failed query: {page.get('error', 'unknown')}")
    inner = page.get("data", page) if isinstance(page, dict) else {}
    return [c["name"].lower() for c in inner.get("cols", [])], inner.get("rows", [])


_TESTS: dict[str, Callable[[Any, Any], bool]] = {
    "EqualTo": operator.eq,
    "GreaterThan": operator.gt,
    "GreaterThanOrEqual": operator.ge,
    "LessThan": operator.lt,
    "LessThanOrEqual": operator.le,
    "In": lambda value, among: value in among,
    "IsNotNull": lambda value, _: True,
}


class Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PageReader(DataSourceReader):
    """Reads pages into Arrow batches."""

    def __init__(self, schema: T.StructType, path: str, other_names: dict[str, str]):
        self.schema, self.path, self.other_names = schema, path, other_names
        self.tests: list[tuple[str, str, Any]] = []

    def pushFilters(self, filters: list[Filter]):
        """Take note of simple comparisons. All are given back, so Spark checks them again."""
        for found in filters:
            kind, column = type(found).__name__, getattr(found, "attribute", ())
            value = getattr(found, "value", None)
            comparable = not isinstance(value, datetime) or value.tzinfo is not None
            if kind in _TESTS and len(column) == 1 and comparable:
                self.tests.append((column[0], kind, value))
            yield found

    def partitions(self) -> list[Page]:
        system, folder = pa.fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("/") else (pa.fs.LocalFileSystem(), self.path)
        found = system.get_file_info(pa.fs.FileSelector(folder, recursive=True))
        names = [f.path for f in found if f.type == pa.fs.FileType.File and not f.base_name.startswith(("_", "."))]
        return [Page(name) for name in sorted(names)]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        system = pa.fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pa.fs.LocalFileSystem()
        with system.open_input_stream(partition.path) as stream:
            names, rows = page_parts(stream.read().decode())
        names = [self.other_names.get(name, name) for name in names]
        made = {f.name: converter(f.dataType) for f in self.schema}
        lacks = [f.name for f in self.schema if f.name not in names]
        if rows and lacks:
            raise ValueError(f"page {partition.path} lacks columns: {', '.join(lacks)}")
        place = {name: names.index(name) for name in made} if rows else {}
        types = [arrow for _, arrow in made.values()]
        for low in range(0, len(rows), BATCH):
            part = rows[low : low + BATCH]
            for column, kind, value in self.tests:
                convert, test, at = made[column][0], _TESTS[kind], place[column]
                part = [row for row in part if (x := convert(row[at])) is not None and test(x, value)]
            columns = [pa.array([convert(row[place[name]]) for row in part], arrow) for name, (convert, arrow) in made.items()]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(zip(made, types))))


class ResultPages(DataSource):
    """``spark.read.format("result_pages").schema(...).load(folder)``; option ``names`` is a JSON map of
    a page's column names to those of the schema."""

    @classmethod
    def name(cls) -> str:
        return "result_pages"

    def schema(self) -> T.StructType:
        raise ValueError("give the schema of the pages")

    def reader(self, schema: T.StructType) -> PageReader:
        return PageReader(schema, self.options["path"], json.loads(self.options.get("names", "{}")))


def load_pages(spark: SparkSession, name: str, path: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """One logical table out of its saved pages. ``aliases`` maps page columns to ours."""
    from fibrelens.sources.schemas import ALIASES
    from fibrelens.sources.tables import table_schema

    # The reader travels to the executors as a whole; they need no copy of this library.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ResultPages)
    names = {old.lower(): new for old, new in (ALIASES.get(name, {}) | (aliases or {})).items()}
    reader = spark.read.format("result_pages").schema(table_schema(name)).option("names", json.dumps(names))
    return reader.load(path)


def _page_texts(head: str, page_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pages out of rows (page, row); a page of more than about ``page_bytes`` goes on in another one."""

    def text(page: int, rows: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([head + ",".join(rows) + "]}}"])], ["page", "value"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        page = size = 0
        for batch in batches:
            for page, row in zip(batch.column("page").to_pylist(), batch.column("row").to_pylist()):
                held.append(row)
                size += len(row)
                if size >= page_bytes:
                    yield text(page, held)
                    held, size = [], 0
        if held:
            yield text(page, held)

    return join


def save_pages(df: DataFrame, path: str, pages: int, page_rows: int = PAGE_ROWS, page_bytes: int = PAGE_BYTES) -> None:
    """Write ``df`` as about ``pages`` pages, one file each, dealt by a hash of the row; as more pages
    where ``df`` holds more than ``page_rows`` rows a page.

    A page is made in one task and read in one, so its size has a bound: of a page that grows beyond
    ``page_bytes`` the rest goes on in further files. Equal rows of different tasks go to different
    pages.
    """
    n = max(pages, -(-df.count() // page_rows))
    head = "{\"data\": {" + json.dumps({"cols": [{"name": c.upper()} for c in df.columns]})[1:-1] + ", \"rows\": ["
    values = F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns]))
    page = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.spark_partition_id()), F.lit(n)).cast("int")
    dealt = df.select(page.alias("page"), values.alias("row")).repartitionById(n, "page")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    whole = dealt.mapInArrow(_page_texts(head, page_bytes), "page int, value string")
    whole.write.option("maxRecordsPerFile", 1).partitionBy("page").text(path)
