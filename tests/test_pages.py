"""Saved result pages against the tables they were made of."""

import json
from datetime import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from fibrelens.plans.testbed import Testbed
from fibrelens.sources.pages import PageReader, load_pages, page_parts, save_pages
from fibrelens.sources.schemas import TABLES
from fibrelens.sources.tables import table_schema

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted((repr(r.asDict()) for r in df.collect()))


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    bed, root = Testbed(spark, SMALL), tmp_path_factory.mktemp("pages")
    for name in TABLES:
        save_pages(bed[name], f"{root}/{name}", 3)
    return bed, root


@pytest.mark.parametrize("name", list(TABLES))
def test_every_table_loads_with_the_same_rows(spark, saved, name):
    bed, root = saved
    got = load_pages(spark, name, f"{root}/{name}")
    assert got.schema == table_schema(name)
    assert rows(got) == rows(bed[name])


def test_one_partition_per_page_and_filters(spark, saved):
    bed, root = saved
    got = load_pages(spark, "plans", f"{root}/plans")
    assert got.select(F.spark_partition_id()).distinct().count() == 3
    for condition in ("partner_id = 3", "partner_id in (3, 7) and mobile > '5'", "plan_start_time >= '2001-01-01' and charges < 9000", "device_id is null", "time_plan <= 500000 or partner_id = 1"):
        assert rows(got.filter(condition)) == rows(bed["plans"].filter(condition)) != [], condition


def test_pages_are_bounded_whatever_the_number_asked_for(spark, tmp_path):
    """Many rows make more pages, and equal rows, which hash alike, make several pages too."""
    for name, devices in (("apart", "concat('D', id)"), ("equal", "'D'")):
        table = spark.range(0, 2000, numPartitions=2).selectExpr("id % 3 AS partner_id", "string(null) AS customer_id", f"{devices} AS device_id", "'partner' AS location", "date(null) AS user_churn_date")
        table = table if name == "apart" else table.withColumn("partner_id", F.lit(1).cast("bigint"))
        save_pages(table, f"{tmp_path}/{name}", 2, page_rows=500, page_bytes=8192)
        files = list((tmp_path / name).rglob("part-*.txt"))
        assert len(files) > 4 and max(f.stat().st_size for f in files) < 16384
        assert rows(load_pages(spark, "devices", f"{tmp_path}/{name}")) == rows(table)
    save_pages(table.limit(0), f"{tmp_path}/none", 2)
    assert not list((tmp_path / "none").rglob("part-*"))


def page_file(tmp_path, page, name="p.json"):
    (tmp_path / name).write_text(page if isinstance(page, str) else json.dumps(page))
    return str(tmp_path)


def test_filters_are_applied_while_reading(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringContains

    page = {"data": {"cols": [{"name": "NASID"}, {"name": "added_date"}], "rows": [["1", "2024-01-01"], [2, "2024-01-02"], ["x", None], [None, "2024-01-02"]]}}
    path = page_file(tmp_path, page)
    reader = PageReader(table_schema("daily_usage"), path, {"nasid": "nas_id"})
    given = [EqualTo(("nas_id",), 2), GreaterThan(("nas_id",), 0), StringContains(("added_date",), "x")]
    assert list(reader.pushFilters(given)) == given  # Spark checks all of them again
    part, = reader.partitions()
    assert [b.to_pylist() for b in reader.read(part)] == [[{"nas_id": 2, "added_date": datetime(2024, 1, 2).date()}]]


def test_values_of_other_types_and_misfits(spark, tmp_path):
    cols = [{"name": c} for c in ("LCO_ACCOUNT_ID", "MOBILE", "NAS_ID", "DEVICE_ID", "ACCOUNT_ID", "PLAN_START_TIME", "TIME_PLAN", "CHARGES", "SPEED_MBPS", "extra")]
    page = {
        "cols": cols,
        "rows": [
            ["12.0", 98765, 7, None, "x", "2024-01-01T05:30:00+05:30", 86400.9, 499.995, 50, {}],
            [1e30, True, "nan", "D", 5, "2024-01-01 00:00:00.5", "-1.5", "1e20", 2.5, []],
        ],
    }
    got = load_pages(spark, "plans", page_file(tmp_path, page)).orderBy("device_id").collect()
    assert tuple(got[0]) == (12, "98765", 7, None, None, datetime(2024, 1, 1), 86400, D("500.00"), "50")
    assert tuple(got[1]) == (None, "true", None, "D", 5, datetime(2024, 1, 1, 0, 0, 0, 500000), -1, None, "2.5")


def test_empty_failed_and_incomplete_pages(spark, tmp_path):
    for i, page in enumerate(({"data": {"cols": [], "rows": []}}, [], {"rows": []})):
        page_file(tmp_path, page, f"{i}.json")
    assert load_pages(spark, "roster", str(tmp_path)).count() == 0
    with pytest.raises(RuntimeError, match="no such table"):
        page_parts(json.dumps({"status": "failed", "error": "no such table"}))
    page_file(tmp_path, {"cols": [{"name": "partner_id"}], "rows": [[1]]}, "bad.json")
    with pytest.raises(Exception, match="lacks columns: partner_name, partner_city"):
        load_pages(spark, "roster", str(tmp_path)).collect()
