"""Tables laid out by day: the same results from fewer files."""

import re

import pytest
from pyspark.sql import functions as F

from fibrelens.operators import city, payouts, tickets
from fibrelens.plans.testbed import AS_OF, Testbed
from fibrelens.sources.layout import load_days, write_days
from fibrelens.sources.schemas import DAY_COLUMNS, TABLES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bed(spark):
    return Testbed(spark, SMALL)


def some_months(bed, name):
    """Rows around the reports' windows; every day is a folder."""
    return bed[name].filter(F.col(DAY_COLUMNS[name]).between("2001-02-15", "2001-07-31"))


@pytest.fixture(scope="module")
def days(spark, bed, tmp_path_factory):
    root = tmp_path_factory.mktemp("days")
    for name in ("ticket_events", "ticket_daily", "disbursements", "bookings"):
        write_days(some_months(bed, name), name, f"{root}/{name}")
    return lambda name: load_days(spark, name, f"{root}/{name}")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def scans(df):
    """Partition filters per scan, and files read."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    return re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)


def test_every_table_with_a_time_has_its_day():
    assert DAY_COLUMNS.keys() | {"growth_card", "partner_scores", "devices", "roster"} == TABLES.keys()


def reports(table, bed):
    roster = city.city_roster(bed["roster"], bed.cities())
    return {
        "counts": tickets.ticket_counts(table("ticket_events"), "2001-06-20", "2001-07-10"),
        "sla": tickets.ticket_sla(table("ticket_events"), "2001-06-20", "2001-07-10 06:00:00"),
        "live": tickets.live_tickets(table("ticket_events"), AS_OF),
        "tickets_30d": city.tickets_30d(table("ticket_daily"), roster, AS_OF),
        "payouts": payouts.fixed_payout_monthly(table("disbursements"), AS_OF),
        "daily": city.daily_leads_installs(bed["plans"], table("bookings"), roster, AS_OF),
    }


def test_windows_become_partition_filters_and_results_stay(bed, days):
    by_day, whole = reports(days, bed), reports(lambda name: some_months(bed, name), bed)
    for name, df in by_day.items():
        filters = [f for f in scans(df) if "event_day" in f]
        assert filters, name
        assert rows(df) == rows(whole[name]), name
    assert all(">= 2001-06-20" in f and "<= 2001-07-09" in f for f in scans(by_day["counts"]) if "event_day" in f)
    assert any("<= 2001-07-10" in f for f in scans(by_day["sla"]))


def test_fewer_files_are_read(days):
    table = days("ticket_events")
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    one_day = load_days(table.sparkSession, "ticket_events", re.sub(r"/event_day=.*", "", table.inputFiles()[0]), "2001-07-01", "2001-07-02")
    assert one_day.count() == table.filter("added_time >= '2001-07-01' and added_time < '2001-07-02'").count() > 0
    assert files(one_day) == 1 < 20 < files(table)


def test_writing_replaces_the_days_it_holds(spark, table, tmp_path):
    row = lambda day, nas: dict(nas_id=nas, added_date=day)
    path = f"{tmp_path}/usage"
    write_days(table("daily_usage", [row("2024-01-01", 1), row("2024-01-02", 2), row(None, 3)]), "daily_usage", path)
    write_days(table("daily_usage", [row("2024-01-02", 20), row("2024-01-03", 30)]), "daily_usage", path)
    got = load_days(spark, "daily_usage", path)
    assert sorted(r.nas_id for r in got.collect()) == [1, 3, 20, 30]
    assert sorted(r.nas_id for r in load_days(spark, "daily_usage", path, "2024-01-02").collect()) == [20, 30]
