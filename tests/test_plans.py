"""The shape of the plans: what reaches the scan, what is shuffled, what must never appear."""

import re

import pytest
from pyspark.sql import functions as F

from fibrelens.functions.joins import left_join_spread
from fibrelens.operators import city, customers, payouts, tickets, wallet
from fibrelens.plans.registry import all_queries
from fibrelens.plans.testbed import Testbed
from fibrelens.sources.tables import load_table
from tests.helpers import AS_OF

SMALL = "/root/testdata/sf0.001"


def plan_of(df, *, broadcast=True):
    """Physical plan as text, without shortened filter lists."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.maxMetadataStringLength", "10000")
    conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB" if broadcast else "-1")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.unset("spark.sql.maxMetadataStringLength")
        conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def stored(spark, table, tmp_path):
    """An empty logical table read back from parquet, as in real use."""

    def build(name):
        table(name, []).write.parquet(f"{tmp_path}/{name}")
        return load_table(spark, name, f"{tmp_path}/{name}")

    return build


@pytest.mark.parametrize("name", [name for name in all_queries() if not name.endswith("_pages")])
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(all_queries()[name](spark, SMALL))
    assert not re.search(r"Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)


def pushed(df):
    return re.findall(r"PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>", plan_of(df))


def test_time_filters_reach_the_scan(stored):
    cases = [
        (payouts.fixed_payout_monthly(stored("disbursements"), AS_OF), "GreaterThanOrEqual(added_time,2023-12-01"),
        (tickets.ticket_counts(stored("ticket_events"), "2024-02-01", "2024-03-01"), "LessThan(added_time,2024-03-01"),
        (city.tickets_30d(stored("ticket_daily"), stored("roster").withColumnRenamed("partner_city", "city"), AS_OF), "GreaterThanOrEqual(tkt_dt,2024-02-14"),
    ]
    for df, want in cases:
        assert any(want in filters for filters, _ in pushed(df)), plan_of(df)


def test_asking_for_one_partner_reads_only_that_partner(stored):
    names = ("plans", "devices", "bookings", "booking_events", "daily_usage", "task_events", "optical_readings", "speed_tests")
    view = customers.customer_360(*map(stored, names), as_of=AS_OF)
    hits = [filters for filters, _ in pushed(view.filter("partner_id = 17")) if "EqualTo(partner_id,17)" in filters]
    assert len(hits) == 2  # plans and devices
    log = stored("ticket_events")
    for df in (tickets.ticket_sla(log, "2024-02-01"), tickets.live_tickets(log, AS_OF), payouts.fixed_payout_monthly(stored("disbursements"), AS_OF)):
        assert any("EqualTo(partner_id,17)" in filters for filters, _ in pushed(df.filter("partner_id = 17")))
    olds, news = (stored(n).filter("partner_id = 17") for n in ("ledger_old", "ledger_new"))
    assert all("EqualTo(partner_id,17)" in filters for filters, _ in pushed(wallet.wallet_transactions(olds, news)))


def test_summaries_do_not_read_unused_sources(stored):
    names = ("plans", "devices", "bookings", "booking_events", "daily_usage", "task_events", "optical_readings", "speed_tests")
    view = customers.customer_360(*map(stored, names), as_of=AS_OF)
    assert len(pushed(customers.customer_status_counts(view))) == 1


def test_only_needed_columns_are_read(stored):
    plans = stored("plans")
    roster = stored("roster").withColumnRenamed("partner_city", "city")
    _, columns = max(pushed(city.recharge_counts(plans, roster)), key=lambda x: "mobile" in x[1])
    assert columns == "partner_id:bigint,mobile:string"
    _, columns = pushed(customers.recharge_count(plans))[0]
    assert columns == "partner_id:bigint,mobile:string,charges:decimal(18,2)"


def test_customer_view_takes_four_joins(spark):
    """Without broadcasts, and each on another key than the one before."""
    t = Testbed(spark, SMALL)
    df = customers.customer_360(
        t["plans"], t["devices"], t["bookings"], t["booking_events"], t["daily_usage"], t["task_events"],
        t["optical_readings"], t["speed_tests"], AS_OF,
    )
    plan = plan_of(df, broadcast=False)
    assert plan.count("SortMergeJoin") == 5  # four of the view and the one inside the bookings mapping
    joins = re.findall(r"SortMergeJoin \[(.*?)\]", plan)
    assert [j.split("#")[0] for j in joins[:3]] == ["device_id", "nas_id", "mobile"]


def test_large_roster_keeps_the_mobile_in_every_aggregation(spark):
    t = Testbed(spark, SMALL)
    roster = city.city_roster(t["roster"], t.cities())
    plan = plan_of(city.partner_scorecard(t["plans"], roster, t["ticket_daily"], AS_OF), broadcast=False)
    # Raw rows by (mobile, partner), then reduced rows by (mobile, city) above the roster join.
    keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"hashpartitioning\((.*?), \d+\)", plan)]
    assert "mobile, city" in keys and "mobile, partner_id" in keys
    assert keys.index("mobile, city") < keys.index("mobile, partner_id")


def test_wallet_limits_before_the_shuffle(spark):
    t = Testbed(spark, SMALL)
    plan = plan_of(wallet.wallet_transactions(t["ledger_old"], t["ledger_new"]))
    bottom = plan[plan.rindex("Exchange hashpartitioning"):]
    assert "WindowGroupLimit" in bottom


SIDES = ("bookings", "booking_events", "task_events", "daily_usage", "optical_readings", "speed_tests")


@pytest.fixture
def saved(spark, tmp_path):
    """The logical tables of the test bed as parquet, as in real use."""
    t = Testbed(spark, SMALL)
    for name in ("plans", "devices", *SIDES):
        t[name].write.parquet(f"{tmp_path}/{name}")
    return {name: load_table(spark, name, f"{tmp_path}/{name}") for name in ("plans", "devices", *SIDES)}


def leaf_lines(plan):
    """For every scan of a side table, the operators above it up to the first shuffle or union."""
    lines = plan.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]
    found = {}
    for at, line in enumerate(lines):
        name = re.search(r"/(" + "|".join(SIDES) + r")[],]", line) if "FileScan" in line else None
        if not name:
            continue
        above, level = [], depth[at]
        for back in range(at - 1, -1, -1):
            if depth[back] < level:
                level = depth[back]
                if re.search(r"Exchange|Union", lines[back]):
                    break
                above.append(lines[back])
        found.setdefault(name.group(1), []).append("\n".join(above))
    return found


def few(tables, partners):
    names = ("plans", "devices", "bookings", "booking_events", "daily_usage", "task_events", "optical_readings", "speed_tests")
    return customers.customer_360(*(tables[n] for n in names), as_of="2001-07-15 10:30:00", partners=partners)


def test_few_partners_read_on_only_their_rows_of_all_side_tables(spark, saved):
    plan = plan_of(few(saved, [3, 7]))
    above = leaf_lines(plan)
    assert above.keys() == set(SIDES)
    for name, paths in above.items():
        assert all("LeftSemi" in path for path in paths), name
    # Without broadcasts, Spark's Bloom filters stand above the scans instead.
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    try:
        above = leaf_lines(plan_of(few(saved, [3, 7]), broadcast=False))
    finally:
        spark.conf.unset("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold")
    for name, paths in above.items():
        assert all("might_contain" in path for path in paths), name


@pytest.mark.parametrize("partners", [[3, 7], "table", []])
def test_few_partners_are_the_same_rows_as_the_whole_view(spark, saved, partners):
    whole = few(saved, None).filter("partner_id in (3, 7)")
    given = spark.createDataFrame([(3,), (7,)], "id long") if partners == "table" else partners
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(few(saved, given)) == (rows(whole) if given else [])


def test_parts_over_known_customers_reduce_at_the_scan(saved):
    known = customers.known_customers(saved["plans"], saved["devices"], [3])
    parts = {
        "bookings": customers.customer_name(saved["bookings"], known),
        "booking_events": customers.customer_address(saved["booking_events"], known),
        "task_events": customers.install_date(saved["task_events"], known),
        "optical_readings": customers.latest_optical(saved["optical_readings"], known),
    }
    for name, df in parts.items():
        assert all("LeftSemi" in path for path in leaf_lines(plan_of(df))[name]), plan_of(df)


def test_rows_without_a_key_are_dealt_evenly(spark):
    """90 % of the customers have no device; the tasks of the join stay even."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        left = spark.range(20000).selectExpr("id % 50 as partner_id", "cast(id as string) as mobile", "if(id % 10 = 0, concat('D', id), null) as device_id")
        right = spark.range(20000).selectExpr("concat('D', id) as device_id", "id as speed").unionByName(spark.sql("select cast(null as string) as device_id, -1L as speed"))
        joined = left_join_spread(left, right, ["device_id"], by=["mobile", "partner_id"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        plain = [r["count"] for r in left.join(right, "device_id", "left").groupBy(F.spark_partition_id().alias("p")).count().collect()]
        got = joined.agg(F.count(F.lit(1)), F.count("speed"), F.count_if(F.expr("speed <> cast(mobile as long)"))).first()
    finally:
        for name in ("autoBroadcastJoinThreshold", "adaptive.enabled"):
            spark.conf.unset(f"spark.sql.{name}")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert max(sizes) < 1.2 * 20000 / 16 < 18000 <= max(plain)
    assert tuple(got) == (20000, 2000, 0)


def test_raw_plan_rows_are_hashed_not_sorted(saved, spark):
    t = Testbed(spark, SMALL)
    roster = city.city_roster(t["roster"], t.cities())
    for df in (
        city.plan_rollup(saved["plans"], roster),
        city.first_last_plan(saved["plans"], roster),
        customers.current_plan(saved["plans"]),
        customers.partner_mobiles(saved["plans"]),
    ):
        lines = plan_of(df, broadcast=False).splitlines()
        scan = next(i for i, line in enumerate(lines) if "FileScan" in line and "/plans]" in line)
        above = [line for line in lines[:scan] if "Aggregate" in line]
        assert "HashAggregate" in above[-1] and "HashAggregate" in above[-2], lines


def test_customer_report_only_sorts_the_stored_view(spark):
    """While rows are sorted, no shuffle file of the view's joins lies on disk."""
    plan = plan_of(all_queries()["customer_report"](spark, SMALL), broadcast=False)
    assert plan.count("Exchange") == plan.count("Exchange rangepartitioning(partner_id#") == 1
    assert plan.count("FileScan") == plan.count("/customers-") == 1
