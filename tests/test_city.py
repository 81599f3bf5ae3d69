from datetime import date, datetime

import pytest

from fibrelens.operators import city
from fibrelens.sources.dimensions import LAUNCH_CITIES, launch_cities
from tests.helpers import AS_OF, by

DAY = 86400


def plan(partner, mobile, start, days=28, **more):
    return dict(partner_id=partner, mobile=mobile, plan_start_time=start, time_plan=int(days * DAY), **more)


@pytest.fixture(params=["broadcast", "merge"])
def roster_size(request, spark):
    """Every city operator must give the same whichever join Spark picks."""
    if request.param == "merge":
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        yield
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    else:
        yield


@pytest.fixture
def roster(frame):
    return lambda *rows: frame([(c, p, n) for c, p, n in rows], "city string, partner_id bigint, partner_name string")


def test_city_roster_trims_maps_and_dedups(spark, table):
    rows = [
        dict(partner_id=1, partner_name="A", partner_city=" Meerut_City "),
        dict(partner_id=1, partner_name="A", partner_city="Meerut_City"),
        dict(partner_id=1, partner_name="A2", partner_city="Meerut_City"),
        dict(partner_id=2, partner_name="B", partner_city="Agra"),
        dict(partner_id=3, partner_name="C", partner_city="Elsewhere"),
    ]
    got = city.city_roster(table("roster", rows), launch_cities(spark)).collect()
    assert sorted((r.city, r.partner_id, r.partner_name) for r in got) == [
        ("Agra", 2, "B"),
        ("Meerut City", 1, "A"),
        ("Meerut City", 1, "A2"),
    ]
    assert len(LAUNCH_CITIES) == 11


def test_active_base_grace_edges(table, roster, roster_size):
    plans = table(
        "plans",
        [
            plan(1, "gone", "2024-02-28 10:00:00", 0),  # expired 16 days ago
            plan(1, "grace", "2024-02-29 00:00:00", 0),  # 15 days ago
            plan(1, "today", "2024-03-15 00:00:00", 0.1),
            plan(1, "tomorrow", "2024-03-15 00:00:00", 1),
            plan(1, "back", "2023-01-01 00:00:00", 1),
            plan(2, "back", "2024-03-01 00:00:00", 28),  # same mobile, other partner of the city
            plan(1, None, "2024-03-15 00:00:00", 30),
            plan(9, "stranger", "2024-03-15 00:00:00", 30),
        ],
    )
    got = city.city_active_base(plans, roster(("X", 1, "a"), ("X", 2, "b"), ("Y", 3, "c")), AS_OF)
    assert {r.city: r.active_base for r in got.collect()} == {"X": 4, "Y": 0}


def test_rollup_gives_the_same(table, roster, roster_size):
    rows = [plan(i % 3, None if i % 11 == 0 else f"m{i % 17}", f"2024-0{1 + i % 3}-{1 + i % 28:02d} 00:00:00", i % 30) for i in range(200)]
    bookings = table("bookings", [dict(mobile=f"l{i}", partner_id=i % 4, added_time=f"2024-03-{1 + i % 14:02d} 19:00:00") for i in range(40)])
    plans, tickets = table("plans", rows), table("ticket_daily", [])
    pairs = roster(("X", 0, "a"), ("X", 1, "b"), ("Y", 1, "b"), ("Y", 2, "c"))
    rollup = city.plan_rollup(plans, pairs)
    for alone, shared in (
        (city.city_active_base(plans, pairs, AS_OF), city.active_base_from_rollup(rollup, pairs, AS_OF)),
        (city.daily_leads_installs(plans, bookings, pairs, AS_OF), city.daily_from_rollup(rollup, bookings, pairs, AS_OF)),
        (city.partner_scorecard(plans, pairs, tickets, AS_OF), city.scorecard_from_rollup(rollup, pairs, tickets, AS_OF)),
    ):
        got = sorted(map(tuple, alone.collect()))
        assert got and got == sorted(map(tuple, shared.collect()))


def test_daily_leads_and_installs(table, roster, roster_size):
    plans = table(
        "plans",
        [
            plan(1, "m1", "2024-02-14 00:00:00"),  # 30 days back: in
            plan(1, "m2", "2024-02-13 23:59:59"),  # 31 days back: out
            plan(1, "m3", "2024-03-10 05:00:00"),
            plan(2, "m3", "2024-03-12 05:00:00"),  # later plan at another partner of the city
            plan(2, "m4", "2024-03-10 23:00:00"),  # raw day, no shift
        ],
    )
    lead = lambda m, p, t: dict(mobile=m, partner_id=p, added_time=t)
    bookings = table(
        "bookings",
        [
            lead("x", 1, "2024-03-10 18:29:00"),  # 23:59 local
            lead("y", 1, "2024-03-10 18:30:00"),  # midnight local: next day
            lead("y", 2, "2024-03-10 19:30:00"),  # same lead again through another partner
            lead("noplan", 2, "2024-03-01 00:00:00"),
            lead("old", 1, "2024-02-13 23:00:00"),
        ],
    )
    daily = city.daily_leads_installs(plans, bookings, roster(("X", 1, "a"), ("X", 2, "b")), AS_OF)
    rows = daily.collect()
    assert [(r.day, r.installs, r.leads) for r in rows] == [
        (date(2024, 2, 14), 1, 0),
        (date(2024, 3, 1), 0, 1),
        (date(2024, 3, 10), 2, 1),
        (date(2024, 3, 11), 0, 1),
    ]
    totals = city.leads_installs_totals(daily).first()
    assert (totals.total_leads, totals.total_installs) == (3, 3)


def test_r30_worked_example(table, roster, roster_size):
    rows = [plan(1, f"m{i}", "2024-01-01 00:00:00") for i in range(70)]
    rows += [plan(1, f"m{i}", "2024-03-01 00:00:00", 365) for i in range(70, 100)]
    got = city.partner_scorecard(table("plans", rows), roster(("X", 1, "a")), table("ticket_daily", []), AS_OF).first()
    assert (got.total_gross, got.r30_plus) == (100, 70)


def test_scorecard_rules(table, roster, roster_size):
    rows = [
        plan(1, "once29", "2024-02-15 00:00:00"),  # 29 days ago
        plan(1, "once30", "2024-02-14 23:00:00"),  # 30 calendar days ago
        plan(1, "again", "2024-01-01 00:00:00"),
        plan(1, "again", "2024-03-10 00:00:00"),
        plan(1, "moved", "2024-01-01 00:00:00"),  # first here, then at partner 2
        plan(2, "moved", "2024-03-10 00:00:00"),
        plan(2, "moved", "2024-03-11 00:00:00"),
        plan(1, "nostart", None),
        plan(1, None, "2024-03-10 00:00:00"),
    ]
    tickets = [
        dict(partner_id=1, tkt_dt="2024-02-14", total_tickets=5, resolved_tickets=3),  # day 30
        dict(partner_id=1, tkt_dt="2024-02-13", total_tickets=100, resolved_tickets=100),  # day 31
        dict(partner_id=1, tkt_dt="2024-03-01", total_tickets=2, resolved_tickets=None),
        dict(partner_id=9, tkt_dt="2024-03-01", total_tickets=7, resolved_tickets=7),
    ]
    pairs = roster(("X", 1, "a"), ("X", 1, "a again"), ("X", 2, "b"), ("X", 3, "no plans"))
    args = (table("plans", rows), pairs, table("ticket_daily", tickets), AS_OF)

    got = by(city.partner_scorecard(*args), "partner_name")
    a = got["a"]
    assert (a["total_gross"], a["live"], a["active"]) == (5, 2, 4)  # both single plans ended within the grace days
    # "moved" has one plan at partner 1 and two at partner 2: counted as both.
    assert (a["m1_expired"], a["m1_renewed"], a["r30_plus"]) == (2, 2, 1)
    assert (a["tickets_1m"], a["resolved_1m"]) == (7, 3)
    assert {k: v for k, v in got["a again"].items() if k != "partner_name"} == {k: v for k, v in a.items() if k != "partner_name"}
    assert set(list(got["no plans"].values())[3:]) == {0}
    assert got["b"]["total_gross"] == 0
    assert city.tickets_30d(args[2], pairs, AS_OF).count() == 1

    whole = by(city.partner_scorecard(*args, recharge_scope="mobile"), "partner_name")["a"]
    assert (whole["m1_expired"], whole["m1_renewed"]) == (1, 2)
    with pytest.raises(ValueError):
        city.partner_scorecard(*args, recharge_scope="city")


def test_cities_are_kept_apart(table, roster, roster_size):
    rows = [plan(1, "m", "2024-01-01 00:00:00"), plan(2, "m", "2024-03-10 00:00:00")]
    pairs = roster(("X", 1, "a"), ("Y", 2, "b"), ("Z", 1, "a"), ("Z", 2, "b"))
    got = by(city.first_last_plan(table("plans", rows), pairs), "city")
    assert (got["X"]["first_partner_id"], got["X"]["last_partner_id"]) == (1, 1)
    assert (got["Y"]["first_partner_id"], got["Y"]["last_partner_id"]) == (2, 2)
    assert (got["Z"]["first_partner_id"], got["Z"]["last_partner_id"]) == (1, 2)


def test_mobile_summary_ties_and_fan_out(table, roster, roster_size):
    same = "2024-03-01 00:00:00"
    rows = [plan(1, "m", same, 10), plan(1, "m", same, 20), plan(2, "m", same, 20), plan(2, "m", None)]
    pairs = roster(("X", 1, "a"), ("X", 2, "b"))
    got = city.mobile_summary(table("plans", rows), pairs).collect()
    assert sorted(r.recharge_count for r in got) == [2, 2]
    assert {r.partner_id for r in got} == {1}
    assert {r.last_expiry for r in got} == {datetime(2024, 3, 21)}
    counts = by(city.recharge_counts(table("plans", rows), pairs), "partner_id")
    assert {k: v["recharge_count"] for k, v in counts.items()} == {1: 2, 2: 2}


def test_ratios_and_report(frame):
    cols = "city string, partner_id bigint, partner_name string, total_gross bigint, active bigint, live bigint, r30_plus bigint, m1_expired bigint, m1_renewed bigint, tickets_1m bigint, resolved_1m bigint"
    df = frame([("X", 1, "a", 8, 1, 1, 7, 3, 1, 4, 2), ("X", 2, "b", 0, 0, 0, 0, 0, 0, 0, 0)], cols)
    got = by(city.scorecard_ratios(df), "partner_id")
    assert (got[1]["active_pct"], got[1]["m1_pct"]) == (12.5, 25.0)
    assert (got[2]["active_pct"], got[2]["m1_pct"]) == (None, None)
    shown = by(city.scorecard_report(df), "Partner")
    assert (shown["a"]["Active %"], shown["a"]["M1 %"]) == ("12%", "25%")  # ties to even
    assert (shown["b"]["Active %"], shown["b"]["M1 %"]) == ("—", "—")


def test_listed_cities_without_partners_show_zero(spark, table, roster):
    plans = table("plans", [plan(1, "a", "2024-03-10 00:00:00")])
    pairs, cities = roster(("Agra", 1, "a"), ("Agra", 1, "b"), ("Agra", 2, "c")), launch_cities(spark)
    rollup = city.plan_rollup(plans, pairs)
    for got in (city.city_active_base(plans, pairs, AS_OF, cities=cities), city.active_base_from_rollup(rollup, pairs, AS_OF, cities)):
        assert {r.city: r.active_base for r in got.collect()} == {label: int(label == "Agra") for label in LAUNCH_CITIES}
    counts = {r.city: r.partners for r in city.city_partner_counts(pairs, cities).collect()}
    assert counts == {label: 2 * (label == "Agra") for label in LAUNCH_CITIES}


def test_building_a_plan_starts_no_job(spark, table, roster):
    tracker, group = spark.sparkContext.statusTracker(), "building"
    plans, bookings, daily = table("plans", [plan(1, "a", "2024-03-10 00:00:00")]), table("bookings", []), table("ticket_daily", [])
    pairs = roster(("Agra", 1, "a"))
    spark.sparkContext.setJobGroup(group, group)
    city.partner_scorecard(plans, pairs, daily, AS_OF)
    city.daily_leads_installs(plans, bookings, pairs, AS_OF)
    city.city_active_base(plans, pairs, AS_OF, cities=launch_cities(spark))
    city.mobile_summary(plans, pairs)
    assert len(tracker.getJobIdsForGroup(group)) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
