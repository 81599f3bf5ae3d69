import json
from datetime import date, datetime

import pytest

from fibrelens.operators import customers as c
from tests.helpers import AS_OF, by, new_shuffle_files, shuffle_files

DAY = 86400


def plan(mobile, start="2024-03-01 00:00:00", partner=1, seconds=28 * DAY, **more):
    return dict(partner_id=partner, mobile=mobile, plan_start_time=start, time_plan=seconds, **more)


def address(**parts):
    return json.dumps({"address": json.dumps(parts)})


@pytest.fixture
def sources(table):
    """customer_360 arguments with some tables given and the others empty."""
    names = ["plans", "devices", "bookings", "booking_events", "daily_usage", "task_events", "optical_readings", "speed_tests"]
    return lambda **rows: {n: table(n, rows.get(n, [])) for n in names}


def view(tables, as_of=AS_OF):
    return c.customer_360(**tables, as_of=as_of)


def test_ids_are_independent_maxima(table):
    rows = [plan("m", nas_id=1, device_id="D9", account_id=5), plan("m", nas_id=7, device_id="D1"), plan("m", partner=2, nas_id=3)]
    got = by(c.partner_mobiles(table("plans", rows)), "partner_id")
    assert (got[1]["nas_id"], got[1]["device_id"], got[1]["account_id"]) == (7, "D9", 5)
    assert got[2]["nas_id"] == 3


def test_missing_device_comes_from_the_device_table(table):
    plans = table("plans", [plan("a", account_id=10), plan("b", account_id=11, device_id="own"), plan("c"), plan("d", account_id=10, partner=2)])
    devices = table(
        "devices",
        [
            dict(partner_id=1, customer_id="10", device_id="X1"),
            dict(partner_id=1, customer_id="10", device_id="X2"),
            dict(partner_id=1, customer_id="11", device_id="X3"),
            dict(partner_id=None, customer_id="10", device_id="X9"),
        ],
    )
    got = by(c.resolved_devices(plans, devices), "mobile")
    assert {m: r["device_id"] for m, r in got.items()} == {"a": "X2", "b": "own", "c": None, "d": None}
    assert [tuple(r) for r in c.device_lookup(devices).orderBy("customer_id").select("customer_id", "lookup_device_id").collect()] == [("10", "X2"), ("11", "X3")]


def test_current_plan_picks_latest_start(table):
    rows = [
        plan("m", "2024-01-01 00:00:00", seconds=300 * DAY, charges=1),
        plan("m", "2024-03-01 20:00:00", seconds=int(27.5 * DAY), charges=2, speed_mbps="50"),
        plan("m", None, charges=3),
        plan("none", None),
    ]
    got = by(c.current_plan(table("plans", rows)), "mobile")
    assert got["m"]["last_recharge"] == datetime(2024, 3, 2, 1, 30)
    assert got["m"]["plan_expiry"] == datetime(2024, 3, 29, 13, 30)
    assert (got["m"]["plan_days"], got["m"]["charges"]) == (28, 2)
    assert got["none"]["plan_expiry"] is None
    raw = by(c.current_plan(table("plans", rows), tz_offset_min=0), "mobile")
    assert raw["m"]["last_recharge"] == datetime(2024, 3, 1, 20, 0)


def test_status_text_and_days(table):
    rows = [
        plan("edge", "2024-03-15 06:30:00", seconds=0, speed_mbps="40", charges=499.5),  # 12:00 local = now
        plan("old", "2024-03-10 12:00:00", seconds=0, speed_mbps=""),  # 17:30 local
        plan("none", None, seconds=None),
    ]
    got = by(c.plan_status(c.current_plan(table("plans", rows)), AS_OF), "mobile")
    tell = lambda m: (got[m]["status"], got[m]["days_since_expiry"], got[m]["plan_details"])
    assert tell("edge") == ("Active", None, "40 Mbps | 0d | Rs 500")
    assert tell("old") == ("Expired", 5, "0d")
    assert tell("none") == ("No Plan", None, None)


def test_names_addresses_installs(table):
    plans = table("plans", [plan("a"), plan("b")])
    bookings = table(
        "bookings",
        [
            dict(mobile="a", name="Zed", is_deleted=False),
            dict(mobile="a", name="Abe", is_deleted=False),
            dict(mobile="a", name="AAA", is_deleted=True),
            dict(mobile="b", name="BBB", is_deleted=None),
            dict(mobile="x", name="Xxx", is_deleted=False),
        ],
    )
    assert [tuple(r) for r in c.customer_name(bookings, plans).collect()] == [("a", "Abe")]

    update = lambda m, data, when, name="address_updated": dict(mobile=m, data=data, added_time=when, event_name=name)
    events = table(
        "booking_events",
        [
            update("a", address(home="Old", city="C"), "2024-01-01 00:00:00"),
            update("a", address(home="12 Road", city="Agra"), "2024-02-01 00:00:00"),
            update("a", address(home="Other", city="C"), "2024-03-01 00:00:00", "visited"),
            update("b", address(home="", city="Agra"), "2024-01-01 00:00:00"),
            update("x", address(home="H"), "2024-01-01 00:00:00"),
        ],
    )
    assert by(c.customer_address(events, plans), "mobile") == {
        "a": {"mobile": "a", "address": "12 Road, Agra"},
        "b": {"mobile": "b", "address": "Agra"},
    }
    for bad in ("no json", json.dumps({"address": "no json"}), json.dumps({"home": "H"}), address(home="", city=""), None):
        events = table("booking_events", [update("a", bad, "2024-01-01 00:00:00")])
        assert c.customer_address(events, plans).first().address is None

    tasks = table(
        "task_events",
        [
            dict(mobile="a", event_name="OTP_VERIFIED", added_time="2024-01-05 18:30:00"),
            dict(mobile="a", event_name="OTP_VERIFIED", added_time="2024-02-05 00:00:00"),
            dict(mobile="a", event_name="VISIT", added_time="2024-01-01 00:00:00"),
            dict(mobile="x", event_name="OTP_VERIFIED", added_time="2024-01-05 00:00:00"),
        ],
    )
    assert [tuple(r) for r in c.install_date(tasks, plans).collect()] == [("a", date(2024, 1, 6))]


def test_signals(table):
    plans = table("plans", [plan("a", nas_id=1, account_id=10), plan("b", nas_id=1), plan("c", nas_id=None)])
    usage = table("daily_usage", [dict(nas_id=1, added_date="2024-01-01"), dict(nas_id=1, added_date="2024-02-01"), dict(nas_id=8, added_date="2024-02-01"), dict(added_date="2024-02-01")])
    assert {m: r["last_ping"] for m, r in by(c.last_ping(usage, plans), "mobile").items()} == {"a": date(2024, 2, 1), "b": date(2024, 2, 1)}

    optical = table(
        "optical_readings",
        [
            dict(nas_id=1, date_ist="2024-01-01", avg_optical_dbm=-20.0, optical_health="Good"),
            dict(nas_id=1, date_ist="2024-02-01", avg_optical_dbm=None, optical_health="Bad"),
            dict(nas_id=5, date_ist="2024-02-01", avg_optical_dbm=-9.0),
        ],
    )
    assert [tuple(r) for r in c.latest_optical(optical, plans).collect()] == [(1, date(2024, 2, 1), None, "Bad")]

    devices = table("devices", [dict(partner_id=1, customer_id="10", device_id="X")])
    speed = table("speed_tests", [dict(device_id="X", tested_on="2024-01-01 00:00:00", speed=1.0), dict(device_id="X", tested_on="2024-01-02 00:00:00", speed=2.0), dict(device_id="Y", tested_on="2024-01-02 00:00:00", speed=3.0)])
    assert [(r.device_id, r.speed) for r in c.latest_speed(speed, plans, devices).collect()] == [("X", 2.0)]

    counted = table("plans", [plan("a", charges=5), plan("a", charges=0), plan("a", charges=None), plan("b", charges=0), plan("a", charges=1)])
    assert [tuple(r) for r in c.recharge_count(counted).collect()] == [(1, "a", 2)]


def test_whole_view_keeps_every_customer(sources):
    tables = sources(
        plans=[
            plan("a", nas_id=1, account_id=10, charges=5, speed_mbps="50"),
            plan("a", partner=2, start="2024-01-01 00:00:00", nas_id=2, device_id="E"),
            plan(None, nas_id=1, account_id=10, charges=5, device_id="E"),
            plan("lost", partner=None),
        ],
        devices=[dict(partner_id=1, customer_id="10", device_id="X")],
        bookings=[dict(mobile="a", name="Abe", is_deleted=False), dict(mobile=None, name="Ghost", is_deleted=False)],
        booking_events=[dict(mobile="a", event_name="address_updated", data=address(home="H", city="C"), added_time="2024-01-01 00:00:00")],
        daily_usage=[dict(nas_id=1, added_date="2024-03-01")],
        task_events=[dict(mobile="a", event_name="OTP_VERIFIED", added_time="2023-12-31 20:00:00")],
        optical_readings=[dict(nas_id=1, date_ist="2024-03-01", avg_optical_dbm=-21.0, optical_health="Good")],
        speed_tests=[dict(device_id="X", tested_on="2024-03-01 00:00:00", speed=44.0), dict(device_id="E", tested_on="2024-03-01 00:00:00", speed=9.0)],
    )
    got = by(view(tables), "partner_id", "mobile")
    assert set(got) == {(1, "a"), (2, "a"), (1, None)}
    a = got[1, "a"]
    assert (a["name"], a["address"], a["install_date"]) == ("Abe", "H, C", date(2024, 1, 1))
    assert (a["last_ping"], a["recharge_count"], a["status"]) == (date(2024, 3, 1), 1, "Active")
    assert (a["plan_details"], a["avg_optical_dbm"], a["actual_speed_mbps"]) == ("50 Mbps | 28d | Rs 5", -21.0, 44.0)
    b = got[2, "a"]
    assert (b["status"], b["days_since_expiry"], b["last_ping"], b["actual_speed_mbps"]) == ("Expired", 46, None, 9.0)
    # A missing mobile matches nothing by mobile, but its NAS id still finds the reading.
    n = got[1, None]
    assert (n["name"], n["status"], n["recharge_count"], n["plan_expiry"], n["last_ping"]) == (None, "No Plan", 0, None, None)
    assert (n["avg_optical_dbm"], n["actual_speed_mbps"]) == (-21.0, None)


def test_parts_agree_with_the_whole(sources):
    tables = sources(
        plans=[plan(f"m{i % 7}", f"2024-0{1 + i % 3}-0{1 + i % 9} 10:00:00", partner=i % 3, nas_id=i % 5, account_id=i % 4, device_id="D1" if i % 6 == 0 else None, charges=i % 3) for i in range(60)],
        devices=[dict(partner_id=i % 3, customer_id=str(i % 4), device_id=f"D{i % 5}") for i in range(20)],
        daily_usage=[dict(nas_id=i % 4, added_date=f"2024-02-{1 + i:02d}") for i in range(20)],
        speed_tests=[dict(device_id=f"D{i % 4}", tested_on=f"2024-02-{1 + i:02d} 00:00:00", speed=float(i)) for i in range(20)],
    )
    whole = by(view(tables), "partner_id", "mobile")
    plans, devices = tables["plans"], tables["devices"]
    status = by(c.plan_status(c.current_plan(plans), AS_OF), "partner_id", "mobile")
    pings = by(c.last_ping(tables["daily_usage"], plans), "partner_id", "mobile")
    counts = by(c.recharge_count(plans), "partner_id", "mobile")
    own = by(c.resolved_devices(plans, devices), "partner_id", "mobile")
    speeds = by(c.latest_speed(tables["speed_tests"], plans, devices), "device_id")
    assert set(whole) == set(status) == set(own)
    for key, row in whole.items():
        assert (row["status"], row["plan_details"], row["plan_expiry"]) == tuple(status[key][f] for f in ("status", "plan_details", "plan_expiry"))
        assert row["last_ping"] == pings.get(key, {}).get("last_ping")
        assert row["recharge_count"] == counts.get(key, {}).get("recharge_count", 0)
        assert row["actual_speed_mbps"] == speeds.get(own[key]["device_id"], {}).get("speed")


def test_summaries_order_and_report(frame):
    rows = [
        (1, "a", "A", "x" * 70, date(2024, 1, 1), None, datetime(2024, 3, 1, 5, 30, 9), 2, datetime(2024, 4, 1, 5, 30), "28d", None, "Active", -20.25, "Good", 10.0),
        (1, "b", "b", None, None, date(2024, 2, 2), datetime(2024, 1, 1), 0, datetime(2024, 1, 9), None, 66, "Expired", -30.0, None, None),
        (1, "c", "c", None, None, None, None, 0, None, None, None, "No Plan", None, "Good", 30.5),
        (2, "d", "d", None, None, None, None, 0, None, None, None, "No Plan", None, None, None),
        (3, "n", "n", None, None, None, None, 0, None, None, None, "No Plan", float("nan"), "Good", float("nan")),
        (1, "e", "e", None, None, None, None, 0, datetime(2024, 3, 9), None, 6, "Expired", None, None, None),
    ]
    df = frame(
        rows,
        "partner_id bigint, mobile string, name string, address string, install_date date, last_ping date, last_recharge timestamp_ntz, "
        "recharge_count bigint, plan_expiry timestamp_ntz, plan_details string, days_since_expiry int, status string, "
        "avg_optical_dbm double, optical_health string, actual_speed_mbps double",
    )
    signal = by(c.signal_summary(df), "partner_id")
    assert tuple(signal[1].values())[1:] == (2, -25.125, 50.0, 2, 20.25)
    assert tuple(signal[2].values())[1:] == tuple(signal[3].values())[1:] == (0, None, None, 0, None)
    counts = by(c.customer_status_counts(df), "partner_id")
    assert tuple(counts[1].values())[1:] == (4, 1, 2, 1)
    ordered = [r.mobile for r in c.order_customers(df, AS_OF).collect()]
    assert ordered == ["a", "e", "b", "c", "d", "n"]
    shown = by(c.customer_report(df), "Mobile")
    a, b = shown["a"], shown["b"]
    assert (shown["n"]["Optical (dBm)"], shown["n"]["Speed (Mbps)"]) == ("—", "—")
    assert (len(a["Address"]), a["Last Recharge"], a["Since Expiry"], a["Optical (dBm)"]) == (60, "2024-03-01 05:30", "Active ✓", "-20.2")
    assert (b["Address"], b["Last Ping"], b["Since Expiry"], b["Optical Health"], b["Plan"]) == ("—", "2024-02-02", "66d ago", "—", "—")
    assert (shown["c"]["Since Expiry"], shown["c"]["Last Recharge"], shown["c"]["Speed (Mbps)"]) == ("—", "—", "30.5")


@pytest.mark.parametrize(
    "data, want",
    [
        (json.dumps({"address": json.dumps({"home": "12 Road", "city": "Agra"})}), "12 Road, Agra"),
        (json.dumps({"address": {"home": "12 Road", "city": "Agra"}}), "12 Road, Agra"),  # nested, not text
        (json.dumps({"address": json.dumps({"home": 12, "city": True})}), "12, true"),
        (json.dumps({"address": json.dumps({"home": {"no": 1}, "city": ["a", 2]})}), '{"no":1}, ["a",2]'),
        (json.dumps({"address": json.dumps({"home": None, "city": "É\"x"})}), 'É"x'),
        (json.dumps({"address": json.dumps(["home"])}), None),
        (json.dumps({"address": 7}), None),
        (json.dumps([1]), None),
        ('{"address": "{\\"home\\": \\"cut', None),
        ("{}", None),
        ("", None),
        (None, None),
    ],
)
def test_address_of_bad_nested_and_other_values(table, data, want):
    event = dict(mobile="a", data=data, added_time="2024-01-01 00:00:00", event_name="address_updated")
    assert c.customer_address(table("booking_events", [event]), table("plans", [plan("a")])).first().address == want


def test_each_text_is_parsed_once(table):
    update = table("booking_events", [dict(mobile="a", data="{}", added_time="2024-01-01 00:00:00", event_name="address_updated")])
    text = c.address_updates(update).select(c.address_text(c.F.col("address_json")).alias("address"))._jdf.queryExecution().optimizedPlan().toString()
    assert "get_json_object" not in text and "variant" in text.lower()
    inner = [line for line in text.splitlines() if "concat_ws" in line]
    assert len(inner) == 1


def test_plan_rows_are_shuffled_once_by_mobile(spark, sources):
    """Customers and their facts by mobile follow in place; rows without a mobile are reduced beforehand."""
    lost = [plan(None, nas_id=n, device_id=f"D{n}", account_id=n, charges=5) for n in (3, 9, 4)] + [plan(None, partner=2)]
    tables = sources(
        plans=[plan("a", nas_id=1, charges=1), plan("a", partner=2), *lost],
        bookings=[dict(mobile="a", name="Ann", is_deleted=False), dict(mobile=None, name="None", is_deleted=False)],
        optical_readings=[dict(nas_id=9, avg_optical_dbm=-20.0, date_ist="2024-03-01")],
        devices=[dict(partner_id=1, customer_id="9", device_id="D9")],
    )
    got = {(r["partner_id"], r["mobile"]): r.asDict() for r in view(tables).collect()}
    assert len(got) == 4 and got[1, "a"]["name"] == got[2, "a"]["name"] == "Ann"
    assert [got[1, None][n] for n in ("name", "avg_optical_dbm", "recharge_count", "plan_expiry", "status")] == [None, -20.0, 0, None, "No Plan"]
    assert got[2, None]["avg_optical_dbm"] is None
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        steps = view(tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert steps.count("Exchange hashpartitioning(mobile#") == 2  # the plan rows and the facts by mobile


def many(sources):
    """Customers of several accounts, devices and partners, and rows without a mobile, device or account."""
    n = range(60)
    some = lambda i, k, value: None if i % k == 0 else value
    return sources(
        plans=[
            plan(some(i, 7, f"m{i % 11}"), partner=i % 3 or None, nas_id=some(i, 5, i % 6), device_id=some(i, 2, f"D{i % 9}"), account_id=some(i, 4, i % 13), charges=i % 4, speed_mbps=some(i, 6, str(i % 3)), start=some(i, 10, f"2024-03-{1 + i % 5:02d} 00:00:00"), seconds=some(i, 9, i * DAY))
            for i in n
        ],
        devices=[dict(partner_id=i % 3, customer_id=some(i, 8, str(i % 13)), device_id=f"D{i % 7}") for i in n],
        bookings=[dict(mobile=some(i, 9, f"m{i % 5}"), name=f"N{i}", is_deleted=i % 2 == 0) for i in n],
        booking_events=[dict(mobile=some(i, 9, f"m{i % 7}"), event_name="address_updated", data=address(home=f"H{i}"), added_time=f"2024-01-{1 + i % 9:02d} 00:00:00") for i in n],
        daily_usage=[dict(nas_id=some(i, 9, i % 4), added_date=f"2024-02-{1 + i % 9:02d}") for i in n],
        task_events=[dict(mobile=some(i, 9, f"m{i % 6}"), event_name="OTP_VERIFIED", added_time=f"2024-01-{1 + i % 9:02d} 00:00:00") for i in n],
        optical_readings=[dict(nas_id=some(i, 9, 2 + i % 4), date_ist=f"2024-02-{1 + i % 9:02d}", avg_optical_dbm=-float(i)) for i in n],
        speed_tests=[dict(device_id=some(i, 9, f"D{i % 8}"), tested_on=f"2024-02-{1 + i % 9:02d} 00:00:00", speed=float(i)) for i in n],
    )


def test_a_missing_device_is_that_of_the_largest_account(sources):
    tables = sources(
        plans=[plan("a", account_id=2), plan("a", account_id=10), plan("b", account_id=2), plan("b", account_id=2, device_id="E"), plan(None, account_id=2)],
        devices=[dict(partner_id=1, customer_id="2", device_id="Z"), dict(partner_id=1, customer_id="10", device_id="C")],
        speed_tests=[dict(device_id=d, tested_on="2024-03-01 00:00:00", speed=s) for d, s in (("Z", 1.0), ("C", 2.0), ("E", 3.0))],
    )
    for stored in (False, True):
        got = by(c.customer_360(**tables, as_of=AS_OF, stored=stored), "mobile")
        assert {m: r["actual_speed_mbps"] for m, r in got.items()} == {"a": 2.0, "b": 3.0, None: None}


def test_the_stored_view_is_the_view(sources):
    tables = many(sources)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = rows(view(tables))
    stored = c.customer_360(**tables, as_of=AS_OF, stored=True)
    assert len(want) > 20 and stored.schema.names == view(tables).schema.names and rows(stored) == want
    # Joined out of the parts, none of which shares its joins with the view.
    devices = {(r.partner_id, r.mobile): r.device_id for r in c.resolved_devices(tables["plans"], tables["devices"]).collect()}
    speeds = by(c.latest_speed(tables["speed_tests"], tables["plans"], tables["devices"]), "device_id")
    shown = by(stored, "partner_id", "mobile")
    assert any(r["actual_speed_mbps"] for r in shown.values()) and any(r["mobile"] is None and r["avg_optical_dbm"] for r in shown.values())
    for key, row in shown.items():
        test = speeds.get(devices[key]) if key[1] is not None else None
        assert row["actual_speed_mbps"] == (test and test["speed"])


def test_steps_of_the_stored_view_leave_no_files(spark, sources, tmp_path, monkeypatch):
    """Nothing is shuffled after the last step, and of the steps only its table and no shuffle file is left."""
    monkeypatch.setattr("fibrelens.session.shared_folder", lambda spark: str(tmp_path))
    tables = many(sources)
    before = shuffle_files(spark)
    stored = c.customer_360(**tables, as_of=AS_OF, stored=True)
    assert not new_shuffle_files(spark, before)
    assert [path.name.split("-")[0] for path in tmp_path.iterdir()] == ["customers"]
    assert "Exchange" not in stored._jdf.queryExecution().executedPlan().toString()
    whole = view(tables)
    whole.collect()
    assert new_shuffle_files(spark, before)  # as the view in one plan leaves them, at least until it is collected as garbage
