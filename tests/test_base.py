from fibrelens.operators import base, calendar
from tests.helpers import AS_OF, by


def series(df, *values):
    got = by(df, "partner_id", "month_off")
    return {p: [tuple(got[p, k][v] for v in values) for k in (3, 2, 1, 0) if (p, k) in got] for p, _ in got}


def active(partner, m3, m2, m1, m0, **more):
    return dict(partner_id=partner, active_customer_15d_m3=m3, active_customer_15d_m2=m2, active_customer_15d_m1=m1, active_customer_15d_m0=m0, **more)


def test_active_base_and_trend(table, frame):
    card = table("growth_card", [active(1, 0, 10, 8, 12), active(2, None, None, None, None)])
    got = series(base.active_base_trend(card, AS_OF), "active_base", "change")
    assert got[1] == [(0, None), (10, None), (8, -2), (12, 4)]
    assert got[2] == [(0, None)] * 4
    months = base.active_base_months(card, AS_OF, frame([(1,), (9,)], "partner_id bigint"))
    assert series(months, "active_base") == {1: [(0,), (10,), (8,), (12,)], 9: [(0,)] * 4}
    labels = by(base.active_base_months(card, AS_OF), "partner_id", "month_off")
    assert labels[1, 3]["month_label"] == "Dec 2023"


def test_churn_estimate(table):
    lost = lambda *v: {f"lost_customers_m{3 - i}": x for i, x in enumerate(v)}
    installs = lambda m2, m1, m0: dict(installs_m2=m2, installs_m1=m1, installs_m0=m0)
    card = table(
        "growth_card",
        [
            active(1, 10, 12, 15, 14, **lost(0, 0, 0, None), **installs(5, 1, 0)),
            active(2, 10, 12, 15, 14, **lost(0, 0, 0, 4), **installs(5, 9, 9)),
            active(3, 10, 20, 30, 40, **lost(0, 0, 0, 0), **installs(1, 1, 1)),
            active(4, 10, 10, 10, 10, **lost(7, 0, 0, 0), **installs(9, 9, 9)),
        ],
    )
    got = series(base.churn_estimate(card, AS_OF), "lost_customers", "estimated")
    assert got[1] == [(0, True), (3, True), (0, True), (1, True)]
    assert got[2] == [(0, False), (0, False), (0, False), (4, False)]
    assert got[3] == [(0, False)] * 4
    assert got[4] == [(7, False), (0, False), (0, False), (0, False)]


def test_engagement_series(table):
    card = table("growth_card", [dict(partner_id=1, installs_m2=1, notifs_m1=2, intersts_m0=3)])
    got = series(base.engagement_series(card, AS_OF), "installs", "notifications", "interests")
    assert got == {1: [(1, 0, 0), (0, 2, 0), (0, 0, 3)]}


def test_one_row_per_partner(table, frame):
    card = table("growth_card", [dict(partner_id=1, zone="A"), dict(partner_id=1, zone="B"), dict(zone="C")])
    assert [r.zone for r in base.partner_detail(card).collect()] == ["B"]
    upper = frame([(1, "x")], "PARTNER_ID bigint, Zone string")
    assert base.partner_detail(upper).columns == ["partner_id", "zone"]
    scores = table("partner_scores", [dict(partner_id=1, service_rating=4.5)])
    got = by(base.partner_scores(scores, frame([(1,), (2,)], "partner_id bigint")), "partner_id")
    assert (got[1]["service_rating"], got[2]["service_rating"]) == (4.5, None)


def test_names_lookup_and_fields(frame):
    card = frame([(2, "B"), (1, "A"), (3, None), (4, "B")], "partner_id bigint, partner_name string")
    assert [r[0] for r in base.partner_names(card).collect()] == ["A", "B", "B"]
    assert base.find_partner(card, "B").first().partner_id == 2
    assert base.find_partner(card, "b").count() == 0
    fields = base.partner_fields(card.withColumnRenamed("partner_name", "name"))
    names = {(2, "name", "B"), (1, "name", "A"), (3, "name", None), (4, "name", "B")}
    assert {tuple(r) for r in fields.collect()} == names | {(i, "partner_id", str(i)) for i, _, _ in names}


def test_month_keys(table):
    rows = [dict(added_time=t) for t in ("2024-03-31 23:59:59", "2024-01-01 00:00:00", "2023-12-01 00:00:00", "2023-11-30 23:00:00", "2024-04-01 00:00:00")]
    got = calendar.month_keys(table("disbursements", rows), "added_time", AS_OF).collect()
    assert sorted((r.month_off, r.month_key, r.month_label) for r in got) == [
        (0, "2024-03", "Mar 2024"),
        (2, "2024-01", "Jan 2024"),
        (3, "2023-12", "Dec 2023"),
    ]
