from datetime import date
from decimal import Decimal as D

import pytest

from fibrelens.operators import devices, payouts
from tests.helpers import AS_OF, by


def card_row(partner=1, zone="Agra", **more):
    return dict(partner_id=partner, partner_name=f"P{partner}", zone=zone, **more)


def paid(partner, amount, when, status=5, deleted=False):
    return dict(partner_id=partner, amount=amount, added_time=when, bonus_status=status, is_deleted=deleted)


def test_card_filters_zones_and_sums_bonuses(table):
    rows = [
        card_row(1, fixed_bonus_m0=10, claim_rating_bonus_m0=None, claim_work_bonus_m0=2.5, claim_device_bonus_m0=-1),
        card_row(2, zone="Delhi", fixed_bonus_m0=10),
        card_row(3, zone="Meerut++", service_ticket_m0=4, service_ticket_sla_m0=3, device_ticket_m0=0, device_ticket_sla_m0=9),
        card_row(4, zone=None),
    ]
    got = by(payouts.partner_card(table("growth_card", rows)), "partner_id")
    assert set(got) == {1, 3}
    assert got[1]["total_m0_payout"] == D("11.50")
    assert got[3]["total_m0_payout"] == 0  # all bonuses missing
    assert (got[3]["current_service_sla"], got[3]["current_device_sla"]) == (0.75, 0.0)
    assert got[1]["current_service_sla"] == 0.0
    assert (got[1]["current_rating"], got[1]["partner_lottery_earning"], got[1]["m1_rating_at_payout"]) == (0, 0, 0)
    assert {"m0_installs_mtd", "m1_installs", "m2_rating_bonus_renewals"} <= set(got[1])


@pytest.fixture
def disbursed(table):
    return table(
        "disbursements",
        [
            paid(1, 100, "2024-03-01 00:00:00"),
            paid(1, 10, "2024-03-14 00:00:00", status=1),  # accrued this month
            paid(1, 7, "2024-02-29 23:59:59", status=1),  # unpaid, past month
            paid(1, 50, "2024-02-10 00:00:00"),
            paid(1, 20, "2024-01-10 00:00:00"),
            paid(1, 30, "2023-12-01 00:00:00"),
            paid(1, 99, "2023-11-30 23:59:59"),  # four months ago
            paid(1, 1000, "2024-03-02 00:00:00", deleted=True),
            paid(1, 1000, "2024-03-02 00:00:00", deleted=None),
            paid(1, 3, "2024-04-01 00:00:00", status=1),  # next month, unpaid
            paid(2, 5, "2024-02-10 00:00:00"),
            paid(None, 5, "2024-02-10 00:00:00"),
        ],
    )


def test_fixed_payout_monthly(disbursed):
    rows = payouts.fixed_payout_monthly(disbursed, AS_OF).collect()
    assert [(r.partner_id, r.month, r.fixed_paid, r.renewal_count) for r in rows] == [
        (1, date(2024, 3, 1), D("110.00"), 2),
        (1, date(2024, 2, 1), D("50.00"), 1),
        (1, date(2024, 1, 1), D("20.00"), 1),
        (1, date(2023, 12, 1), D("30.00"), 1),
        (2, date(2024, 2, 1), D("5.00"), 1),
    ]


def test_fixed_payout_bulk_keeps_listed_partners(disbursed, frame):
    ids = frame([(2,), (2,), (None,), (7,)], "partner_id bigint")
    rows = payouts.fixed_payout_monthly_bulk(disbursed, ids, AS_OF).collect()
    assert [tuple(r) for r in rows] == [(2, "2024-02", D("5.00"))]


def test_device_buckets_follow_location(table):
    d = lambda p, loc, churn=None, customer="c": dict(partner_id=p, location=loc, user_churn_date=churn, customer_id=customer)
    rows = [
        d(1, "partner", customer=None),
        d(1, "partner", "2024-01-01"),  # recovered from a churned customer
        d(1, "customer"),
        d(1, "customer", "2024-01-01"),
        d(1, "warehouse"),
        d(1, None),
        d(None, "partner"),
    ]
    got = devices.device_location_counts(table("devices", rows)).collect()
    assert [tuple(r) for r in got] == [(1, 2, 1, 1)]


@pytest.fixture
def card(table):
    rows = [
        card_row(1, active_customer_15d_m0=5, fixed_bonus_m0=0, fixed_bonus_m1=None, fixed_bonus_m2=8, claim_rating_bonus_m0=1, life_time_earning=1234567.5),
        card_row(2, active_customer_15d_m0=9, fixed_bonus_m0=0, fixed_bonus_m1=-4, fixed_bonus_m2=0),
        card_row(3, active_customer_15d_m0=None),
    ]
    return payouts.partner_card(table("growth_card", rows))


def test_overview_corrects_only_zero_fixed(card, disbursed, table):
    counts = devices.device_location_counts(table("devices", [dict(partner_id=1, location="partner")]))
    overview = payouts.partner_overview(card, disbursed, counts, AS_OF)
    assert [r.partner_id for r in overview.collect()] == [2, 1, 3]
    got = by(overview, "partner_id")
    totals = lambda p: [got[p][f"corrected_m{k}_payout"] for k in (0, 1, 2)]
    assert totals(1) == [D("111.00"), D("50.00"), D("8.00")]  # M2 has its own fixed bonus
    assert totals(2) == [D("0.00"), D("-4.00"), D("0.00")]  # negative is not zero
    assert totals(3) == [0, 0, 0]
    assert (got[1]["ont_with_partner"], got[2]["ont_with_partner"]) == (1, 0)
    shown = by(payouts.overview_report(overview, AS_OF), "Partner")
    assert shown["P1"]["Lifetime Earning"] == "₹1,234,568"
    assert shown["P1"]["Mar 2024 Payout"] == "₹111"
    assert shown["P3"]["Feb 2024 Payout"] == "₹0"


def test_earnings_breakdown(card, disbursed):
    earnings = payouts.earnings_breakdown(card, disbursed, AS_OF)
    got = by(earnings, "partner_id", "month_off")
    assert len(got) == 9
    assert (got[1, 0]["fixed_payout"], got[1, 0]["total_payout"]) == (D("110.00"), D("111.00"))
    assert [got[1, k]["from_disbursement"] for k in (2, 1, 0)] == [False, True, True]
    assert got[1, 0]["disbursed_months"] == "Feb 2024 · Mar 2024"
    assert got[1, 0]["avg_3m"] == pytest.approx((111 + 50 + 8) / 3)
    # A negative fixed bonus shows the disbursed sum but leaves the total alone.
    assert (got[2, 1]["fixed_payout"], got[2, 1]["total_payout"]) == (D("5.00"), D("-4.00"))
    assert not got[2, 1]["from_disbursement"]
    assert got[3, 2]["avg_3m"] == 0.0 and got[3, 2]["disbursed_months"] == ""
    shown = by(payouts.earnings_report(earnings), "partner_id", "Month")
    assert shown[1, "Jan 2024"]["Fixed Payout"] == "₹8"
    assert shown[1, "Jan 2024"]["Rating Score"] == "0.00"
