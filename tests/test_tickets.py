import pytest

from fibrelens.operators import tickets
from tests.helpers import AS_OF, by


def event(task, name, when, partner=1, kind="SERVICE"):
    return dict(task_id=task, event_name=name, added_time=when, partner_id=partner, type=kind)


MADE = "TICKET_CREATED"


@pytest.fixture
def log(table):
    return table(
        "ticket_events",
        [
            event("start", MADE, "2024-02-01 00:00:00"),  # exactly at the start: in
            event("end", MADE, "2024-03-01 00:00:00"),  # exactly at the end: out of M1, in M0
            event("twice", MADE, "2024-02-05 00:00:00"),
            event("twice", MADE, "2024-02-06 00:00:00"),
            event("late", MADE, "2024-02-10 00:00:00"),
            event("late", "TICKET_CLOSED", "2024-03-01 00:00:00"),  # not before the end
            event("early", MADE, "2024-02-10 00:00:00", kind="ROUTER_PICKUP"),
            event("early", "ROUTER_RECOVERED", "2023-12-01 00:00:00", partner=9, kind="ROUTER_PICKUP"),
            event("sent", MADE, "2024-02-11 00:00:00"),
            event("sent", "ESCALATED", "2024-02-12 00:00:00"),
            event("shared", MADE, "2024-02-11 00:00:00"),
            event("shared", MADE, "2024-02-12 00:00:00", partner=2),
            event("shared", "CUSTOMER_RECOVERED", "2024-02-13 00:00:00", partner=3),
            event("odd", MADE, "2024-02-12 00:00:00", kind="OTHER"),
            event("only-end", "TICKET_RESOLVED", "2024-02-12 00:00:00", partner=4),
            event("nobody", MADE, "2024-02-12 00:00:00", partner=None),
            event(None, MADE, "2024-02-12 00:00:00", partner=5),
        ],
    )


def test_counts_in_window(log, frame):
    got = by(tickets.ticket_counts(log, "2024-02-01", "2024-03-01"), "partner_id")
    pair = lambda p: (got[p]["service_tickets"], got[p]["router_pickup_tickets"])
    assert (pair(1), pair(2), pair(5)) == ((5, 1), (1, 0), (0, 0))
    assert 4 not in got and None not in got
    listed = by(tickets.ticket_counts(log, "2024-02-01", "2024-03-01", frame([(1,), (8,)], "partner_id bigint")), "partner_id")
    assert {p: r["service_tickets"] for p, r in listed.items()} == {1: 5, 8: 0}
    running = by(tickets.ticket_counts_mtd(log, AS_OF), "partner_id")
    assert {p: r["service_tickets"] for p, r in running.items()} == {1: 1}


def test_sla_in_window(log):
    got = by(tickets.ticket_sla(log, "2024-02-01", "2024-03-01"), "partner_id", "type")
    pair = lambda *k: (got[k]["total_tickets"], got[k]["sla_met"])
    assert pair(1, "SERVICE") == (5, 1)  # only "shared"
    assert pair(1, "ROUTER_PICKUP") == (1, 1)  # resolved before it was made, by another partner
    assert pair(1, "OTHER") == (1, 0)
    assert pair(2, "SERVICE") == (1, 1)
    assert pair(5, "SERVICE") == (0, 0)
    open_end = by(tickets.ticket_sla(log, "2024-02-01"), "partner_id", "type")
    assert open_end[1, "SERVICE"]["sla_met"] == 2  # "late" as well


def test_live_tickets_equal_the_two_windows(log):
    live = by(tickets.live_tickets(log, AS_OF), "partner_id")
    for back, window in ((0, ("2024-03-01", None)), (1, ("2024-02-01", "2024-03-01"))):
        sla = by(tickets.ticket_sla(log, *window), "partner_id", "type")
        for partner, row in live.items():
            for kind, code in (("service", "SERVICE"), ("device", "ROUTER_PICKUP")):
                want = sla.get((partner, code), {"total_tickets": 0, "sla_met": 0})
                assert row[f"{kind}_total_m{back}"] == want["total_tickets"]
                assert row[f"{kind}_met_m{back}"] == want["sla_met"]


def stored(prefix, **months):
    return {f"service_ticket{'_sla' if k[0] == 's' else ''}_m{k[1]}": v for k, v in months.items()} | prefix


def test_best_sla_order(table):
    months = [("t1", "c"), ("t1", "s"), ("t0", "c"), ("t2", "c"), ("t2", "s"), ("t3", "c"), ("t3", "s")]
    labels = ["Feb 2024", "Feb 2024", "Mar 2024 MTD", "Jan 2024", "Jan 2024", "Dec 2023", "Dec 2023"]
    cards, scores = [], []
    for partner in range(len(months) + 1):
        # Partner n has tickets from source n of the order on.
        have = {"c": {}, "s": {}}
        for place in range(partner, len(months)):
            month, source = months[place]
            have[source][month] = 4
            have[source]["s" + month[1]] = place % 4
        cards.append(stored({"partner_id": partner}, **have["c"]))
        if partner < 7:
            scores.append(stored({"partner_id": partner}, **have["s"]))
    got = by(tickets.best_sla(table("growth_card", cards), table("partner_scores", scores), AS_OF), "partner_id")
    for place, label in enumerate(labels):
        assert got[place]["service_sla_label"] == label
        assert got[place]["service_sla_pct"] == place % 4 * 25.0
    assert (got[7]["service_sla_pct"], got[7]["service_sla_label"]) == (None, None)
    assert got[0]["device_sla_pct"] is None


def test_live_override_and_flags(frame):
    best = frame(
        [
            (1, 10.0, "Jan 2024", 20.0, "Feb 2024"),
            (2, 10.0, "Jan 2024", None, None),
            (3, 10.0, "Mar 2024 MTD", None, None),
            (4, None, None, None, None),
        ],
        "partner_id bigint, service_sla_pct double, service_sla_label string, device_sla_pct double, device_sla_label string",
    )
    live = frame(
        [(1, 0, 0, 2, 1, 4, 1, 9, 9), (4, 1, 0, 5, 5, 0, 0, 0, 0)],
        "partner_id bigint, service_total_m0 bigint, service_met_m0 bigint, service_total_m1 bigint, service_met_m1 bigint, "
        "device_total_m0 bigint, device_met_m0 bigint, device_total_m1 bigint, device_met_m1 bigint",
    )
    got = by(tickets.live_sla_override(best, live, AS_OF), "partner_id")
    tell = lambda p: tuple(got[p].values())[1:]
    assert tell(1) == (50.0, "Feb 2024", 25.0, "Mar 2024 MTD", False, True)
    assert tell(2) == (10.0, "Jan 2024", None, None, True, False)
    assert tell(3) == (10.0, "Mar 2024 MTD", None, None, False, True)
    assert tell(4) == (0.0, "Mar 2024 MTD", None, None, False, True)


def test_ticket_series_fills_only_empty_months(table, log):
    live = tickets.live_tickets(log, AS_OF)
    cards = [
        dict(partner_id=1, service_ticket_m1=0, device_ticket_m1=None, service_ticket_sla_m1=8, service_ticket_m0=0, device_ticket_m0=3, device_ticket_sla_m0=2),
        dict(partner_id=7, service_ticket_m2=6, service_ticket_sla_m2=5),
    ]
    got = by(tickets.ticket_series(table("growth_card", cards), live, AS_OF), "partner_id", "month_off")
    tell = lambda *k: tuple(got[k].values())[3:]
    assert tell(1, 1) == (5, 1, 1, 1, True)
    assert tell(1, 0) == (0, 0, 3, 2, False)  # device tickets are there, so nothing is filled
    assert tell(7, 2) == (6, 5, 0, 0, False)
    assert tell(7, 1) == (0, 0, 0, 0, False)
