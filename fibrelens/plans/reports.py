"""The three reports as bundles of lazy DataFrames over the logical tables.

``tables`` maps logical names (see ``fibrelens.sources.schemas``) to DataFrames.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from fibrelens.functions.joins import Ids, of_ids
from fibrelens.functions.times import AsOf
from fibrelens.operators import base, city, customers, devices, payouts, tickets, wallet
from fibrelens.session import checkpointed, kept
from fibrelens.sources.dimensions import ZONES

Tables = Mapping[str, DataFrame]


def overview_page(tables: Tables, as_of: AsOf, zones: Sequence[str] = ZONES) -> DataFrame:
    """All card rows of ``zones`` with corrected payouts and device counts."""
    card = payouts.partner_card(tables["growth_card"], zones)
    counts = devices.device_location_counts(tables["devices"])
    return payouts.partner_overview(card, tables["disbursements"], counts, as_of)


def customers_of(tables: Tables, as_of: AsOf, partners: Ids | None = None, stored: bool = False) -> DataFrame:
    """The customer view over the logical tables, of all partners or the asked-for ones; ``stored`` for
    reports with all its columns."""
    return customers.customer_360(
        tables["plans"],
        tables["devices"],
        tables["bookings"],
        tables["booking_events"],
        tables["daily_usage"],
        tables["task_events"],
        tables["optical_readings"],
        tables["speed_tests"],
        as_of,
        partners=partners,
        stored=stored,
    )


def partner_page(tables: Tables, as_of: AsOf, zones: Sequence[str] = ZONES) -> dict[str, DataFrame]:
    """Every section of the partner page for all partners of ``zones``.

    The customer view, the wallet rows and the live tickets each feed several sections, so
    they are computed once and kept in the shared checkpoint folder.
    """
    # The zones choose partners by their card rows; the detail is then read by id, in any zone.
    card = payouts.partner_card(tables["growth_card"], zones)
    ids = kept(card.select("partner_id").distinct(), "partners")
    detail = base.partner_detail(of_ids(tables["growth_card"], ids))

    live = checkpointed(tickets.live_tickets(tables["ticket_events"], as_of, ids))
    people = checkpointed(customers_of(tables, as_of, ids))
    rows = checkpointed(wallet.wallet_transactions(*(of_ids(tables[n], ids) for n in ("ledger_old", "ledger_new"))))
    stored = tickets.best_sla(detail, base.partner_scores(tables["partner_scores"]), as_of)
    return {
        "fields": base.partner_fields(card),
        "scores": base.partner_scores(tables["partner_scores"], ids),
        "sla": tickets.live_sla_override(stored, live, as_of),
        "devices": devices.device_location_counts(tables["devices"]).join(ids, "partner_id", "left_semi"),
        "signal": customers.signal_summary(people),
        "active_base": base.active_base_trend(detail, as_of),
        "churn": base.churn_estimate(detail, as_of),
        "engagement": base.engagement_series(detail, as_of),
        "earnings": payouts.earnings_breakdown(card, tables["disbursements"], as_of),
        "tickets": tickets.ticket_series(detail, live, as_of),
        "customer_counts": customers.customer_status_counts(people),
        "customers": customers.customer_report(customers.order_customers(people, as_of)),
        "wallet_summary": wallet.wallet_summary(rows),
        "wallet": wallet.wallet_report(rows),
    }


def city_page(tables: Tables, cities: DataFrame, as_of: AsOf) -> dict[str, DataFrame]:
    """Every section of the city page for all cities of ``cities``.

    The plan rows are read and shuffled once, into a rollup kept in the shared checkpoint
    folder, from which all three sections follow.
    """
    roster = city.city_roster(tables["roster"], cities)
    rollup = checkpointed(city.plan_rollup(tables["plans"], roster))
    daily = city.daily_from_rollup(rollup, tables["bookings"], roster, as_of)
    return {
        "partner_counts": city.city_partner_counts(roster, cities),
        "active_base": city.active_base_from_rollup(rollup, roster, as_of, cities),
        "daily": daily,
        "totals": city.leads_installs_totals(daily),
        "partners": city.scorecard_ratios(city.scorecard_from_rollup(rollup, roster, tables["ticket_daily"], as_of)),
    }
