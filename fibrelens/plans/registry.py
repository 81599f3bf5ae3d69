"""Every operator as a query over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fibrelens.functions import values
from fibrelens.operators import base, calendar, city, customers, devices, payouts, tickets, wallet
from fibrelens.plans.reports import customers_of
from fibrelens.plans.refresh import CustomerState
from fibrelens.plans.testbed import AS_OF, FEW, LOADS, ZONES, Testbed
from fibrelens.session import new_table_path
from fibrelens.sources.layout import load_days, write_days
from fibrelens.sources.pages import load_pages, save_pages
from fibrelens.sources.tables import conform

Query = Callable[[SparkSession, str], DataFrame]


def _roster(t: Testbed) -> DataFrame:
    return city.city_roster(t["roster"], t.cities())


def _card(t: Testbed) -> DataFrame:
    return payouts.partner_card(t["growth_card"], ZONES)


def _live(t: Testbed) -> DataFrame:
    return tickets.live_tickets(t["ticket_events"], AS_OF)


def _best(t: Testbed) -> DataFrame:
    return tickets.best_sla(t["growth_card"], t["partner_scores"], AS_OF)


def _scorecard(t: Testbed) -> DataFrame:
    return city.partner_scorecard(t["plans"], _roster(t), t["ticket_daily"], AS_OF)


def _daily(t: Testbed) -> DataFrame:
    return city.daily_leads_installs(t["plans"], t["bookings"], _roster(t), AS_OF)


def _overview(t: Testbed) -> DataFrame:
    counts = devices.device_location_counts(t["devices"])
    return payouts.partner_overview(_card(t), t["disbursements"], counts, AS_OF)


def _earnings(t: Testbed) -> DataFrame:
    return payouts.earnings_breakdown(_card(t), t["disbursements"], AS_OF)


def _wallet(t: Testbed) -> DataFrame:
    return wallet.wallet_transactions(t["ledger_old"], t["ledger_new"])


def _months(t: Testbed) -> DataFrame:
    rows = calendar.month_keys(t["disbursements"], "added_time", AS_OF)
    return rows.groupBy("month", "month_key", "month_label", "month_off").agg(F.count(F.lit(1)).alias("n_rows"))


def _signal(t: Testbed) -> DataFrame:
    means = {c: F.round(c, 9) for c in ("avg_optical", "avg_speed")}
    return customers.signal_summary(customers_of(t, AS_OF)).withColumns(means)


def _casts(t: Testbed) -> DataFrame:
    """Numbers out of texts that hold one, a broken one or none."""
    price, quantity = F.col("l_extendedprice").cast("string"), F.col("l_quantity").cast("string")
    text = F.when(F.col("l_linenumber") == 7, "n/a").when(F.col("l_linenumber") != 6, price)
    return (
        t.raw("lineitem")
        .groupBy("l_linenumber")
        .agg(
            F.sum(values.safe_long(text)).alias("whole_prices"),
            F.sum(values.safe_double(text).cast("decimal(18,2)")).alias("prices"),
            F.sum(values.safe_long(quantity)).alias("quantities"),
        )
    )


def _scores(t: Testbed) -> DataFrame:
    return base.partner_scores(t["partner_scores"], t["roster"])


def _status(t: Testbed) -> DataFrame:
    ordered = customers.order_customers(customers.plan_status(customers.current_plan(t["plans"]), AS_OF), AS_OF)
    return ordered.select("partner_id", "mobile", "plan_expiry", "plan_details", "days_since_expiry", "status")


def _state(t: Testbed) -> CustomerState:
    """State after the loads of the test tables, built once per session and folder of tables."""
    context = t.spark.sparkContext
    if not hasattr(context, "_states"):
        context._states = {}
    if t.sf_dir not in context._states:
        state = CustomerState(t.spark, new_table_path(t.spark, "state"), f"state_{uuid.uuid4().hex}", buckets=8)
        landing = t.landing()
        for day in LOADS:
            state.advance(landing, day)
        context._states[t.sf_dir] = state
    return context._states[t.sf_dir]


def _by_day(t: Testbed, name: str) -> DataFrame:
    path = new_table_path(t.spark, f"days-{name}")
    write_days(t[name], name, path)
    return load_days(t.spark, name, path)


def _by_page(t: Testbed, name: str) -> DataFrame:
    path = new_table_path(t.spark, f"pages-{name}")
    save_pages(t[name], path, pages=8)
    return load_pages(t.spark, name, path)


def _lost_values(t: Testbed) -> DataFrame:
    """Values that the loader cannot convert, per column, counted while the rows are summed up."""
    line = F.col("l_linenumber")
    raw = t.raw("lineitem").select(
        F.when(line == 7, "n/a").otherwise(F.col("l_suppkey").cast("string")).alias("PARTNER_ID"),
        F.lit("c").alias("customer_id"),
        F.lit("d").alias("device_id"),
        F.lit("customer").alias("location"),
        F.when(line == 1, "2001-02-30").when(line == 2, "2001-02-28").alias("user_churn_date"),
    )
    lost = Observation()
    devices.device_location_counts(conform(raw, "devices", lost=lost)).write.format("noop").mode("overwrite").save()
    return t.spark.createDataFrame([(column, lost.get[column]) for column in sorted(lost.get)], "column_name string, lost long")


def _few_known(t: Testbed) -> DataFrame:
    return customers.known_customers(t["plans"], t["devices"], FEW)


_QUERIES: dict[str, Callable[[Testbed], DataFrame]] = {
    # city page
    "partner_scorecard": _scorecard,
    "partner_scorecard_mobile_scope": lambda t: city.partner_scorecard(
        t["plans"], _roster(t), t["ticket_daily"], AS_OF, recharge_scope="mobile"
    ),
    "scorecard_ratios": lambda t: city.scorecard_ratios(_scorecard(t)),
    "scorecard_report": lambda t: city.scorecard_report(_scorecard(t)),
    "recharge_counts": lambda t: city.recharge_counts(t["plans"], _roster(t)),
    "first_last_plan": lambda t: city.first_last_plan(t["plans"], _roster(t)),
    "mobile_summary": lambda t: city.mobile_summary(t["plans"], _roster(t)),
    "tickets_30d": lambda t: city.tickets_30d(t["ticket_daily"], _roster(t), AS_OF),
    "city_roster": _roster,
    "city_active_base": lambda t: city.city_active_base(t["plans"], _roster(t), AS_OF, cities=t.cities()),
    "city_partner_counts": lambda t: city.city_partner_counts(_roster(t), t.cities()),
    "daily_leads_installs": _daily,
    "leads_installs_totals": lambda t: city.leads_installs_totals(_daily(t)),
    # card and payouts
    "month_keys": _months,
    "partner_card": _card,
    "partner_detail": lambda t: base.partner_detail(t["growth_card"]),
    "partner_scores": _scores,
    "partner_names": lambda t: base.partner_names(_card(t)),
    "find_partner": lambda t: base.find_partner(_card(t), "Supplier#000000007"),
    "safe_casts": _casts,
    "partner_fields": lambda t: base.partner_fields(_card(t)),
    "fixed_payout_monthly": lambda t: payouts.fixed_payout_monthly(t["disbursements"], AS_OF),
    "fixed_payout_bulk": lambda t: payouts.fixed_payout_monthly_bulk(t["disbursements"], _card(t), AS_OF),
    "device_location_counts": lambda t: devices.device_location_counts(t["devices"]),
    "partner_overview": _overview,
    "overview_report": lambda t: payouts.overview_report(_overview(t), AS_OF),
    "earnings_breakdown": _earnings,
    "earnings_report": lambda t: payouts.earnings_report(_earnings(t)),
    # tickets
    "ticket_counts": lambda t: tickets.ticket_counts(t["ticket_events"], "2001-06-20", "2001-07-10", t["roster"]),
    "ticket_counts_mtd": lambda t: tickets.ticket_counts_mtd(t["ticket_events"], AS_OF),
    "ticket_sla": lambda t: tickets.ticket_sla(t["ticket_events"], "2001-06-20", "2001-07-10"),
    "live_tickets": _live,
    "best_sla": _best,
    "live_sla_override": lambda t: tickets.live_sla_override(_best(t), _live(t), AS_OF),
    "ticket_series": lambda t: tickets.ticket_series(t["growth_card"], _live(t), AS_OF),
    # customers
    "partner_mobiles": lambda t: customers.partner_mobiles(t["plans"]),
    "device_lookup": lambda t: customers.device_lookup(t["devices"]),
    "resolved_devices": lambda t: customers.resolved_devices(t["plans"], t["devices"]),
    "current_plan": lambda t: customers.current_plan(t["plans"]),
    "customer_name": lambda t: customers.customer_name(t["bookings"], t["plans"]),
    "customer_address": lambda t: customers.customer_address(t["booking_events"], t["plans"]),
    "last_ping": lambda t: customers.last_ping(t["daily_usage"], t["plans"]),
    "install_date": lambda t: customers.install_date(t["task_events"], t["plans"]),
    "recharge_count": lambda t: customers.recharge_count(t["plans"]),
    "latest_optical": lambda t: customers.latest_optical(t["optical_readings"], t["plans"]),
    "latest_speed": lambda t: customers.latest_speed(t["speed_tests"], t["plans"], t["devices"]),
    "plan_status": _status,
    "customer_360": lambda t: customers_of(t, AS_OF, stored=True),
    "customer_360_few": lambda t: customers_of(t, AS_OF, FEW),
    "customer_address_few": lambda t: customers.customer_address(t["booking_events"], _few_known(t)),
    "latest_optical_few": lambda t: customers.latest_optical(t["optical_readings"], _few_known(t)),
    # laid out by day, and out of saved result pages
    "ticket_counts_days": lambda t: tickets.ticket_counts(_by_day(t, "ticket_events"), "2001-06-20", "2001-07-10", t["roster"]),
    "tickets_30d_days": lambda t: city.tickets_30d(_by_day(t, "ticket_daily"), _roster(t), AS_OF),
    "recharge_count_pages": lambda t: customers.recharge_count(_by_page(t, "plans")),
    "device_location_counts_pages": lambda t: devices.device_location_counts(_by_page(t, "devices")),
    "lost_values": _lost_values,
    # out of kept state, refreshed in three loads
    "customer_360_refreshed": lambda t: _state(t).customer_360(AS_OF, stored=True),
    "last_ping_refreshed": lambda t: _state(t).last_ping(),
    "recharge_count_refreshed": lambda t: _state(t).recharge_count(),
    "recharge_counts_refreshed": lambda t: _state(t).recharge_counts(_roster(t)),
    "fixed_payout_monthly_refreshed": lambda t: _state(t).fixed_payout_monthly(AS_OF),
    "wallet_transactions_refreshed": lambda t: _state(t).wallet_transactions(),
    "signal_summary": _signal,
    "customer_status_counts": lambda t: customers.customer_status_counts(customers_of(t, AS_OF)),
    "customer_report": lambda t: customers.customer_report(
        customers.order_customers(customers_of(t, AS_OF, stored=True), AS_OF)
    ),
    # monthly series
    "active_base_months": lambda t: base.active_base_months(t["growth_card"], AS_OF, t["roster"]),
    "active_base_trend": lambda t: base.active_base_trend(t["growth_card"], AS_OF),
    "churn_estimate": lambda t: base.churn_estimate(t["growth_card"], AS_OF),
    "engagement_series": lambda t: base.engagement_series(t["growth_card"], AS_OF),
    # wallet
    "wallet_transactions": _wallet,
    "wallet_summary": lambda t: wallet.wallet_summary(_wallet(t)),
    "wallet_report": lambda t: wallet.wallet_report(_wallet(t)),
}


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for comparison across engines."""
    money = {f.name: F.col(f"`{f.name}`").cast("double") for f in df.schema if isinstance(f.dataType, T.DecimalType)}
    return df.withColumns(money) if money else df


def _query(build: Callable[[Testbed], DataFrame]) -> Query:
    return lambda spark, sf_dir: _plain(build(Testbed(spark, sf_dir)))


def all_queries() -> dict[str, Query]:
    return {name: _query(build) for name, build in _QUERIES.items()}
