"""Partner card, disbursed payouts and corrected earnings.

The card lags: when its fixed bonus of a month is 0 (or missing), the sum really
disbursed for that month stands in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fibrelens.functions.shapes import stack_months
from fibrelens.functions.times import AsOf, month_label, month_of, month_start, ts_lit, within
from fibrelens.functions.values import money, or_zero, ratio
from fibrelens.sources.dimensions import ZONES

PAID = 5


def _card_month(back: int) -> dict[str, Column]:
    running = "_mtd" if back == 0 else ""
    bonuses = {
        f"m{back}_fixed_payout": F.col(f"fixed_bonus_m{back}"),
        f"m{back}_rating_bonus_payout": F.col(f"claim_rating_bonus_m{back}"),
        f"m{back}_service_sla_bonus_payout": F.col(f"claim_work_bonus_m{back}"),
        f"m{back}_device_sla_bonus_payout": F.col(f"claim_device_bonus_m{back}"),
    }
    total = None
    for bonus in bonuses.values():
        total = or_zero(bonus) if total is None else total + or_zero(bonus)
    return {
        **bonuses,
        f"total_m{back}_payout": total,
        f"m{back}_installs{running}": F.col(f"installs_m{back}"),
        f"m{back}_notifications{running}": F.col(f"notifs_m{back}"),
        f"m{back}_interests{running}": F.col(f"intersts_m{back}"),
        f"m{back}_rating_bonus_renewals": F.col(f"total_renewals_m{back}"),
        f"m{back}_rating_at_payout": F.lit(0),
    }


def _current_sla(kind: str) -> Column:
    met = or_zero(F.col(f"{kind}_ticket_sla_m0"))
    tickets = F.col(f"{kind}_ticket_m0")
    return F.when(tickets > 0, ratio(met, tickets)).otherwise(F.lit(0.0))


def partner_card(growth_card: DataFrame, zones: Sequence[str] = ZONES) -> DataFrame:
    """Card of the partners in ``zones``: base, bonuses and totals of M0..M2, current SLA ratios."""
    columns = {
        "partner_id": F.col("partner_id"),
        "partner_name": F.col("partner_name"),
        "zone": F.col("zone"),
        "active_base": F.col("active_customer_15d_m0"),
        "partner_status": F.col("partner_status"),
        "lifetime_earning": F.col("life_time_earning"),
        **_card_month(0),
        **_card_month(1),
        **_card_month(2),
        "current_service_sla": _current_sla("service"),
        "current_device_sla": _current_sla("device"),
        "current_rating": F.lit(0),
        "partner_lottery_earning": F.lit(0),
    }
    return growth_card.filter(F.col("zone").isin(*zones)).select(*[c.alias(n) for n, c in columns.items()])


def _countable(disbursements: DataFrame, as_of: AsOf, months_back: int) -> DataFrame:
    """Rows that count: paid ones, and of the current month accrued ones as well."""
    added = F.col("added_time")
    this_month = (added >= ts_lit(month_start(as_of))) & (added < ts_lit(month_start(as_of, -1)))
    rows = within(payable(disbursements), "added_time", month_start(as_of, months_back))
    return rows.filter((F.col("bonus_status") == PAID) | this_month)


def payable(disbursements: DataFrame) -> DataFrame:
    """Rows of partners that are not deleted."""
    return disbursements.filter(F.col("partner_id").isNotNull() & ~F.col("is_deleted"))


def monthly_of_parts(parts: DataFrame, as_of: AsOf) -> DataFrame:
    """``fixed_payout_monthly`` out of sums per partner, month and status (amount, n_rows)."""
    this_month, first = (F.lit(month_start(as_of, back).date()) for back in (0, 3))
    counted = parts.filter((F.col("month") >= first) & ((F.col("bonus_status") == PAID) | (F.col("month") == this_month)))
    return (
        counted.groupBy("partner_id", "month")
        .agg(F.sum("amount").cast("decimal(28,2)").alias("fixed_paid"), F.sum("n_rows").alias("renewal_count"))
        .select("partner_id", "month", F.date_format("month", "yyyy-MM").alias("month_key"), "fixed_paid", "renewal_count")
        .orderBy("partner_id", F.col("month").desc())
    )


def _by_month(rows: DataFrame) -> DataFrame:
    month = month_of(F.col("added_time"))
    return (
        rows.groupBy("partner_id", month.alias("month"))
        .agg(F.sum("amount").alias("fixed_paid"), F.count(F.lit(1)).alias("renewal_count"))
        .withColumn("month_key", F.date_format("month", "yyyy-MM"))
    )


def fixed_payout_monthly(disbursements: DataFrame, as_of: AsOf) -> DataFrame:
    """Disbursed sum and row count per partner and month since M3, newest month first."""
    return (
        _by_month(_countable(disbursements, as_of, 3))
        .select("partner_id", "month", "month_key", "fixed_paid", "renewal_count")
        .orderBy("partner_id", F.col("month").desc())
    )


def fixed_payout_monthly_bulk(disbursements: DataFrame, partners: DataFrame, as_of: AsOf) -> DataFrame:
    """Disbursed sum per listed partner and month since M3."""
    ids = partners.select("partner_id").distinct()
    return (
        _by_month(_countable(disbursements, as_of, 3))
        .join(ids, "partner_id", "left_semi")
        .select("partner_id", "month_key", "fixed_paid")
    )


def fixed_paid_wide(disbursements: DataFrame, as_of: AsOf) -> DataFrame:
    """Disbursed sums of M0..M2 side by side, one row per partner, from one aggregation."""
    added = F.col("added_time")

    def paid(back: int) -> Column:
        inside = (added >= ts_lit(month_start(as_of, back))) & (added < ts_lit(month_start(as_of, back - 1)))
        return F.sum(F.when(inside, F.col("amount"))).alias(f"paid_m{back}")

    return _countable(disbursements, as_of, 2).groupBy("partner_id").agg(paid(0), paid(1), paid(2))


def _paid(back: int) -> Column:
    return or_zero(F.col(f"paid_m{back}"))


def _card_fixed(back: int) -> Column:
    return or_zero(F.col(f"m{back}_fixed_payout"))


def _corrected_total(back: int) -> Column:
    total = or_zero(F.col(f"total_m{back}_payout"))
    return total + F.when(_card_fixed(back) == 0, _paid(back)).otherwise(F.lit(0))


def partner_overview(card: DataFrame, disbursements: DataFrame, device_counts: DataFrame, as_of: AsOf) -> DataFrame:
    """All partners with corrected payouts and device counts, largest active base first."""
    return (
        card.join(fixed_paid_wide(disbursements, as_of), "partner_id", "left")
        .join(device_counts, "partner_id", "left")
        .select(
            "partner_id",
            "partner_name",
            "zone",
            "active_base",
            "partner_status",
            "lifetime_earning",
            *[_corrected_total(k).alias(f"corrected_m{k}_payout") for k in (0, 1, 2)],
            or_zero(F.col("with_partner")).alias("ont_with_partner"),
            or_zero(F.col("with_active_customer")).alias("ont_with_active"),
            or_zero(F.col("with_churned_customer")).alias("ont_with_churned"),
        )
        .orderBy(F.col("active_base").desc_nulls_last(), "partner_id")
    )


def overview_report(overview: DataFrame, as_of: AsOf) -> DataFrame:
    """The overview as display text, one column per heading."""
    return overview.select(
        F.col("partner_name").alias("Partner"),
        F.col("zone").alias("Zone"),
        F.col("active_base").alias("Active Base"),
        F.col("partner_status").alias("Status"),
        money(F.col("lifetime_earning")).alias("Lifetime Earning"),
        money(F.col("corrected_m0_payout")).alias(f"{month_label(as_of, 0)} Payout"),
        money(F.col("corrected_m1_payout")).alias(f"{month_label(as_of, 1)} Payout"),
        F.col("ont_with_partner").alias("ONT w/ Partner"),
        F.col("ont_with_active").alias("ONT w/ Active Cust"),
        F.col("ont_with_churned").alias("ONT w/ Churned Cust"),
    )


def earnings_breakdown(card: DataFrame, disbursements: DataFrame, as_of: AsOf) -> DataFrame:
    """Earnings by component for M2..M0, with the three-month mean and the lifetime sum.

    The shown fixed payout falls back when the card has no positive value; the total is
    corrected only when the card has exactly 0.
    """
    joined = card.join(fixed_paid_wide(disbursements, as_of), "partner_id", "left")

    def fixed(back: int) -> Column:
        return F.when(_card_fixed(back) > 0, _card_fixed(back)).otherwise(_paid(back))

    def fell_back(back: int) -> Column:
        return (_card_fixed(back) == 0) & (_paid(back) > 0)

    def bonus(back: int, kind: str) -> Column:
        return or_zero(F.col(f"m{back}_{kind}_bonus_payout"))

    three = _corrected_total(0) + _corrected_total(1) + _corrected_total(2)
    note = F.concat_ws(" · ", *[F.when(fell_back(k), F.lit(month_label(as_of, k))) for k in (2, 1, 0)])
    per_partner = {
        "avg_3m": three.cast("double") / F.lit(3.0),
        "lifetime_earning": or_zero(F.col("lifetime_earning")),
        "lottery_earning": F.col("partner_lottery_earning"),
        "disbursed_months": note,
    }
    return stack_months(
        joined,
        ["partner_id"],
        [
            {
                "month_off": F.lit(k),
                "month_label": F.lit(month_label(as_of, k)),
                "fixed_payout": fixed(k),
                "rating_bonus": bonus(k, "rating"),
                "service_sla_bonus": bonus(k, "service_sla"),
                "device_sla_bonus": bonus(k, "device_sla"),
                "total_payout": _corrected_total(k),
                "rating_score": F.col(f"m{k}_rating_at_payout"),
                "renewals": or_zero(F.col(f"m{k}_rating_bonus_renewals")),
                "from_disbursement": fell_back(k),
                **per_partner,
            }
            for k in (2, 1, 0)
        ],
    )


def earnings_report(earnings: DataFrame) -> DataFrame:
    """The breakdown as display text."""
    return earnings.select(
        "partner_id",
        F.col("month_label").alias("Month"),
        money(F.col("fixed_payout")).alias("Fixed Payout"),
        money(F.col("rating_bonus")).alias("Rating Bonus"),
        money(F.col("service_sla_bonus")).alias("Service SLA Bonus"),
        money(F.col("device_sla_bonus")).alias("Device SLA Bonus"),
        money(F.col("total_payout")).alias("Total Payout"),
        F.format_number(F.col("rating_score"), 2).alias("Rating Score"),
        F.col("renewals").alias("Renewals"),
    )
