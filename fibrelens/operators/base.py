"""Growth-card views: one partner's fields, active base, churn and engagement series.

The card holds one row per partner, so the monthly series are computed across its
columns and stacked; none of them shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fibrelens.functions.picks import newest
from fibrelens.functions.shapes import stack_months
from fibrelens.functions.times import AsOf, month_label
from fibrelens.functions.values import or_zero


def one_per_partner(df: DataFrame) -> DataFrame:
    """One row per partner with lower-case column names.

    Of several rows the one with the largest values in column order is kept, so that the
    choice does not depend on the order of arrival.
    """
    df = df.toDF(*[c.lower() for c in df.columns]).filter(F.col("partner_id").isNotNull())
    rest = [F.col(c) for c in df.columns if c != "partner_id"]
    return df.groupBy("partner_id").agg(newest(*rest).alias("_row")).select("partner_id", "_row.*")


def partner_detail(growth_card: DataFrame) -> DataFrame:
    """All card fields, one row per partner."""
    return one_per_partner(growth_card)


def partner_scores(scores: DataFrame, partners: DataFrame | None = None) -> DataFrame:
    """Rating and ticket history, one row per partner; NULLs for ``partners`` without scores."""
    picked = one_per_partner(scores)
    if partners is None:
        return picked
    return partners.select("partner_id").distinct().join(picked, "partner_id", "left")


def partner_names(card: DataFrame) -> DataFrame:
    """Names to choose from, sorted."""
    return card.select("partner_name").filter(F.col("partner_name").isNotNull()).orderBy("partner_name")


def find_partner(card: DataFrame, name: str) -> DataFrame:
    """The card row of an exactly matching name; the lowest partner id when several match."""
    return card.filter(F.col("partner_name") == name).orderBy("partner_id").limit(1)


def partner_fields(card: DataFrame) -> DataFrame:
    """Every field of every partner, its id among them, as (partner_id, field, value) text."""
    fields = [F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for c in card.columns]
    return card.select("partner_id", F.inline(F.array(*fields)))


def _active(back: int) -> Column:
    return or_zero(F.col(f"active_customer_15d_m{back}"))


def active_base_months(card: DataFrame, as_of: AsOf, partners: DataFrame | None = None) -> DataFrame:
    """Active base (15 days of grace) of M3..M0; zeros for ``partners`` without a card."""
    if partners is not None:
        card = partners.select("partner_id").distinct().join(card, "partner_id", "left")
    return stack_months(
        card,
        ["partner_id"],
        [
            {"month_off": F.lit(k), "month_label": F.lit(month_label(as_of, k)), "active_base": _active(k)}
            for k in (3, 2, 1, 0)
        ],
    )


def active_base_trend(card: DataFrame, as_of: AsOf) -> DataFrame:
    """Active base with the change from the month before, NULL when that month was 0."""

    def change(back: int) -> Column:
        if back == 3:
            return F.lit(None).cast("bigint")
        return F.when(_active(back + 1) != 0, _active(back) - _active(back + 1))

    return stack_months(
        card,
        ["partner_id"],
        [
            {
                "month_off": F.lit(k),
                "month_label": F.lit(month_label(as_of, k)),
                "active_base": _active(k),
                "change": change(k),
            }
            for k in (3, 2, 1, 0)
        ],
    )


def churn_estimate(card: DataFrame, as_of: AsOf) -> DataFrame:
    """Lost customers of M3..M0.

    When all four are 0 on the card, M2..M0 are estimated as installs minus the net change
    of the active base, at least 0. ``estimated`` tells that an estimate above 0 is shown.
    """

    def lost(back: int) -> Column:
        return or_zero(F.col(f"lost_customers_m{back}"))

    def implied(back: int) -> Column:
        if back == 3:
            return F.lit(0).cast("bigint")
        installs = or_zero(F.col(f"installs_m{back}"))
        return F.greatest(F.lit(0).cast("bigint"), installs - (_active(back) - _active(back + 1)))

    unfilled = (lost(0) == 0) & (lost(1) == 0) & (lost(2) == 0) & (lost(3) == 0)
    shown = unfilled & ((implied(0) > 0) | (implied(1) > 0) | (implied(2) > 0))
    return stack_months(
        card,
        ["partner_id"],
        [
            {
                "month_off": F.lit(k),
                "month_label": F.lit(month_label(as_of, k)),
                "active_base": _active(k),
                "lost_customers": F.when(unfilled, implied(k)).otherwise(lost(k)),
                "estimated": shown,
            }
            for k in (3, 2, 1, 0)
        ],
    )


def engagement_series(card: DataFrame, as_of: AsOf) -> DataFrame:
    """Installs, notifications and interests of M2..M0."""
    return stack_months(
        card,
        ["partner_id"],
        [
            {
                "month_off": F.lit(k),
                "month_label": F.lit(month_label(as_of, k)),
                "installs": or_zero(F.col(f"installs_m{k}")),
                "notifications": or_zero(F.col(f"notifs_m{k}")),
                "interests": or_zero(F.col(f"intersts_m{k}")),
            }
            for k in (2, 1, 0)
        ],
    )
