"""City launch figures: active base, daily leads and installs, partner scorecard.

The roster says which partners belong to a city. Plan rows are first reduced per (partner,
mobile), with a partial step in the map tasks, then get their city by a plain join, then are
reduced per (city, mobile): the mobile stays in every key until there is one row per customer,
so a large partner or city is spread over many tasks, and the join by partner stands between two
shuffles on other keys, where Spark may split a hot partner at run time. The plan has this shape
whatever the size of the roster (a semi-join before the reduction would tie it to the partner
alone), and no job runs while it is built. The mobile also comes first in the keys, since
sorts compare the first key cheaply and it tells most rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fibrelens.functions.picks import newest, oldest, packed, unpacked
from fibrelens.functions.times import AsOf, add_seconds, date_lit, day_gap, days_before, shift_minutes, ts_lit, within
from fibrelens.functions.values import or_zero, percent, whole_percent

GRACE_DAYS = 15
WINDOW_DAYS = 30
LEAD_OFFSET_MIN = 330


def city_roster(roster: DataFrame, cities: DataFrame) -> DataFrame:
    """Distinct (city, partner, name) of the listed cities; ``cities`` maps label to spelling."""
    spelled = roster.withColumn("funnel", F.trim("partner_city"))
    return (
        spelled.join(cities, "funnel")
        .select(F.col("label").alias("city"), "partner_id", "partner_name")
        .distinct()
    )


class _Members:
    """The (city, partner) pairs of a roster."""

    def __init__(self, roster: DataFrame):
        self.pairs = roster.select("city", "partner_id").distinct()

    def attach_city(self, df: DataFrame) -> DataFrame:
        return df.join(self.pairs, "partner_id")


def with_city(per_partner: DataFrame, roster: DataFrame) -> DataFrame:
    """Rows per partner beside the partner's cities."""
    return _Members(roster).attach_city(per_partner)


def _expiry(tz_offset_min: int) -> Column:
    return shift_minutes(add_seconds(F.col("plan_start_time"), F.col("time_plan")), tz_offset_min)


def plan_rollup(plans: DataFrame, roster: DataFrame, tz_offset_min: int = 0) -> DataFrame:
    """Per (city, partner, mobile): plan count, first start, last plan and latest expiry.

    All city figures follow from it, so that a report reads the plan rows once. Every state of the
    aggregation has a fixed width (the last plan is a packed pair), so raw rows are hashed, not
    sorted.
    """
    members = _Members(roster)
    per_partner = (
        plans
        .groupBy("mobile", "partner_id")
        .agg(
            F.count(F.lit(1)).alias("recharge_count"),
            F.min("plan_start_time").alias("first_start"),
            F.max(packed(F.col("plan_start_time"), F.col("time_plan"))).alias("_packed"),
            F.max(_expiry(tz_offset_min)).alias("latest_expiry"),
        )
    )
    start, seconds = unpacked(F.col("_packed"), plans.schema["plan_start_time"].dataType)
    last = F.struct(start.alias("start"), shift_minutes(add_seconds(start, seconds), tz_offset_min).alias("expiry"))
    return members.attach_city(per_partner.withColumn("_last", last).drop("_packed"))


def _still_active(expiry: Column, as_of: AsOf) -> Column:
    return expiry >= ts_lit(days_before(as_of, GRACE_DAYS))


def _listed(roster: DataFrame, cities: DataFrame | None) -> DataFrame:
    """The cities that get a row: all listed ones, or those of the roster."""
    return (roster.select("city") if cities is None else cities.select(F.col("label").alias("city"))).distinct()


def _count_active(city_mobiles: DataFrame, roster: DataFrame, cities: DataFrame | None) -> DataFrame:
    counts = city_mobiles.select("mobile", "city").distinct().groupBy("city").agg(F.count("mobile").alias("active_base"))
    return _listed(roster, cities).join(counts, "city", "left").fillna(0, ["active_base"])


def city_partner_counts(roster: DataFrame, cities: DataFrame | None = None) -> DataFrame:
    """Partners per city; listed cities without any show 0."""
    counts = roster.select("city", "partner_id").distinct().groupBy("city").agg(F.count("partner_id").alias("partners"))
    return _listed(roster, cities).join(counts, "city", "left").fillna(0, ["partners"])


def city_active_base(
    plans: DataFrame, roster: DataFrame, as_of: AsOf, tz_offset_min: int = 0, cities: DataFrame | None = None
) -> DataFrame:
    """Customers per city whose latest expiry lies ahead or at most 15 days back.

    A later expiry never makes a customer less active, so it is enough to look for any plan
    that qualifies: old plans go before the shuffle. Cities without any show 0; with ``cities``
    that holds for listed cities without partners too.
    """
    members = _Members(roster)
    alive = plans.filter(F.col("mobile").isNotNull() & _still_active(_expiry(tz_offset_min), as_of))
    pairs = alive.select("mobile", "partner_id").distinct()
    return _count_active(members.attach_city(pairs), roster, cities)


def active_base_from_rollup(
    rollup: DataFrame, roster: DataFrame, as_of: AsOf, cities: DataFrame | None = None
) -> DataFrame:
    """``city_active_base`` out of a ``plan_rollup``."""
    return _count_active(rollup.filter(_still_active(F.col("latest_expiry"), as_of)), roster, cities)


def daily_leads_installs(
    plans: DataFrame,
    bookings: DataFrame,
    roster: DataFrame,
    as_of: AsOf,
    install_offset_min: int = 0,
    lead_offset_min: int = LEAD_OFFSET_MIN,
) -> DataFrame:
    """Installs (first plan ever in the city) and leads per city and day since 30 days ago.

    Installs go by the day as stored, leads by the local day. Both kinds are reduced to one
    row per customer first and then counted together, so days of either kind appear.
    """
    members = _Members(roster)
    starts = plans.groupBy("mobile", "partner_id").agg(F.min("plan_start_time").alias("first_start"))
    return _daily(members.attach_city(starts), members, bookings, as_of, install_offset_min, lead_offset_min)


def daily_from_rollup(
    rollup: DataFrame,
    bookings: DataFrame,
    roster: DataFrame,
    as_of: AsOf,
    install_offset_min: int = 0,
    lead_offset_min: int = LEAD_OFFSET_MIN,
) -> DataFrame:
    """``daily_leads_installs`` out of a ``plan_rollup``."""
    return _daily(rollup, _Members(roster), bookings, as_of, install_offset_min, lead_offset_min)


def _daily(
    first_starts: DataFrame,
    members: _Members,
    bookings: DataFrame,
    as_of: AsOf,
    install_offset_min: int,
    lead_offset_min: int,
) -> DataFrame:
    since = days_before(as_of, WINDOW_DAYS)
    installs = (
        first_starts.groupBy("mobile", "city")
        .agg(F.min("first_start").alias("_first"))
        .filter(F.col("_first") >= ts_lit(since))
        .select(
            "city",
            shift_minutes(F.col("_first"), install_offset_min).cast("date").alias("day"),
            F.col("mobile").alias("_install"),
            F.lit(None).cast("string").alias("_lead"),
        )
    )
    local_day = shift_minutes(F.col("added_time"), lead_offset_min).cast("date")
    asked = (
        within(bookings, "added_time", since)
        .select("mobile", "partner_id", local_day.alias("day"))
        .distinct()
    )
    leads = (
        members.attach_city(asked)
        .select(F.col("mobile").alias("_lead"), "city", "day", F.lit(None).cast("string").alias("_install"))
        .distinct()
    )
    return (
        installs.unionByName(leads)
        .groupBy("city", "day")
        .agg(F.count("_install").alias("installs"), F.count("_lead").alias("leads"))
        .orderBy("city", "day")
    )


def leads_installs_totals(daily: DataFrame) -> DataFrame:
    """Sums over the days, per city."""
    return daily.groupBy("city").agg(F.sum("leads").alias("total_leads"), F.sum("installs").alias("total_installs"))


def recharge_counts(plans: DataFrame, roster: DataFrame) -> DataFrame:
    """Number of plan rows per city, partner and mobile."""
    members = _Members(roster)
    counts = plans.groupBy("mobile", "partner_id").agg(F.count(F.lit(1)).alias("recharge_count"))
    return members.attach_city(counts).select("city", "partner_id", "mobile", "recharge_count")


def _known_mobiles(rollup: DataFrame) -> DataFrame:
    return rollup.filter(F.col("mobile").isNotNull())


def _first_in_city() -> Column:
    return oldest(F.col("first_start"), F.col("partner_id"))


def _last_in_city() -> Column:
    return newest(F.col("_last.start").alias("start"), F.col("_last.expiry").alias("expiry"), F.col("partner_id"))


def first_last_plan(plans: DataFrame, roster: DataFrame, tz_offset_min: int = 0) -> DataFrame:
    """First and last plan per (city, mobile), whichever partners of the city sold them."""
    return (
        _known_mobiles(plan_rollup(plans, roster, tz_offset_min))
        .groupBy("mobile", "city")
        .agg(_first_in_city().alias("_f"), _last_in_city().alias("_l"))
        .select(
            "city",
            "mobile",
            F.col("_f.partner_id").alias("first_partner_id"),
            F.col("_f.first_start").alias("first_start"),
            F.col("_l.partner_id").alias("last_partner_id"),
            F.col("_l.start").alias("last_start"),
            F.col("_l.expiry").alias("last_expiry"),
        )
    )


def mobile_summary(plans: DataFrame, roster: DataFrame, tz_offset_min: int = 0) -> DataFrame:
    """First and last plan per (city, mobile) beside the recharge count at each partner.

    A mobile served by several partners of the city has a row per partner's count, all
    attributed to the first partner. The window holds one row per partner of a mobile.
    """
    one_mobile = Window.partitionBy("mobile", "city")
    return (
        _known_mobiles(plan_rollup(plans, roster, tz_offset_min))
        .withColumn("_f", _first_in_city().over(one_mobile))
        .withColumn("_l", _last_in_city().over(one_mobile))
        .select(
            "city",
            F.col("_f.partner_id").alias("partner_id"),
            "mobile",
            F.col("_f.first_start").alias("first_start"),
            F.col("_l.start").alias("last_start"),
            F.col("_l.expiry").alias("last_expiry"),
            "recharge_count",
        )
    )


def tickets_30d(ticket_daily: DataFrame, roster: DataFrame, as_of: AsOf) -> DataFrame:
    """Tickets and resolved tickets of roster partners since 30 days ago."""
    recent = within(ticket_daily, "tkt_dt", days_before(as_of, WINDOW_DAYS))
    return (
        recent.groupBy("partner_id")
        .agg(F.sum("total_tickets").alias("tickets_1m"), F.sum("resolved_tickets").alias("resolved_1m"))
        .join(roster.select("partner_id").distinct(), "partner_id", "left_semi")
    )


_METRICS = ("total_gross", "active", "live", "r30_plus", "m1_expired", "m1_renewed")


def _partner_metrics(rollup: DataFrame, as_of: AsOf, recharge_scope: str) -> DataFrame:
    """The six customer counts per (city, first partner).

    There is one row per (city, mobile) before counting, so plain counts are distinct ones.
    """
    count = F.col("recharge_count")
    if recharge_scope == "partner":
        once, again = F.bool_or(count == 1), F.bool_or(count > 1)
    elif recharge_scope == "mobile":
        once, again = F.sum(count) == 1, F.sum(count) > 1
    else:
        raise ValueError("recharge_scope must be 'partner' or 'mobile'")

    mobiles = (
        _known_mobiles(rollup)
        .groupBy("mobile", "city")
        .agg(_first_in_city().alias("_f"), _last_in_city().alias("_l"), once.alias("once"), again.alias("again"))
    )
    now, today = ts_lit(as_of), date_lit(as_of)
    live = F.col("_l.expiry") >= now
    in_grace = day_gap(today, F.col("_l.expiry")) <= GRACE_DAYS
    settled = day_gap(today, F.col("_f.first_start")) >= WINDOW_DAYS
    return mobiles.groupBy("city", F.col("_f.partner_id").alias("partner_id")).agg(
        F.count(F.lit(1)).alias("total_gross"),
        F.count_if(live | in_grace).alias("active"),
        F.count_if(live).alias("live"),
        F.count_if(day_gap(today, F.col("_l.start")) >= WINDOW_DAYS).alias("r30_plus"),
        F.count_if(settled & F.col("once")).alias("m1_expired"),
        F.count_if(settled & F.col("again")).alias("m1_renewed"),
    )


def partner_scorecard(
    plans: DataFrame,
    roster: DataFrame,
    ticket_daily: DataFrame,
    as_of: AsOf,
    tz_offset_min: int = 0,
    recharge_scope: str = "partner",
) -> DataFrame:
    """Customer counts and 30-day tickets of every roster partner, largest first in each city.

    ``recharge_scope`` says what "recharged again" looks at: a mobile's plans at one partner
    (so a mobile with two partners can count both as expired and as renewed), or all of them.
    """
    rollup = plan_rollup(plans, roster, tz_offset_min)
    return scorecard_from_rollup(rollup, roster, ticket_daily, as_of, recharge_scope)


def scorecard_from_rollup(
    rollup: DataFrame, roster: DataFrame, ticket_daily: DataFrame, as_of: AsOf, recharge_scope: str = "partner"
) -> DataFrame:
    """``partner_scorecard`` out of a ``plan_rollup``."""
    metrics = _partner_metrics(rollup, as_of, recharge_scope)
    tickets = tickets_30d(ticket_daily, roster, as_of)
    zeros = [*_METRICS, "tickets_1m", "resolved_1m"]
    return (
        roster.join(metrics, ["city", "partner_id"], "left")
        .join(tickets, "partner_id", "left")
        .select("city", "partner_id", "partner_name", *[or_zero(F.col(c)).alias(c) for c in zeros])
        .orderBy("city", F.col("total_gross").desc(), "partner_id", "partner_name")
    )


def scorecard_ratios(scorecard: DataFrame) -> DataFrame:
    """Active share and renewal share in percent; NULL when nothing is there to divide by."""
    return scorecard.withColumns(
        {
            "active_pct": percent(F.col("active"), F.col("total_gross")),
            "m1_pct": percent(F.col("m1_renewed"), F.col("m1_expired") + F.col("m1_renewed")),
        }
    )


def scorecard_report(scorecard: DataFrame) -> DataFrame:
    """The scorecard with ratios as display text."""
    shown = scorecard_ratios(scorecard)
    return shown.select(
        "city",
        F.col("partner_name").alias("Partner"),
        F.col("total_gross").alias("Total Gross"),
        F.col("active").alias("Active"),
        whole_percent(F.col("active_pct")).alias("Active %"),
        F.col("live").alias("Live"),
        F.col("r30_plus").alias("R30+"),
        F.col("m1_expired").alias("M1 Expired"),
        F.col("m1_renewed").alias("M1 Renewed"),
        whole_percent(F.col("m1_pct")).alias("M1 %"),
        F.col("tickets_1m").alias("Tickets (30d)"),
        F.col("resolved_1m").alias("Resolved (30d)"),
    )
