"""Ticket counts, resolution rates and the order in which their sources are trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fibrelens.functions.shapes import stack_months
from fibrelens.functions.times import AsOf, month_label, month_start, ts_lit, within
from fibrelens.functions.values import or_zero, percent

# Fixed values of the event log.
CREATED = "TICKET_CREATED"
RESOLUTIONS = ("TICKET_RESOLVED", "TICKET_CLOSED", "ROUTER_RECOVERED", "CUSTOMER_RECOVERED")
SERVICE = "SERVICE"
DEVICE = "ROUTER_PICKUP"

_KINDS = (("service", SERVICE), ("device", DEVICE))


def _created(ticket_events: DataFrame, start: AsOf, end: AsOf | None) -> DataFrame:
    rows = ticket_events.filter(F.col("partner_id").isNotNull() & (F.col("event_name") == CREATED))
    return within(rows, "added_time", start, end)


def _resolutions(ticket_events: DataFrame, end: AsOf | None, tasks: DataFrame) -> DataFrame:
    """Resolution events of ``tasks``; those of all other tasks go before anything is aggregated."""
    rows = ticket_events.filter(F.col("event_name").isin(*RESOLUTIONS) & F.col("task_id").isNotNull())
    return within(rows, "added_time", None, end).join(tasks, "task_id", "left_semi")


def ticket_counts(
    ticket_events: DataFrame, start: AsOf, end: AsOf | None = None, partners: DataFrame | None = None
) -> DataFrame:
    """Tasks created in [start, end) per partner, service and router pick-up side by side.

    Tasks are made distinct first, keyed by the task as well, so a large partner is spread
    over many tasks. ``partners`` without tickets get zeros.
    """
    tasks = _created(ticket_events, start, end).select("partner_id", "type", "task_id").distinct()
    has_id = F.col("task_id").isNotNull()
    counts = tasks.groupBy("partner_id").agg(
        F.count_if((F.col("type") == SERVICE) & has_id).alias("service_tickets"),
        F.count_if((F.col("type") == DEVICE) & has_id).alias("router_pickup_tickets"),
    )
    if partners is None:
        return counts
    return (
        partners.select("partner_id")
        .distinct()
        .join(counts, "partner_id", "left")
        .fillna(0, ["service_tickets", "router_pickup_tickets"])
    )


def ticket_counts_mtd(ticket_events: DataFrame, as_of: AsOf, partners: DataFrame | None = None) -> DataFrame:
    """Tasks created since the first of the month."""
    return ticket_counts(ticket_events, month_start(as_of), None, partners)


def ticket_sla(ticket_events: DataFrame, start: AsOf, end: AsOf | None = None) -> DataFrame:
    """Created and resolved tasks per partner and type.

    A task counts as met when any resolution event of it lies before ``end``, whoever made
    it and however early. Escalation is no resolution.
    """
    tasks = _created(ticket_events, start, end).select("partner_id", "type", "task_id").distinct()
    resolved = _resolutions(ticket_events, end, tasks).select("task_id").distinct().withColumn("_met", F.lit(True))
    return (
        tasks.join(resolved, "task_id", "left")
        .groupBy("partner_id", "type")
        .agg(
            F.count("task_id").alias("total_tickets"),
            F.count_if(F.col("_met")).alias("sla_met"),
        )
    )


def live_tickets(ticket_events: DataFrame, as_of: AsOf, partners: DataFrame | None = None) -> DataFrame:
    """Created and met tasks of M1 and M0, both kinds, one row per partner (of ``partners``).

    One pass serves both windows: the first resolution time of a task tells whether it was
    met before the end of M1 and whether it was met at all.
    """
    m0, m1 = month_start(as_of), month_start(as_of, 1)
    in_m0 = F.col("added_time") >= ts_lit(m0)
    created = _created(ticket_events, m1, None)
    if partners is not None:
        created = created.join(partners, "partner_id", "left_semi")
    tasks = (
        created.filter(F.col("task_id").isNotNull())
        .select("partner_id", "type", "task_id", F.when(in_m0, 0).otherwise(1).alias("month_off"))
        .distinct()
    )
    resolved = _resolutions(ticket_events, None, tasks).groupBy("task_id").agg(F.min("added_time").alias("_first"))
    met = {0: F.col("_first").isNotNull(), 1: F.col("_first") < ts_lit(m0)}
    measures = []
    for kind, code in _KINDS:
        for back in (0, 1):
            mine = (F.col("type") == code) & (F.col("month_off") == back)
            measures.append(F.count_if(mine).alias(f"{kind}_total_m{back}"))
            measures.append(F.count_if(mine & met[back]).alias(f"{kind}_met_m{back}"))
    return tasks.join(resolved, "task_id", "left").groupBy("partner_id").agg(*measures)


def _first_filled(slots: list[tuple[Column, Column, str]]) -> Column:
    """(pct, label) of the first slot with any tickets."""
    filled = [
        F.when(total > 0, F.struct(percent(met, total).alias("pct"), F.lit(label).alias("label")))
        for total, met, label in slots
    ]
    return F.coalesce(*filled)


def _running_label(as_of: AsOf) -> str:
    return f"{month_label(as_of)} MTD"


def best_sla(card: DataFrame, scores: DataFrame, as_of: AsOf) -> DataFrame:
    """Resolution rate per kind from the best stored month.

    Months are tried as M1, M0, M2, M3, the card before the scores in each (the scores have
    no M0). Both inputs hold one row per partner.
    """
    labels = {k: month_label(as_of, k) for k in (1, 2, 3)} | {0: _running_label(as_of)}
    joined = card.alias("c").join(scores.alias("s"), "partner_id", "left")

    def slots(kind: str) -> list[tuple[Column, Column, str]]:
        order = [("c", 1), ("s", 1), ("c", 0), ("c", 2), ("s", 2), ("c", 3), ("s", 3)]
        return [
            (
                F.col(f"{source}.{kind}_ticket_m{back}"),
                or_zero(F.col(f"{source}.{kind}_ticket_sla_m{back}")),
                labels[back],
            )
            for source, back in order
        ]

    picked = joined.select("partner_id", *[_first_filled(slots(kind)).alias(kind) for kind, _ in _KINDS])
    return picked.select(
        "partner_id",
        *[
            F.col(f"{kind}.{field}").alias(f"{kind}_sla_{field}")
            for kind, _ in _KINDS
            for field in ("pct", "label")
        ],
    )


def live_sla_override(best: DataFrame, live: DataFrame, as_of: AsOf) -> DataFrame:
    """``best_sla`` with live M0, then live M1, taking precedence wherever they have tickets.

    ``sla_stale`` marks partners with a rate from M2 or M3, ``sla_running`` others with a
    rate of the running month.
    """
    joined = best.join(live, "partner_id", "left")

    def settled(kind: str) -> Column:
        live_slots = [
            (F.col(f"{kind}_total_m0"), F.col(f"{kind}_met_m0"), _running_label(as_of)),
            (F.col(f"{kind}_total_m1"), F.col(f"{kind}_met_m1"), month_label(as_of, 1)),
        ]
        stored = F.struct(F.col(f"{kind}_sla_pct").alias("pct"), F.col(f"{kind}_sla_label").alias("label"))
        return F.coalesce(_first_filled(live_slots), stored)

    picked = joined.select("partner_id", *[settled(kind).alias(kind) for kind, _ in _KINDS])

    def any_label(*labels: str) -> Column:
        hits = [F.coalesce(F.col(f"{kind}.label").isin(*labels), F.lit(False)) for kind, _ in _KINDS]
        return hits[0] | hits[1]

    stale = any_label(month_label(as_of, 2), month_label(as_of, 3))
    return picked.select(
        "partner_id",
        *[
            F.col(f"{kind}.{field}").alias(f"{kind}_sla_{field}")
            for kind, _ in _KINDS
            for field in ("pct", "label")
        ],
        stale.alias("sla_stale"),
        (~stale & any_label(_running_label(as_of))).alias("sla_running"),
    )


def ticket_series(card: DataFrame, live: DataFrame, as_of: AsOf) -> DataFrame:
    """Tickets and met tickets of M2..M0 per kind.

    M1 and M0 are filled from the live log only when the card has neither service nor
    device tickets for that month and the log has some; ``from_live`` marks them.
    """
    joined = card.join(live, "partner_id", "left")

    def tickets(kind: str, back: int) -> Column:
        return or_zero(F.col(f"{kind}_ticket_m{back}"))

    def met(kind: str, back: int) -> Column:
        return or_zero(F.col(f"{kind}_ticket_sla_m{back}"))

    def live_total(kind: str, back: int) -> Column:
        return or_zero(F.col(f"{kind}_total_m{back}"))

    def filled(back: int) -> Column:
        if back == 2:
            return F.lit(False)
        empty = (tickets("service", back) == 0) & (tickets("device", back) == 0)
        return empty & ((live_total("service", back) > 0) | (live_total("device", back) > 0))

    def either(back: int, live_value: Column, stored: Column) -> Column:
        return stored if back == 2 else F.when(filled(back), live_value).otherwise(stored)

    def row(back: int) -> dict[str, Column]:
        out = {"month_off": F.lit(back), "month_label": F.lit(month_label(as_of, back))}
        for kind, _ in _KINDS:
            out[f"{kind}_tickets"] = either(back, live_total(kind, back), tickets(kind, back))
            out[f"{kind}_met"] = either(back, or_zero(F.col(f"{kind}_met_m{min(back, 1)}")), met(kind, back))
        out["from_live"] = filled(back)
        return out

    return stack_months(joined, ["partner_id"], [row(k) for k in (2, 1, 0)])
