"""The logical tables as views over the star-schema test tables.

Suppliers play partners, order keys play customer mobiles, line items play plan rows.
``testbed_sql`` states the same mapping for the DuckDB side of the check.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fibrelens.operators.calendar import month_offset
from fibrelens.sources.tables import conform

AS_OF = "2001-07-15 10:30:00"
# The event log starts on 2024-01-01; moved back by this it ends on the day of AS_OF.
EVENT_SHIFT_DAYS = 8234
ZONES = ("AFRICA", "AMERICA", "ASIA", "EUROPE")
# Partners of the queries over a few partners.
FEW = (3, 7)
# Days on which the tables arrive, for the kept state.
LOADS = (date(2001, 7, 13), date(2001, 7, 14), date(2001, 7, 15))
OLD_LEDGER_END = "2001-04-01"
NEW_LEDGER_START = "2001-01-01"


class Testbed:
    """Lazy logical tables over one scale-factor folder."""

    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    def __getitem__(self, name: str) -> DataFrame:
        return conform(_VIEWS[name](self), name)

    def __iter__(self):
        return iter(_VIEWS)

    def keys(self):
        return _VIEWS.keys()

    def landing(self) -> dict[str, DataFrame]:
        """The logical tables as they arrive in three loads; rows of any time may come in any load."""
        arrived = {}
        for name in _VIEWS:
            table = self[name]
            day = F.lit(LOADS[0]) + F.pmod(F.xxhash64(*table.columns), F.lit(len(LOADS))).cast("int")
            arrived[name] = table.withColumn("load_day", day)
        return arrived

    def cities(self) -> DataFrame:
        """Every nation, and a listed city that has no partner yet."""
        nations = self.raw("nation").select(
            F.replace(F.col("n_name"), F.lit("_"), F.lit(" ")).alias("label"), F.col("n_name").alias("funnel")
        )
        return nations.union(nations.limit(1).select(F.lit("NEWTOWN").alias("label"), F.lit("NEWTOWN").alias("funnel")))

    def events(self) -> DataFrame:
        e = self.raw("events")
        return e.select(
            F.col("user_id"),
            F.col("event_type"),
            F.col("value"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
            F.timestamp_add("DAY", F.lit(-EVENT_SHIFT_DAYS), F.col("ts")).alias("at"),
        )


def _flag(value: str) -> Column:
    return F.col("l_returnflag") == value


def _status(value: str) -> Column:
    return F.col("l_linestatus") == value


def _money(name: str) -> Column:
    return F.col(name).cast("decimal(18,2)")


def _hours(moment: str, hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours, F.col(moment))


def _roster(t: Testbed) -> DataFrame:
    s, n = t.raw("supplier"), t.raw("nation")
    padded = F.concat(F.col("n_name"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("  ")).otherwise(F.lit("")))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("partner_id"), F.col("s_name").alias("partner_name"), padded.alias("partner_city")
    )


def _plans(t: Testbed) -> DataFrame:
    line = F.col("l_linenumber")
    seconds = F.col("l_quantity").cast("bigint") * 86400 + line * 7200
    return t.raw("lineitem").select(
        F.col("l_suppkey").alias("partner_id"),
        F.col("l_orderkey").cast("string").alias("mobile"),
        F.col("l_partkey").alias("nas_id"),
        F.when(~_flag("R"), F.concat(F.lit("D"), F.col("l_partkey").cast("string"))).alias("device_id"),
        F.col("l_orderkey").alias("account_id"),
        F.when(F.col("l_orderkey") % 97 != 0, F.col("l_shipdate")).alias("plan_start_time"),
        seconds.alias("time_plan"),
        F.when(line == 7, F.lit(0)).otherwise(_money("l_extendedprice")).alias("charges"),
        F.when(line != 3, (line * 50).cast("string")).alias("speed_mbps"),
    )


def _devices(t: Testbed) -> DataFrame:
    line = F.col("l_linenumber")
    location = (
        F.when(_flag("R"), "partner").when(_flag("N") & (line == 1), "warehouse").otherwise("customer")
    )
    return t.raw("lineitem").select(
        F.when(line != 7, F.col("l_suppkey")).alias("partner_id"),
        F.col("l_orderkey").cast("string").alias("customer_id"),
        F.concat(F.lit("D"), F.col("l_partkey").cast("string")).alias("device_id"),
        location.alias("location"),
        F.when(_status("F"), F.col("l_shipdate").cast("date")).alias("user_churn_date"),
    )


def _bookings(t: Testbed) -> DataFrame:
    line = F.col("l_linenumber")
    joined = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("l_orderkey").cast("string").alias("mobile"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"), F.lit("/"), line.cast("string"))).alias("name"),
        F.col("l_suppkey").alias("partner_id"),
        _hours("o_orderdate", line * 3).alias("added_time"),
        F.when(line == 7, True).when(line < 6, False).alias("is_deleted"),
    )


def _booking_events(t: Testbed) -> DataFrame:
    line = F.col("l_linenumber")
    home = F.when(line == 2, F.lit("")).otherwise(F.concat(F.lit("House "), F.col("l_partkey").cast("string")))
    city = F.concat(F.lit("City "), F.col("l_suppkey").cast("string"))
    inner = F.concat(F.lit('{\\"home\\":\\"'), home, F.lit('\\",\\"city\\":\\"'), city, F.lit('\\"}'))
    data = F.when(line == 5, F.lit("not json")).otherwise(F.concat(F.lit('{"address":"'), inner, F.lit('"}')))
    return t.raw("lineitem").select(
        F.col("l_orderkey").cast("string").alias("mobile"),
        F.when(_status("O"), "address_updated").otherwise("slot_booked").alias("event_name"),
        data.alias("data"),
        F.col("l_shipdate").alias("added_time"),
    )


def _task_events(t: Testbed) -> DataFrame:
    return t.raw("orders").select(
        F.col("o_orderkey").cast("string").alias("mobile"),
        F.when(F.col("o_orderstatus") == "F", "OTP_VERIFIED").otherwise("SCHEDULED").alias("event_name"),
        _hours("o_orderdate", F.lit(20)).alias("added_time"),
    )


def _daily_usage(t: Testbed) -> DataFrame:
    return t.events().select(F.col("user_id").alias("nas_id"), F.col("at").cast("date").alias("added_date"))


def _optical(t: Testbed) -> DataFrame:
    value = F.col("value")
    return t.events().select(
        F.col("user_id").alias("nas_id"),
        F.when(F.col("event_type") != "error", -value).alias("avg_optical_dbm"),
        F.when(value < 20, "Good").when(value < 60, "Fair").alias("optical_health"),
        F.col("at").cast("date").alias("date_ist"),
    )


def _speed(t: Testbed) -> DataFrame:
    return t.events().select(
        F.concat(F.lit("D"), F.col("user_id").cast("string")).alias("device_id"),
        F.col("value").alias("speed"),
        F.col("k").cast("double").alias("latency"),
        (F.col("k") / 4.0).alias("jitter"),
        F.col("at").alias("tested_on"),
    )


def _no_recent_tickets(partner: Column) -> Column:
    """Partners whose newest tickets are two or three months old (these: every ninth)."""
    return (partner % 6 == 0) | (partner % 9 == 0)


def _ticket_events(t: Testbed) -> DataFrame:
    k = F.col("k")
    slot = F.floor(F.hour("at") / 6).cast("int").cast("string")
    name = (
        F.when(F.col("event_type") == "signup", "TICKET_CREATED")
        .when(F.col("event_type") == "purchase", "TICKET_RESOLVED")
        .when(F.col("event_type") == "click", "TICKET_CLOSED")
        .when(F.col("event_type") == "error", "ESCALATED")
        .otherwise("VIEWED")
    )
    return t.events().select(
        F.concat_ws("-", k.cast("string"), F.col("at").cast("date").cast("string"), slot).alias("task_id"),
        F.when(k < 45, "SERVICE").when(k < 90, "ROUTER_PICKUP").otherwise("OTHER").alias("type"),
        name.alias("event_name"),
        F.col("at").alias("added_time"),
        (F.col("user_id") + F.when(_no_recent_tickets(F.col("user_id")), 1_000_000).otherwise(0)).alias("partner_id"),
    )


def _ticket_daily(t: Testbed) -> DataFrame:
    return (
        t.events()
        .groupBy(F.col("user_id").alias("partner_id"), F.col("at").cast("date").alias("tkt_dt"))
        .agg(
            F.count(F.lit(1)).alias("total_tickets"),
            F.count_if(F.col("event_type") == "click").alias("resolved_tickets"),
        )
    )


def _disbursements(t: Testbed) -> DataFrame:
    line = F.col("l_linenumber")
    return t.raw("lineitem").select(
        F.col("l_suppkey").alias("partner_id"),
        _money("l_extendedprice").alias("amount"),
        F.when(_flag("R"), 5).otherwise(3).alias("bonus_status"),
        F.col("l_shipdate").alias("added_time"),
        F.when(line == 7, True).when(line < 6, False).alias("is_deleted"),
    )


def _growth_card(t: Testbed) -> DataFrame:
    price = _money("l_extendedprice")
    partner = F.col("partner_id")
    small = _flag("N") & (F.col("l_quantity") <= 25)

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, price))

    measures = {
        "fixed_bonus": total(_flag("R")),
        "claim_rating_bonus": total(_flag("A")),
        "claim_work_bonus": total(_flag("N") & _status("O")),
        "claim_device_bonus": total(_flag("N") & _status("F")),
        "installs": F.count_if(_status("O")),
        "notifs": F.count_if(_flag("N")),
        "intersts": F.count_if(_flag("A")),
        "total_renewals": F.count_if(_flag("R")),
        "active_customer_15d": F.count_if(_status("F")),
        "service_ticket": F.count_if(_flag("A")),
        "service_ticket_sla": F.count_if(_flag("A") & _status("O")),
        "device_ticket": F.count_if(small),
        "device_ticket_sla": F.count_if(small & _status("F")),
        "lost_customers": F.count_if(F.col("l_discount") > 0.085),
    }
    # One row per partner and month (all other months together) before the months go side by side.
    off = month_offset(F.col("l_shipdate"), AS_OF)
    monthly = (
        t.raw("lineitem")
        .groupBy(F.col("l_suppkey").alias("partner_id"), F.when(off.between(0, 3), off).alias("_off"))
        .agg(
            F.sum(price).alias("_earned"),
            F.count(F.lit(1)).alias("_rows"),
            *[c.alias(n) for n, c in measures.items()],
        )
    )
    wide = {"life_time_earning": F.sum("_earned"), "active_customer": F.sum("_rows")}
    for name in measures:
        for b in range(3 if name.endswith("_bonus") or name in ("installs", "notifs", "intersts", "total_renewals") else 4):
            value = F.max(F.when(F.col("_off") == b, F.col(name)))
            wide[f"{name}_m{b}"] = value if name.endswith("_bonus") else F.coalesce(value, F.lit(0))
    card = monthly.groupBy("partner_id").agg(*[c.alias(n) for n, c in wide.items()])

    changed = {}
    for b in range(3):
        stored = F.col(f"fixed_bonus_m{b}")
        changed[f"fixed_bonus_m{b}"] = (
            F.when(partner % 4 == 0, F.lit(0)).when(partner % 8 == 2, -stored).when(partner % 4 != 1, stored)
        ).cast("decimal(18,2)")
    for b in range(2):
        for kind in ("service_ticket", "service_ticket_sla", "device_ticket", "device_ticket_sla"):
            stored = F.col(f"{kind}_m{b}")
            changed[f"{kind}_m{b}"] = F.when(partner % 3 == 0, F.lit(0)).otherwise(stored)
    for kind in ("service_ticket", "service_ticket_sla", "device_ticket", "device_ticket_sla"):
        changed[f"{kind}_m2"] = F.when(partner % 9 == 0, F.lit(0)).otherwise(F.col(f"{kind}_m2"))
    for b in range(4):
        stored = F.col(f"lost_customers_m{b}")
        changed[f"lost_customers_m{b}"] = F.when(partner % 2 == 0, F.lit(0)).otherwise(stored)
    card = card.withColumns(changed)

    s, n, r = t.raw("supplier"), t.raw("nation"), t.raw("region")
    dims = (
        s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("partner_id"),
            F.when(F.col("s_suppkey") % 13 != 5, F.col("s_name")).alias("partner_name"),
            F.col("r_name").alias("zone"),
            F.when(F.col("s_acctbal") > 5000, "ACTIVE").otherwise("DORMANT").alias("partner_status"),
        )
    )
    return card.join(dims, "partner_id")


def _partner_scores(t: Testbed) -> DataFrame:
    li = t.raw("lineitem").withColumn("_off", month_offset(F.col("l_shipdate"), AS_OF))
    measures = {
        "service_rating": F.avg("l_quantity") / 10.0,
        "avg_install_rating": F.avg(F.col("l_linenumber").cast("double")),
    }
    for b in (1, 2, 3):
        month = F.col("_off") == b
        if b == 1:
            month = month & ~_no_recent_tickets(F.col("l_suppkey"))
        if b == 2:
            month = month & (F.col("l_suppkey") % 9 != 0)
        measures[f"service_ticket_m{b}"] = F.count_if(month & _status("F"))
        measures[f"service_ticket_sla_m{b}"] = F.count_if(month & _status("F") & _flag("R"))
        measures[f"device_ticket_m{b}"] = F.count_if(month & _status("O"))
        measures[f"device_ticket_sla_m{b}"] = F.count_if(month & _status("O") & _flag("A"))
    return li.groupBy(F.col("l_suppkey").alias("partner_id")).agg(*[c.alias(n) for n, c in measures.items()])


def _ledger_parts(t: Testbed) -> tuple[DataFrame, dict[str, Column]]:
    price = _money("o_totalprice")
    delta = F.when(F.col("o_orderstatus") == "F", -price).when(F.col("o_orderstatus") == "O", price).otherwise(F.lit(0))
    return t.raw("orders"), {
        "partner_id": F.col("o_custkey") % 10,
        "action": F.col("o_orderstatus"),
        "remark": F.concat_ws(" ", F.col("o_orderpriority"), F.lit("order"), F.col("o_orderkey").cast("string")),
        "delta": delta.cast("decimal(18,2)"),
        "balance": price,
    }


def _ledger_old(t: Testbed) -> DataFrame:
    orders, c = _ledger_parts(t)
    return orders.filter(F.col("o_orderdate") < F.lit(OLD_LEDGER_END).cast("timestamp_ntz")).select(
        c["partner_id"].alias("partner_id"),
        c["action"].alias("action"),
        c["remark"].alias("remark"),
        c["delta"].alias("credit_delta"),
        c["balance"].alias("balance"),
        F.col("o_orderdate").alias("added_at_ist"),
    )


def _ledger_new(t: Testbed) -> DataFrame:
    orders, c = _ledger_parts(t)
    return orders.filter(F.col("o_orderdate") >= F.lit(NEW_LEDGER_START).cast("timestamp_ntz")).select(
        c["partner_id"].alias("partner_id"),
        c["action"].alias("action"),
        c["remark"].alias("remark"),
        (c["balance"] - c["delta"]).alias("old_balance"),
        c["balance"].alias("balance"),
        _hours("o_orderdate", F.lit(19)).alias("added_time"),
    )


_VIEWS: dict[str, Callable[[Testbed], DataFrame]] = {
    "growth_card": _growth_card,
    "partner_scores": _partner_scores,
    "ticket_events": _ticket_events,
    "plans": _plans,
    "devices": _devices,
    "bookings": _bookings,
    "booking_events": _booking_events,
    "daily_usage": _daily_usage,
    "task_events": _task_events,
    "optical_readings": _optical,
    "speed_tests": _speed,
    "disbursements": _disbursements,
    "ledger_old": _ledger_old,
    "ledger_new": _ledger_new,
    "roster": _roster,
    "ticket_daily": _ticket_daily,
}
