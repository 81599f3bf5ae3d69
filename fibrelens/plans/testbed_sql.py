"""The testbed mapping in DuckDB SQL, and a plain statement of what each query must return.

Written from the definitions, not from the Spark plans: ordered windows, DISTINCT ON, EXISTS
and separate joins where the Spark side aggregates once.
"""

from __future__ import annotations

import re

from fibrelens.plans.testbed import AS_OF, EVENT_SHIFT_DAYS, FEW, NEW_LEDGER_START, OLD_LEDGER_END, ZONES

_NOW = f"TIMESTAMP '{AS_OF}'"
_TODAY = f"DATE '{AS_OF[:10]}'"
_M = {-1: "2001-08-01", 0: "2001-07-01", 1: "2001-06-01", 2: "2001-05-01", 3: "2001-04-01"}
_LABEL = {0: "Jul 2001", 1: "Jun 2001", 2: "May 2001", 3: "Apr 2001"}
_OFF = "(2001 * 12 + 7 - year(l_shipdate) * 12 - month(l_shipdate))"
_PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"


# --- logical tables --------------------------------------------------------------------


def _growth_card_sql() -> str:
    cols = []

    def count(name: str, back: int, cond: str) -> None:
        cols.append((f"{name}_m{back}", f"count(*) FILTER ({_OFF} = {back} AND {cond})"))

    def total(name: str, back: int, cond: str) -> None:
        cols.append((f"{name}_m{back}", f"sum({_PRICE}) FILTER ({_OFF} = {back} AND {cond})"))

    for b in range(3):
        total("fixed_bonus", b, "l_returnflag = 'R'")
        total("claim_rating_bonus", b, "l_returnflag = 'A'")
        total("claim_work_bonus", b, "l_returnflag = 'N' AND l_linestatus = 'O'")
        total("claim_device_bonus", b, "l_returnflag = 'N' AND l_linestatus = 'F'")
        count("installs", b, "l_linestatus = 'O'")
        count("notifs", b, "l_returnflag = 'N'")
        count("intersts", b, "l_returnflag = 'A'")
        count("total_renewals", b, "l_returnflag = 'R'")
    for b in range(4):
        count("active_customer_15d", b, "l_linestatus = 'F'")
        count("service_ticket", b, "l_returnflag = 'A'")
        count("service_ticket_sla", b, "l_returnflag = 'A' AND l_linestatus = 'O'")
        count("device_ticket", b, "l_returnflag = 'N' AND l_quantity <= 25")
        count("device_ticket_sla", b, "l_returnflag = 'N' AND l_quantity <= 25 AND l_linestatus = 'F'")
        count("lost_customers", b, "l_discount > 0.085")
    raw = ",\n  ".join(f"{expr} AS {name}" for name, expr in cols)
    shown = []
    for name, _ in cols:
        if name.startswith("fixed_bonus"):
            shown.append(
                f"CASE WHEN partner_id % 4 = 0 THEN 0 WHEN partner_id % 8 = 2 THEN -{name} "
                f"WHEN partner_id % 4 <> 1 THEN {name} END AS {name}"
            )
        elif "_ticket" in name and name[-1] in "01":
            shown.append(f"CASE WHEN partner_id % 3 = 0 THEN 0 ELSE {name} END AS {name}")
        elif "_ticket" in name and name[-1] == "2":
            shown.append(f"CASE WHEN partner_id % 9 = 0 THEN 0 ELSE {name} END AS {name}")
        elif name.startswith("lost_customers"):
            shown.append(f"CASE WHEN partner_id % 2 = 0 THEN 0 ELSE {name} END AS {name}")
        else:
            shown.append(name)
    return f"""SELECT partner_id,
  CASE WHEN partner_id % 13 <> 5 THEN s_name END AS partner_name, r_name AS zone,
  CASE WHEN s_acctbal > 5000 THEN 'ACTIVE' ELSE 'DORMANT' END AS partner_status,
  life_time_earning, active_customer, {", ".join(shown)}
FROM (SELECT l_suppkey AS partner_id, sum({_PRICE}) AS life_time_earning, count(*) AS active_customer,
  {raw}
  FROM lineitem GROUP BY l_suppkey) card
JOIN supplier ON s_suppkey = partner_id
JOIN nation ON n_nationkey = s_nationkey
JOIN region ON r_regionkey = n_regionkey"""


def _partner_scores_sql() -> str:
    cols = []
    for b in (1, 2, 3):
        for name, cond in (
            ("service_ticket", "l_linestatus = 'F'"),
            ("service_ticket_sla", "l_linestatus = 'F' AND l_returnflag = 'R'"),
            ("device_ticket", "l_linestatus = 'O'"),
            ("device_ticket_sla", "l_linestatus = 'O' AND l_returnflag = 'A'"),
        ):
            recent = {1: " AND l_suppkey % 6 <> 0 AND l_suppkey % 9 <> 0", 2: " AND l_suppkey % 9 <> 0"}.get(b, "")
            cols.append(f"count(*) FILTER ({_OFF} = {b} AND {cond}{recent}) AS {name}_m{b}")
    return f"""SELECT l_suppkey AS partner_id, avg(l_quantity) / 10.0 AS service_rating,
  avg(CAST(l_linenumber AS DOUBLE)) AS avg_install_rating, {", ".join(cols)}
FROM lineitem GROUP BY l_suppkey"""


_LEDGER = """o_custkey % 10 AS partner_id, o_orderstatus AS action,
  o_orderpriority || ' order ' || o_orderkey AS remark,
  CAST(CASE o_orderstatus WHEN 'F' THEN -o_totalprice WHEN 'O' THEN o_totalprice ELSE 0 END AS DECIMAL(18,2)) AS credit_delta,
  CAST(o_totalprice AS DECIMAL(18,2)) AS balance"""

# In order of dependence.
_TABLES: dict[str, str] = {
    "ev": f"""SELECT user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  ts - INTERVAL {EVENT_SHIFT_DAYS} DAY AS seen_at FROM events""",
    "cities": "SELECT replace(n_name, '_', ' ') AS label, n_name AS funnel FROM nation UNION ALL SELECT 'NEWTOWN', 'NEWTOWN'",
    "roster": """SELECT s_suppkey AS partner_id, s_name AS partner_name,
  n_name || CASE WHEN s_suppkey % 2 = 0 THEN '  ' ELSE '' END AS partner_city
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "city_partners": """SELECT DISTINCT label AS city, partner_id, partner_name
FROM roster JOIN cities ON trim(partner_city) = funnel""",
    "plans": f"""SELECT l_suppkey AS partner_id, CAST(l_orderkey AS VARCHAR) AS mobile, l_partkey AS nas_id,
  CASE WHEN l_returnflag <> 'R' THEN 'D' || l_partkey END AS device_id, l_orderkey AS account_id,
  CASE WHEN l_orderkey % 97 <> 0 THEN l_shipdate END AS plan_start_time, CAST(l_quantity AS BIGINT) * 86400 + l_linenumber * 7200 AS time_plan,
  CASE WHEN l_linenumber = 7 THEN 0 ELSE {_PRICE} END AS charges,
  CASE WHEN l_linenumber <> 3 THEN CAST(l_linenumber * 50 AS VARCHAR) END AS speed_mbps
FROM lineitem""",
    "devices": """SELECT CASE WHEN l_linenumber <> 7 THEN l_suppkey END AS partner_id,
  CAST(l_orderkey AS VARCHAR) AS customer_id, 'D' || l_partkey AS device_id,
  CASE WHEN l_returnflag = 'R' THEN 'partner' WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN 'warehouse' ELSE 'customer' END AS location,
  CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) END AS user_churn_date
FROM lineitem""",
    "bookings": """SELECT CAST(l_orderkey AS VARCHAR) AS mobile,
  CASE WHEN o_orderstatus <> 'P' THEN 'Customer ' || o_custkey || '/' || l_linenumber END AS name,
  l_suppkey AS partner_id, o_orderdate + to_hours(l_linenumber * 3) AS added_time,
  CASE WHEN l_linenumber = 7 THEN true WHEN l_linenumber < 6 THEN false END AS is_deleted
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "booking_events": """SELECT CAST(l_orderkey AS VARCHAR) AS mobile,
  CASE WHEN l_linestatus = 'O' THEN 'address_updated' ELSE 'slot_booked' END AS event_name,
  CASE WHEN l_linenumber = 5 THEN 'not json' ELSE
    '{"address":"{\\"home\\":\\"' || CASE WHEN l_linenumber = 2 THEN '' ELSE 'House ' || l_partkey END
    || '\\",\\"city\\":\\"City ' || l_suppkey || '\\"}"}' END AS data,
  l_shipdate AS added_time
FROM lineitem""",
    "task_events": """SELECT CAST(o_orderkey AS VARCHAR) AS mobile,
  CASE WHEN o_orderstatus = 'F' THEN 'OTP_VERIFIED' ELSE 'SCHEDULED' END AS event_name,
  o_orderdate + INTERVAL 20 HOUR AS added_time
FROM orders""",
    "daily_usage": "SELECT user_id AS nas_id, CAST(seen_at AS DATE) AS added_date FROM ev",
    "optical_readings": """SELECT user_id AS nas_id, CASE WHEN event_type <> 'error' THEN -value END AS avg_optical_dbm,
  CASE WHEN value < 20 THEN 'Good' WHEN value < 60 THEN 'Fair' END AS optical_health, CAST(seen_at AS DATE) AS date_ist
FROM ev""",
    "speed_tests": """SELECT 'D' || user_id AS device_id, value AS speed, CAST(k AS DOUBLE) AS latency, k / 4.0::DOUBLE AS jitter,
  seen_at AS tested_on FROM ev""",
    "ticket_events": """SELECT k || '-' || CAST(CAST(seen_at AS DATE) AS VARCHAR) || '-' || hour(seen_at) // 6 AS task_id,
  CASE WHEN k < 45 THEN 'SERVICE' WHEN k < 90 THEN 'ROUTER_PICKUP' ELSE 'OTHER' END AS type,
  CASE event_type WHEN 'signup' THEN 'TICKET_CREATED' WHEN 'purchase' THEN 'TICKET_RESOLVED'
    WHEN 'click' THEN 'TICKET_CLOSED' WHEN 'error' THEN 'ESCALATED' ELSE 'VIEWED' END AS event_name,
  seen_at AS added_time, CASE WHEN user_id % 6 = 0 OR user_id % 9 = 0 THEN user_id + 1000000 ELSE user_id END AS partner_id
FROM ev""",
    "ticket_daily": """SELECT user_id AS partner_id, CAST(seen_at AS DATE) AS tkt_dt, count(*) AS total_tickets,
  count(*) FILTER (event_type = 'click') AS resolved_tickets
FROM ev GROUP BY 1, 2""",
    "disbursements": f"""SELECT l_suppkey AS partner_id, {_PRICE} AS amount,
  CASE WHEN l_returnflag = 'R' THEN 5 ELSE 3 END AS bonus_status, l_shipdate AS added_time,
  CASE WHEN l_linenumber = 7 THEN true WHEN l_linenumber < 6 THEN false END AS is_deleted
FROM lineitem""",
    "growth_card": _growth_card_sql(),
    "scores": _partner_scores_sql(),
    "ledger_old": f"SELECT {_LEDGER}, o_orderdate AS added_at_ist FROM orders WHERE o_orderdate < TIMESTAMP '{OLD_LEDGER_END}'",
    "ledger_new": f"""SELECT partner_id, action, remark, balance - credit_delta AS old_balance, balance, added_time
FROM (SELECT {_LEDGER}, o_orderdate + INTERVAL 19 HOUR AS added_time FROM orders
  WHERE o_orderdate >= TIMESTAMP '{NEW_LEDGER_START}') moved""",
}

# --- intermediate results --------------------------------------------------------------


def _card_sql() -> str:
    cols = []
    for b in (0, 1, 2):
        running = "_mtd" if b == 0 else ""
        bonus = [f"fixed_bonus_m{b}", f"claim_rating_bonus_m{b}", f"claim_work_bonus_m{b}", f"claim_device_bonus_m{b}"]
        names = ["fixed", "rating_bonus", "service_sla_bonus", "device_sla_bonus"]
        cols += [f"{x} AS m{b}_{n}_payout" for x, n in zip(bonus, names)]
        cols.append(" + ".join(f"coalesce({x}, 0)" for x in bonus) + f" AS total_m{b}_payout")
        cols.append(f"installs_m{b} AS m{b}_installs{running}, notifs_m{b} AS m{b}_notifications{running}")
        cols.append(f"intersts_m{b} AS m{b}_interests{running}, total_renewals_m{b} AS m{b}_rating_bonus_renewals")
        cols.append(f"0 AS m{b}_rating_at_payout")
    for kind in ("service", "device"):
        cols.append(
            f"CASE WHEN coalesce({kind}_ticket_m0, 0) > 0 THEN CAST(coalesce({kind}_ticket_sla_m0, 0) AS DOUBLE) "
            f"/ {kind}_ticket_m0 ELSE CAST(0 AS DOUBLE) END AS current_{kind}_sla"
        )
    zones = ", ".join(f"'{z}'" for z in ZONES)
    return f"""SELECT partner_id, partner_name, zone, active_customer_15d_m0 AS active_base, partner_status,
  life_time_earning AS lifetime_earning, {", ".join(cols)}, 0 AS current_rating, 0 AS partner_lottery_earning
FROM growth_card WHERE zone IN ({zones})"""


def _scorecard_sql(scope: str) -> str:
    """``scope`` names the sold-once and sold-again flags to use."""
    return f"""SELECT city, c.partner_id, partner_name,
  coalesce(total_gross, 0) AS total_gross, coalesce(active, 0) AS active, coalesce(live, 0) AS live,
  coalesce(r30_plus, 0) AS r30_plus, coalesce(m1_expired, 0) AS m1_expired, coalesce(m1_renewed, 0) AS m1_renewed,
  coalesce(tickets_1m, 0)::BIGINT AS tickets_1m, coalesce(resolved_1m, 0)::BIGINT AS resolved_1m
FROM city_partners c
LEFT JOIN (SELECT city, first_partner_id AS partner_id, count(*) AS total_gross,
    count(*) FILTER (last_expiry::DATE >= {_TODAY} - 15) AS active,
    count(*) FILTER (last_expiry >= {_NOW}) AS live,
    count(*) FILTER (last_start::DATE <= {_TODAY} - 30) AS r30_plus,
    count(*) FILTER (first_start::DATE <= {_TODAY} - 30 AND once_{scope}) AS m1_expired,
    count(*) FILTER (first_start::DATE <= {_TODAY} - 30 AND again_{scope}) AS m1_renewed
  FROM city_mobiles JOIN city_repeats USING (city, mobile) GROUP BY ALL) counted USING (city, partner_id)
LEFT JOIN recent_tickets t ON t.partner_id = c.partner_id"""


def _live_cols_sql() -> str:
    cols = []
    for kind, code in (("service", "SERVICE"), ("device", "ROUTER_PICKUP")):
        for b in (0, 1):
            mine = f"type = '{code}' AND off = {b}"
            cols.append(f"count(DISTINCT CASE WHEN {mine} THEN task_id END) AS {kind}_total_m{b}")
            cols.append(f"count(DISTINCT CASE WHEN {mine} AND met THEN task_id END) AS {kind}_met_m{b}")
    return ", ".join(cols)


_RESOLVED = "event_name IN ('TICKET_RESOLVED', 'TICKET_CLOSED', 'ROUTER_RECOVERED', 'CUSTOMER_RECOVERED')"


def _best_sql() -> str:
    def case(kind: str, what: str) -> str:
        arms = []
        for src, b in (("g", 1), ("s", 1), ("g", 0), ("g", 2), ("s", 2), ("g", 3), ("s", 3)):
            label = f"'{_LABEL[b]}{' MTD' if b == 0 else ''}'"
            pct = f"CAST({src}.{kind}_ticket_sla_m{b} AS DOUBLE) / {src}.{kind}_ticket_m{b} * 100"
            arms.append(f"WHEN {src}.{kind}_ticket_m{b} > 0 THEN {pct if what == 'pct' else label}")
        return f"CASE {' '.join(arms)} END AS {kind}_sla_{what}"

    cols = ", ".join(case(kind, what) for kind in ("service", "device") for what in ("pct", "label"))
    return f"SELECT g.partner_id, {cols} FROM growth_card g LEFT JOIN scores s ON s.partner_id = g.partner_id"


def _sla_sql() -> str:
    cols = []
    for kind in ("service", "device"):
        cols.append(
            f"CASE WHEN {kind}_total_m0 > 0 THEN CAST({kind}_met_m0 AS DOUBLE) / {kind}_total_m0 * 100 "
            f"WHEN {kind}_total_m1 > 0 THEN CAST({kind}_met_m1 AS DOUBLE) / {kind}_total_m1 * 100 "
            f"ELSE {kind}_sla_pct END AS {kind}_sla_pct"
        )
        cols.append(
            f"CASE WHEN {kind}_total_m0 > 0 THEN '{_LABEL[0]} MTD' WHEN {kind}_total_m1 > 0 THEN '{_LABEL[1]}' "
            f"ELSE {kind}_sla_label END AS {kind}_sla_label"
        )
    return f"""SELECT *, NOT sla_stale AND coalesce(service_sla_label = '{_LABEL[0]} MTD', false)
    OR NOT sla_stale AND coalesce(device_sla_label = '{_LABEL[0]} MTD', false) AS sla_running
FROM (SELECT *, coalesce(service_sla_label IN ('{_LABEL[2]}', '{_LABEL[3]}'), false)
    OR coalesce(device_sla_label IN ('{_LABEL[2]}', '{_LABEL[3]}'), false) AS sla_stale
  FROM (SELECT b.partner_id, {", ".join(cols)} FROM best b LEFT JOIN live l ON l.partner_id = b.partner_id) x) y"""


def _ticket_series_sql() -> str:
    months = []
    for b in (2, 1, 0):
        head = f"g.partner_id, {b} AS month_off, '{_LABEL[b]}' AS month_label"
        if b == 2:
            body = (
                "service_ticket_m2 AS service_tickets, service_ticket_sla_m2 AS service_met, "
                "device_ticket_m2 AS device_tickets, device_ticket_sla_m2 AS device_met, false AS from_live"
            )
        else:
            fill = (
                f"(service_ticket_m{b} = 0 AND device_ticket_m{b} = 0 "
                f"AND coalesce(service_total_m{b}, 0) + coalesce(device_total_m{b}, 0) > 0)"
            )
            body = ", ".join(
                f"CASE WHEN {fill} THEN {kind}_total_m{b} ELSE {kind}_ticket_m{b} END AS {kind}_tickets, "
                f"CASE WHEN {fill} THEN {kind}_met_m{b} ELSE {kind}_ticket_sla_m{b} END AS {kind}_met"
                for kind in ("service", "device")
            )
            body += f", {fill} AS from_live"
        months.append(f"SELECT {head}, {body} FROM growth_card g LEFT JOIN live l ON l.partner_id = g.partner_id")
    return " UNION ALL ".join(months)


_COUNTABLE = f"""coalesce(NOT is_deleted, false) AND added_time >= TIMESTAMP '{_M[3]}'
  AND CASE WHEN strftime(added_time, '%Y-%m') = '{_M[0][:7]}' THEN true ELSE bonus_status = 5 END"""


def _paid(b: int) -> str:
    return f"coalesce((SELECT fixed_paid FROM paid WHERE paid.partner_id = c.partner_id AND month_key = '{_M[b][:7]}'), 0)"


def _corrected(b: int) -> str:
    return f"total_m{b}_payout + CASE WHEN coalesce(m{b}_fixed_payout, 0) = 0 THEN {_paid(b)} ELSE 0 END"


def _earnings_sql() -> str:
    totals = " + ".join(_corrected(b) for b in (0, 1, 2))
    fell = {b: f"(coalesce(m{b}_fixed_payout, 0) = 0 AND {_paid(b)} > 0)" for b in (0, 1, 2)}
    note = ", ".join(f"CASE WHEN {fell[b]} THEN '{_LABEL[b]}' END" for b in (2, 1, 0))
    months = []
    for b in (2, 1, 0):
        months.append(
            f"""SELECT partner_id, {b} AS month_off, '{_LABEL[b]}' AS month_label,
  CASE WHEN coalesce(m{b}_fixed_payout, 0) > 0 THEN m{b}_fixed_payout ELSE {_paid(b)} END AS fixed_payout,
  coalesce(m{b}_rating_bonus_payout, 0) AS rating_bonus, coalesce(m{b}_service_sla_bonus_payout, 0) AS service_sla_bonus,
  coalesce(m{b}_device_sla_bonus_payout, 0) AS device_sla_bonus, {_corrected(b)} AS total_payout, 0 AS rating_score,
  m{b}_rating_bonus_renewals AS renewals, {fell[b]} AS from_disbursement,
  CAST({totals} AS DOUBLE) / 3 AS avg_3m, lifetime_earning, 0 AS lottery_earning, concat_ws(' · ', {note}) AS disbursed_months
FROM card c"""
        )
    return " UNION ALL ".join(months)


def _joined(parts: list[str], sep: str) -> str:
    """Non-empty parts as one text, NULL when there are none."""
    filled = ", ".join(f"CASE WHEN ({part}) <> '' THEN {part} END" for part in parts)
    return f"nullif(concat_ws('{sep}', {filled}), '')"


_PLAN_TEXT = _joined(
    [
        "CASE WHEN speed_mbps <> '' THEN speed_mbps || ' Mbps' END",
        "plan_days || 'd'",
        "'Rs ' || floor(charges + 0.5)::BIGINT",
    ],
    " | ",
)


def _valid(path: str, text: str) -> str:
    return f"CASE WHEN json_valid({text}) THEN json_extract_string({text}, '{path}') END"


_STEPS: dict[str, str] = {
    "city_plans": """SELECT city, p.partner_id, mobile, plan_start_time, plan_start_time + to_seconds(time_plan) AS expiry
FROM plans p JOIN (SELECT DISTINCT city, partner_id FROM city_partners) c ON c.partner_id = p.partner_id""",
    "sold": "SELECT city, mobile, partner_id, count(*) AS recharge_count FROM city_plans GROUP BY ALL",
    "city_repeats": """SELECT city, mobile, bool_or(recharge_count = 1) AS once_partner, bool_or(recharge_count > 1) AS again_partner,
  sum(recharge_count) = 1 AS once_mobile, sum(recharge_count) > 1 AS again_mobile FROM sold GROUP BY ALL""",
    "city_mobiles": """SELECT DISTINCT city, mobile,
  first_value(partner_id) OVER up AS first_partner_id, first_value(plan_start_time) OVER up AS first_start,
  first_value(partner_id) OVER down AS last_partner_id, first_value(plan_start_time) OVER down AS last_start,
  first_value(expiry) OVER down AS last_expiry
FROM city_plans
WINDOW up AS (PARTITION BY city, mobile ORDER BY plan_start_time NULLS LAST, partner_id),
  down AS (PARTITION BY city, mobile ORDER BY plan_start_time DESC NULLS LAST, expiry DESC NULLS LAST, partner_id DESC)""",
    "recent_tickets": f"""SELECT partner_id, sum(total_tickets) AS tickets_1m, sum(resolved_tickets) AS resolved_1m
FROM ticket_daily SEMI JOIN city_partners USING (partner_id) WHERE tkt_dt + 30 >= {_TODAY} GROUP BY partner_id""",
    "scorecard": _scorecard_sql("partner"),
    "happenings": f"""SELECT city, 'install' AS kind, mobile, min(plan_start_time)::DATE AS day
FROM city_plans GROUP BY city, mobile HAVING min(plan_start_time) >= {_TODAY} - 30
UNION ALL
SELECT city, 'lead', mobile, (added_time + INTERVAL 330 MINUTE)::DATE
FROM bookings JOIN (SELECT DISTINCT city, partner_id FROM city_partners) USING (partner_id) WHERE added_time >= {_TODAY} - 30""",
    "daily": """SELECT city, day, count(DISTINCT mobile) FILTER (kind = 'install') AS installs,
  count(DISTINCT mobile) FILTER (kind = 'lead') AS leads FROM happenings GROUP BY city, day""",
    "card": _card_sql(),
    "paid": f"""SELECT partner_id, CAST(date_trunc('month', added_time) AS DATE) AS month, strftime(added_time, '%Y-%m') AS month_key,
  sum(amount) AS fixed_paid, count(*) AS renewal_count
FROM disbursements WHERE {_COUNTABLE} GROUP BY ALL""",
    "device_counts": """SELECT partner_id, count(*) FILTER (location = 'partner') AS with_partner,
  count(*) FILTER (location = 'customer' AND user_churn_date IS NULL) AS with_active_customer,
  count(*) FILTER (location = 'customer' AND user_churn_date IS NOT NULL) AS with_churned_customer
FROM devices WHERE partner_id IS NOT NULL GROUP BY partner_id""",
    "overview": f"""SELECT c.partner_id, partner_name, zone, active_base, partner_status, lifetime_earning,
  {", ".join(f"{_corrected(b)} AS corrected_m{b}_payout" for b in (0, 1, 2))},
  coalesce(with_partner, 0) AS ont_with_partner, coalesce(with_active_customer, 0) AS ont_with_active,
  coalesce(with_churned_customer, 0) AS ont_with_churned
FROM card c LEFT JOIN device_counts d ON d.partner_id = c.partner_id""",
    "earnings": _earnings_sql(),
    "live_tasks": f"""SELECT partner_id, type, task_id, off,
  EXISTS (FROM ticket_events r WHERE r.task_id = made.task_id AND {_RESOLVED} AND (off = 0 OR r.added_time < TIMESTAMP '{_M[0]}')) AS met
FROM (SELECT partner_id, type, task_id, CASE WHEN added_time < TIMESTAMP '{_M[0]}' THEN 1 ELSE 0 END AS off
  FROM ticket_events WHERE event_name = 'TICKET_CREATED' AND added_time >= TIMESTAMP '{_M[1]}') made""",
    "live": f"SELECT partner_id, {_live_cols_sql()} FROM live_tasks GROUP BY partner_id",
    "best": _best_sql(),
    "known_devices": """SELECT partner_id, customer_id, max(device_id) AS lookup_device_id FROM devices
WHERE partner_id IS NOT NULL GROUP BY partner_id, customer_id""",
    "customers": """SELECT partner_id, mobile, max(nas_id) AS nas_id, max(device_id) AS own_device_id, max(account_id) AS account_id,
  count(*) FILTER (charges > 0) AS recharges
FROM plans GROUP BY partner_id, mobile""",
    "equipped": """SELECT c.*, coalesce(own_device_id, lookup_device_id) AS device_id FROM customers c
LEFT JOIN known_devices k ON k.partner_id = c.partner_id AND k.customer_id = c.account_id::VARCHAR""",
    "running": """SELECT DISTINCT ON (partner_id, mobile) partner_id, mobile,
  plan_start_time + INTERVAL 330 MINUTE AS last_recharge,
  plan_start_time + to_seconds(time_plan + 330 * 60) AS plan_expiry,
  round(time_plan / 86400.0::DOUBLE)::BIGINT AS plan_days, charges, speed_mbps
FROM plans ORDER BY partner_id, mobile, plan_start_time DESC NULLS LAST, time_plan DESC NULLS LAST,
  charges DESC NULLS LAST, speed_mbps DESC NULLS LAST""",
    "named": "SELECT mobile, min(name) AS customer_name FROM bookings SEMI JOIN plans USING (mobile) WHERE is_deleted IS FALSE GROUP BY mobile",
    "moved_in": f"""SELECT mobile, {_joined([_valid("$.home", "inner_json"), _valid("$.city", "inner_json")], ", ")} AS address
FROM (SELECT DISTINCT ON (mobile) mobile, {_valid("$.address", "data")} AS inner_json
  FROM booking_events SEMI JOIN plans USING (mobile) WHERE event_name = 'address_updated'
  ORDER BY mobile, added_time DESC NULLS LAST, inner_json DESC NULLS LAST) latest""",
    "online": "SELECT nas_id, max(added_date) AS last_ping FROM daily_usage GROUP BY nas_id",
    "verified": """SELECT mobile, min(added_time + INTERVAL 330 MINUTE)::DATE AS install_date
FROM task_events SEMI JOIN plans USING (mobile) WHERE event_name = 'OTP_VERIFIED' GROUP BY mobile""",
    "light": """SELECT DISTINCT ON (nas_id) nas_id, date_ist, avg_optical_dbm, optical_health
FROM optical_readings SEMI JOIN plans USING (nas_id)
ORDER BY nas_id, date_ist DESC NULLS LAST, avg_optical_dbm DESC NULLS LAST, optical_health DESC NULLS LAST""",
    "pace": """SELECT DISTINCT ON (device_id) device_id, tested_on, speed, latency, jitter
FROM speed_tests SEMI JOIN equipped USING (device_id)
ORDER BY device_id, tested_on DESC NULLS LAST, speed DESC NULLS LAST, latency DESC NULLS LAST, jitter DESC NULLS LAST""",
    "standing": f"""SELECT partner_id, mobile, last_recharge, plan_expiry, {_PLAN_TEXT} AS plan_details,
  CASE WHEN plan_expiry < {_NOW} THEN ({_TODAY} - plan_expiry::DATE)::INTEGER END AS days_since_expiry,
  coalesce(CASE plan_expiry >= {_NOW} WHEN true THEN 'Active' WHEN false THEN 'Expired' END, 'No Plan') AS status
FROM running""",
    "c360": """SELECT partner_id, mobile, coalesce(customer_name, mobile) AS name, address, install_date, last_ping, last_recharge,
  recharges AS recharge_count, plan_expiry, plan_details, days_since_expiry, status, avg_optical_dbm, optical_health,
  date_ist AS optical_date, speed AS actual_speed_mbps, latency, jitter, tested_on
FROM equipped JOIN standing USING (partner_id, mobile)
LEFT JOIN named USING (mobile) LEFT JOIN moved_in USING (mobile) LEFT JOIN verified USING (mobile)
LEFT JOIN online USING (nas_id) LEFT JOIN light USING (nas_id) LEFT JOIN pace USING (device_id)""",
    "wallet_all": """SELECT partner_id, action, remark, credit_delta, balance, added_at_ist, false AS from_new, NULL AS stored FROM ledger_old
UNION ALL SELECT partner_id, action, remark, balance - old_balance, balance, added_time + INTERVAL 330 MINUTE, true, added_time FROM ledger_new""",
    "wallet": """SELECT * EXCLUDE (from_new, stored, last_old), row_number() OVER (PARTITION BY partner_id ORDER BY added_at_ist DESC NULLS LAST,
  from_new DESC, remark DESC NULLS LAST, action DESC NULLS LAST, balance DESC NULLS LAST, credit_delta DESC NULLS LAST)::INTEGER AS row_no
FROM (SELECT *, max(added_at_ist) FILTER (NOT from_new) OVER (PARTITION BY partner_id) AS last_old FROM wallet_all) w
WHERE NOT from_new OR stored > coalesce(last_old, TIMESTAMP '2000-01-01')
QUALIFY row_no <= 100""",
}


# --- expected results ------------------------------------------------------------------


def _money(expr: str, decimals: int = 0) -> str:
    return f"'₹' || format('{{:,.{decimals}f}}', CAST(coalesce({expr}, 0) AS DOUBLE))"


def _pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} <> 0 THEN CAST({part} AS DOUBLE) / ({whole}) * 100 END"


def _pct_text(part: str, whole: str) -> str:
    return f"coalesce(format('{{:.0f}}', {_pct(part, whole)}) || '%', '—')"


_CARD_FIELDS = (
    ["partner_name", "zone", "active_base", "partner_status", "lifetime_earning"]
    + [
        f"{prefix}{name}"
        for b in (0, 1, 2)
        for prefix, name in (
            [(f"m{b}_", n) for n in ("fixed_payout", "rating_bonus_payout", "service_sla_bonus_payout", "device_sla_bonus_payout")]
            + [("", f"total_m{b}_payout")]
            + [(f"m{b}_", n + ("_mtd" if b == 0 else "")) for n in ("installs", "notifications", "interests")]
            + [(f"m{b}_", n) for n in ("rating_bonus_renewals", "rating_at_payout")]
        )
    ]
    + ["current_service_sla", "current_device_sla", "current_rating", "partner_lottery_earning"]
)
_MONEY_FIELDS = [f for f in _CARD_FIELDS if f == "lifetime_earning" or f.endswith("_payout") and "rating_at" not in f]
_GROWTH_MONEY = ["life_time_earning"] + [
    f"{n}_m{b}" for n in ("fixed_bonus", "claim_rating_bonus", "claim_work_bonus", "claim_device_bonus") for b in (0, 1, 2)
]


def _doubles(source: str, fields: list[str]) -> str:
    casts = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in fields)
    return f"SELECT * REPLACE ({casts}) FROM {source}"


def _monthly(body: dict[int, str], source: str = "growth_card") -> str:
    return " UNION ALL ".join(
        f"SELECT partner_id, {b} AS month_off, '{_LABEL[b]}' AS month_label, {cols} FROM {source}" for b, cols in body.items()
    )


def _active(b: int) -> str:
    return f"active_customer_15d_m{b}"


def _churn_sql() -> str:
    none_lost = "(" + " AND ".join(f"lost_customers_m{b} = 0" for b in range(4)) + ")"
    implied = {b: f"greatest(0, installs_m{b} - ({_active(b)} - {_active(b + 1)}))" for b in range(3)} | {3: "0"}
    some = " + ".join(implied[b] for b in range(3)) + " > 0"
    return _monthly(
        {
            b: f"{_active(b)} AS active_base, CASE WHEN {none_lost} THEN {implied[b]} ELSE lost_customers_m{b} END AS lost_customers, "
            f"{none_lost} AND {some} AS estimated"
            for b in (3, 2, 1, 0)
        }
    )


def _created(where: str) -> str:
    return f"event_name = 'TICKET_CREATED' AND {where}"


_WINDOW = "added_time >= TIMESTAMP '2001-06-20' AND added_time < TIMESTAMP '2001-07-10'"
_COUNTS = """count(DISTINCT CASE WHEN type = 'SERVICE' THEN task_id END) AS service_tickets,
  count(DISTINCT CASE WHEN type = 'ROUTER_PICKUP' THEN task_id END) AS router_pickup_tickets"""

_RESULTS: dict[str, str] = {
    "partner_scorecard": "SELECT * FROM scorecard",
    "partner_scorecard_mobile_scope": _scorecard_sql("mobile"),
    "scorecard_ratios": f"""SELECT *, {_pct("active", "total_gross")} AS active_pct,
  {_pct("m1_renewed", "m1_expired + m1_renewed")} AS m1_pct FROM scorecard""",
    "scorecard_report": f"""SELECT city, partner_name AS "Partner", total_gross AS "Total Gross", active AS "Active",
  {_pct_text("active", "total_gross")} AS "Active %", live AS "Live", r30_plus AS "R30+", m1_expired AS "M1 Expired",
  m1_renewed AS "M1 Renewed", {_pct_text("m1_renewed", "m1_expired + m1_renewed")} AS "M1 %",
  tickets_1m AS "Tickets (30d)", resolved_1m AS "Resolved (30d)" FROM scorecard""",
    "recharge_counts": "SELECT * FROM sold",
    "first_last_plan": "SELECT * FROM city_mobiles",
    "mobile_summary": """SELECT city, first_partner_id AS partner_id, mobile, first_start, last_start, last_expiry, recharge_count
FROM city_mobiles JOIN sold USING (city, mobile)""",
    "tickets_30d": "SELECT partner_id, CAST(tickets_1m AS BIGINT) AS tickets_1m, CAST(resolved_1m AS BIGINT) AS resolved_1m FROM recent_tickets",
    "city_roster": "SELECT * FROM city_partners",
    "city_active_base": f"""SELECT city, count(DISTINCT mobile) FILTER (expiry::DATE >= {_TODAY} - 15) AS active_base
FROM (SELECT label AS city FROM cities) LEFT JOIN city_plans USING (city) GROUP BY city""",
    "city_partner_counts": """SELECT label AS city, count(DISTINCT partner_id) AS partners
FROM cities LEFT JOIN city_partners ON city = label GROUP BY label""",
    "daily_leads_installs": "SELECT * FROM daily ORDER BY city, day",
    "leads_installs_totals": """SELECT city, CAST(sum(leads) AS BIGINT) AS total_leads, CAST(sum(installs) AS BIGINT) AS total_installs
FROM daily GROUP BY city""",
    "month_keys": f"""SELECT CAST(date_trunc('month', added_time) AS DATE) AS month, strftime(added_time, '%Y-%m') AS month_key,
  strftime(added_time, '%b %Y') AS month_label, date_diff('month', added_time, {_NOW})::INTEGER AS month_off, count(*) AS n_rows
FROM disbursements WHERE added_time >= TIMESTAMP '{_M[3]}' AND added_time < TIMESTAMP '{_M[-1]}' GROUP BY ALL""",
    "partner_card": _doubles("card", _MONEY_FIELDS),
    "partner_detail": _doubles("growth_card", _GROWTH_MONEY),
    "partner_scores": "SELECT r.partner_id, s.* EXCLUDE (partner_id) FROM (SELECT DISTINCT partner_id FROM roster) r LEFT JOIN scores s ON s.partner_id = r.partner_id",
    "partner_names": "SELECT partner_name FROM card WHERE partner_name IS NOT NULL ORDER BY partner_name",
    "find_partner": _doubles("card", _MONEY_FIELDS) + " WHERE partner_name = 'Supplier#000000007' ORDER BY partner_id LIMIT 1",
    "safe_casts": """SELECT l_linenumber, CAST(sum(CASE WHEN l_linenumber < 6 THEN trunc(l_extendedprice) ELSE 0 END) AS BIGINT) AS whole_prices,
  CAST(sum(CAST(CASE WHEN l_linenumber < 6 THEN l_extendedprice ELSE 0 END AS DECIMAL(18,2))) AS DOUBLE) AS prices,
  CAST(sum(l_quantity) AS BIGINT) AS quantities
FROM lineitem GROUP BY l_linenumber""",
    "partner_fields": " UNION ALL ".join(
        f"SELECT partner_id, '{f}' AS field, CAST({f} AS VARCHAR) AS value FROM card" for f in ['partner_id', *_CARD_FIELDS]
    ),
    "fixed_payout_monthly": """SELECT partner_id, month, month_key, CAST(fixed_paid AS DOUBLE) AS fixed_paid, renewal_count
FROM paid ORDER BY partner_id, month DESC""",
    "fixed_payout_bulk": """SELECT partner_id, month_key, CAST(fixed_paid AS DOUBLE) AS fixed_paid FROM paid
WHERE partner_id IN (SELECT partner_id FROM card)""",
    "device_location_counts": "SELECT * FROM device_counts",
    "partner_overview": _doubles("overview", ["lifetime_earning", *[f"corrected_m{b}_payout" for b in (0, 1, 2)]])
    + " ORDER BY active_base DESC NULLS LAST, partner_id",
    "overview_report": f"""SELECT partner_name AS "Partner", zone AS "Zone", active_base AS "Active Base", partner_status AS "Status",
  {_money("lifetime_earning")} AS "Lifetime Earning", {_money("corrected_m0_payout")} AS "{_LABEL[0]} Payout",
  {_money("corrected_m1_payout")} AS "{_LABEL[1]} Payout", ont_with_partner AS "ONT w/ Partner",
  ont_with_active AS "ONT w/ Active Cust", ont_with_churned AS "ONT w/ Churned Cust" FROM overview""",
    "earnings_breakdown": _doubles(
        "earnings", ["fixed_payout", "rating_bonus", "service_sla_bonus", "device_sla_bonus", "total_payout", "lifetime_earning"]
    ),
    "earnings_report": f"""SELECT partner_id, month_label AS "Month", {_money("fixed_payout")} AS "Fixed Payout",
  {_money("rating_bonus")} AS "Rating Bonus", {_money("service_sla_bonus")} AS "Service SLA Bonus",
  {_money("device_sla_bonus")} AS "Device SLA Bonus", {_money("total_payout")} AS "Total Payout",
  format('{{:.2f}}', CAST(rating_score AS DOUBLE)) AS "Rating Score", renewals AS "Renewals" FROM earnings""",
    "ticket_counts": f"""SELECT r.partner_id, {_COUNTS} FROM (SELECT DISTINCT partner_id FROM roster) r
LEFT JOIN (SELECT * FROM ticket_events WHERE {_created(_WINDOW)}) t ON t.partner_id = r.partner_id GROUP BY r.partner_id""",
    "ticket_counts_mtd": f"SELECT partner_id, {_COUNTS} FROM ticket_events WHERE {_created(f"added_time >= TIMESTAMP '{_M[0]}'")} GROUP BY partner_id",
    "ticket_sla": f"""SELECT partner_id, type, count(*) AS total_tickets, count(*) FILTER (met) AS sla_met
FROM (SELECT DISTINCT partner_id, type, task_id, EXISTS (FROM ticket_events r
    WHERE r.task_id = t.task_id AND {_RESOLVED} AND r.added_time < TIMESTAMP '2001-07-10') AS met
  FROM ticket_events t WHERE {_created(_WINDOW)}) GROUP BY ALL""",
    "live_tickets": "SELECT * FROM live",
    "best_sla": "SELECT * FROM best",
    "live_sla_override": _sla_sql(),
    "ticket_series": _ticket_series_sql(),
    "partner_mobiles": "SELECT partner_id, mobile, nas_id, own_device_id AS device_id, account_id FROM customers",
    "device_lookup": "SELECT * FROM known_devices",
    "resolved_devices": "SELECT partner_id, mobile, device_id FROM equipped",
    "current_plan": "SELECT * REPLACE (CAST(charges AS DOUBLE) AS charges) FROM running",
    "customer_name": "SELECT * FROM named",
    "customer_address": "SELECT * FROM moved_in",
    "last_ping": "SELECT partner_id, mobile, last_ping FROM customers JOIN online USING (nas_id)",
    "install_date": "SELECT * FROM verified",
    "recharge_count": "SELECT partner_id, mobile, recharges AS recharge_count FROM customers WHERE recharges > 0",
    "latest_optical": "SELECT * FROM light",
    "latest_speed": "SELECT * FROM pace",
    "plan_status": "SELECT * EXCLUDE (last_recharge) FROM standing",
    "customer_360": "SELECT * FROM c360",
    "customer_360_few": f"SELECT * FROM c360 WHERE partner_id IN {FEW}",
    "customer_address_few": f"SELECT * FROM moved_in WHERE mobile IN (SELECT mobile FROM plans WHERE partner_id IN {FEW})",
    "latest_optical_few": f"SELECT * FROM light WHERE nas_id IN (SELECT max(nas_id) FROM plans WHERE partner_id IN {FEW} GROUP BY partner_id, mobile)",
    "signal_summary": f"""SELECT partner_id, count(avg_optical_dbm) AS optical_n, round(avg(avg_optical_dbm), 9) AS avg_optical,
  {_pct("count(*) FILTER (avg_optical_dbm IS NOT NULL AND optical_health = 'Good')", "count(avg_optical_dbm)")} AS optical_good_pct,
  count(actual_speed_mbps) AS speed_n, round(avg(actual_speed_mbps), 9) AS avg_speed FROM c360 GROUP BY partner_id""",
    "customer_status_counts": """SELECT partner_id, count(*) AS total_customers, count(*) FILTER (status = 'Active') AS active_customers,
  count(*) FILTER (status = 'Expired') AS expired_customers, count(*) FILTER (status = 'No Plan') AS no_plan_customers
FROM c360 GROUP BY partner_id""",
    "customer_report": """SELECT partner_id, mobile AS "Mobile", name AS "Name", coalesce(left(address, 60), '—') AS "Address",
  coalesce(CAST(install_date AS VARCHAR), '—') AS "Installed On", coalesce(CAST(last_ping AS VARCHAR), '—') AS "Last Ping",
  coalesce(strftime(last_recharge, '%Y-%m-%d %H:%M'), '—') AS "Last Recharge", recharge_count AS "Recharges",
  coalesce(strftime(plan_expiry, '%Y-%m-%d %H:%M'), '—') AS "Plan Expiry", coalesce(plan_details, '—') AS "Plan",
  CASE WHEN status = 'Active' THEN 'Active ✓' ELSE coalesce(days_since_expiry || 'd ago', '—') END AS "Since Expiry",
  status AS "Status", coalesce(format('{:.1f}', avg_optical_dbm), '—') AS "Optical (dBm)",
  coalesce(optical_health, '—') AS "Optical Health", coalesce(format('{:.1f}', actual_speed_mbps), '—') AS "Speed (Mbps)"
FROM c360""",
    "active_base_months": " UNION ALL ".join(
        f"SELECT r.partner_id, {b} AS month_off, '{_LABEL[b]}' AS month_label, coalesce({_active(b)}, 0) AS active_base "
        "FROM (SELECT DISTINCT partner_id FROM roster) r LEFT JOIN growth_card g ON g.partner_id = r.partner_id"
        for b in (3, 2, 1, 0)
    ),
    "active_base_trend": f"""SELECT partner_id, month_off, month_label, active_base,
  CASE WHEN before <> 0 THEN active_base - before END AS change
FROM (SELECT *, lag(active_base) OVER (PARTITION BY partner_id ORDER BY month_off DESC) AS before
  FROM ({_monthly({b: f"{_active(b)} AS active_base" for b in (3, 2, 1, 0)})}) m) t""",
    "churn_estimate": _churn_sql(),
    "engagement_series": _monthly(
        {b: f"installs_m{b} AS installs, notifs_m{b} AS notifications, intersts_m{b} AS interests" for b in (2, 1, 0)}
    ),
    "wallet_transactions": _doubles("wallet", ["credit_delta", "balance"]),
    "wallet_summary": """SELECT partner_id, CAST(max(CASE WHEN row_no = 1 THEN balance END) AS DOUBLE) AS current_balance,
  CAST(coalesce(sum(credit_delta) FILTER (credit_delta > 0), 0) AS DOUBLE) AS total_credits,
  CAST(abs(coalesce(sum(credit_delta) FILTER (credit_delta < 0), 0)) AS DOUBLE) AS total_debits, count(*) AS rows_shown
FROM wallet GROUP BY partner_id""",
    "wallet_report": f"""SELECT partner_id, row_no AS "#", strftime(added_at_ist, '%Y-%m-%d %H:%M:%S') AS "Date & Time (IST)", action AS "Type",
  CASE WHEN credit_delta > 0 THEN '+' || {_money("credit_delta", 2)} WHEN credit_delta < 0 THEN '-' || {_money("abs(credit_delta)", 2)}
    ELSE '₹0' END AS "Amount", {_money("balance", 2)} AS "Balance After", coalesce(left(remark, 80), '') AS "Remark" FROM wallet""",
}

_KNOWN = {**_TABLES, **_STEPS}


def _needs(sql: str) -> list[str]:
    """Names of the shared steps a statement mentions, directly or through others, in order of dependence."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in words & _KNOWN.keys() - found:
            found.add(name)
            todo.append(_KNOWN[name])
    return [name for name in _KNOWN if name in found]


# Neither layout changes a result.
_RESULTS |= {f"{name}_days": _RESULTS[name] for name in ("ticket_counts", "tickets_30d")}
_RESULTS |= {f"{name}_pages": _RESULTS[name] for name in ("recharge_count", "device_location_counts")}
_RESULTS["lost_values"] = """SELECT 'partner_id' AS column_name, count(*) FILTER (l_linenumber = 7) AS lost FROM lineitem
UNION ALL SELECT 'rows', count(*) FROM lineitem UNION ALL SELECT 'user_churn_date', count(*) FILTER (l_linenumber = 1) FROM lineitem"""

# Kept state gives what the whole history gives.
_RESULTS |= {
    f"{name}_refreshed": _RESULTS[name]
    for name in ("customer_360", "last_ping", "recharge_count", "recharge_counts", "fixed_payout_monthly", "wallet_transactions")
}


def all_oracles() -> dict[str, str]:
    out = {}
    for name, sql in _RESULTS.items():
        steps = ",\n".join(f"{step} AS ({_KNOWN[step]})" for step in _needs(sql))
        out[name] = f"WITH {steps}\n{sql}" if steps else sql
    return out
