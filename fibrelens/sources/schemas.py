"""The sixteen logical tables. Money is decimal(18,2), times are UTC."""

from __future__ import annotations


def _months(prefix: str, months: str, kind: str) -> str:
    return ", ".join(f"{prefix}_m{m} {kind}" for m in months)


_MONEY = "decimal(18,2)"

_GROWTH_CARD = ", ".join(
    [
        "partner_id bigint, partner_name string, zone string, partner_status string",
        f"life_time_earning {_MONEY}, active_customer bigint",
        _months("active_customer_15d", "0123", "bigint"),
        _months("fixed_bonus", "012", _MONEY),
        _months("claim_rating_bonus", "012", _MONEY),
        _months("claim_work_bonus", "012", _MONEY),
        _months("claim_device_bonus", "012", _MONEY),
        _months("installs", "012", "bigint"),
        _months("notifs", "012", "bigint"),
        _months("intersts", "012", "bigint"),
        _months("total_renewals", "012", "bigint"),
        _months("service_ticket", "0123", "bigint"),
        _months("service_ticket_sla", "0123", "bigint"),
        _months("device_ticket", "0123", "bigint"),
        _months("device_ticket_sla", "0123", "bigint"),
        _months("lost_customers", "0123", "bigint"),
    ]
)

_PARTNER_SCORES = ", ".join(
    [
        "partner_id bigint, service_rating double, avg_install_rating double",
        _months("service_ticket", "123", "bigint"),
        _months("service_ticket_sla", "123", "bigint"),
        _months("device_ticket", "123", "bigint"),
        _months("device_ticket_sla", "123", "bigint"),
    ]
)

TABLES: dict[str, str] = {
    "growth_card": _GROWTH_CARD,
    "partner_scores": _PARTNER_SCORES,
    "ticket_events": "task_id string, type string, event_name string, added_time timestamp, partner_id bigint",
    "plans": (
        "partner_id bigint, mobile string, nas_id bigint, device_id string, account_id bigint, "
        f"plan_start_time timestamp, time_plan bigint, charges {_MONEY}, speed_mbps string"
    ),
    "devices": "partner_id bigint, customer_id string, device_id string, location string, user_churn_date date",
    "bookings": "mobile string, name string, partner_id bigint, added_time timestamp, is_deleted boolean",
    "booking_events": "mobile string, event_name string, data string, added_time timestamp",
    "daily_usage": "nas_id bigint, added_date date",
    "task_events": "mobile string, event_name string, added_time timestamp",
    "optical_readings": "nas_id bigint, avg_optical_dbm double, optical_health string, date_ist date",
    "speed_tests": "device_id string, speed double, latency double, jitter double, tested_on timestamp",
    "disbursements": f"partner_id bigint, amount {_MONEY}, bonus_status int, added_time timestamp, is_deleted boolean",
    "ledger_old": (
        "partner_id bigint, action string, remark string, "
        f"credit_delta {_MONEY}, balance {_MONEY}, added_at_ist timestamp"
    ),
    "ledger_new": (
        "partner_id bigint, action string, remark string, "
        f"old_balance {_MONEY}, balance {_MONEY}, added_time timestamp"
    ),
    "roster": "partner_id bigint, partner_name string, partner_city string",
    "ticket_daily": "partner_id bigint, tkt_dt date, total_tickets bigint, resolved_tickets bigint",
}

# Source column names accepted in place of ours.
ALIASES: dict[str, dict[str, str]] = {
    "ticket_events": {"assigned_account_id": "partner_id"},
    "plans": {"lco_account_id": "partner_id"},
    "bookings": {"lco_account_id": "partner_id"},
    "daily_usage": {"nasid": "nas_id"},
    "speed_tests": {"deviceid": "device_id"},
    "disbursements": {"account_id": "partner_id"},
    "ledger_old": {"partner_account_id": "partner_id"},
    "ticket_daily": {"partner_account_id": "partner_id"},
}

#: Column by whose day a table is laid out (see ``fibrelens.sources.layout``).
DAY_COLUMNS: dict[str, str] = {
    "ticket_events": "added_time",
    "plans": "plan_start_time",
    "bookings": "added_time",
    "booking_events": "added_time",
    "daily_usage": "added_date",
    "task_events": "added_time",
    "optical_readings": "date_ist",
    "speed_tests": "tested_on",
    "disbursements": "added_time",
    "ledger_old": "added_at_ist",
    "ledger_new": "added_time",
    "ticket_daily": "tkt_dt",
}
