"""The one-row-per-customer view and what is derived from it.

A customer is a (partner, mobile) pair. The parts are available one by one, but
``customer_360`` does not join them one by one: plan facts come from a single
aggregation, the facts per mobile from one aggregation over three tagged sources, and
those per NAS id from one over two, which leaves four joins of already reduced rows.
The join by mobile follows the plan facts' own shuffle in place; of all partners' plan rows
there is no other shuffle before it. Each other join stands between two shuffles, where a hot
join key can be split at run time;
customers without a NAS id, device or account are dealt evenly over the tasks of their join.

For a few partners, their customers are found first and stored; that small table then says
which rows of the six side tables are read on.

The parts below that take ``plans`` for its mobiles, NAS ids or devices also take the table of
``known_customers`` in its place. Its size is known, so Spark moves the semi-join below the
aggregation: other customers' rows go as they are read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fibrelens.functions.joins import SPREAD, Ids, left_join_spread, of_ids, of_keys
from fibrelens.functions.picks import newest_per, packed, unpacked
from fibrelens.functions.times import AsOf, add_seconds, date_lit, day_gap, shift_minutes, ts_lit
from fibrelens.functions.values import DASH, blank_to_null, fixed, json_text, not_nan, or_dash, or_zero, percent
from fibrelens.session import kept, passing

IST_MINUTES = 330

# Fixed values of the event logs.
ADDRESS_UPDATED = "address_updated"
OTP_VERIFIED = "OTP_VERIFIED"

_PLAN_FIELDS = ("plan_start_time", "time_plan", "charges", "speed_mbps")


def _own(plans: DataFrame) -> DataFrame:
    return plans.filter(F.col("partner_id").isNotNull())


# --- parts -----------------------------------------------------------------------------


def partner_mobiles(plans: DataFrame) -> DataFrame:
    """Customers with the largest NAS, device and account id of their plan rows.

    The device is a grouping key of the first step, so that raw rows are hashed, not sorted.
    """
    kinds = _own(plans).groupBy("mobile", "partner_id", "device_id").agg(
        F.max("nas_id").alias("nas_id"), F.max("account_id").alias("account_id")
    )
    return (
        kinds.groupBy("mobile", "partner_id")
        .agg(
            F.max("nas_id").alias("nas_id"),
            F.max("device_id").alias("device_id"),
            F.max("account_id").alias("account_id"),
        )
        .select("partner_id", "mobile", "nas_id", "device_id", "account_id")
    )


def device_lookup(devices: DataFrame) -> DataFrame:
    """Largest device id per partner and customer id."""
    return (
        devices.filter(F.col("partner_id").isNotNull() & F.col("customer_id").isNotNull())
        .groupBy("customer_id", "partner_id")
        .agg(F.max("device_id").alias("lookup_device_id"))
        .select("partner_id", "customer_id", "lookup_device_id")
    )


def with_device(customers: DataFrame, devices: DataFrame) -> DataFrame:
    """Fill a missing device id from the device table, where the customer id is the account id."""
    known = device_lookup(devices).withColumnRenamed("customer_id", "_account")
    return (
        left_join_spread(
            customers.withColumn("_account", F.col("account_id").cast("string")),
            known,
            ["_account", "partner_id"],
            by=["mobile", "partner_id"],
        )
        .withColumn("device_id", F.coalesce("device_id", "lookup_device_id"))
        .drop("_account", "lookup_device_id")
    )


def resolved_devices(plans: DataFrame, devices: DataFrame) -> DataFrame:
    """Device per customer, from the plan rows or else from the device table."""
    return with_device(partner_mobiles(plans), devices).select("partner_id", "mobile", "device_id")


def _plan_columns(start: Column, seconds: Column, tz_offset_min: int) -> dict[str, Column]:
    return {
        "last_recharge": shift_minutes(start, tz_offset_min),
        "plan_expiry": shift_minutes(add_seconds(start, seconds), tz_offset_min),
        "plan_days": F.round(seconds / F.lit(86400.0)).cast("bigint"),
    }


def current_plan(plans: DataFrame, tz_offset_min: int = IST_MINUTES) -> DataFrame:
    """Latest plan per customer by start; times shifted by ``tz_offset_min``."""
    latest = _plan_facts(plans.filter(F.col("mobile").isNotNull()))
    shown = _plan_columns(F.col("plan_start_time"), F.col("time_plan"), tz_offset_min)
    return latest.select(
        "partner_id", "mobile", *[c.alias(n) for n, c in shown.items()], "charges", "speed_mbps"
    )


def recharge_count(plans: DataFrame) -> DataFrame:
    """Number of plan rows with a charge, for customers that have any."""
    return (
        _own(plans)
        .filter((F.col("charges") > 0) & F.col("mobile").isNotNull())
        .groupBy("mobile", "partner_id")
        .agg(F.count(F.lit(1)).alias("recharge_count"))
        .select("partner_id", "mobile", "recharge_count")
    )


def names_of(bookings: DataFrame) -> DataFrame:
    return bookings.filter(~F.col("is_deleted") & F.col("mobile").isNotNull())


def address_updates(booking_events: DataFrame) -> DataFrame:
    """Only the address part of the event text goes on into the shuffle."""
    rows = booking_events.filter((F.col("event_name") == ADDRESS_UPDATED) & F.col("mobile").isNotNull())
    return rows.select("mobile", "added_time", json_text(F.try_parse_json("data"), "address").alias("address_json"))


def verifications(task_events: DataFrame) -> DataFrame:
    return task_events.filter((F.col("event_name") == OTP_VERIFIED) & F.col("mobile").isNotNull())


def address_text(address_json: Column) -> Column:
    """'home, city' out of the address, itself JSON text; empty parts are left out.

    The text is parsed once, into a variant from which both parts are taken.
    """
    parsed = F.try_parse_json(address_json)
    parts = [blank_to_null(json_text(parsed, name)) for name in ("home", "city")]
    return blank_to_null(F.concat_ws(", ", *parts))


def install_day(first_verified: Column, tz_offset_min: int) -> Column:
    return shift_minutes(first_verified, tz_offset_min).cast("date")


def _known_mobiles(plans: DataFrame) -> DataFrame:
    return _own(plans).select("mobile").distinct()


def customer_name(bookings: DataFrame, plans: DataFrame) -> DataFrame:
    """One name per customer mobile out of the bookings that are not deleted."""
    named = names_of(bookings).groupBy("mobile").agg(F.min("name").alias("customer_name"))
    return named.join(_known_mobiles(plans), "mobile", "left_semi")


def customer_address(booking_events: DataFrame, plans: DataFrame) -> DataFrame:
    """Address of the latest update per customer mobile."""
    updates, among = address_updates(booking_events), _known_mobiles(plans)
    return newest_per(updates, ["mobile"], ["added_time"], ["address_json"], among).select(
        "mobile", address_text(F.col("address_json")).alias("address")
    )


def install_date(task_events: DataFrame, plans: DataFrame, tz_offset_min: int = IST_MINUTES) -> DataFrame:
    """Day of the first verification per customer mobile."""
    first = verifications(task_events).groupBy("mobile").agg(F.min("added_time").alias("_first"))
    return first.join(_known_mobiles(plans), "mobile", "left_semi").select(
        "mobile", install_day(F.col("_first"), tz_offset_min).alias("install_date")
    )


def last_ping(daily_usage: DataFrame, plans: DataFrame) -> DataFrame:
    """Last day with usage per customer, through the NAS id."""
    days = (
        daily_usage.filter(F.col("nas_id").isNotNull())
        .groupBy("nas_id")
        .agg(F.max("added_date").alias("last_ping"))
    )
    return (
        partner_mobiles(plans)
        .select("partner_id", "mobile", "nas_id")
        .join(days, "nas_id")
        .select("partner_id", "mobile", "last_ping")
    )


def latest_optical(optical_readings: DataFrame, plans: DataFrame) -> DataFrame:
    """Newest optical reading per NAS id in use."""
    in_use = _own(plans).select("nas_id").distinct()
    return newest_per(
        optical_readings.filter(F.col("nas_id").isNotNull()),
        ["nas_id"],
        ["date_ist"],
        ["avg_optical_dbm", "optical_health"],
        in_use,
    )


def newest_speed(speed_tests: DataFrame, among: DataFrame | None = None) -> DataFrame:
    rows = speed_tests.filter(F.col("device_id").isNotNull())
    return newest_per(rows, ["device_id"], ["tested_on"], ["speed", "latency", "jitter"], among)


def latest_speed(speed_tests: DataFrame, plans: DataFrame, devices: DataFrame) -> DataFrame:
    """Newest speed test per device in use."""
    in_use = resolved_devices(plans, devices).select("device_id").distinct()
    return newest_speed(speed_tests, in_use)


def _plan_text(speed: Column, days: Column, charges: Column) -> Column:
    """'50 Mbps | 28d | Rs 499', without the parts that are missing."""
    rupees = F.floor(charges + F.lit(0.5)).cast("bigint")
    parts = [
        F.concat(blank_to_null(speed), F.lit(" Mbps")),
        F.concat(days.cast("string"), F.lit("d")),
        F.concat(F.lit("Rs "), rupees.cast("string")),
    ]
    return blank_to_null(F.concat_ws(" | ", *parts))


def plan_status(current: DataFrame, as_of: AsOf) -> DataFrame:
    """Plan text, days since expiry and status of rows that carry the current plan."""
    expiry = F.col("plan_expiry")
    running = expiry >= ts_lit(as_of)
    return current.withColumns(
        {
            "plan_details": _plan_text(F.col("speed_mbps"), F.col("plan_days"), F.col("charges")),
            "days_since_expiry": F.when(~running, day_gap(date_lit(as_of), expiry)),
            "status": F.when(running, "Active").when(expiry.isNull(), "No Plan").otherwise("Expired"),
        }
    )


def order_customers(customers: DataFrame, as_of: AsOf) -> DataFrame:
    """Per partner: running plans first, then by expiry, latest first."""
    running = F.coalesce(F.col("plan_expiry") >= ts_lit(as_of), F.lit(False))
    return customers.orderBy(
        "partner_id", F.when(running, 0).otherwise(1), F.col("plan_expiry").desc_nulls_last(), "mobile"
    )


# --- whole view ------------------------------------------------------------------------


def _plan_facts(plans: DataFrame, devices: DataFrame | None = None, by_mobile: DataFrame | None = None) -> DataFrame:
    """Everything known from plan rows, one row per customer, joined with the facts ``by_mobile``.

    Plan rows are shuffled once by mobile: kinds, customers and the join with ``by_mobile`` all follow
    in place. Raw rows are hashed, not sorted: columns of varying width (device, speed) are grouping
    keys of the first step, with the price, of which a customer has few; the plan's start and length
    are a packed pair. The second step picks among a customer's few reduced rows. Rows without a
    mobile are dealt by partner.

    With ``devices``, each row first gets the device of its own account, and the customer that of the
    largest account. As it is a left join of its own, Spark leaves it out where no device is asked for.
    """
    rows = plan_rows(plans)
    if devices is not None:
        known = device_lookup(devices).withColumnRenamed("customer_id", "_account")
        # The account goes through the join once, as the text that is its key there.
        account_type, accounts = rows.schema["account_id"].dataType, rows.withColumn("_account", F.col("account_id").cast("string"))
        rows = left_join_spread(accounts.drop("account_id"), known, ["_account", "partner_id"], by=["mobile", "partner_id"])
        rows = rows.withColumn("account_id", F.col("_account").cast(account_type)).drop("_account")
    rows = rows.withColumn("_deal", _mobile_deal("partner_id")).repartition("mobile", "_deal")
    if devices is not None:
        rows = rows.withColumn("_lookup", F.struct("account_id", "lookup_device_id"))
    facts = PLAN_FACTS if devices is None else PLAN_FACTS | {"_lookup": "max"}
    kinds = rows.groupBy(*PLAN_KIND, "_deal").agg(*[getattr(F, how)(name).alias(name) for name, how in facts.items()])
    largest = IDS if devices is None else (*IDS, "_lookup")
    found = facts_of_kinds(kinds, plans.schema["plan_start_time"].dataType, largest, ("_deal",))
    if devices is not None:
        found = found.withColumn("device_id", F.coalesce("device_id", "_lookup.lookup_device_id")).drop("_lookup")
    if by_mobile is not None:
        found = found.join(by_mobile, ["mobile", "_deal"], "left")
    return found.drop("_deal")


def _mobile_deal(*by: str) -> Column:
    """0 for rows with a mobile; the others are dealt by the columns ``by``.

    The 0 is not a literal, which Spark would take out of the grouping keys, so that tables grouped by
    mobile and this column could not be joined in place.
    """
    zero = F.length("mobile") * 0
    return F.coalesce(zero, F.pmod(F.xxhash64(*by), F.lit(SPREAD)).cast("int") + 1) if by else zero


#: Kinds of plan rows, and how the facts of several rows or parts of a kind become one.
PLAN_KIND = ("mobile", "partner_id", "device_id", "charges", "speed_mbps")
PLAN_FACTS = {"nas_id": "max", "account_id": "max", "_packed": "max", "_rows": "sum"}
IDS = ("nas_id", "device_id", "account_id")


def plan_rows(plans: DataFrame) -> DataFrame:
    """Plan rows as PLAN_KIND and PLAN_FACTS. Of rows without a mobile only the NAS id counts; they are
    one kind per partner."""
    has_mobile = F.col("mobile").isNotNull()
    rows = _own(plans).withColumns({c: F.when(has_mobile, F.col(c)) for c in ("device_id", "charges", "speed_mbps", "account_id")})
    pair = packed(F.col("plan_start_time"), F.col("time_plan"))
    return rows.select(*PLAN_KIND, "nas_id", "account_id", pair.alias("_packed"), F.lit(1).cast("bigint").alias("_rows"))


def facts_of_kinds(
    kinds: DataFrame, time_type: T.DataType, largest: Sequence[str] = IDS, also_by: Sequence[str] = ()
) -> DataFrame:
    """One row per customer out of one row per kind, with the maximum of the columns ``largest``.

    Rows without a mobile form a customer of their own that has ids but, as nothing can be
    matched to a missing mobile, no plan, recharges or device.
    """
    has_mobile = F.col("mobile").isNotNull()
    picked = kinds.groupBy("mobile", "partner_id", *also_by).agg(
        *[F.max(c).alias(c) for c in largest],
        F.max(F.struct("_packed", "charges", "speed_mbps")).alias("_plan"),
        F.sum(F.when(F.col("charges") > 0, F.col("_rows"))).alias("_recharges"),
    )
    start, seconds = unpacked(F.col("_plan._packed"), time_type)
    plan = dict(zip(_PLAN_FIELDS, (start, seconds, F.col("_plan.charges"), F.col("_plan.speed_mbps"))))
    return picked.select(
        "partner_id",
        "mobile",
        *also_by,
        *[F.when(has_mobile, F.col(c)).alias(c) if c in ("device_id", "account_id") else c for c in largest],
        *[F.when(has_mobile, value).alias(name) for name, value in plan.items()],
        F.when(has_mobile, or_zero(F.col("_recharges"))).otherwise(0).alias("recharge_count"),
    )


def known_customers(plans: DataFrame, devices: DataFrame, partners: Ids | None = None) -> DataFrame:
    """Customers (of ``partners``) with their ids and plan, stored in the shared folder."""
    if partners is not None:
        plans, devices = of_ids(plans, partners), of_ids(devices, partners)
    customers = kept(with_device(_plan_facts(plans), devices), "customers")
    return customers if partners is None else of_ids(customers, partners)


def _tagged(df: DataFrame, key: str, facts: dict[str, str], **given: Column) -> DataFrame:
    """``key`` plus all fact columns, NULL where this source does not give one."""
    return df.select(key, *[given.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in facts.items()])


def _mobile_facts(
    bookings: DataFrame,
    booking_events: DataFrame,
    task_events: DataFrame,
    tz_offset_min: int,
    only: Callable[[DataFrame, str], DataFrame],
) -> DataFrame:
    """Name, latest address and install day per mobile, in one shuffle, dealt as ``_plan_facts``.

    ``only`` leaves the asked-for customers' rows. The address is taken apart after the
    aggregation, once per mobile.
    """
    bookings, booking_events, task_events = (only(t, "mobile") for t in (bookings, booking_events, task_events))
    updates = address_updates(booking_events).select("mobile", F.struct("added_time", "address_json").alias("_update"))
    update_type = updates.schema["_update"].dataType.simpleString()
    verified_type = task_events.schema["added_time"].dataType.simpleString()
    facts = {"_name": "string", "_update": update_type, "_verified": verified_type}
    rows = (
        _tagged(names_of(bookings), "mobile", facts, _name=F.col("name"))
        .unionByName(_tagged(updates, "mobile", facts, _update=F.col("_update")))
        .unionByName(_tagged(verifications(task_events), "mobile", facts, _verified=F.col("added_time")))
    )
    picked = rows.groupBy("mobile", _mobile_deal().alias("_deal")).agg(
        F.min("_name").alias("customer_name"), F.max("_update").alias("_update"), F.min("_verified").alias("_verified")
    )
    return picked.select(
        "mobile",
        "_deal",
        "customer_name",
        address_text(F.col("_update.address_json")).alias("address"),
        install_day(F.col("_verified"), tz_offset_min).alias("install_date"),
    )


def _nas_facts(
    daily_usage: DataFrame, optical_readings: DataFrame, only: Callable[[DataFrame, str], DataFrame]
) -> DataFrame:
    """Last usage day and newest optical reading per NAS id, in one shuffle."""
    daily_usage, optical_readings = only(daily_usage, "nas_id"), only(optical_readings, "nas_id")
    facts = {
        "_day": "date",
        "_reading": "struct<date_ist:date,avg_optical_dbm:double,optical_health:string>",
    }
    reading = F.struct("date_ist", "avg_optical_dbm", "optical_health")
    rows = _tagged(daily_usage, "nas_id", facts, _day=F.col("added_date")).unionByName(
        _tagged(optical_readings, "nas_id", facts, _reading=reading)
    )
    picked = (
        rows.filter(F.col("nas_id").isNotNull())
        .groupBy("nas_id")
        .agg(F.max("_day").alias("last_ping"), F.max("_reading").alias("_reading"))
    )
    return picked.select(
        "nas_id",
        "last_ping",
        F.col("_reading.avg_optical_dbm").alias("avg_optical_dbm"),
        F.col("_reading.optical_health").alias("optical_health"),
        F.col("_reading.date_ist").alias("optical_date"),
    )


def customer_360(
    plans: DataFrame,
    devices: DataFrame,
    bookings: DataFrame,
    booking_events: DataFrame,
    daily_usage: DataFrame,
    task_events: DataFrame,
    optical_readings: DataFrame,
    speed_tests: DataFrame,
    as_of: AsOf,
    tz_offset_min: int = IST_MINUTES,
    partners: Ids | None = None,
    stored: bool = False,
) -> DataFrame:
    """One row per customer: name, address, install day, last ping, plan, status and signal.

    Expiry is shifted by ``tz_offset_min`` and then compared with the unshifted ``as_of``.

    With ``stored``, the joined rows of the whole view are computed first, step by step, into the shared
    folder: for reports that read all its columns, or read it twice, and for disks that do not hold the
    shuffle files of the whole view at once (``_joined_in_steps``).

    ``partners`` (a list of ids, or a table with them in its first column) restricts the view. Their
    customers are then computed first, into the shared folder, and of the side tables only these
    customers' rows are aggregated and shuffled.
    """
    by_mobile = (bookings, booking_events, task_events, tz_offset_min)
    if stored and partners is None:
        only = lambda rows, key: rows
        signals = (_nas_facts(daily_usage, optical_readings, only), newest_speed(speed_tests))
        return finish(_joined_in_steps(plans, devices, _mobile_facts(*by_mobile, only), *signals), as_of, tz_offset_min)
    if partners is None:
        only = lambda rows, key: rows
        joined = _plan_facts(plans, devices, _mobile_facts(*by_mobile, only))
    else:
        facts = known_customers(plans, devices, partners)
        only = lambda rows, key: of_keys(rows, facts, key)
        joined = left_join_spread(facts, _mobile_facts(*by_mobile, only).drop("_deal"), ["mobile"], by=["mobile", "partner_id"])
    for other, key in (
        (_nas_facts(daily_usage, optical_readings, only), "nas_id"),
        (newest_speed(only(speed_tests, "device_id")).withColumnsRenamed({"speed": "actual_speed_mbps"}), "device_id"),
    ):
        joined = left_join_spread(joined, other, [key], by=["mobile", "partner_id"])
    return finish(joined, as_of, tz_offset_min)


#: What a customer has by its NAS id and by its device, in a column each.
_SIGNALS = {
    "_nas": ("last_ping", "avg_optical_dbm", "optical_health", "optical_date"),
    "_speed": ("speed", "latency", "jitter", "tested_on"),
}

#: Stores a table under a name.
Keep = Callable[[DataFrame, str], DataFrame]


def found_signals(
    ids: DataFrame, devices: DataFrame, by_nas: DataFrame, by_device: DataFrame, keep: Keep, keep_ids: Keep
) -> DataFrame:
    """The customers of ``ids`` that have a row in ``by_nas`` or ``by_device``, as columns of _SIGNALS; of
    a customer with both there are two rows.

    Customers without a device alone meet the device table, and only what is found goes on.
    """
    key = ("mobile", "partner_id")
    ids = ids.withColumns({c: F.when(F.col("mobile").isNotNull(), F.col(c)) for c in ("device_id", "account_id")})
    has_device = F.col("device_id").isNotNull()
    lacking = ids.filter(~has_device & F.col("account_id").isNotNull())
    looked_up = keep_ids(with_device(lacking, devices).filter(has_device).select(*key, "device_id"), "looked-up")
    in_use = ids.filter(has_device).select(*key, "device_id").union(looked_up)
    nas, speed = (F.struct(*names).alias(signal) for signal, names in _SIGNALS.items())
    on_nas = keep(ids.select(*key, "nas_id").join(by_nas, "nas_id").select(*key, nas), "on-nas")
    on_device = keep(in_use.join(by_device, "device_id").select(*key, speed), "on-device")
    return on_nas.unionByName(on_device, allowMissingColumns=True)


def _joined_in_steps(
    plans: DataFrame, devices: DataFrame, by_mobile: DataFrame, by_nas: DataFrame, by_device: DataFrame
) -> DataFrame:
    """The joins of the whole view, stored, with no more on disk than a step needs.

    In one plan, the rows of all customers are shuffled once per join with all their columns, and these
    files lie on disk until the last join is done. Here the ids alone are joined first. What they find
    meets the plan rows, this time without ids, in the shuffle by mobile; customers and the join with the
    facts ``by_mobile`` follow in place. Each step is stored and its shuffle files go; tables that only
    later steps read go after these.
    """
    spark = plans.sparkSession
    with passing(spark) as keep:
        with passing(spark) as keep_ids:
            ids = keep_ids(partner_mobiles(plans.repartition("mobile", "partner_id")), "ids")
            signals = found_signals(ids, devices, by_nas, by_device, keep, keep_ids)
        by_mobile = keep(by_mobile, "by-mobile")
        return kept(shown_signals(_plans_with_signals(plans, signals).join(by_mobile, ["mobile", "_deal"], "left")), "customers")


def _plans_with_signals(plans: DataFrame, signals: DataFrame) -> DataFrame:
    """``_plan_facts`` without ids, and the signals, dealt by mobile."""
    has_mobile, n = F.col("mobile").isNotNull(), F.lit(1).cast("bigint")
    rows = _own(plans).select("mobile", "partner_id", *[F.when(has_mobile, F.col(c)).alias(c) for c in _PLAN_FIELDS], n.alias("_rows"))
    rows = rows.unionByName(signals, allowMissingColumns=True).withColumn("_deal", _mobile_deal("partner_id"))
    # The packed pair is wider than its parts, so it is made after the shuffle.
    dealt = rows.repartition("mobile", "_deal").withColumn("_packed", packed(F.col("plan_start_time"), F.col("time_plan")))
    by = ("mobile", "partner_id", "_deal", "charges", "speed_mbps", *_SIGNALS)
    kinds = dealt.groupBy(*by).agg(F.max("_packed").alias("_packed"), F.sum("_rows").alias("_rows"))
    return facts_of_kinds(kinds, plans.schema["plan_start_time"].dataType, tuple(_SIGNALS), ("_deal",))


def shown_signals(customers: DataFrame) -> DataFrame:
    """The columns of _SIGNALS taken apart."""
    parts = [F.col(f"{signal}.{name}") for signal, names in _SIGNALS.items() for name in names]
    return customers.select("*", *parts).drop(*_SIGNALS, "_deal").withColumnRenamed("speed", "actual_speed_mbps")


def finish(joined: DataFrame, as_of: AsOf, tz_offset_min: int = IST_MINUTES) -> DataFrame:
    """The columns of the view out of plan facts joined with all others."""
    shown = _plan_columns(F.col("plan_start_time"), F.col("time_plan"), tz_offset_min)
    # A ping needs a known mobile; an optical reading only needs the NAS id.
    ping = F.when(F.col("mobile").isNotNull(), F.col("last_ping"))
    return plan_status(joined.withColumns({**shown, "last_ping": ping}), as_of).select(
        "partner_id",
        "mobile",
        F.coalesce("customer_name", "mobile").alias("name"),
        "address",
        "install_date",
        "last_ping",
        "last_recharge",
        "recharge_count",
        "plan_expiry",
        "plan_details",
        "days_since_expiry",
        "status",
        "avg_optical_dbm",
        "optical_health",
        "optical_date",
        "actual_speed_mbps",
        "latency",
        "jitter",
        "tested_on",
    )


def signal_summary(customers: DataFrame) -> DataFrame:
    """Per partner: customers with an optical reading, its mean, share of 'Good', same for speed."""
    optical, speed = not_nan(F.col("avg_optical_dbm")), not_nan(F.col("actual_speed_mbps"))
    good = F.count_if(optical.isNotNull() & (F.col("optical_health") == "Good"))
    return customers.groupBy("partner_id").agg(
        F.count(optical).alias("optical_n"),
        F.avg(optical).alias("avg_optical"),
        percent(good, F.count(optical)).alias("optical_good_pct"),
        F.count(speed).alias("speed_n"),
        F.avg(speed).alias("avg_speed"),
    )


def customer_status_counts(customers: DataFrame) -> DataFrame:
    status = F.col("status")
    return customers.groupBy("partner_id").agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(status == "Active").alias("active_customers"),
        F.count_if(status == "Expired").alias("expired_customers"),
        F.count_if(status == "No Plan").alias("no_plan_customers"),
    )


def customer_report(customers: DataFrame) -> DataFrame:
    """The view as display text."""

    def cut(name: str, length: int) -> Column:
        return or_dash(F.substring(F.col(name).cast("string"), 1, length))

    def one_decimal(name: str) -> Column:
        return F.coalesce(fixed(not_nan(F.col(name)), 1), F.lit(DASH))

    since = F.concat(F.col("days_since_expiry").cast("string"), F.lit("d ago"))
    return customers.select(
        "partner_id",
        F.col("mobile").alias("Mobile"),
        F.col("name").alias("Name"),
        cut("address", 60).alias("Address"),
        cut("install_date", 10).alias("Installed On"),
        cut("last_ping", 10).alias("Last Ping"),
        cut("last_recharge", 16).alias("Last Recharge"),
        or_zero(F.col("recharge_count")).alias("Recharges"),
        cut("plan_expiry", 16).alias("Plan Expiry"),
        or_dash(F.col("plan_details")).alias("Plan"),
        F.when(F.col("status") == "Active", F.lit("Active ✓")).otherwise(F.coalesce(since, F.lit(DASH))).alias("Since Expiry"),
        F.col("status").alias("Status"),
        one_decimal("avg_optical_dbm").alias("Optical (dBm)"),
        F.coalesce("optical_health", F.lit(DASH)).alias("Optical Health"),
        one_decimal("actual_speed_mbps").alias("Speed (Mbps)"),
    )
