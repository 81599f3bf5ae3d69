"""Kept state against a full recomputation over the whole history."""

import re
import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from fibrelens.operators import city, customers, payouts, wallet
from fibrelens.plans.refresh import FACTS, CustomerState
from fibrelens.plans.reports import customers_of
from fibrelens.plans.testbed import AS_OF, LOADS, Testbed
from fibrelens.session import new_table_path
from tests.helpers import new_shuffle_files, shuffle_files

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bed(spark):
    return Testbed(spark, SMALL)


@pytest.fixture(scope="module")
def landing(spark, bed):
    """The loads as tables partitioned by load day, as in real use."""
    out = {}
    for name in {fact.source for fact in FACTS.values()} | {"ledger_old", "ledger_new"}:
        path = new_table_path(spark, f"landing-{name}")
        bed.landing()[name].write.partitionBy("load_day").parquet(path)
        out[name] = spark.read.parquet(path)
    return out


def fresh(spark, root=None):
    return CustomerState(spark, root or new_table_path(spark, "state"), f"state_{uuid.uuid4().hex}", buckets=4)


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def same_as_whole(state, bed, upto):
    """All reports of the state against the operators over all rows of the loads up to a day."""
    whole = {name: df.filter(F.col("load_day") <= F.lit(upto)).drop("load_day") for name, df in bed.landing().items()}
    roster = city.city_roster(bed["roster"], bed.cities())
    assert rows(state.customer_360(AS_OF)) == rows(customers_of(whole, AS_OF))
    assert rows(state.last_ping()) == rows(customers.last_ping(whole["daily_usage"], whole["plans"]))
    assert rows(state.recharge_counts(roster)) == rows(city.recharge_counts(whole["plans"], roster))
    assert rows(state.fixed_payout_monthly(AS_OF)) == rows(payouts.fixed_payout_monthly(whole["disbursements"], AS_OF))
    assert rows(state.wallet_transactions()) == rows(wallet.wallet_transactions(whole["ledger_old"], whole["ledger_new"]))


def test_each_refresh_equals_a_full_recomputation(spark, bed, landing):
    state = fresh(spark)
    assert state.mark() is None
    with pytest.raises(ValueError, match="no refresh"):
        state.customer_360(AS_OF)
    assert state.advance(landing, LOADS[0]) and state.mark() == LOADS[0]
    assert state.advance(landing, LOADS[2]) and state.mark() == LOADS[2]  # two loads at once
    same_as_whole(state, bed, LOADS[2])
    assert not state.advance(landing, LOADS[2])
    before = rows(state.customer_360(AS_OF)), rows(state.wallet_transactions())
    state.compact()
    # Another session finds the state by its files.
    again = fresh(spark, state.root)
    assert again.mark() == LOADS[2]
    assert (rows(again.customer_360(AS_OF)), rows(again.wallet_transactions())) == before


def counts(state):
    return rows(state.recharge_count()), rows(state.fixed_payout_monthly(AS_OF))


def test_a_failed_refresh_is_neither_seen_nor_counted_twice(spark, bed, landing, monkeypatch):
    state = fresh(spark)
    state.advance(landing, LOADS[0])
    before = counts(state)

    def fail(self, *given):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(CustomerState, "_commit", fail)
        with pytest.raises(RuntimeError):
            state.advance(landing, LOADS[1])
    assert counts(state) == before
    again = fresh(spark, state.root)
    assert again.mark() == LOADS[0]
    assert again.advance(landing, LOADS[1])
    whole = {name: df.filter(F.col("load_day") <= F.lit(LOADS[1])) for name, df in bed.landing().items()}
    assert counts(again) == (rows(customers.recharge_count(whole["plans"])), rows(payouts.fixed_payout_monthly(whole["disbursements"], AS_OF)))


def test_sources_without_rows(spark, landing):
    empty = {name: df.filter("false") for name, df in landing.items()}
    state = fresh(spark)
    state.advance(empty | {"plans": landing["plans"]}, LOADS[0])
    again = fresh(spark, state.root)
    for kept in (state, again):
        seen = kept.customer_360(AS_OF).agg(F.count(F.lit(1)).alias("n"), F.count("tested_on").alias("tests"), F.count("address").alias("homes")).first()
        assert seen.n > 0 == seen.tests == seen.homes
        assert kept.wallet_transactions().count() == kept.fixed_payout_monthly(AS_OF).count() == 0
    again.advance(landing, LOADS[1])
    assert again.customer_360(AS_OF).filter("address is not null").count() > 0


def test_only_loads_beyond_the_mark_are_read(spark, bed, landing):
    state = fresh(spark)
    state.advance(landing, LOADS[0])
    kept = state.facts("plan_kinds").agg(F.sum("_rows")).first()[0]
    # Load 0 comes again with other contents, which must not count; load 1 is empty.
    other = {name: df.filter(F.col("load_day") == F.lit(LOADS[2])).withColumn("load_day", F.lit(LOADS[0])) for name, df in landing.items()}
    assert state.advance(other, LOADS[1]) and state.mark() == LOADS[1]
    assert state.facts("plan_kinds").agg(F.sum("_rows")).first()[0] == kept
    assert not state.advance(other, date(2001, 7, 1))


def test_the_number_of_buckets_follows_the_kept_rows(spark, bed, landing):
    state = CustomerState(spark, new_table_path(spark, "state"), f"state_{uuid.uuid4().hex}", buckets=2, bucket_rows=700)
    state.advance(landing, LOADS[0])
    assert 7 <= state.facts("plan_kinds").rdd.getNumPartitions() <= 10  # about 6,000 kinds in all loads
    state.advance(landing, LOADS[2])
    same_as_whole(state, bed, LOADS[2])
    # Another session goes by the number in the mark; a compaction sets it anew.
    again = CustomerState(spark, state.root, f"state_{uuid.uuid4().hex}", buckets=3, bucket_rows=2000)
    same_as_whole(again, bed, LOADS[2])
    again.compact()
    assert again.facts("plan_kinds").rdd.getNumPartitions() in (3, 4)
    same_as_whole(again, bed, LOADS[2])


def test_customer_facts_are_joined_without_a_shuffle(spark, landing):
    state = fresh(spark)
    for day in LOADS:
        state.advance(landing, day)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = state.customer_360(AS_OF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*()0123456789")) for line in lines]

    def above(at):
        """Operators from a scan up to the topmost join by mobile."""
        path, level = [], depth[at]
        for back in range(at - 1, -1, -1):
            if depth[back] < level:
                level = depth[back]
                path.append(lines[back])
        joins = [i for i, line in enumerate(path) if re.search(r"SortMergeJoin \[mobile#\d+\]", line)]
        return path[: max(joins) + 1] if joins else path

    for part in ("plan_kinds", "names", "addresses", "verified"):
        at = next(i for i, line in enumerate(lines) if "FileScan" in line and f"_{part}_" in line)
        assert "Bucketed: true" in lines[at]
        path = above(at)
        assert "SortMergeJoin" in path[-1] and not any("Exchange" in line for line in path), plan


@pytest.fixture
def odd_landing(table):
    """Loads with rows that lack a mobile, NAS id, device or account."""
    some = lambda i, k, value: None if i % k == 0 else value
    days = [f"2001-06-{1 + i % 9:02d}" for i in range(60)]
    given = {
        "plans": lambda i: dict(
            partner_id=i % 3 or None, mobile=some(i, 7, f"m{i % 11}"), nas_id=some(i, 5, i % 6), device_id=some(i, 2, f"D{i % 9}"), account_id=some(i, 4, i % 13),
            plan_start_time=some(i, 10, f"{days[i]} 00:00:00"), time_plan=some(i, 9, i * 86400), charges=i % 4, speed_mbps=some(i, 6, str(i % 3)),
        ),
        "devices": lambda i: dict(partner_id=i % 3, customer_id=some(i, 8, str(i % 13)), device_id=f"D{i % 7}"),
        "bookings": lambda i: dict(mobile=some(i, 9, f"m{i % 5}"), name=f"N{i}", is_deleted=i % 2 == 0),
        "booking_events": lambda i: dict(mobile=some(i, 9, f"m{i % 7}"), event_name="address_updated", data='{"address": "{\\"home\\": \\"H%d\\"}"}' % i, added_time=f"{days[i]} 00:00:00"),
        "task_events": lambda i: dict(mobile=some(i, 9, f"m{i % 6}"), event_name="OTP_VERIFIED", added_time=f"{days[i]} 00:00:00"),
        "daily_usage": lambda i: dict(nas_id=some(i, 9, i % 4), added_date=days[i]),
        "optical_readings": lambda i: dict(nas_id=some(i, 9, 2 + i % 4), date_ist=days[i], avg_optical_dbm=-float(i)),
        "speed_tests": lambda i: dict(device_id=some(i, 9, f"D{i % 8}"), tested_on=f"{days[i]} 00:00:00", speed=float(i)),
    }
    row = {name: given.get(name, lambda i: {}) for name in [*{fact.source for fact in FACTS.values()}, "ledger_old", "ledger_new"]}
    tables = {name: table(name, [build(i) for i in range(60)]) for name, build in row.items()}
    day = F.lit(LOADS[0]) + F.pmod(F.monotonically_increasing_id(), F.lit(3)).cast("int")
    return {name: df.withColumn("load_day", day) for name, df in tables.items()}


def test_the_stored_view_out_of_the_state_is_the_view(spark, odd_landing):
    state = fresh(spark)
    for day in LOADS:
        state.advance(odd_landing, day)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = state.customer_360(AS_OF, stored=True)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    whole = customers_of({name: df.drop("load_day") for name, df in odd_landing.items()}, AS_OF)
    assert rows(stored) == rows(state.customer_360(AS_OF)) == rows(whole)
    found = stored.agg(*[F.count_if(F.col(c).isNotNull()).alias(c) for c in ("last_ping", "actual_speed_mbps", "address")]).first()
    assert all(found) and stored.filter("mobile is null and avg_optical_dbm is not null").count() > 0
    assert "Exchange" not in stored._jdf.queryExecution().executedPlan().toString()


def test_shuffle_files_go_with_each_table_of_a_load(spark, landing, tmp_path, monkeypatch):
    monkeypatch.setattr("fibrelens.session.shared_folder", lambda spark: str(tmp_path / "steps"))
    state, put, seen = fresh(spark, f"{tmp_path}/state"), CustomerState._put, {}

    def watched(self, part, *given):
        before = shuffle_files(spark)
        put(self, part, *given)
        seen[part] = new_shuffle_files(spark, before)

    monkeypatch.setattr("fibrelens.plans.refresh.WRITERS", 1)
    monkeypatch.setattr(CustomerState, "_put", watched)
    for day in LOADS[:2]:
        state.advance(landing, day)
        assert seen.keys() >= FACTS.keys() and not any(seen.values()), seen
    before = shuffle_files(spark)
    stored = state.customer_360(AS_OF, stored=True)
    assert not new_shuffle_files(spark, before)
    assert [path.name.split("-")[0] for path in (tmp_path / "steps").iterdir()] == ["customers"]
    assert stored.count() == state.customer_360(AS_OF).count()
