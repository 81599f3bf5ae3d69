from datetime import datetime
from decimal import Decimal as D

import pytest

from fibrelens.functions import times, values
from fibrelens.session import TASK_BYTES, checkpointed, settings_for
from fibrelens.sources.dimensions import ZONES
from fibrelens.sources.schemas import TABLES
from fibrelens.sources.tables import conform, load_catalog_table, load_table, load_tables, table_schema
from pyspark.sql import Observation
from pyspark.sql import functions as F


def test_all_sixteen_tables_have_a_schema(spark):
    assert len(TABLES) == 16
    for name in TABLES:
        assert len(table_schema(name)) >= 2
    assert len(ZONES) == 10


def test_conform_names_types_and_extra_columns(frame):
    raw = frame(
        [("12.0", 7, 1, "2024-01-01 10:00:00", None, 86400, "499.99", 50, "junk")],
        "LCO_ACCOUNT_ID string, Mobile bigint, NAS_ID int, PLAN_START_TIME string, DEVICE_ID string, TIME_PLAN int, charges string, SPEED_MBPS int, other string",
    ).withColumn("account_id", F.lit(9.0))
    row = conform(raw, "plans").first()
    assert row.asDict() == dict(
        partner_id=12, mobile="7", nas_id=1, device_id=None, account_id=9, plan_start_time=datetime(2024, 1, 1, 10),
        time_plan=86400, charges=D("499.99"), speed_mbps="50",
    )
    assert conform(raw, "plans").columns == table_schema("plans").fieldNames()


def test_conform_tolerates_bad_ids_and_rejects_missing_columns(frame):
    rows = frame([("x", "2024-01-01"), ("nan", None), ("9007199254740993", "bad")], "NASID string, added_date string")
    got = conform(rows, "daily_usage").collect()
    assert [r.nas_id for r in got] == [None, None, 9007199254740993]
    assert [str(r.added_date) for r in got] == ["2024-01-01", "None", "None"]
    with pytest.raises(ValueError, match="added_date"):
        conform(frame([(1,)], "nas_id bigint"), "daily_usage")


def test_loaders(spark, table, tmp_path):
    df = table("daily_usage", [dict(nas_id=1, added_date="2024-01-01")])
    for fmt in ("parquet", "orc", "json"):
        df.write.format(fmt).save(f"{tmp_path}/{fmt}/daily_usage")
        assert load_table(spark, "daily_usage", f"{tmp_path}/{fmt}/daily_usage", fmt).collect() == df.collect()
    assert load_tables(spark, f"{tmp_path}/parquet", ["daily_usage"])["daily_usage"].count() == 1
    df.createOrReplaceTempView("usage_view")
    assert load_catalog_table(spark, "daily_usage", "usage_view").count() == 1


def test_forgiving_values(frame):
    df = frame([("3.9",), ("-3.9",), ("nan",), ("x",), (None,), ("1e30",), ("12",)], "v string")
    got = df.select(values.safe_long(F.col("v")).alias("i"), values.safe_double(F.col("v")).alias("f")).collect()
    assert [r.i for r in got] == [3, -3, 0, 0, 0, 0, 12]
    assert [r.f for r in got] == [3.9, -3.9, 0.0, 0.0, 0.0, 1e30, 12.0]
    numbers = frame([(0.25, 1234.5), (None, None), (-1000.75, -2.5)], "a double, b double")
    got = numbers.select(values.fixed(F.col("a"), 1).alias("a"), values.money(F.col("b")).alias("b"), values.whole_percent(F.col("a")).alias("p")).collect()
    assert [r.a for r in got] == ["0.2", None, "-1000.8"]
    assert [r.b for r in got] == ["₹1,234", "₹0", "₹-2"]
    assert [r.p for r in got] == ["0%", "—", "-1001%"]
    assert numbers.select(values.ratio(F.lit(1), F.lit(0)).alias("r")).first().r is None


def test_months():
    assert [times.month_key("2024-02-29 23:00:00", k) for k in (-1, 0, 1, 2, 3)] == ["2024-03", "2024-02", "2024-01", "2023-12", "2023-11"]
    assert times.month_label("2024-01-15", 1) == "Dec 2023"
    assert times.days_before("2024-03-15 12:00:00", 30) == datetime(2024, 2, 14)
    with pytest.raises(ValueError):
        times.as_datetime("2024-01-01T00:00:00+05:30")


def test_day_gap_counts_boundaries(frame):
    df = frame([(datetime(2024, 1, 1, 23), datetime(2024, 1, 2, 1))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(times.day_gap(F.col("b"), F.col("a")).alias("d")).first().d == 1


def test_shuffle_sizing():
    small, huge = settings_for(10**9), settings_for(20 * 10**12)
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert small[key] == "200"
    assert int(huge[key]) * TASK_BYTES >= 20 * 10**12


def test_checkpoint_folder_is_the_sessions_own(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    got = checkpointed(spark.range(5))
    assert got.count() == 5
    assert any(tmp_path.rglob("part-*"))


def test_times_with_a_zone_need_a_session_in_utc(spark, frame):
    rows = frame([("m", "e", datetime(2024, 1, 1))], "mobile string, event_name string, added_time timestamp")
    plain = rows.withColumn("added_time", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        with pytest.raises(ValueError, match="added_time has a zone"):
            conform(rows, "task_events")
        assert str(conform(plain, "task_events").first().added_time) == "2024-01-01 00:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert conform(rows, "task_events").count() == 1


def test_values_lost_by_conversion_are_reported_without_a_second_pass(spark, frame):
    passes = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (passes.add(1), x)[1], "string")
    raw = frame(
        [("12", "m1", "7"), ("x", "m2", "8.5"), ("nan", "m3", None), (None, "m4", "n/a")],
        "partner_id string, customer_id string, device_id string",
    ).withColumns({"partner_id": seen("partner_id"), "location": F.lit("customer"), "user_churn_date": F.lit("2024-13-01")})
    lost = Observation("devices")
    told = conform(raw, "devices", lost=lost).collect()
    assert lost.get == {"rows": 4, "partner_id": 2, "user_churn_date": 4}
    assert passes.value == 4
    assert sorted(map(repr, told)) == sorted(map(repr, conform(raw, "devices").collect()))


def test_nothing_lost_is_reported_as_such(frame):
    lost = Observation("usage")
    assert conform(frame([(1, "2024-01-01")], "nas_id bigint, added_date string"), "daily_usage", lost=lost).count() == 1
    conform(frame([(1, "2024-01-01")], "nas_id bigint, added_date string"), "daily_usage", lost=(full := Observation("full"))).collect()
    assert full.get == {"rows": 1, "added_date": 0}
