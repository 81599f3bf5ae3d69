"""The daily refresh: reports out of kept state instead of the whole history.

Source tables arrive in loads, one per ``load_day``; a load may hold rows of any event time, so late
rows are ordinary. The state holds *partials*: per load, each source reduced to what the reports
need, by sums, counts, maxima and minima, which can be merged in any order. Partials of all loads
stand in one table per source, partitioned by load and bucketed by the key they are joined on. So

- a refresh reads only rows beyond the high-water mark and adds one partition to each table,
- a report merges all partials bucket by bucket, without a shuffle, and the facts of a customer
  (plan, name, address, install day; all bucketed by mobile) are joined in place,
- one hot mobile or partner is a few rows of partials, never its raw rows,
- while a load is written, a table's rows are shuffled once at a time, and the files go with each job,
- a bucket is what a task holds, so the number of buckets follows the number of plan kinds: it is set
  by the first load and by each compaction, and stands in the mark.

The mark is written last. A refresh that failed before it leaves partitions that no report reads and
that the next attempt overwrites; a load at or below the mark is not taken again. ``compact`` merges
all partials into those of the mark's load, in new tables.

Tables are created in the session's catalog with files under ``root``; ``CustomerState`` finds them
again in a later session by these files.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from fibrelens.functions.joins import left_join_spread
from fibrelens.functions.picks import salted_top_n
from fibrelens.functions.times import AsOf, month_of
from fibrelens.operators import city, customers, payouts, wallet
from fibrelens.session import kept, passing, remove, shuffles_dropped, with_conf
from fibrelens.sources.tables import table_schema

LOAD = "load_day"
#: Least number of buckets, and kept plan rows in one.
BUCKETS, BUCKET_ROWS = 64, 1 << 19
#: Tables of a load that are written side by side, so that one's last tasks leave no core idle.
WRITERS = 3
COMPRESSION = "zstd"
MARK = "load_day date, generation int, buckets int"


class Mark(NamedTuple):
    """Load day and generation of the last complete refresh or compaction, and the tables' buckets; no
    number in a mark of the time when it was fixed."""

    load_day: date | None
    generation: int
    buckets: int | None


class Fact(NamedTuple):
    """How a source is kept: its table, bucket key, merge keys, merged columns, and rows to start from."""

    source: str
    bucket: str
    keys: tuple[str, ...]
    merges: dict[str, str]
    rows: Callable[[DataFrame], DataFrame]


def _known(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull())


FACTS: dict[str, Fact] = {
    "plan_kinds": Fact("plans", "mobile", customers.PLAN_KIND, customers.PLAN_FACTS, customers.plan_rows),
    "names": Fact(
        "bookings", "mobile", ("mobile",), {"customer_name": "min"},
        lambda t: customers.names_of(t).select("mobile", F.col("name").alias("customer_name")),
    ),
    "addresses": Fact(
        "booking_events", "mobile", ("mobile",), {"update": "max"},
        lambda t: customers.address_updates(t).select("mobile", F.struct("added_time", "address_json").alias("update")),
    ),
    "verified": Fact(
        "task_events", "mobile", ("mobile",), {"verified": "min"},
        lambda t: customers.verifications(t).select("mobile", F.col("added_time").alias("verified")),
    ),
    "usage": Fact(
        "daily_usage", "nas_id", ("nas_id",), {"last_ping": "max"},
        lambda t: _known(t, "nas_id").select("nas_id", F.col("added_date").alias("last_ping")),
    ),
    "optical": Fact(
        "optical_readings", "nas_id", ("nas_id",), {"reading": "max"},
        lambda t: _known(t, "nas_id").select("nas_id", F.struct("date_ist", "avg_optical_dbm", "optical_health").alias("reading")),
    ),
    "speeds": Fact(
        "speed_tests", "device_id", ("device_id",), {"test": "max"},
        lambda t: _known(t, "device_id").select("device_id", F.struct("tested_on", "speed", "latency", "jitter").alias("test")),
    ),
    "known_devices": Fact(
        "devices", "customer_id", ("customer_id", "partner_id"), {"device_id": "max"},
        lambda t: _known(_known(t, "partner_id"), "customer_id").select("customer_id", "partner_id", "device_id"),
    ),
    "payouts": Fact(
        "disbursements", "partner_id", ("partner_id", "month", "bonus_status"), {"amount": "sum", "n_rows": "sum"},
        lambda t: payouts.payable(t).select(
            "partner_id", month_of(F.col("added_time")).alias("month"), "bonus_status",
            F.col("amount").cast("decimal(38,2)").alias("amount"), F.lit(1).cast("bigint").alias("n_rows"),
        ),
    ),
}

#: Ledgers are kept as each load's newest rows per partner, in the order of the statement.
LEDGERS = {
    "ledger_old": ("added_at_ist", "remark", "action", "balance", "credit_delta"),
    "ledger_new": ("added_time", "remark", "action", "balance", "balance - old_balance"),
}


class CustomerState:
    """Kept state under ``root``; ``name`` starts the names of its tables in the catalog.

    ``buckets`` is the least number of buckets, ``bucket_rows`` the number of kept plan rows for which
    there is one. An object sees the state as it first found it, or as it has advanced it since.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.root, self.name, self.buckets, self.bucket_rows = spark, root.rstrip("/"), name, buckets, bucket_rows
        self._marks = f"{self.root}/marks"
        self._last: Mark | None = None

    # --- the mark

    def _committed(self) -> Mark:
        if self._last is None:
            marks = self._found(self._marks, MARK)
            last = marks and marks.agg(F.max(F.struct("generation", "load_day", "buckets")).alias("last")).first()["last"]
            self._last = Mark(last["load_day"], last["generation"], last["buckets"]) if last else Mark(None, 0, None)
        return self._last

    def _found(self, path: str, schema: str | None = None) -> DataFrame | None:
        """The table at ``path``, None before anything was written there."""
        try:
            return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(path)
        except AnalysisException as problem:
            if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def mark(self) -> date | None:
        """The last load that the state contains."""
        return self._committed().load_day

    def _commit(self, mark: Mark) -> None:
        self.spark.createDataFrame([mark], MARK).coalesce(1).write.mode("append").parquet(self._marks)
        self._last = mark

    def _buckets_for(self, kept_rows: int) -> int:
        return max(self.buckets, -(-kept_rows // self.bucket_rows))

    # --- writing

    def _place(self, part: str, mark: Mark) -> tuple[str, str, int]:
        """Name, folder and buckets of a table of the mark's generation."""
        suffix = f"{part}_{mark.generation}" + (f"_{mark.buckets}" if mark.buckets else "")
        return f"{self.name}_{suffix}", f"{self.root}/{suffix}", mark.buckets or self.buckets

    def _put(self, part: str, bucket: str, rows: DataFrame, mark: Mark) -> None:
        """Write one load's partition, that of the coming ``mark``, in place of an earlier attempt's."""
        table, path, buckets = self._place(part, mark)
        if self._open(part, mark):
            self.spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({LOAD} = DATE'{mark.load_day}')")
            remove(self.spark, f"{path}/{LOAD}={mark.load_day}")
        else:
            remove(self.spark, path)  # a folder without rows may be left of an earlier session's load without rows
            self._create(part, rows.withColumn(LOAD, F.lit(mark.load_day)).schema, mark)
        with passing(self.spark) as keep:
            if part in FACTS and len(FACTS[part].keys) > 1:  # nearly as many rows as are merged
                rows = keep(rows, part)
            dealt = rows.repartition(buckets, bucket)  # a task writes one file, that of its bucket
            # Of the ways to write a table, only this one lets the shuffle files go when it ends.
            dealt.withColumn(LOAD, F.lit(mark.load_day)).write.insertInto(table)

    def _put_all(self, facts: Callable[[str], DataFrame], ledgers: Callable[[str], DataFrame], mark: Mark) -> None:
        """Write the partitions of all tables, some tables at a time, and then the mark."""
        writes = [(part, fact.bucket, facts(part)) for part, fact in FACTS.items()]
        writes += [(ledger, "partner_id", ledgers(ledger)) for ledger in LEDGERS]
        put = inheritable_thread_target(self.spark)(lambda write: self._put(*write, mark))
        with shuffles_dropped(self.spark), ThreadPoolExecutor(WRITERS) as pool:
            put(writes[0])  # the plan kinds, whose shuffle files are the largest, by themselves
            for done in [pool.submit(put, write) for write in writes[1:]]:
                done.result()
        self._commit(mark)

    def _open(self, part: str, mark: Mark) -> bool:
        """Whether the table is in the catalog; files of an earlier session are made known to it."""
        table, path, _ = self._place(part, mark)
        if self.spark.catalog.tableExists(table):
            return True
        files = self._found(path)
        if files is None:
            return False
        self._create(part, files.schema, mark)
        self.spark.sql(f"MSCK REPAIR TABLE {table}")
        return True

    def _create(self, part: str, schema: T.StructType, mark: Mark) -> None:
        table, path, buckets = self._place(part, mark)
        bucket = FACTS[part].bucket if part in FACTS else "partner_id"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        self.spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet OPTIONS (compression '{COMPRESSION}') PARTITIONED BY ({LOAD}) "
            f"CLUSTERED BY ({bucket}) SORTED BY ({bucket}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def advance(self, landing: Mapping[str, DataFrame], load_day: date) -> bool:
        """Take all rows of ``landing`` with mark < load_day <= ``load_day``; False if there is nothing to do.

        Landing tables have the columns of the logical tables and ``load_day``, by which they should
        be partitioned, so that only new loads are read.
        """
        mark, generation, buckets = self._committed()
        if mark is not None and load_day <= mark:
            return False
        new = F.col(LOAD) <= F.lit(load_day)
        if mark is not None:
            new = new & (F.col(LOAD) > F.lit(mark))
        else:  # all that lies in the landing table will be in the state
            buckets = self._buckets_for(landing["plans"].agg(F.approx_count_distinct(F.xxhash64(*customers.PLAN_KIND))).first()[0])
        facts = lambda part: _merged(FACTS[part].rows(landing[FACTS[part].source].filter(new)), FACTS[part])
        rows = lambda ledger: landing[ledger].filter(new & F.col("partner_id").isNotNull()).drop(LOAD)
        self._put_all(facts, lambda ledger: _newest_rows(rows(ledger), ledger), Mark(load_day, generation, buckets))
        return True

    def compact(self) -> None:
        """Merge the partials of all loads into one partition each, in new tables."""
        mark, generation, _ = self._committed()
        if mark is None:
            return
        buckets = self._buckets_for(self.facts("plan_kinds").count())
        newest = lambda ledger: _newest_rows(self._partials(ledger), ledger)
        self._put_all(self.facts, newest, Mark(mark, generation + 1, buckets))

    # --- reading

    def _partials(self, part: str) -> DataFrame:
        mark = self._committed()
        if mark.load_day is None:
            raise ValueError(f"no refresh has been completed under {self.root}")
        if not self._open(part, mark):  # no load had rows, and no file tells the schema
            source = FACTS[part].source if part in FACTS else part
            none = self.spark.createDataFrame([], table_schema(source))
            return _merged(FACTS[part].rows(none), FACTS[part]) if part in FACTS else none
        return self.spark.table(self._place(part, mark)[0]).filter(F.col(LOAD) <= F.lit(mark.load_day)).drop(LOAD)

    def facts(self, part: str) -> DataFrame:
        """The merged facts of one source."""
        return _merged(self._partials(part), FACTS[part])

    def customer_360(self, as_of: AsOf, tz_offset_min: int = customers.IST_MINUTES, stored: bool = False) -> DataFrame:
        """``customers.customer_360`` out of the state. Up to the joins by mobile nothing is shuffled.

        With ``stored``, the joined rows are computed first, step by step, into the shared folder.
        """
        by_mobile = {
            "address": customers.address_text(F.col("update.address_json")),
            "install_date": customers.install_day(F.col("verified"), tz_offset_min),
        }
        if stored:
            return customers.finish(self._joined_in_steps(by_mobile), as_of, tz_offset_min)
        time_type = table_schema("plans")["plan_start_time"].dataType
        joined = customers.facts_of_kinds(self.facts("plan_kinds"), time_type)
        for part in ("names", "addresses", "verified"):
            joined = joined.join(self.facts(part), "mobile", "left")
        joined = customers.with_device(joined, self.facts("known_devices"))
        for part, key in (("usage", "nas_id"), ("optical", "nas_id"), ("speeds", "device_id")):
            joined = left_join_spread(joined, self.facts(part), [key], by=["mobile", "partner_id"])
        shown = {
            "avg_optical_dbm": F.col("reading.avg_optical_dbm"),
            "optical_health": F.col("reading.optical_health"),
            "optical_date": F.col("reading.date_ist"),
            "actual_speed_mbps": F.col("test.speed"),
            "latency": F.col("test.latency"),
            "jitter": F.col("test.jitter"),
            "tested_on": F.col("test.tested_on"),
        }
        return customers.finish(joined.withColumns(by_mobile | shown), as_of, tz_offset_min)

    def _joined_in_steps(self, by_mobile: Mapping[str, Column]) -> DataFrame:
        """The joins of the view, stored: ids meet the signals first, and customers never leave their bucket.

        What was found is dealt to the buckets. Rows without a mobile, one per partner, are joined apart.
        """
        key = ("mobile", "partner_id")
        plans, time_type = self._partials("plan_kinds"), table_schema("plans")["plan_start_time"].dataType
        by_nas = self.facts("usage").join(self.facts("optical"), "nas_id", "full").select(
            "nas_id", "last_ping", "reading.avg_optical_dbm", "reading.optical_health", F.col("reading.date_ist").alias("optical_date")
        )
        by_device = self.facts("speeds").select("device_id", "test.speed", "test.latency", "test.jitter", "test.tested_on")
        with passing(self.spark) as keep:
            with passing(self.spark) as keep_ids:
                ids = keep_ids(plans.groupBy(*key).agg(*[F.max(c).alias(c) for c in customers.IDS]), "ids")
                found = customers.found_signals(ids, self.facts("known_devices"), by_nas, by_device, keep, keep_ids)
            signals = [F.max(c).alias(c) for c in found.columns if c not in key]
            kinds = plans.groupBy(*key, "charges", "speed_mbps").agg(F.max("_packed").alias("_packed"), F.sum("_rows").alias("_rows"))
            facts = customers.facts_of_kinds(kinds, time_type, ())
            has_mobile = F.col("mobile").isNotNull()
            dealt = found.filter(has_mobile).repartition(self._committed().buckets or self.buckets, "mobile")
            joined = facts.filter(has_mobile).join(dealt.groupBy(*key).agg(*signals), [*key], "left")
            for part in ("names", "addresses", "verified"):
                joined = joined.join(self.facts(part), "mobile", "left")
            of_partners = found.filter(~has_mobile).groupBy("partner_id").agg(*signals)
            others = facts.filter(~has_mobile).join(of_partners, "partner_id", "left")
            whole = joined.withColumns(dict(by_mobile)).drop("update", "verified").unionByName(others, allowMissingColumns=True)
            # Rows of a customer are in the bucket of its mobile, so they need not be dealt by both keys.
            with with_conf(self.spark, spark__sql__requireAllClusterKeysForCoPartition="false"):
                return kept(customers.shown_signals(whole), "customers")

    def last_ping(self) -> DataFrame:
        """``customers.last_ping`` out of the state."""
        owners = self.facts("plan_kinds").groupBy("mobile", "partner_id").agg(F.max("nas_id").alias("nas_id"))
        return owners.join(self.facts("usage"), "nas_id").select("partner_id", "mobile", "last_ping")

    def recharge_count(self) -> DataFrame:
        """``customers.recharge_count`` out of the state."""
        paid = self.facts("plan_kinds").filter((F.col("charges") > 0) & F.col("mobile").isNotNull())
        return paid.groupBy("mobile", "partner_id").agg(F.sum("_rows").alias("recharge_count")).select("partner_id", "mobile", "recharge_count")

    def recharge_counts(self, roster: DataFrame) -> DataFrame:
        """``city.recharge_counts`` out of the state."""
        counts = self.facts("plan_kinds").groupBy("mobile", "partner_id").agg(F.sum("_rows").alias("recharge_count"))
        return city.with_city(counts, roster).select("city", "partner_id", "mobile", "recharge_count")

    def fixed_payout_monthly(self, as_of: AsOf) -> DataFrame:
        """``payouts.fixed_payout_monthly`` out of the state."""
        return payouts.monthly_of_parts(self.facts("payouts"), as_of)

    def wallet_transactions(self, n: int = wallet.WALLET_ROWS) -> DataFrame:
        """``wallet.wallet_transactions`` out of the state, for at most the kept number of rows."""
        if n > wallet.WALLET_ROWS:
            raise ValueError(f"the state keeps {wallet.WALLET_ROWS} rows per partner and load")
        return wallet.wallet_transactions(self._partials("ledger_old"), self._partials("ledger_new"), n)


def _merged(rows: DataFrame, fact: Fact) -> DataFrame:
    merges = [getattr(F, how)(name).alias(name) for name, how in fact.merges.items()]
    return rows.groupBy(*fact.keys).agg(*merges)


def _newest_rows(rows: DataFrame, ledger: str) -> DataFrame:
    """The newest rows per partner, as many as a statement shows."""
    order = [F.expr(c).desc_nulls_last() for c in LEDGERS[ledger]]
    few = salted_top_n(rows, ["partner_id"], order, wallet.WALLET_ROWS)
    ranked = few.withColumn("_rank", F.row_number().over(Window.partitionBy("partner_id").orderBy(*order)))
    return ranked.filter(F.col("_rank") <= wallet.WALLET_ROWS).drop("_rank")
