"""Wallet statements over the old ledger and the one that replaced it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fibrelens.functions.picks import salted_top_n
from fibrelens.functions.times import ts_lit
from fibrelens.functions.values import RUPEE, or_zero

WALLET_ROWS = 100
# Fixed value: hand-over time of partners that are not in the old ledger.
NO_OLD_ROWS = "2000-01-01"

_ORDER = ("_instant", "_from_new", "remark", "action", "balance", "credit_delta")


def wallet_transactions(
    ledger_old: DataFrame, ledger_new: DataFrame, n: int = WALLET_ROWS, zone: str = "Asia/Kolkata"
) -> DataFrame:
    """The newest ``n`` wallet rows per partner, numbered from the newest.

    Rows of the new ledger count only when later than the partner's last row in the old
    one; the new (UTC) time is compared as it stands with the old local time. Rows are ranked
    by their instant, also where the clock of ``zone`` is set back (an old row of a repeated hour
    counts as its first pass). Within a ledger that bound only drops the oldest new rows, so the
    newest n of each ledger and the old ledger's latest time are enough: the full ledgers are
    never shuffled.
    For the statement of a few partners, filter both ledgers by partner beforehand.
    """
    old_time = F.col("added_at_ist").cast("timestamp_ntz")
    old = ledger_old.select(
        "partner_id",
        "action",
        "remark",
        "credit_delta",
        "balance",
        old_time.alias("added_at_ist"),
        F.convert_timezone(F.lit(zone), F.lit("UTC"), old_time).alias("_instant"),
        F.lit(False).alias("_from_new"),
        F.lit(None).cast("timestamp_ntz").alias("_added"),
    )
    new = ledger_new.select(
        "partner_id",
        "action",
        "remark",
        (F.col("balance") - F.col("old_balance")).alias("credit_delta"),
        "balance",
        F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("added_time").cast("timestamp_ntz")).alias("added_at_ist"),
        F.col("added_time").cast("timestamp_ntz").alias("_instant"),
        F.lit(True).alias("_from_new"),
        F.col("added_time").cast("timestamp_ntz").alias("_added"),
    )
    order = [F.col(c).desc_nulls_last() for c in _ORDER]
    rows = old.unionByName(new).filter(F.col("partner_id").isNotNull())
    few = salted_top_n(rows, ["partner_id", "_from_new"], order, n)

    # At most 2 * n * salts rows per partner from here on.
    per_partner = Window.partitionBy("partner_id")
    hand_over = F.max(F.when(~F.col("_from_new"), F.col("added_at_ist"))).over(per_partner)
    counted = few.withColumn("_hand_over", F.coalesce(hand_over, ts_lit(NO_OLD_ROWS))).filter(
        ~F.col("_from_new") | (F.col("_added") > F.col("_hand_over"))
    )
    return (
        counted.withColumn("row_no", F.row_number().over(per_partner.orderBy(*order)))
        .filter(F.col("row_no") <= n)
        .select("partner_id", "row_no", "added_at_ist", "action", "remark", "credit_delta", "balance")
    )


def wallet_summary(transactions: DataFrame) -> DataFrame:
    """Current balance, credits, debits and row count over the newest rows of each partner."""
    delta = F.col("credit_delta")
    return transactions.groupBy("partner_id").agg(
        or_zero(F.max(F.when(F.col("row_no") == 1, F.col("balance")))).alias("current_balance"),
        or_zero(F.sum(F.when(delta > 0, delta))).alias("total_credits"),
        F.abs(or_zero(F.sum(F.when(delta < 0, delta)))).alias("total_debits"),
        F.count(F.lit(1)).alias("rows_shown"),
    )


def wallet_report(transactions: DataFrame) -> DataFrame:
    """The statement as display text."""
    delta = F.col("credit_delta")

    def signed(sign: str) -> Column:
        return F.concat(F.lit(sign + RUPEE), F.format_number(F.abs(delta), 2))

    amount = F.when(delta > 0, signed("+")).when(delta < 0, signed("-")).otherwise(F.lit(RUPEE + "0"))
    return transactions.select(
        "partner_id",
        F.col("row_no").alias("#"),
        F.substring(F.col("added_at_ist").cast("string"), 1, 19).alias("Date & Time (IST)"),
        F.col("action").alias("Type"),
        amount.alias("Amount"),
        F.concat(F.lit(RUPEE), F.format_number(or_zero(F.col("balance")), 2)).alias("Balance After"),
        F.coalesce(F.substring("remark", 1, 80), F.lit("")).alias("Remark"),
    )
