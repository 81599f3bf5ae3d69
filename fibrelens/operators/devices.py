"""Where each partner's devices are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def device_location_counts(devices: DataFrame) -> DataFrame:
    """Devices with the partner, with an active and with a churned customer.

    The location column decides. A recovered device keeps its old customer and churn
    date, but its location is back at the partner.
    """
    with_customer = F.col("location") == "customer"
    churned = F.col("user_churn_date").isNotNull()
    return (
        devices.filter(F.col("partner_id").isNotNull())
        .groupBy("partner_id")
        .agg(
            F.count_if(F.col("location") == "partner").alias("with_partner"),
            F.count_if(with_customer & ~churned).alias("with_active_customer"),
            F.count_if(with_customer & churned).alias("with_churned_customer"),
        )
    )
