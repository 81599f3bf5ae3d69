"""The two fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The zones whose partners are shown.
ZONES = (
    "Agra",
    "Agra++",
    "Meerut",
    "Meerut++",
    "Bareilly",
    "Bareilly++",
    "Gorakhpur",
    "Prayagraj",
    "Lucknow",
    "Meerut City",
)

# Launch city label -> spelling in the roster.
LAUNCH_CITIES = {
    "Saharanpur": "Saharanpur",
    "Bijnor": "Bijnor",
    "Muzaffarnagar": "Muzaffarnagar",
    "Hapur": "Hapur",
    "Aligarh": "Aligarh",
    "Mathura": "Mathura",
    "Firozabad": "Firozabad",
    "Moradabad": "Moradabad",
    "Bareilly": "Bareilly",
    "Meerut City": "Meerut_City",
    "Agra": "Agra",
}


def launch_cities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LAUNCH_CITIES.items()), "label string, funnel string")
