"""fibrelens: partner and customer analytics for an internet access business, on Spark.

Every operator is a plain function from DataFrames (plus an explicit ``as_of``
time where "now" matters) to a lazy DataFrame, for all partners or cities at once.
"""

__version__ = "0.1.0"
