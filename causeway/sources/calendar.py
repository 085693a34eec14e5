"""A calendar of scheduled events by rule, with the dates that follow no rule stated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from causeway.functions.columns import third_friday

#: Announcement days of the rate committee, July 2023 to December 2024.
RATE_DAYS = [
    "2023-07-26", "2023-09-20", "2023-11-01", "2023-12-13", "2024-01-31", "2024-03-20", "2024-05-01", "2024-06-12",
    "2024-07-31", "2024-09-18", "2024-11-07", "2024-12-18",
]
#: Fixed values.
MAGNITUDES = {"FOMC": 1.0, "CPI": 0.8, "NFP": 0.7, "OpEx": 0.6, "EIA_Crude": 0.5}


#: The other dated events of those 18 months.
PRICE_DAYS = [
    "2023-07-12", "2023-08-10", "2023-09-13", "2023-10-12", "2023-11-14", "2023-12-12", "2024-01-11", "2024-02-13", "2024-03-12",
    "2024-04-10", "2024-05-15", "2024-06-12", "2024-07-11", "2024-08-14", "2024-09-11", "2024-10-10", "2024-11-13", "2024-12-11",
]
JOB_DAYS = [
    "2023-07-07", "2023-08-04", "2023-09-01", "2023-10-06", "2023-11-03", "2023-12-08", "2024-01-05", "2024-02-02", "2024-03-08",
    "2024-04-05", "2024-05-03", "2024-06-07", "2024-07-05", "2024-08-02", "2024-09-06", "2024-10-04", "2024-11-01", "2024-12-06",
]
EXPIRY_DAYS = ["2023-09-15", "2023-12-15", "2024-03-15", "2024-06-21", "2024-09-20", "2024-12-20"]
STOCK_DAYS = [
    "2023-07-12", "2023-08-09", "2023-09-06", "2023-10-04", "2023-11-01", "2023-12-06", "2024-01-03", "2024-02-07", "2024-03-06",
    "2024-04-03", "2024-05-01", "2024-06-05", "2024-07-03", "2024-08-07", "2024-09-04", "2024-10-02", "2024-11-06", "2024-12-04",
]


def dated(spark: SparkSession) -> DataFrame:
    """event_day, event_type, magnitude of the 72 dated events of July 2023 to December 2024, by day."""
    kinds = {"FOMC": RATE_DAYS, "CPI": PRICE_DAYS, "NFP": JOB_DAYS, "OpEx": EXPIRY_DAYS, "EIA_Crude": STOCK_DAYS}
    rows = [(day, kind, MAGNITUDES[kind]) for kind, days in kinds.items() for day in days]
    table = spark.createDataFrame(rows, "event_day string, event_type string, magnitude double")
    return table.withColumn("event_day", F.to_date("event_day")).orderBy("event_day", "event_type")


def build(spark: SparkSession, start: str, end: str) -> DataFrame:
    """event_day, event_type, magnitude: jobs on first Fridays, expiries on third ones, crude stocks on Wednesdays,
    consumer prices on the second Wednesday of a month."""
    days = spark.sql(f"select explode(sequence(date'{start}', date'{end}')) as event_day")
    d = F.col("event_day")
    first = F.next_day(F.date_sub(F.trunc(d, "MM"), 1), "FRI")
    wednesday = F.date_add(F.next_day(F.date_sub(F.trunc(d, "MM"), 1), "WED"), 7)
    rules = F.array_compact(F.array(
        F.when(d.cast("string").isin(RATE_DAYS), "FOMC"), F.when(d == wednesday, "CPI"), F.when(d == first, "NFP"),
        F.when(d == third_friday(d), "OpEx"), F.when(F.weekday(d) == 2, "EIA_Crude"),
    ))
    named = days.select("event_day", F.explode(rules).alias("event_type"))
    weight = F.lit(None).cast("double")
    for kind, magnitude in MAGNITUDES.items():
        weight = F.when(F.col("event_type") == kind, magnitude).otherwise(weight)
    return named.withColumn("magnitude", weight)
