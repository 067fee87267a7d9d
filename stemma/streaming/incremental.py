"""Incremental forms over a stream of events: an addition, for tables that keep growing.

Both bound their state by a watermark on event time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _token() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def first_seen(events: DataFrame, late: str = "1 day") -> DataFrame:
    """group_id, array_id, token, ts: a token's first event in its array, copies dropped within the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(F.col("event_type").alias("group_id"), F.col("user_id").alias("array_id"), _token().alias("token"), "ts")
    return rows.dropDuplicatesWithinWatermark(["group_id", "array_id", "token"])


def token_counts(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """group_id, token, begin, n for each window of event time."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select(F.col("event_type").alias("group_id"), _token().alias("token"), "ts")
    return rows.groupBy("group_id", "token", F.window("ts", window)).agg(F.count(F.lit(1)).alias("n")).select("group_id", "token", F.col("window.start").alias("begin"), "n")
