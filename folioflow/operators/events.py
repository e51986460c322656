"""Operators over job events: feeds, ring buffers, latest state, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def distinct_events(events: DataFrame) -> DataFrame:
    """Each event once: repeated deliveries share all but event_id and received_at; the first received stays."""
    key = ["project_id", "chapter_id", "para_id", "level_name", "message", "event_at"]
    w = Window.partitionBy(*key).orderBy("received_at", "event_id")
    return events.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def feed_since(events: DataFrame, cursor: str) -> DataFrame:
    """Events received strictly after the cursor: by arrival, so that late events are not lost."""
    return events.filter(F.col("received_at") > F.lit(cursor).cast("timestamp_ntz"))


def ring(events: DataFrame, size: int) -> DataFrame:
    """The last ``size`` events of each project."""
    w = Window.partitionBy("project_id").orderBy(F.desc("event_at"), F.desc("event_id"))
    return events.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= size)


def latest_state(events: DataFrame) -> DataFrame:
    """Last event, number of events and of warnings and errors, by project."""
    key = F.struct("event_at", "event_id")
    return events.groupBy("project_id").agg(F.max_by("message", key).alias("status_text"), F.max_by("chapter_id", key).alias("chapter_id"), F.count("*").alias("n_events"), F.count_if(F.coalesce(F.col("level_name").isin("warning", "error"), F.lit(False))).alias("n_problems"))


def late_events(events: DataFrame, days: int = 1) -> DataFrame:
    """Events received more than ``days`` after they happened."""
    return events.filter(F.col("received_at") > F.col("event_at") + F.expr(f"INTERVAL {days} DAYS"))
