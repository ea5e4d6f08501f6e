"""The audit log: append-only CSV lines of time, event, user and detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark import schema as S
from tallyspark.functions import text

# Fixed values.
EVENTS = ("LOGIN", "LOGOUT", "LOGIN_FAILED", "SCAN", "FINISH")
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def scan_events(images: DataFrame, username: str, at: Column) -> DataFrame:
    """One SCAN event per image."""
    return images.select(
        F.date_format(at, TIME_FORMAT).alias("event_time"), F.lit("SCAN").alias("event"),
        F.lit(username).alias("username"), F.col("image_name").alias("detail"),
    )


def event_lines(events: DataFrame) -> DataFrame:
    line = F.concat_ws(",", "event_time", "event", text.csv_escape("username"), text.csv_escape("detail"))
    return events.select(line.alias("value"))


def append_events(events: DataFrame, path: str) -> None:
    event_lines(events).write.mode("append").text(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The log as a table.  An absent user or detail is empty text, as it is written."""
    reader = spark.read.schema(S.AUDIT_EVENT).option("quote", '"').option("escape", '"').option("multiLine", "true")
    return reader.csv(path).na.fill("")
