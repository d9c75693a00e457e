"""Queries that run Structured Streaming over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casebook.plans.base import query
from casebook.streaming import streams


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.read_events(spark, f"{sf_dir}/events.parquet")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 3 DAY FROM events) GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts from a stream: the windows that the watermark has closed (G-S11)."""
    rows = streams.run_to_table(streams.windowed_counts(_events(spark, sf_dir), "ts", "1 day", "event_type"), "daily")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS keys FROM events")
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that carries every event twice, each kept once (G-S2)."""
    twice = _events(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    seen = streams.run_to_table(streams.first_seen(twice, "ts", "event_id"), "seen")
    return seen.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("keys"))


@query("SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest event of each user through batch upserts (G-S3, G-S4)."""
    return streams.upsert_batches(_events(spark, sf_dir), "user_id", "ts", "latest").select("user_id", "event_id", "event_type")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 86400 OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
i AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS incident FROM g) SELECT user_id, incident::BIGINT AS incident, count(*) AS n FROM i GROUP BY 1, 2""")
def stream_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running incidents of each user from keyed state (G-S5, G-S6)."""
    rows = streams.run_to_table(streams.incident_windows(_events(spark, sf_dir), "user_id", "ts", 1), "incidents")
    whole = rows.groupBy("user_id", "first").agg(F.max("n").alias("n"))
    return whole.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("first")).cast("long").alias("incident"), "n")


@query()
def stream_incident_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open incidents of each kind of event with the tokens of their members, and what became of them (G-S5, G-S6)."""
    words = F.array_distinct(F.concat(F.array("event_type"), F.regexp_extract_all("props", F.lit("([0-9a-z]+)"), 1), F.array(F.concat(F.lit("v"), F.floor(F.col("value") / 20).cast("string")))))
    rows = streams.incident_states(_events(spark, sf_dir).withColumn("words", words), "user_id", "ts", "words", "event_type", 1)
    kept = streams.run_to_table(rows, "states", closing=False)
    return kept.groupBy("user_id", "first", "field").agg(F.max("n").alias("n"), F.max("last").alias("last"), F.max("tokens").alias("tokens"))
