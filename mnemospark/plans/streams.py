"""Streaming queries, run over the stored tables as streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.streaming import runs, sessions
from mnemospark.sources.tables import table


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users by merging intervals in state; the mark of the end of input, a day
    past the last event, lets the watermark close those still open."""
    e = runs.file_stream(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("t"))
    folder = runs.shared_dir(spark)
    end = table(spark, d, "events").agg((F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 3 DAYS")).alias("t")).select(F.lit(None).cast("long").alias("user_id"), "t")
    end.write.parquet(f"{folder}/end")
    marked = e.unionByName(spark.readStream.schema(end.schema).parquet(f"{folder}/end"))
    out = runs.run_available(sessions.session_stream(marked, "user_id", "t", "30 minutes", "1 hour"), folder=f"{folder}/run")
    return out.where("user_id IS NOT NULL").select("user_id", F.unix_millis("start_at").alias("start_ms"), F.unix_millis("end_at").alias("end_ms"), "n")


def stream_once(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries reduced to one per message as they stream in, counted by source."""
    o = runs.file_stream(spark, d, "originals").select("source", "conversation_id", "item_id")
    first = runs.run_available(o.dropDuplicates(["conversation_id", "item_id"]))
    return first.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """Running counts per type of event, the last state of each."""
    e = runs.file_stream(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))
    out = runs.run_available(e, "update")
    return out.groupBy("event_type").agg(F.max("n").alias("n"), F.max("last_id").alias("last_id"))


QUERIES = {"stream_sessions": stream_sessions, "stream_once": stream_once, "stream_counts": stream_counts}

ORACLES = {
    "stream_sessions": """
WITH m AS (SELECT user_id, epoch_us(ts) AS us FROM events), l AS (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us) AS b FROM m),
n AS (SELECT *, sum(CASE WHEN b IS NULL OR us - b > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT user_id, min(us) // 1000 AS start_ms, max(us) // 1000 AS end_ms, count(*) AS n FROM n GROUP BY user_id, s""",
    "stream_once": "SELECT source, count(*) AS n FROM (SELECT DISTINCT source, conversation_id, item_id FROM originals) GROUP BY 1",
    "stream_counts": "SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1",
}
