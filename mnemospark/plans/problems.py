"""Queries of the general training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.times import to_millis
from mnemospark.operators import delivery, sessions
from mnemospark.sources.tables import table
from mnemospark.streaming import sessions as state

_MS = """CASE WHEN regexp_full_match(trim({c}), '[0-9]{{11,14}}') THEN CAST(trim({c}) AS BIGINT)
    WHEN regexp_full_match(trim({c}), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]{{1,9}})?)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?)?')
    THEN epoch_ms(CASE WHEN regexp_matches(trim({c}), '[0-9]{{2}}:[0-9]{{2}}.*(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$') THEN TRY_CAST(trim({c}) AS TIMESTAMPTZ)
        WHEN length(trim({c})) = 10 THEN TRY_CAST(trim({c}) || 'T00:00:00Z' AS TIMESTAMPTZ)
        ELSE TRY_CAST(trim({c}) || 'Z' AS TIMESTAMPTZ) END) END"""


def millis_sql(column: str) -> str:
    return _MS.format(c=column)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "originals")
    return state.message_sessions(o, to_millis("created_at")).select("conversation_id", "start_ms", "end_ms", "n_messages")


def p2_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: sessions, messages, whole and longest duration."""
    o = table(spark, sf_dir, "originals")
    return (
        state.message_sessions(o, to_millis("created_at"))
        .groupBy("conversation_id")
        .agg(
            F.count(F.lit(1)).alias("n_sessions"), F.sum("n_messages").alias("n_messages"),
            F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("longest_ms"),
        )
    )


def p2_user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user's events, with a gap of 30 minutes."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return sessions.merge_intervals(e, ["user_id"], "ms", 30 * 60 * 1000).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "originals")
    return delivery.repeated(o, to_millis("ingested_at")).select("conversation_id", "item_id", "first_ingested_ms", "n_copies")


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One whole row of each message."""
    return delivery.one_copy(table(spark, sf_dir, "originals"), to_millis("ingested_at"))


#: Rows ingested before this are the stored ones of p5_absorbed.
SPLIT_MS = 1_456_790_400_000


def p5_absorbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second batch laid onto a stored one that holds each message once: per source the
    messages in all and those of them that only the second batch brought."""
    o = table(spark, sf_dir, "originals")
    at = to_millis("ingested_at")
    old = F.coalesce(at < SPLIT_MS, F.lit(False))
    stored = delivery.one_copy(o.where(old), at)
    both = delivery.absorbed(stored, o.where(~old), at)
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(~old).alias("n_new"))


QUERIES = {"p2_found": p2_found, "p2_durations": p2_durations, "p2_user_events": p2_user_events, "p5_found": p5_found, "p5_kept": p5_kept, "p5_absorbed": p5_absorbed}

_BY_ALL = ", ".join(f"{c} NULLS FIRST" for c in "id source conversation_id item_id role content created_at ingested_at sha256 claude_session_id turn_id source_type meta".split())
_SESSIONS = f"""
WITH m AS (SELECT conversation_id, item_id, min({millis_sql('created_at')}) AS ms FROM originals GROUP BY ALL),
l AS (SELECT conversation_id, ms, lag(ms) OVER (PARTITION BY conversation_id ORDER BY ms) AS before FROM m WHERE ms IS NOT NULL),
n AS (SELECT conversation_id, ms, sum(CASE WHEN before IS NULL OR ms - before > 3600000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY conversation_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS s FROM l),
found AS (SELECT conversation_id, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS n_messages FROM n GROUP BY conversation_id, s)
"""

ORACLES = {
    "p2_found": _SESSIONS + "SELECT * FROM found",
    "p2_durations": _SESSIONS
    + """SELECT conversation_id, count(*) AS n_sessions, CAST(sum(n_messages) AS BIGINT) AS n_messages,
    CAST(sum(end_ms - start_ms) AS BIGINT) AS total_ms, max(end_ms - start_ms) AS longest_ms FROM found GROUP BY 1""",
    "p2_user_events": """
WITH m AS (SELECT user_id, epoch_us(ts) // 1000 AS ms FROM events WHERE ts IS NOT NULL),
l AS (SELECT *, lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS before FROM m),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR ms - before > 1800000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS s FROM l)
SELECT user_id, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS n, max(ms) - min(ms) AS duration_ms FROM n GROUP BY user_id, s""",
    "p5_found": f"""
SELECT conversation_id, item_id, min({millis_sql('ingested_at')}) AS first_ingested_ms, count(*) AS n_copies
FROM originals WHERE conversation_id IS NOT NULL AND item_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
    "p5_kept": f"""
SELECT * FROM originals QUALIFY conversation_id IS NULL OR item_id IS NULL OR row_number() OVER (PARTITION BY conversation_id, item_id ORDER BY {millis_sql('ingested_at')} NULLS LAST,
    {_BY_ALL}) = 1""",
    "p5_absorbed": f"""
WITH m AS (SELECT conversation_id, item_id, any_value(source) AS source, min({millis_sql('ingested_at')}) AS ms FROM originals GROUP BY 1, 2)
SELECT source, count(*) AS n, count(*) FILTER (ms IS NULL OR ms >= {SPLIT_MS}) AS n_new FROM m GROUP BY 1""",
}
