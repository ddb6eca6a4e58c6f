"""Streaming forms: sessions as merged intervals in state, late rows, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.sessions import GAP_MS, once_each, slot_intervals
from mnemospark.session import shared_dir
from mnemospark.streaming.runs import replayed


def session_stream(events: DataFrame, key: str, ts: str, gap: str = "60 minutes", delay: str = "24 hours") -> DataFrame:
    """Session windows of a stream.

    Each event opens an interval of the length of the gap and the state of a key is its set
    of merged intervals. A late event within ``delay`` extends or joins sessions that are
    still in state; a session is emitted once the watermark has passed its end. Events
    later than that are dropped by the engine; :func:`replanned` repairs their keys.
    """
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.col(key), F.session_window(F.col(ts), gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("start_at"), F.max(ts).alias("end_at"))
        .select(key, "start_at", "end_at", "n")
    )


def merge_stream(intervals: DataFrame, key: str, delay_ms: int, gap_ms: int = GAP_MS) -> DataFrame:
    """Merging interval state over a stream of intervals (``key, lo, hi, n, at``; ``at`` is
    the start): each stays open for the gap behind its end, and those that touch or overlap
    merge, whenever they come within the delay."""
    open_for = F.make_interval(secs=((F.col("hi") - F.col("lo") + gap_ms) / F.lit(1000)).cast("decimal(18,3)"))
    return (
        intervals.withWatermark("at", f"{delay_ms} milliseconds")
        .groupBy(F.col(key), F.session_window(F.col("at"), open_for).alias("w"))
        .agg(F.min("lo").alias("start_ms"), F.max("hi").alias("end_ms"), F.sum("n").alias("n_messages"))
        .select(key, "start_ms", "end_ms", "n_messages")
    )


def message_sessions(messages: DataFrame, created_ms: Column, gap_ms: int = GAP_MS, files_per_batch: int | None = None) -> DataFrame:
    """``conversation_id, start_ms, end_ms, n_messages, duration_ms``: sessions by merging
    interval state with a watermark, every (conversation_id, item_id) counted once.

    Messages of one conversation within one slot of the gap's length always merge; they do
    so before the shuffle, so a conversation with a third of all rows enters the state as
    one interval per slot it was active in. The stored intervals are then streamed; none is
    late, whatever the order of files (see :func:`replayed`). An empty table has no session,
    a null conversation_id is one like any other, messages without a usable time count
    nowhere.
    """
    spark = messages.sparkSession
    path = f"{shared_dir(spark)}/intervals"
    slots = slot_intervals(once_each(messages, created_ms), ["conversation_id"], "ms", gap_ms)
    slots.withColumn("at", F.timestamp_millis("lo")).write.parquet(path)
    merged = replayed(path, "at", lambda s, delay: merge_stream(s, "conversation_id", delay, gap_ms), spark, files_per_batch)
    return merged.withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))


def replanned(emitted: DataFrame, stored: DataFrame, key: str, ms: str, batch) -> DataFrame:
    """Sessions a stream emitted (``key, start_ms, end_ms, n``), made whole for late rows.

    What came later than the watermark is missing from ``emitted``, so the rows of its key do
    not add up to those stored. Such keys, and no others, are planned again by
    ``batch(rows)`` over all of their stored rows.
    """
    there = emitted.groupBy(F.col(key).alias("_k")).agg(F.sum("n").alias("_n"))
    whole = stored.where(F.col(ms).isNotNull()).groupBy(F.col(key).alias("_q")).agg(F.count(F.lit(1)).alias("_m"))
    short = whole.join(there, F.col("_q").eqNullSafe(F.col("_k")), "left").where(~F.col("_m").eqNullSafe(F.col("_n"))).select("_q")
    kept = emitted.join(short, F.col(key).eqNullSafe(F.col("_q")), "left_anti")
    again = batch(stored.join(short, F.col(key).eqNullSafe(F.col("_q")), "left_semi"))
    return kept.unionByName(again.select(*kept.columns))


def once_stream(messages: DataFrame, keys: list[str], ts: str, delay: str = "24 hours") -> DataFrame:
    """First delivery of each identifier while its state is kept (``delay`` past its time)."""
    return messages.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
