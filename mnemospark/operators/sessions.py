"""Sessions: events of a key cut at silences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_MS = 60 * 60 * 1000


def _named(keys: list[str]) -> list[str]:
    return [f"_k{i}" for i in range(len(keys))]


def slot_intervals(df: DataFrame, keys: list[str], ms: str, gap_ms: int = GAP_MS) -> DataFrame:
    """``keys, slot, lo, hi, n``: events of a key within one slot of the length of the gap as
    one interval, for they always belong together. Counts combine before the shuffle, so a
    key that holds a third of all rows is as many rows as it has active slots."""
    t = df.select(*[F.col(c).alias(n) for c, n in zip(keys, _named(keys))], F.col(ms).cast("bigint").alias("_t")).where(F.col("_t").isNotNull())
    slots = t.groupBy(*_named(keys), F.floor(F.col("_t") / F.lit(gap_ms)).alias("_slot")).agg(
        F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    return slots.select(*[F.col(n).alias(c) for n, c in zip(_named(keys), keys)], F.col("_slot").alias("slot"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_n").alias("n"))


def merge_intervals(df: DataFrame, keys: list[str], ms: str, gap_ms: int = GAP_MS) -> DataFrame:
    """Sessions of each key: ``keys, start_ms, end_ms, n`` (rows of ``df`` in the session).

    Every event opens the interval ``[t, t + gap_ms]``; intervals that touch or overlap
    merge. Merging happens twice: first by slot (:func:`slot_intervals`), then the slots of
    a key in order. The window of a key is bounded by the time it covers and not by its rows.

    Rows with a null time count nowhere. A null key is a key like any other. An empty input
    gives no session. Ties and repeated rows are counted; columns beside keys and time are
    ignored, whatever their names.
    """
    slots = slot_intervals(df, keys, ms, gap_ms).select(*[F.col(c).alias(n) for c, n in zip(keys, _named(keys))], F.col("slot").alias("_slot"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("n").alias("_n"))
    order = Window.partitionBy(*_named(keys)).orderBy("_slot")
    opened = (F.col("_lo") - F.lag("_hi").over(order)) > gap_ms
    numbered = slots.withColumn("_new", F.coalesce(opened, F.lit(True)).cast("int")).withColumn(
        "_s", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    return (
        numbered.groupBy(*_named(keys), "_s")
        .agg(F.min("_lo").alias("start_ms"), F.max("_hi").alias("end_ms"), F.sum("_n").alias("n"))
        .select(*[F.col(n).alias(c) for n, c in zip(_named(keys), keys)], "start_ms", "end_ms", "n")
    )


def once_each(messages: DataFrame, created_ms: Column) -> DataFrame:
    """``conversation_id, ms`` of every message once.

    Copies of a message share a time; where they differ the earliest usable one counts. A
    message without an item_id cannot be told from another and counts by itself.
    """
    m = messages.select("conversation_id", "item_id", created_ms.alias("ms")).where(F.col("ms").isNotNull())
    known = m.where(F.col("item_id").isNotNull()).groupBy("conversation_id", "item_id").agg(F.min("ms").alias("ms"))
    return known.select("conversation_id", "ms").unionByName(m.where(F.col("item_id").isNull()).select("conversation_id", "ms"))


def message_sessions(messages: DataFrame, created_ms: Column, gap_ms: int = GAP_MS) -> DataFrame:
    """Sessions of each conversation in one batch, every (conversation_id, item_id) once."""
    return (
        merge_intervals(once_each(messages, created_ms), ["conversation_id"], "ms", gap_ms)
        .withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
        .withColumnRenamed("n", "n_messages")
    )


def without_open_tail(sessions: DataFrame, now_ms: Column | int, gap_ms: int = GAP_MS) -> DataFrame:
    """Drops sessions that may still grow: those whose end is not yet older than the gap."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return sessions.where(now - F.col("end_ms") > gap_ms)
