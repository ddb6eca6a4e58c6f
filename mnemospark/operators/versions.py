"""Versioned rows without updates: logs of versions, status events and tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version of each key; ties go to the last updated and then to
    the whole row, so that repeated rows give one. Null versions come first.

    It is a maximum of structs with partial aggregation: no sort, and a key with many
    versions reaches its task as one row per input partition.
    """
    order = F.struct(F.col(version), F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in log.columns]))
    return log.groupBy(*keys).agg(F.max_by(F.struct(*log.columns), order).alias("_r")).select("_r.*")


def history(log: DataFrame, key: str, version: str, value: str) -> DataFrame:
    """Versions of a key in order, with what stood before and whether it changed."""
    by = Window.partitionBy(key).orderBy(version)
    once = log.select(key, version, value).dropDuplicates([key, version])
    return once.withColumn("previous", F.lag(value).over(by)).withColumn("changed", ~F.col(value).eqNullSafe(F.col("previous")))


def without_tombstones(rows: DataFrame, key: str, tombstones: DataFrame, ids: str) -> DataFrame:
    """Rows that no tombstone names."""
    gone = tombstones.select(F.explode(ids).alias("_gone")).distinct()
    return rows.join(gone, rows[key] == gone["_gone"], "left_anti")


def upserted(stored: DataFrame, changes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Stored rows with changes applied: the latest by ``at`` wins, changes over equals."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return both.groupBy(*keys).agg(F.max_by(F.struct(*stored.columns), F.struct(F.col(at), F.col("_new"))).alias("_r")).select("_r.*")


def intervals(events: DataFrame, key: str, at: str, state: str) -> DataFrame:
    """Validity intervals of a state: equal neighbours merge, each ends where the next begins."""
    by = Window.partitionBy(key).orderBy(at)
    new = events.select(key, at, state).distinct().withColumn("_before", F.lag(state).over(by)).where(~F.col(state).eqNullSafe(F.col("_before")))
    return new.select(key, state, F.col(at).alias("valid_from"), F.lead(at).over(by).alias("valid_to"))


def valid_at(spans: DataFrame, moment: Column) -> DataFrame:
    return spans.where((F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (moment < F.col("valid_to"))))
