"""Taking in messages: ids from content, classification against what is stored, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def derived_id(prefix: str, *parts: str) -> Column:
    """The prefix and 20 hex digits of the hash of the parts, set apart by a unit separator."""
    joined = F.concat_ws("\u001f", *[F.coalesce(F.col(p), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 20))


def content_hash(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def hash_state(text: str, stored: str) -> Column:
    """``missing``, ``ok`` or ``different``: the stored hash against the text's own."""
    return F.when(F.col(stored).isNull() | (F.trim(stored) == ""), "missing").when(F.lower(stored) == content_hash(text), "ok").otherwise("different")


def safe_name(c: str) -> Column:
    """Whether an id may be part of a path."""
    return F.coalesce(F.col(c).rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$") & ~F.contains(F.col(c), F.lit("..")), F.lit(False))


def classified(arriving: DataFrame, key: str, text: str, order: Column, stored: DataFrame | None = None) -> DataFrame:
    """``key, added, existing, conflicts``: what becomes of each arriving row of a key.

    The first text to arrive (or the stored one) wins: a row with it is existing, one with
    another text a conflict. Per key this is a minimum and two counts, so no rows of a key
    have to meet in a window.
    """
    hashed = arriving.select(F.col(key).alias("k"), content_hash(text).alias("h"), order.alias("o"))
    counts = hashed.groupBy("k", "h").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("o"))
    if stored is not None:
        held = stored.groupBy(F.col(key).alias("k")).agg(F.min(content_hash(text)).alias("held"))
    else:
        held = counts.groupBy("k").agg(F.lit(None).cast("string").alias("held"))
    first = counts.groupBy("k").agg(F.min_by("h", "o").alias("first")).join(held, "k", "left")
    wins = F.coalesce("held", "first")
    j = counts.join(first, "k").groupBy("k").agg(
        F.max(F.col("held").isNull().cast("int")).alias("added"),
        F.sum(F.when(F.col("h") == wins, F.col("n")).otherwise(0)).alias("same"),
        F.sum(F.when(F.col("h") != wins, F.col("n")).otherwise(0)).alias("conflicts"),
    )
    return j.select(F.col("k").alias(key), F.col("added").cast("long").alias("added"), (F.col("same") - F.col("added")).alias("existing"), "conflicts")
