"""Who speaks: roles in many spellings and the speakers they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spelt(role: Column | str) -> Column:
    """A role as it is compared with aliases: without outer white space, in lower case."""
    role = F.col(role) if isinstance(role, str) else role
    return F.lower(F.trim(F.regexp_replace(role, r"^\s+|\s+$", "")))


def with_speaker(rows: DataFrame, speakers: DataFrame, role: str = "role") -> DataFrame:
    """Adds ``speaker``: that of the alias the role equals, null for a null or unknown role.

    The aliases are a setting of a few rows; their join is left to Spark, which broadcasts
    what it knows to be small. An alias given twice counts once.
    """
    alias = speakers.select(spelt("alias").alias("_alias"), "speaker").where(F.col("_alias").isNotNull()).groupBy("_alias").agg(F.min("speaker").alias("speaker"))
    return rows.withColumn("_role", spelt(role)).join(alias, F.col("_role") == F.col("_alias"), "left").drop("_role", "_alias")
