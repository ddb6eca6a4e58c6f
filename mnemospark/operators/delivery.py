"""At-least-once delivery: repeated messages found, counted and reduced to one copy.

Identifiers are split by their aggregated frequency. Those that occur once pass as they
are; only the rows of repeated ones are ranked; both results are united.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.session import materialized

KEYS = ("conversation_id", "item_id")
#: Copies of one identifier that one task ranks; more are first ranked in shares of so many.
SHARE = 10_000


def frequencies(df: DataFrame, ingested_ms: Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``keys, n_copies, first_ingested_ms`` of each identifier that is complete.

    Counts combine before the shuffle, so an identifier that holds a third of all rows
    reaches its task as one row per input partition. Null times are apart from the minimum,
    which is null when a message has none.
    """
    known = df.select(*keys, ingested_ms.alias("_at"))
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_copies"), F.min("_at").alias("first_ingested_ms"))


def split(df: DataFrame, ingested_ms: Column, keys: tuple[str, ...] = KEYS) -> tuple[DataFrame, DataFrame]:
    """Rows of identifiers that occur once, and the first-ranked row of each repeated one.

    The repeated identifiers are counted in a narrow pass and kept as a table; rows pass or
    are ranked by joining it, by broadcast where Spark finds it small. Single rows and those
    that lack a part of the identifier, which cannot be matched, go through no ranking. The
    copy ranked first is the one ingested first; copies without a time come last and ties go
    by the other columns in order, nulls first, so the choice does not depend on the order
    of rows. A very frequent identifier is ranked in shares first, so that no task holds all
    of its rows. The second table has ``_n_copies`` and ``_first_ms`` besides.
    """
    cols = df.columns
    own = "_m"
    while any(c.startswith(own) for c in cols):
        own = "_" + own
    more = materialized(frequencies(df, ingested_ms, keys).where(F.col("n_copies") > 1))
    more = more.select(*[F.col(k).alias(f"{own}_{k}") for k in keys], F.col("n_copies").alias(f"{own}_n"), F.col("first_ingested_ms").alias(f"{own}_first"))
    same = [df[k] == more[f"{own}_{k}"] for k in keys]
    single = df.join(more, same, "left_anti")
    rows = df.join(more, same).withColumn(f"{own}_at", ingested_ms)
    order = [F.asc_nulls_last(f"{own}_at"), *[F.asc_nulls_first(F.to_json(c) if t.startswith(("map", "variant")) else F.col(c)) for c, t in df.dtypes]]
    share = F.pmod(F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in cols]), F.ceil(F.col(f"{own}_n") / SHARE))
    rows = rows.withColumn(f"{own}_share", F.when(F.col(f"{own}_n") > SHARE, share).otherwise(F.lit(0)))
    for by in ([*keys, f"{own}_share"], list(keys)):
        rows = rows.withColumn(f"{own}_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(f"{own}_rank") == 1).drop(f"{own}_rank")
    return single, rows.select(*cols, F.col(f"{own}_n").alias("_n_copies"), F.col(f"{own}_first").alias("_first_ms"))


def repeated(df: DataFrame, ingested_ms: Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """``keys, first_ingested_ms, n_copies`` of the identifiers stored in more than one row:
    the ranked half of :func:`split`."""
    narrow = df.select(*keys, ingested_ms.alias("ingested_ms"))
    _, ranked = split(narrow, F.col("ingested_ms"), keys)
    return ranked.select(*keys, F.col("_first_ms").alias("first_ingested_ms"), F.col("_n_copies").alias("n_copies"))


def one_copy(df: DataFrame, ingested_ms: Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Exactly one row of each message, with all columns of ``df``: both halves of
    :func:`split`. An empty table gives an empty one."""
    single, ranked = split(df, ingested_ms, keys)
    return single.unionByName(ranked.drop("_n_copies", "_first_ms"))


def absorbed(stored: DataFrame, arriving: DataFrame, ingested_ms: Column, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Stored and newly delivered rows as one table with one copy of each message."""
    return one_copy(stored.unionByName(arriving, allowMissingColumns=True), ingested_ms, keys)
