"""Cutting conversations further: long sessions at their longest pause, windows of bounded
size, and merged spans."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.session import materialized

MOST_MESSAGES, MOST_CHARS = 80, 16_000
#: Messages of a stretch that one task folds; longer stretches are cut by set operations first.
PART_ROWS = 200_000
DAY_MS = 24 * 3_600_000
WINDOW_CHARS, WINDOW_MESSAGES, WINDOW_GAP_MS = 2_600, 24, 3 * 3_600_000


def _cut_at(ms: list[int]) -> int:
    """Where a stretch is cut: before the message behind the longest pause of the middle
    three fifths, the first one of equal length."""
    n = len(ms)
    lo = max(n // 5, 1)
    return max(range(lo, max(n - n // 5, lo + 1)), key=lambda i: (ms[i] - ms[i - 1], -i))


def split_long(messages: DataFrame, most: int = MOST_MESSAGES, chars: int = MOST_CHARS, part_rows: int = PART_ROWS, rounds: int | None = None) -> DataFrame:
    """``session, ms, ord, chars, part``: sessions of more than ``most`` messages or ``chars``
    characters are cut at their longest pause whose place is in the middle three fifths, the
    first one of equal length, and the parts again until all fit. A part of one message is
    never cut; every row comes out.

    ``messages`` has ``session, ms, ord, chars``. Parts of up to ``part_rows`` messages are
    cut to the end in one fold, which holds just one of them. Longer ones are first cut by
    rounds of set operations: sizes and places come from counts per day and never from a
    window over the whole part. Each round is written to the shared folder; ``rounds`` bounds
    them in tests, and what is then still longer is folded all the same.
    """
    todo = messages.select("session", "ms", "ord", "chars").withColumn("part", F.lit("0"))
    ready: list[DataFrame] = []
    n = 0
    while True:
        todo = materialized(todo)
        days = todo.groupBy("session", "part", F.floor(F.col("ms") / DAY_MS).alias("day")).agg(F.count(F.lit(1)).alias("c"), F.max("ms").alias("last"))
        size = days.groupBy("session", "part").agg(F.sum("c").alias("n"))
        big = materialized(size.where(F.col("n") > part_rows))
        keys = ["session", "part"]
        if (rounds is not None and n >= rounds) or not big.take(1):
            ready.append(todo)
            break
        ready.append(todo.join(big, keys, "left_anti"))
        todo = todo.join(big, keys).withColumn("day", F.floor(F.col("ms") / DAY_MS))
        by_day = Window.partitionBy(*keys).orderBy("day")
        before = days.join(big.select(*keys), keys, "left_semi").select(
            *keys, "day", F.coalesce(F.sum("c").over(by_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lag("last").over(by_day).alias("last")
        )
        inside = Window.partitionBy(*keys, "day").orderBy("ms", "ord")
        placed = materialized(
            todo.join(before, [*keys, "day"])
            .withColumn("i", F.col("before") + F.row_number().over(inside) - 1)
            .withColumn("pause", F.col("ms") - F.coalesce(F.lag("ms").over(inside), F.col("last")))
        )
        lo = F.greatest(F.floor(F.col("n") / 5), F.lit(1))
        may = (F.col("i") >= lo) & (F.col("i") < F.greatest(F.col("n") - F.floor(F.col("n") / 5), lo + 1))
        cut = placed.where(may).groupBy(*keys).agg(F.min_by("i", F.struct(-F.col("pause"), F.col("i"))).alias("cut"))
        todo = placed.join(cut, keys).select("session", "ms", "ord", "chars", F.concat("part", F.when(F.col("i") < F.col("cut"), F.lit("0")).otherwise(F.lit("1"))).alias("part"))
        n += 1
    rows = reduce(DataFrame.unionByName, ready)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ms", "ord"], kind="stable", ignore_index=True)
        ms, size = pdf["ms"].tolist(), [0, *pdf["chars"].cumsum().tolist()]
        names: list[str] = [""] * len(ms)
        stack = [(0, len(ms), pdf["part"].iloc[0])]
        while stack:
            a, b, name = stack.pop()
            if b - a > 1 and (b - a > most or size[b] - size[a] > chars):
                at = a + _cut_at(ms[a:b])
                stack += [(a, at, name + "0"), (at, b, name + "1")]
            else:
                names[a:b] = [name] * (b - a)
        return pdf.assign(part=names)

    # most parts fit as they are and need no fold
    keys = ["session", "part"]
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("c"))
    long = materialized(size.where((F.col("n") > 1) & ((F.col("n") > most) | (F.col("c") > chars))).select(*keys))
    return rows.join(long, keys, "left_anti").unionByName(rows.join(long, keys, "left_semi").groupBy(*keys).applyInPandas(fold, rows.schema))


def pack_windows(messages: DataFrame, gap_ms: int = WINDOW_GAP_MS, chars: int = WINDOW_CHARS, most: int = WINDOW_MESSAGES) -> DataFrame:
    """``conversation_id, ms, ord, chars, stretch, window``: messages in order fill a window
    until a silence longer than the gap, or until one more would pass the characters or the
    number of messages.

    A silence ends a window whatever came before, so stretches between silences are packed
    on their own: they, not the conversations, are the groups.
    """
    m = messages.select("conversation_id", "ms", "ord", "chars")
    slot = Window.partitionBy("conversation_id").orderBy("slot")
    slots = m.groupBy("conversation_id", F.floor(F.col("ms") / gap_ms).alias("slot")).agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    opened = F.coalesce((F.col("lo") - F.lag("hi").over(slot)) > gap_ms, F.lit(True)).cast("int")
    slots = slots.withColumn("_new", opened).withColumn("stretch", F.sum("_new").over(slot)).select("conversation_id", "slot", "stretch")
    m = m.withColumn("slot", F.floor(F.col("ms") / gap_ms)).join(slots, ["conversation_id", "slot"]).drop("slot")

    schema = T.StructType([*m.schema.fields, T.StructField("window", T.IntegerType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come stretch by stretch and in order, so all that is carried on is one window
        at, window, size, held = None, 0, 0, 0
        for pdf in batches:
            numbers = []
            for c, s, n in zip(pdf["conversation_id"], pdf["stretch"], pdf["chars"]):
                if (c, s) != at:
                    at, window, size, held = (c, s), 0, 0, 0
                if held and (held >= most or size + n > chars):
                    window, size, held = window + 1, 0, 0
                numbers.append(window)
                size, held = size + n, held + 1
            yield pdf.assign(window=numbers)

    keys = ["conversation_id", "stretch"]
    return m.repartition(*keys).sortWithinPartitions(*keys, "ms", "ord").mapInPandas(fold, schema)


def merged_spans(spans: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """``key, lo, hi, n``: overlapping or touching spans of a key as one."""
    order = Window.partitionBy(key).orderBy(lo, hi)
    reach = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col(lo) > reach).cast("int"), F.lit(1))
    s = spans.withColumn("_new", new).withColumn("_s", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return s.groupBy(key, "_s").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("n")).drop("_s")
