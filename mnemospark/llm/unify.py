"""One consistent form for texts that look the same but differ in their characters.

Unified are character width and compatibility forms, composed and separate accents,
invisible characters, the kind and amount of white space (outer white space goes), and
letters of other scripts drawn like Latin ones. Case, accents as such, digits and
punctuation marks stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.llm import characters as ch
from mnemospark.session import materialized

#: Rows of a block of a look-alike group; a task pairs two blocks.
BLOCK = 2000


@lru_cache(1)
def _segments() -> re.Pattern:
    """An unstable segment: a run of unstable characters and the spaces among them, with the
    stable character before it as boundary context, since an accent may join it; or a run
    of spaces. A stable character after the run never joins what stands before it."""
    u = ch.python_class()
    return re.compile(f"[^ {u}]?(?:[{u} ]*[{u}][{u} ]*)| {{2,}}")


@lru_cache(1 << 16)
def _segment_form(segment: str) -> str:
    return re.sub(r"\s+", " ", ch.fold(segment))


def unify_text(text: str | None) -> str | None:
    """The consistent form of one text: only unstable segments are normalised, and spliced
    into the text, which is otherwise copied. Null stays null."""
    if text is None:
        return None
    return _segments().sub(lambda m: _segment_form(m.group()) if len(m.group()) < 64 else re.sub(r"\s+", " ", ch.fold(m.group())), text).strip(" ")


@F.pandas_udf(T.StringType())
def _unify(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(unify_text, na_action="ignore")


def quick_check(c: Column) -> Column:
    """True where a text may not be in its consistent form: it has a character outside the
    ranges known to be stable, or spaces in a row or at an end."""
    return c.rlike(f"[^{ch.java_stable()}]|  |^ | $")


def unified(c: Column | str) -> Column:
    """The consistent form as a column.

    Texts that pass the quick check never leave the JVM: they are handed on as they are and
    Python sees null in their place. Null gives null, an empty text or one of white space
    and invisible characters gives the empty text; the form of a form is itself.
    """
    c = F.col(c) if isinstance(c, str) else c
    unstable = quick_check(c)
    return F.when(unstable, _unify(F.when(unstable, c))).otherwise(c)


def _number(c: str) -> list[Column]:
    """A text as 128 bits, so that numbers and not texts are moved and compared."""
    return [F.xxhash64(c), F.xxhash64(F.lit("2"), c)]


def look_alikes(texts: DataFrame) -> DataFrame:
    """Pairs of keys with texts that look the same and are different strings.

    ``texts`` has ``src_table``, ``id`` and ``text``; one key may have several texts and one
    text several keys. Result: ``src_table, id_a, id_b`` with ``id_a < id_b``, each pair
    once. Null keys and texts without a visible character are in no pair.

    Each text is brought to its form once and kept as numbers of form and text. The first
    pass aggregates two numbers per form and so finds the forms that are written in more than
    one way, with partial aggregation whatever a form's share of the rows; only their rows
    are joined. A large group is cut into blocks of about ``BLOCK`` rows, and two blocks meet
    in a cell of their own: a task holds two blocks, never a whole group, and no pair is lost.
    """
    t = texts.select("src_table", "id", "text").where(F.col("id").isNotNull() & F.col("text").rlike(ch.VISIBLE_JAVA))
    h, g = _number("form")
    x, y = _number("text")
    t = materialized(t.withColumn("form", unified("text")).select("src_table", "id", h.alias("h"), g.alias("g"), x.alias("x"), y.alias("y")))
    form = ["src_table", "h", "g"]
    varied = t.groupBy(*form).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi")
    rows = t.join(varied.select(*form, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), form).distinct()
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # a row is on the left with its own and later blocks, on the right with its own and earlier ones
    left = rows.select(*form, F.col("id").alias("l"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("block").alias("i"), F.explode_outer(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    right = rows.select(*form, F.col("id").alias("r"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.explode_outer(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"))
    return (
        left.join(right, [*form, "i", "j"])
        .where("l <> r AND (lx <> rx OR ly <> ry)")
        .select("src_table", F.least("l", "r").alias("id_a"), F.greatest("l", "r").alias("id_b"))
        .distinct()
    )
