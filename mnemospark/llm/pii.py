"""Personal information in free text: found by a trained tagger, replaced by placeholders.

Texts are cut at line ends and ideographic full stops, which no mention crosses, and nowhere
else; what is longer than a window is tagged in overlapping windows whose scores are blended
and decoded as one path. Equal segments are tagged once, whatever number of texts they occur
in: their distinct values are shuffled, tagged in batches by a character-level BiLSTM-CRF,
and only those with a mention are joined back.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from io import BytesIO
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm import characters as ch
from mnemospark.llm.charlstm import Tagger, spans
from mnemospark.session import materialized

MODEL = str(Path(__file__).with_name("pii_model.npz"))
#: Texts are cut behind line ends and ideographic full stops.
CUT = r"(?<=[。！？\n])"
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Segments tagged in one call of the model.
CHUNK = 4096
#: Rows of a table of numbers and masks that is broadcast at most.
BROADCAST = 500_000
_HAN_DIGITS = "零〇一二三四五六七八九十百两幺"


def segments(text: str) -> list[str]:
    """The segments of a text, in order; together they are the text."""
    return [s for s in re.split(CUT, text) if s]


@lru_cache(1 << 15)
def _folded(c: str) -> str:
    if c.isspace():
        return " "
    return ch.fold(c)


@lru_cache(1 << 15)
def _plain(c: str) -> bool:
    """Whether a character stays as it is, whatever stands before it."""
    return not unicodedata.combining(c) and _folded(c) == c


def normalised(segment: str) -> tuple[str, np.ndarray]:
    """The segment as the tagger reads it, and where each of its characters stood.

    Width and compatibility forms, look-alike letters and invisible characters are folded,
    accents composed and runs of white space shortened.
    """
    if "  " not in segment and (segment.isascii() and not re.search(r"[\t\n\r\f\v]", segment) or all(map(_plain, set(segment)))):
        return segment, np.arange(len(segment))
    out: list[str] = []
    place: list[int] = []
    for i, c in enumerate(segment):
        if unicodedata.combining(c) and out:
            joined = unicodedata.normalize("NFC", out[-1] + c)
            if len(joined) == 1:
                out[-1] = joined
                continue
        for f in _folded(c):
            if f == " " and out and out[-1] == " ":
                continue
            out.append(f)
            place.append(i)
    return "".join(out), np.array(place, dtype=np.int64)


# What stands in or before a name and is no part of it that counts.
_TITLES = frozenset("dr mr mrs ms miss prof professor doctor sir herr frau monsieur madame señor señora signor signora".split())
_PARTICLES = frozenset("de del della der den di da dos du la le van von y zu".split())


def plausible(kind: str, text: str) -> bool:
    """The exact check behind the tagger: a span must have what its type cannot do without,
    and no list of words or greatest length says what it may be."""
    digits = sum(c.isdigit() for c in text)
    if kind == "email":
        return bool(re.search(r"(?:@|\bat\b|\(at\))\s?[^\s@]+.*(?:\.|dot\b)", text, re.I)) and bool(re.search(r"[A-Za-z)]\W*$", text))
    if kind == "phone":
        return digits >= 7 or sum(c in _HAN_DIGITS for c in text) >= 7
    if kind == "id_number":
        return digits >= 6
    if kind == "address":
        return (bool(digits) or any(c in _HAN_DIGITS for c in text)) and sum(c.isalpha() for c in text) >= 2
    if any("一" <= c <= "鿿" for c in text):
        return len(text) >= 2 and text != "谢谢"  # thanks, though 谢 is a family name
    words = re.findall(r"[^\W\d_]+(?:['’-][^\W\d_]+)*", text)
    words = [w for w in words if w.lower() not in _PARTICLES and w.lower() not in _TITLES]
    return len(words) >= 2 and min(len(words[0]), len(words[-1])) > 1 and (text.islower() or all(not w.islower() for w in words))


@lru_cache(2)
def _model(content: bytes) -> Tagger:
    """One tagger per worker process."""
    return Tagger.load(BytesIO(content))


def find(texts: list[str], model: Tagger) -> list[list[tuple[int, int, str]]]:
    """Mentions of each segment as (start, end, type) in its own characters."""
    read = [normalised(t) for t in texts]
    out = []
    for (text, place), raw, tags in zip(read, texts, model.decode([t for t, _ in read])):
        found = []
        for a, b, kind in spans(tags):
            while b > a and text[b - 1] in " ,.;:!?，。；：！？":
                b -= 1
            while b > a and text[a] == " ":
                a += 1
            if b > a and plausible(kind, text[a:b]):
                end = int(place[b]) if b < len(place) else len(raw)
                found.append((int(place[a]), end if b < len(place) else int(place[b - 1]) + 1, kind))
        out.append(found)
    return out


def _tag(held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(held.value)
        for pdf in batches:
            for at in range(0, len(pdf), CHUNK):
                part = pdf["segment"].iloc[at : at + CHUNK].tolist()
                rows = [(s, [{"start": a, "end": b, "type": k} for a, b, k in f]) for s, f in zip(part, find(part, model)) if f]
                yield pd.DataFrame(rows, columns=["segment", "mentions"])

    return run


def cut(c: Column) -> Column:
    return F.filter(F.split(c, CUT), lambda s: s != "")


def _number(c: Column | str) -> list[Column]:
    """A text as 128 bits, so that joins move numbers and not texts."""
    return [F.xxhash64(c).alias("h"), F.xxhash64(F.lit("g"), c).alias("g")]


def _parts(texts: DataFrame, *keep: str) -> DataFrame:
    # the outer form, for the other cuts every text twice
    return texts.where(F.col("text").isNotNull()).select(*keep, F.posexplode_outer(cut(F.col("text"))).alias("k", "segment")).where(F.length("segment") > 1)


def mentions(parts: DataFrame, model: str = MODEL) -> DataFrame:
    """``segment, mentions`` of every distinct value of ``parts.segment`` that has any."""
    spark = parts.sparkSession
    # tagging is costly for its bytes: parts by number and not by size
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # the model is a file of some 50 kB, read by the driver
    distinct = parts.select("segment").where(F.length("segment") > 1).distinct().repartition(n)
    return distinct.mapInPandas(_tag(spark.sparkContext.broadcast(Path(model).read_bytes())), "segment string, mentions array<struct<start:int,end:int,type:string>>")


def _small(df: DataFrame) -> DataFrame:
    """A table to broadcast where it is counted and small, so that a segment or text that a
    third of all rows share is not shuffled; as it is otherwise."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def found(texts: DataFrame, model: str = MODEL) -> DataFrame:
    """``src_table, row_id, pii_type`` of a table of ``src_table, row_id, text``, once each.

    A row counts when any text with its key has a mention of the type. Null and empty texts
    and null keys have none; repeated rows and long texts need no care, the latter being
    read whole in overlapping windows.
    """
    parts = _parts(texts.where(F.col("row_id").isNotNull()), "src_table", "row_id")
    types = materialized(mentions(parts, model).select(*_number("segment"), F.array_distinct(F.transform("mentions", lambda m: m["type"])).alias("types")))
    return (
        parts.select("src_table", "row_id", *_number("segment"))
        .join(_small(types), ["h", "g"])
        .select("src_table", "row_id", F.explode("types").alias("pii_type"))
        .distinct()
    )


def redacted(texts: DataFrame, model: str = MODEL) -> DataFrame:
    """``src_table, row_id, text`` with each mention replaced by the placeholder of its type.

    Rows without a mention are handed on as they are. For the others the segments, masked
    where needed, are put together again in order; nothing else of a text changes. Null and
    empty texts stay so, and every row comes out once. Rows and their masks meet by a number
    of the text, and a row without text by one of its own, so none are gathered.
    """
    rows = texts.select("src_table", "row_id", "text")
    marks = F.create_map(*[F.lit(x) for kv in PLACEHOLDER.items() for x in kv])
    # from the end to the start, so that places to the left stay valid
    masked = F.aggregate(
        F.reverse(F.array_sort("mentions")), F.col("segment"),
        lambda s, m: F.concat(F.substring(s, F.lit(1), m["start"]), F.try_element_at(marks, m["type"]), F.substring(s, m["end"] + 1, F.length(s))),
    )
    change = materialized(mentions(_parts(rows), model).select(*_number("segment"), masked.alias("masked")))
    t, u = _number("text")
    numbered = rows.where(F.col("text").isNotNull()).select(t.alias("t"), u.alias("u"), "text")
    changed = (
        _parts(numbered, "t", "u").select("t", "u", "k", *_number("segment")).join(_small(change), ["h", "g"])
        .groupBy("t", "u").agg(F.map_from_entries(F.collect_set(F.struct("k", "masked"))).alias("by"))
    )
    key = F.when(F.col("text").isNull(), F.xxhash64("src_table", "row_id")).otherwise(t)
    whole = F.concat_ws("", F.transform(cut(F.col("text")), lambda s, i: F.coalesce(F.try_element_at(F.col("by"), i), s)))
    j = rows.withColumns({"t": key, "u": u}).join(_small(materialized(changed)), ["t", "u"], "left")
    return j.select("src_table", "row_id", F.when(F.col("by").isNotNull() & F.col("text").isNotNull(), whole).otherwise(F.col("text")).alias("text"))
