"""Cutting documents into units and chunks that tile them exactly."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, CHUNK, LEAST = 300, 600, 20


def unit_ends(text: str, most: int = UNIT) -> list[int]:
    """Where the sentences and lines of a text end; longer ones are cut at ``most``."""
    ends, at = [], 0
    for m in re.finditer(r"[^。！？!?.\n]*(?:[。！？!?]+|\.(?=\s)|\n+|$|\.)", text):
        if m.end() == m.start():
            continue
        while m.end() - at > most:
            at += most
            ends.append(at)
        if m.end() > at:
            at = m.end()
            ends.append(at)
    if at < len(text):
        ends.append(len(text))
    return ends


def chunk_ends(text: str, size: int = CHUNK, least: int = LEAST) -> list[int]:
    """Where chunks end: units are taken up to about ``size`` characters, a paragraph's end
    closes a chunk of at least half of it, and a rest of less than ``least`` joins the last."""
    ends: list[int] = []
    start = before = 0
    for e in unit_ends(text):
        if e - start > size and before > start:
            ends.append(before)
            start = before
        if e - start >= size // 2 and text[:e].endswith("\n\n"):
            ends.append(e)
            start = e
        before = e
    if len(text) > start:
        if ends and len(text) - start < least:
            ends[-1] = len(text)
        else:
            ends.append(len(text))
    return ends


def chunked(documents: DataFrame, key: str, text: str, size: int = CHUNK) -> DataFrame:
    """``key, chunk, start_at, end_at, text``: chunks that together are the text. Null and
    empty texts have none."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["key"], pdf["text"]):
                a = 0
                for n, b in enumerate(chunk_ends(t, size)):
                    rows.append((k, n, a, b, t[a:b]))
                    a = b
            yield pd.DataFrame(rows, columns=["key", "chunk", "start_at", "end_at", "text"])

    d = documents.where(F.col(text).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return d.mapInPandas(run, f"key {kind}, chunk int, start_at int, end_at int, text string").withColumnRenamed("key", key)
