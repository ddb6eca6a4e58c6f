"""Files as sources and sinks: lines and documents of JSON, texts with front matter, append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROKEN = "_broken"

MESSAGE = T.StructType([T.StructField(c, T.StringType()) for c in "id source conversation_id item_id role content created_at ingested_at sha256 claude_session_id turn_id source_type meta".split()])


def json_lines(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON lines (or of a document per file), and what could not be read.

    Blank lines are no rows. A torn or foreign line raises nothing: it comes out in the
    second table (column ``line``), to be counted. Fields a line lacks are null.
    """
    lines = spark.read.text(path, wholetext=multi_line).where(F.col("value").rlike(r"\S"))
    whole = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    read = lines.select("value", F.from_json("value", whole, {"columnNameOfCorruptRecord": BROKEN, "mode": "PERMISSIVE"}).alias("r"))
    bad = F.col("r").isNull() | F.col(f"r.{BROKEN}").isNotNull()
    return read.where(~bad).select(*[F.col("r").getField(f.name).alias(f.name) for f in schema.fields]), read.where(bad).select(F.col("value").alias("line"))


def append_json(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Appends rows as JSON lines; the commit protocol of the job makes it all or nothing."""
    rows.write.mode("append").partitionBy(*partition_by).json(path)


def message_rows(records: DataFrame) -> DataFrame:
    """Records as message rows with defaults: a missing hash is computed, upper case lowered,
    empty provenance is null, ``meta`` becomes a map (null when it is no JSON object)."""
    empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    return records.withColumns({
        "content": F.coalesce("content", F.lit("")), "sha256": F.coalesce(F.lower(empty("sha256")), F.sha2(F.coalesce("content", F.lit("")), 256)),
        "ingested_at": empty("ingested_at"), "turn_id": empty("turn_id"), "claude_session_id": empty("claude_session_id"), "meta": F.from_json("meta", "map<string,string>"),
    })


def front_matter(text: Column) -> Column:
    """``struct<head: map<string,string>, body: string>`` of a text that begins with lines
    ``key: value`` between two lines of dashes; without them the head is empty."""
    t = F.regexp_replace(text, "\r\n?", "\n")
    head = F.regexp_extract(t, r"\A---\n((?s:.*?))\n?---(?:\n|\z)", 1)
    there = t.rlike(r"\A---\n(?s:.*?)\n?---(?:\n|\z)")
    lines = F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))
    # of a key given twice the last line counts
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"])))
    return F.when(there, F.struct(last.alias("head"), F.regexp_replace(t, r"\A---\n(?s:.*?)\n?---(?:\n|\z)", "").alias("body"))).otherwise(F.struct(F.create_map().cast("map<string,string>").alias("head"), t.alias("body")))


def with_front_matter(head: dict[str, Column], body: Column) -> Column:
    """A text with the columns as front matter; values are kept on one line, nulls left out."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), F.regexp_replace(c.cast("string"), r"\s*[\r\n]+\s*", " "))) for k, c in head.items()]
    return F.concat(F.lit("---\n"), F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n---\n"), F.coalesce(body, F.lit("")))


def evolved(*tables: DataFrame) -> DataFrame:
    """Tables of several ages of a schema as one; columns a table lacks are null in it."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
