"""Queries of the text problems, for the entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import conversations, packing, pii, tokens, truncation, unify
from mnemospark.plans.problems import millis_sql
from mnemospark.sources.tables import table


def _personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "originals").select(F.lit("originals").alias("src_table"), F.col("id").alias("row_id"), F.col("content").alias("text"))
    e = table(spark, sf_dir, "episodes").select(F.lit("episodes").alias("src_table"), F.col("episode_id").alias("row_id"), F.col("content").alias("text"))
    return o.unionByName(e)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_personal(spark, sf_dir))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every content with placeholders in the place of personal information."""
    return pii.redacted(_personal(spark, sf_dir))


def _same_looking(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "originals").select(F.lit("originals").alias("src_table"), "id", F.col("content").alias("text"))
    n = table(spark, sf_dir, "names").select(F.lit("names").alias("src_table"), F.col("name_id").alias("id"), F.explode("aliases").alias("text"))
    return o.unionByName(n)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.look_alikes(_same_looking(spark, sf_dir))


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its consistent form: contents by id, aliases by name_id."""
    return _same_looking(spark, sf_dir).select("src_table", "id", unify.unified("text").alias("text"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.defects(spark, table(spark, sf_dir, "originals"), table(spark, sf_dir, "speakers"))


def p4_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations that are whole, as ordered rows of speaker and text."""
    return conversations.rebuilt(spark, table(spark, sf_dir, "originals"), table(spark, sf_dir, "speakers"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which text, or piece of a text, lies in which container of each budget."""
    items = packing.document_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "budgets"))
    return packing.pack(items).select("budget_id", F.col("key").alias("doc_id"), "piece", F.col("size").alias("n_tokens"), "container")


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per budget: containers used, the lower bound and the share filled."""
    items = packing.document_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "budgets"))
    return packing.fill_report(packing.pack(items))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.judged(table(spark, sf_dir, "documents")).where("cut").select("doc_id").distinct()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.shares(truncation.judged(table(spark, sf_dir, "documents")))


QUERIES = {
    "p1_found": p1_found, "p1_redacted": p1_redacted,
    "p3_found": p3_found, "p3_unified": p3_unified, "p4_found": p4_found, "p4_rebuilt": p4_rebuilt, "p6_ids": p6_ids,
    "p7_packed": p7_packed, "p7_fill": p7_fill, "p8_found": p8_found, "p8_shares": p8_shares,
}
# Characters that show nothing, for the other engine's regular expressions.
_BLANK = r"\s\pZ\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}"
ORACLES: dict[str, str] = {
    "p4_found": f"""
WITH o AS (SELECT *, row_number() OVER () AS rn FROM originals),
f AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY conversation_id, coalesce(item_id, 'row ' || rn) ORDER BY rn) = 1),
s AS (SELECT conversation_id, rn, {millis_sql('created_at')} AS ms, speaker, coalesce(regexp_matches(content, '[^{_BLANK}]'), false) AS v
  FROM f LEFT JOIN (SELECT DISTINCT lower(trim(alias)) AS alias, speaker FROM speakers) ON alias = lower(regexp_replace(role, '^\\s+|\\s+$', '', 'g'))),
c AS (SELECT conversation_id, coalesce(bool_or(v AND speaker IN ('user', 'assistant')), false) AS shown, bool_or(speaker IS NULL OR ms IS NULL) AS odd FROM s GROUP BY 1),
t AS (SELECT * FROM s WHERE ms IS NOT NULL AND speaker IN ('user', 'assistant')),
n AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY conversation_id ORDER BY ms, rn) THEN 0 ELSE 1 END AS new FROM t),
g AS (SELECT *, sum(new) OVER (PARTITION BY conversation_id ORDER BY ms, rn ROWS UNBOUNDED PRECEDING) AS turn FROM n),
r AS (SELECT conversation_id, turn, any_value(speaker) AS speaker, bool_or(v) AS v FROM g GROUP BY 1, 2),
a AS (SELECT *, coalesce(lead(v) OVER (PARTITION BY conversation_id ORDER BY turn), false) AS answered FROM r),
j AS (SELECT conversation_id, bool_or(speaker = 'user' AND v AND NOT answered) AS unanswered, bool_or(turn = 1 AND speaker = 'assistant') AS begun FROM a GROUP BY 1)
SELECT conversation_id, 'empty' AS defect FROM c WHERE NOT shown
UNION ALL SELECT conversation_id, 'broken' FROM c LEFT JOIN j USING (conversation_id) WHERE shown AND (odd OR coalesce(begun, false))
UNION ALL SELECT conversation_id, 'unanswered' FROM c JOIN j USING (conversation_id) WHERE shown AND unanswered""",
}
