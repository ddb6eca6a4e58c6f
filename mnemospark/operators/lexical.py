"""Lexical ranking of many queries at once: postings, document frequency, BM25, coverage.

A unit is a row with a title, a body, entities and tags, in a channel (memories, messages,
documents) that has its own statistics. Queries and units meet in parts of the units
(``operators.search``), so pairs that share a term are never rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import search
from mnemospark.operators.versions import latest
from mnemospark.session import materialized

FIELDS = search.FIELDS
COMMON, LEAST_UNITS = 0.3, 8
POOL, DEPTH = 200, 50
RELEVANCE = {"coverage": 0.65, "lexical": 0.35, "phrase": 0.15}
CHANNELS = ("memory", "message", "document")
_NONE = "array<string>"


def episode_units(episodes: DataFrame) -> DataFrame:
    """Searchable units of the latest version of each episode, whatever its status."""
    e = latest(episodes, ["episode_id"], "version")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    trailing = lambda c: F.when(F.length(text(c)) > 0, F.concat(F.lit("\n"), F.col(c))).otherwise(F.lit(""))
    return e.select(
        F.lit("memory").alias("channel"), F.col("episode_id").alias("unit_id"), T.first_sentence(text("content")).alias("title"),
        F.concat(text("content"), trailing("state"), trailing("excerpt")).alias("body"),
        F.coalesce("entities", F.array().cast(_NONE)).alias("entities"), F.coalesce("topics", F.array().cast(_NONE)).alias("tags"),
        F.when(F.col("status") == "active", "confirmed").otherwise("archived").alias("status"),
        F.coalesce("importance", F.lit(0.5)).alias("importance"), F.col("time_start").alias("effective_at"), "version", "kind",
        F.coalesce("source_raw_ids", F.array().cast(_NONE)).alias("sources"),
    )


def document_units(documents: DataFrame) -> DataFrame:
    """Documents as units of one field, the body."""
    none = F.array().cast(_NONE)
    return documents.select(
        F.lit("document").alias("channel"), F.col("doc_id").alias("unit_id"), F.lit("").alias("title"), F.coalesce("text", F.lit("")).alias("body"), none.alias("entities"), none.alias("tags"),
        F.lit("confirmed").alias("status"), F.lit(0.5).alias("importance"), F.date_format("effective_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("effective_at"), F.lit(1).alias("version"),
        F.lit("document").alias("kind"), none.alias("sources"),
    )


def message_units(messages: DataFrame) -> DataFrame:
    """Messages as units of one field, each id once, in the text that arrived first.

    ``messages`` has ``arrival`` (see ``sources.tables.with_arrival``) and ``speaker`` besides
    its columns. ``ord`` is the place in its file, so that neighbours have neighbouring ones.
    """
    first = messages.where("id IS NOT NULL").groupBy("id").agg(F.min_by(F.struct("content", "created_at", "conversation_id", "turn_id", "speaker", "arrival"), "arrival").alias("m"))
    none = F.array().cast(_NONE)
    return first.select(
        F.lit("message").alias("channel"), F.col("id").alias("unit_id"), F.lit("").alias("title"), F.coalesce("m.content", F.lit("")).alias("body"), none.alias("entities"), none.alias("tags"),
        F.lit("original").alias("status"), F.lit(0.5).alias("importance"), F.col("m.created_at").alias("effective_at"), F.lit(1).alias("version"), F.lit("message").alias("kind"), F.array("id").alias("sources"),
        F.col("m.conversation_id").alias("conversation_id"), F.col("m.turn_id").alias("turn_id"), F.col("m.arrival.row").alias("ord"), F.col("m.speaker").alias("speaker"),
    )


def _marked(field: str) -> Column:
    return F.transform(field, lambda x: F.struct(F.lit(field).alias("field"), x.alias("term")))


def postings(units: DataFrame) -> DataFrame:
    """``channel, term, unit_id, title, body, ent, tag, tokens``: how often a term occurs in
    each field of a unit, and the length of the unit (terms of all fields and single
    ideographs, as the index counts them). Every unit also has a row of the empty term, so
    that units are counted without reading them again. Written once, for all that asks it.
    """
    joined = lambda c: F.array_join(F.col(c), "\n")
    texts = {"title": F.col("title"), "body": F.col("body"), "ent": joined("entities"), "tag": joined("tags")}
    t = units.select("channel", "unit_id", *[T.terms(x).alias(f) for f, x in texts.items()], F.size(T.cjk_characters(F.concat_ws("\n", *texts.values()))).alias("_single"))
    t = t.withColumn("tokens", reduce(Column.__add__, [F.size(f) for f in texts]) + F.col("_single"))
    each = F.concat(F.array(F.struct(F.lit("").alias("field"), F.lit("").alias("term"))), *[_marked(f) for f in texts])
    # the outer form, for the other would compute the list twice to filter by it
    e = t.select("channel", "unit_id", "tokens", F.explode_outer(each).alias("p")).select("channel", "unit_id", "tokens", "p.field", "p.term")
    return e.groupBy("channel", "term", "unit_id", "tokens").agg(*[F.count_if(F.col("field") == f).alias(f) for f in texts])


def sizes(postings_: DataFrame) -> DataFrame:
    """``channel, n_units, mean``: a row per channel."""
    return postings_.where("term = ''").groupBy("channel").agg(F.count(F.lit(1)).alias("n_units"), F.avg("tokens").alias("mean"))


def document_frequency(postings_: DataFrame) -> DataFrame:
    """``channel, term, df`` and the same by field: units with the term."""
    by_field = [F.count_if(F.col(f) > 0).alias(f"n_{f}") for f in FIELDS]
    return postings_.where("term <> ''").groupBy("channel", "term").agg(F.count(F.lit(1)).alias("df"), *by_field)


def analysed(queries: DataFrame) -> DataFrame:
    """``query_id, term`` of ``query_id, text``: the informative terms, each once."""
    return queries.select("query_id", F.explode_outer(T.informative("text")).alias("term")).where("term IS NOT NULL")


def weights(asked: DataFrame, postings_: DataFrame) -> DataFrame:
    """``query_id, channel, term, weight`` for coverage: terms of too many units go, others
    weigh up to one and as little as half as they spread; in a small channel all weigh one."""
    spread = F.coalesce("df", F.lit(0)) / F.col("n_units")
    every = asked.withColumn("channel", F.explode(F.array(*map(F.lit, CHANNELS)))).join(sizes(postings_), "channel")
    return (
        every.join(document_frequency(postings_).select("channel", "term", "df"), ["channel", "term"], "left")
        .where((F.col("n_units") < LEAST_UNITS) | (spread <= COMMON))
        .select("query_id", "channel", "term", F.when(F.col("n_units") >= LEAST_UNITS, F.round(1.0 - 0.5 * spread, 4)).otherwise(F.lit(1.0)).alias("weight"))
    )


def indexed(units: DataFrame, phrases: bool = False) -> DataFrame:
    """``channel, unit_id, status, tokens, title, body, ent, tag``: the terms of each field of
    a unit in order with repeats, between spaces, and the length of the unit (terms of all
    fields and single ideographs, as the index counts them); and its ``phrase``."""
    joined = lambda c: F.array_join(F.col(c), "\n")
    texts = {"title": F.col("title"), "body": F.col("body"), "ent": joined("entities"), "tag": joined("tags")}
    phrase = [T.phrase(F.concat_ws(" ", "title", "body")).alias("phrase")] if phrases else []
    t = units.select("channel", "unit_id", "status", *[T.terms(x).alias(f) for f, x in texts.items()], F.size(T.cjk_characters(F.concat_ws("\n", *texts.values()))).alias("_single"), *phrase)
    tokens = reduce(Column.__add__, [F.size(f) for f in texts]) + F.col("_single")
    return t.select("channel", "unit_id", "status", tokens.alias("tokens"), *[F.array_join(f, " ").alias(f) for f in texts], *["phrase"] * phrases)


def asked_of(queries: DataFrame, most: int | None = 64) -> DataFrame:
    """``query_id, terms, phrase`` of ``query_id, text``: the informative terms between spaces
    (of the first ``most``, or of all), and the phrase where it is long enough to say something."""
    q = queries.select("query_id", F.array_join(T.informative("text", most), " ").alias("terms"), T.phrase("text").alias("_p"))
    return q.select("query_id", "terms", F.when((F.length("_p") >= 4) | F.col("_p").rlike(f"[{T.CJK}].*[{T.CJK}]"), F.col("_p")).alias("phrase"))


def vocabulary(asked: DataFrame, index: DataFrame) -> DataFrame:
    """``channel, term, stats`` of the terms asked for: the mean length of a unit, the idf over
    units with the term in any field and by field, and the weight for coverage (NaN for a term
    of too many units), as ``operators.search`` has them. An idf is at least 1e-6."""
    whole = F.concat_ws(" ", *FIELDS).alias("text")
    texts = F.array(F.struct(F.lit("any").alias("field"), whole), *[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])
    rows = index.select("channel", F.explode(texts).alias("t")).select("channel", "t.field", "t.text").where("text <> ''")
    rows = rows.select("channel", "field", F.explode_outer(F.array_distinct(F.split("text", " "))).alias("term")).where("term <> ''")
    df = rows.groupBy("channel", "term").agg(F.count_if(F.col("field") == "any").alias("df"), *[F.count_if(F.col("field") == f).alias(f"n_{f}") for f in FIELDS])
    per = index.groupBy("channel").agg(F.count(F.lit(1)).alias("n_units"), F.avg("tokens").alias("mean"))
    terms = asked.select(F.explode_outer(F.split("terms", " ")).alias("term")).where("term <> ''").distinct()
    every = terms.withColumn("channel", F.explode(F.array(*map(F.lit, CHANNELS)))).join(per, "channel")
    every = every.join(df, ["channel", "term"], "left").fillna(0, ["df", *[f"n_{f}" for f in FIELDS]])

    def idf(nt: str) -> Column:
        x = F.log((F.col("n_units") - F.col(nt) + 0.5) / (F.col(nt) + 0.5))
        return F.greatest(F.when(x > 0, x), F.lit(1e-6))

    share = F.col("df") / F.col("n_units")
    weight = F.when(F.col("n_units") < LEAST_UNITS, 1.0).when(share <= COMMON, F.round(1.0 - 0.5 * share, 4)).otherwise(float("nan"))
    return every.select("channel", "term", F.array("mean", idf("df"), *[idf(f"n_{f}") for f in FIELDS], weight).alias("stats"))


def bm25_pool(asked: DataFrame, terms: DataFrame, index: DataFrame, size: int) -> DataFrame:
    """``query_id, channel, unit_id, score, rank``: the pool by BM25, with frequencies weighted
    by field and one idf over units with the term in any field; lengths count all fields."""
    return search.best(index, asked, terms, size)


def raw_score() -> Column:
    """The weighted sum of four scores, one by each field with the idf of that field."""
    return F.round(reduce(Column.__add__, [F.round(f"b_{c}", 4) * w for c, w in FIELDS.items()]), 6)


def coverage(asked: DataFrame, terms: DataFrame, index: DataFrame, candidates: DataFrame, matched: bool = True) -> DataFrame:
    """``query_id, channel, unit_id, raw, coverage, n_matched, n_strong, n_terms, weight_sum,
    phrase, matched`` of candidate pairs: the share of a query's weight that the unit's terms
    match, rounded to four digits, and the matched terms with their weights."""
    return search.common(index, asked, terms, candidates, matched).select(
        "query_id", "channel", "unit_id", raw_score().alias("raw"), F.round(F.coalesce(F.try_divide("part", "whole"), F.lit(0.0)), 4).alias("coverage"),
        "n_matched", "n_strong", "n_terms", F.col("whole").alias("weight_sum"), F.coalesce("phrase", F.lit(False)).alias("phrase"), "matched",
    )


def relevance(asked: DataFrame, terms: DataFrame, index: DataFrame, size: int = POOL) -> DataFrame:
    """The lexical ranking: ``query_id, channel, unit_id, raw, coverage, phrase, relevance, ...``
    of an index with phrases.

    The pool is cut before the filter on status, so an archived unit uses up its place; the
    raw score of what remains is set against the best of its query and channel.
    """
    best = bm25_pool(asked, terms, index, size).select("query_id", "channel", "unit_id")
    kept = materialized(best.join(index.where("status IN ('confirmed', 'original')").select("channel", "unit_id"), ["channel", "unit_id"]))
    scored = coverage(asked, terms, index, kept, matched=False).drop("matched")
    top = F.max("raw").over(Window.partitionBy("query_id", "channel"))
    value = RELEVANCE["coverage"] * F.col("coverage") + RELEVANCE["lexical"] * F.when(top > 0, F.col("raw") / top).otherwise(0.0) + F.when(F.col("phrase"), RELEVANCE["phrase"]).otherwise(0.0)
    return scored.withColumn("relevance", F.round(F.least(F.lit(1.0), value), 4))


def searched(queries: DataFrame, units: DataFrame, phrases: bool = False, most: int | None = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, terms and index as ``bm25_pool``, ``relevance`` and ``coverage`` take them, each
    written once; of a query its first ``most`` terms, or all."""
    index, asked = materialized(indexed(units, phrases)), materialized(asked_of(queries, most))
    return asked, materialized(vocabulary(asked, index)), index


def single_character_hits(queries: DataFrame, units: DataFrame) -> DataFrame:
    """``query_id, channel, unit_id, n``: units with the one ideograph that is the whole query,
    with the number of times it occurs. Characters and units meet by equality."""
    q = queries.select("query_id", T.single_character("text").alias("character")).where("character IS NOT NULL")
    whole = F.concat_ws("\n", "title", F.array_join("entities", "\n"), F.array_join("tags", "\n"), "body")
    c = units.select("channel", "unit_id", F.explode_outer(T.cjk_characters(whole)).alias("character")).where("character IS NOT NULL").groupBy("channel", "unit_id", "character").agg(F.count(F.lit(1)).alias("n"))
    return q.join(c, "character").select("query_id", "channel", "unit_id", "n")
