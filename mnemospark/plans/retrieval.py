"""Queries of the recall path: terms, BM25, vectors, entities, fusion, gate, folding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions.times import to_millis
from mnemospark.operators import dedupe, entities, fusion, lexical, vectors
from mnemospark.plans import sql
from mnemospark.plans.sql import SPEAKERS, SPELT
from mnemospark.session import materialized
from mnemospark.operators.speakers import with_speaker
from mnemospark.sources.tables import spread, table, with_arrival

NOW_MS = 1_461_000_000_000
#: Documents whose id is divisible by this are the queries.
EVERY = 50


def _units(spark: SparkSession, d: str) -> DataFrame:
    return lexical.episode_units(table(spark, d, "episodes"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated set of queries, in their whole text."""
    docs = table(spark, d, "documents").where(f"doc_id % {EVERY} = 0 AND text IS NOT NULL")
    return docs.select(F.col("doc_id").alias("query_id"), "text")


def term_df(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.terms("text"))).alias("term"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def informative_terms(spark: SparkSession, d: str) -> DataFrame:
    return lexical.analysed(_queries(spark, d))


def document_phrases(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.length(T.phrase("text")).alias("n_phrase"), F.size(T.cjk_characters("text")).alias("n_cjk"), T.token_estimate("text").alias("estimate"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_units(spread(table(spark, d, "documents").select("doc_id", "text", "effective_at")))


def bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    """The best documents for each query by all terms of its text."""
    return lexical.bm25_pool(*lexical.searched(_queries(spark, d), _documents(spark, d), most=None), 20).select("query_id", "unit_id", "score", "rank")


def bm25_episodes(spark: SparkSession, d: str) -> DataFrame:
    s = lexical.searched(_queries(spark, d), _units(spark, d))
    best = materialized(lexical.bm25_pool(*s, 50))
    return best.join(lexical.coverage(*s, best, matched=False), ["query_id", "channel", "unit_id"]).select("query_id", "unit_id", "score", "raw", "rank")


def coverage_weights(spark: SparkSession, d: str) -> DataFrame:
    p = materialized(lexical.postings(_units(spark, d)))
    return lexical.weights(lexical.analysed(_queries(spark, d)), p).select("query_id", "term", "weight")


def lexical_ranking(spark: SparkSession, d: str) -> DataFrame:
    r = lexical.relevance(*lexical.searched(_queries(spark, d), _units(spark, d), phrases=True))
    return fusion.ranked(r.where("n_matched > 0"), "relevance").select("query_id", "unit_id", "raw", "coverage", "phrase", "relevance", "rank")


def pool_then_filter(spark: SparkSession, d: str) -> DataFrame:
    """Archived units use up places of the pool: how many of each query's pool remain."""
    asked, terms, index = lexical.searched(_queries(spark, d), _units(spark, d))
    best = lexical.bm25_pool(asked, terms, index, lexical.POOL)
    return best.join(index.select("unit_id", "status"), "unit_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_pool"), F.count_if(F.col("status") == "confirmed").alias("n_kept"))


def query_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Keywords, phrase length and intent of each query."""
    q = _queries(spark, d)
    return q.select("query_id", F.array_join(F.array_sort(T.keywords("text")), "|").alias("keywords"), F.size(T.informative("text")).alias("n_terms"), T.single_character("text").alias("character"), T.quote_intent("text").alias("quotes"))


def characters_found(spark: SparkSession, d: str) -> DataFrame:
    """Single ideographs asked for (the first of each alias) and the episodes that have them."""
    n = table(spark, d, "names").select(F.col("name_id").alias("query_id"), F.substring("name", 1, 1).alias("text"))
    h = lexical.single_character_hits(n, _units(spark, d))
    return h.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_units"), F.sum("n").alias("n"))


def cosine_top(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"))
    asked = e.where(f"vec_id % {EVERY} = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return vectors.top_by_cosine(rows, asked, k=50, floor=0.1)


def entity_lexicon(spark: SparkSession, d: str) -> DataFrame:
    return entities.lexicon(_units(spark, d)).select("entity", "df")


def entity_weights(spark: SparkSession, d: str) -> DataFrame:
    u = _units(spark, d)
    return entities.weighted(entities.lexicon(u), u).select("entity", F.round("weight", 6).alias("weight"))


def entity_ranking(spark: SparkSession, d: str) -> DataFrame:
    return entities.scores(_queries(spark, d), _units(spark, d))


def name_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Names and aliases that each conversation mentions, with the number of messages."""
    n = table(spark, d, "names").select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).where("name IS NOT NULL")
    o = table(spark, d, "originals").where("content IS NOT NULL").select(F.struct("conversation_id", "item_id").alias("query_id"), F.col("content").alias("text"))
    return entities.named(o, n).groupBy(F.col("query_id.conversation_id").alias("conversation_id"), "name").agg(F.count(F.lit(1)).alias("n_messages"))


def heat(spark: SparkSession, d: str) -> DataFrame:
    return fusion.heat(table(spark, d, "seen"), "ref_id", to_millis("at"), NOW_MS)


def recency(spark: SparkSession, d: str) -> DataFrame:
    u = _units(spark, d)
    half = fusion.half_life(F.lit("episode"), F.col("importance"), F.col("tags"))
    age = (F.lit(NOW_MS) - to_millis("effective_at")) / 86_400_000
    return u.select("unit_id", half.alias("half_life"), F.round(F.lit(fusion.CAPS["recency"]) * fusion.decay(age, half), 4).alias("recency"))


def source_quality(spark: SparkSession, d: str) -> DataFrame:
    return fusion.source_quality(_units(spark, d), with_speaker(table(spark, d, "originals"), table(spark, d, "speakers")))


def frequent_entities(spark: SparkSession, d: str) -> DataFrame:
    return entities.frequent(_units(spark, d))


def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Lexical and entity rankings fused by reciprocal rank."""
    u = materialized(_units(spark, d))
    q = _queries(spark, d)
    lex = fusion.ranked(lexical.relevance(*lexical.searched(q, u, phrases=True)).where("n_matched > 0"), "relevance")
    return fusion.reciprocal_ranks({"lexical": materialized(lex), "entity": materialized(entities.scores(q, u))}).select("query_id", "unit_id", "fused")


def two_searches(spark: SparkSession, d: str) -> DataFrame:
    """The search for the first sentence and that for the whole text, as one list."""
    q = _queries(spark, d)
    # both searches are one, told apart by a number beside the query
    both = q.select(F.struct("query_id", F.lit(1).alias("n")).alias("query_id"), T.first_sentence("text").alias("text")).unionByName(q.select(F.struct("query_id", F.lit(2).alias("n")).alias("query_id"), "text"))
    best = materialized(lexical.bm25_pool(*lexical.searched(both, _documents(spark, d)), 20)).select("query_id.query_id", "query_id.n", "unit_id", "score")
    return fusion.two_searches(best.where("n = 1"), best.where("n = 2")).select("query_id", "unit_id", F.round("score", 4).alias("score"))


HOUR = 3_600_000
TOP = {"inject": 5, "recall": 8, "engine": 12}


def engine(spark: SparkSession, d: str, policy: str = "recall", mode: str = "balanced", top: int = 12, every: int = EVERY) -> DataFrame:
    """The whole engine over memories and messages, as a trace: one row per candidate with
    ``stage`` (final, below top k, folded, seen, cooling, below threshold).

    Documents whose id is divisible by ``every`` are the queries: with 1, all that have a text.
    Every query is asked in its document's conversation at its document's time. Messages of
    that conversation from the last hour (its session) and messages that archived memories
    name (rolled back) are no candidates; a memory shown in the conversation within six hours
    is held back as seen, within a day as cooling. Candidates come from three rankings over
    both channels, are fused, weighted by channel, boosted, gated, folded and cut.
    """
    q = materialized(
        table(spark, d, "documents").where(f"doc_id % {every} = 0 AND text IS NOT NULL")
        .select(F.col("doc_id").alias("query_id"), "text", F.col("conversation_id").alias("q_conversation"), F.coalesce(F.unix_millis(F.col("effective_at").cast("timestamp")), F.lit(NOW_MS)).alias("now_ms"))
    )
    memories = _units(spark, d)
    said = with_speaker(with_arrival(table(spark, d, "originals")), table(spark, d, "speakers"))
    rolled = memories.where("status = 'archived'").select(F.explode("sources").alias("unit_id")).distinct().withColumn("_rolled", F.lit("rolled back"))
    messages = lexical.message_units(said).join(rolled, "unit_id", "left").withColumn("status", F.coalesce("_rolled", "status")).drop("_rolled")
    u = materialized(memories.unionByName(messages, allowMissingColumns=True).withColumn("ms", to_millis("effective_at")))
    s = lexical.searched(q, u, phrases=True)
    place = u.select("unit_id", "conversation_id", F.col("ms").alias("unit_ms"), "status")

    def allowed(hits: DataFrame) -> DataFrame:
        j = hits.join(place, "unit_id").join(q.select("query_id", "q_conversation", "now_ms"), "query_id")
        session = F.coalesce((F.col("conversation_id") == F.col("q_conversation")) & (F.col("unit_ms") >= F.col("now_ms") - HOUR), F.lit(False))
        return j.where(F.col("status").isin("confirmed", "original") & ~session).select(*hits.columns)

    lex = materialized(fusion.ranked(allowed(lexical.relevance(*s).where("n_matched > 0")), "relevance"))
    provider = vectors.Provider()
    searchable = u.where("status IN ('confirmed', 'original')")
    v = materialized(searchable.select(F.col("unit_id").alias("key"), provider.stored(vectors.embedding_text(F.col("kind"), F.col("title"), F.col("body"))).alias("v")))
    asked = materialized(q.select("query_id", provider.embed(F.col("text")).alias("v")))
    near = vectors.with_mean(vectors.top_by_index(v, asked, probes=22), v, asked).withColumnRenamed("key", "unit_id")
    vec = materialized(fusion.ranked(allowed(near.drop("rank")), "sim"))
    ent = materialized(fusion.ranked(allowed(entities.scores(q, u).drop("rank")), "score"))
    pair = ["query_id", "unit_id"]
    cand = materialized(fusion.reciprocal_ranks({"lexical": lex, "vector": vec, "entity": ent}).join(u.select("unit_id", "channel"), "unit_id"))
    cov = materialized(lexical.coverage(*s, cand).drop("channel", "raw", "phrase"))
    # written in steps, so that no plan is long and what was shuffled for one step is gone before the next
    ranks = materialized(
        cand.join(cov, pair, "left")
        .join(lex.select(*pair, F.col("rank").alias("lexical_rank")), pair, "left")
        .join(vec.select(*pair, "sim", "mean", F.col("rank").alias("vector_rank")), pair, "left")
        .join(ent.select(*pair, F.col("rank").alias("entity_rank")), pair, "left")
    )
    common = entities.frequent(memories).agg(F.collect_set("entity")).scalar()  # entities of three tenths of all units: hardly any
    words = q.select("query_id", T.normalized("text").alias("_q"), T.keywords("text").alias("_k"), T.phrase("text").alias("_p"), T.single_character("text").alias("_c"), "q_conversation", "now_ms")
    heat_ = fusion.heat(table(spark, d, "seen"), "ref_id", to_millis("at"), NOW_MS).withColumnRenamed("ref_id", "unit_id")
    quality = fusion.source_quality(memories, said)
    known = materialized(heat_.join(quality, "unit_id", "full"))
    # what is narrow first, then the units' texts, and the queries' last, so that no query's text is shuffled for its candidates
    side = ranks.join(known, "unit_id", "left").join(u.drop("channel"), "unit_id").join(words, "query_id")
    body = T.phrase(F.concat_ws(" ", "title", "body"))
    own = F.filter("entities", lambda e: ~F.coalesce(F.array_contains(F.col("_common"), T.normalized(e)), F.lit(False)))
    tags = F.transform(F.filter("tags", lambda t: t.rlike("^(故事线|梗|昵称|日常)·")), lambda t: F.regexp_replace(t, "^[^·]*·", ""))
    entity_terms = F.flatten(F.transform("_own", lambda e: T.terms(e)))
    share = F.aggregate(F.filter("matched", lambda m: F.array_contains(F.col("_eterms"), m["term"])), F.lit(0.0), lambda a, m: a + m["weight"]) / F.col("weight_sum")
    side = (
        side.withColumn("_common", common).withColumn("_own", own).withColumn("_eterms", entity_terms)
        .withColumns({
            "phrase": ((F.length("_p") >= 4) | F.col("_p").rlike(f"[{T.CJK}].*[{T.CJK}]")) & F.contains(body, F.col("_p")),
            "named_tag": F.size(entities.mentioned(tags, F.col("_q"))) > 0,
            "named_entity": F.size(entities.mentioned(F.col("_own"), F.col("_q"))) > 0,
            "keyword_inside": F.element_at(F.transform(F.array(T.normalized(F.concat_ws(" ", "title", "body"))), lambda t: F.exists("_k", lambda k: (F.length(k) >= 2) & F.contains(t, k))), 1),
            "single_matched": F.when(F.col("_c").isNotNull(), F.contains(T.normalized("body"), F.col("_c"))),
            "has_vector": F.lit(True), "entity_share": F.coalesce(share, F.lit(0.0)),
        })
        .fillna({"coverage": 0.0, "n_matched": 0, "n_strong": 0, "n_terms": 0})
    )
    age = (F.lit(NOW_MS) - F.col("ms")) / 86_400_000
    memory = F.col("channel") == "memory"
    half = fusion.half_life(F.when(memory, "episode").otherwise("message"), F.col("importance"), F.col("tags"))
    boost = fusion.boosts(
        F.when(memory, F.col("importance")).otherwise(0.5), age, half, F.col("entity_share"), F.when(memory, F.coalesce("quality", F.lit(0.0))).otherwise(0.0),
        F.when(memory, F.coalesce("heat", F.lit(0.0))).otherwise(0.0), (~memory) & (F.coalesce("speaker", F.lit("")) == "user") & F.lit(mode != "memory"),
    )
    weight = F.when(memory, fusion.CHANNELS[mode][0]).otherwise(fusion.CHANNELS[mode][1])
    hits = materialized(
        side.withColumn("reason", fusion.gate(policy)).select(
            *pair, "channel", F.round(F.col("fused") * weight * (1 + boost), 4).alias("score"), "reason", "signals", "coverage", "sim",
            F.when(memory, F.col("unit_id")).alias("lineage"), T.terms("body").alias("terms"), "sources", "conversation_id", "turn_id", "ord", "ms", "version", "q_conversation", "now_ms",
        )
    )
    shown = table(spark, d, "seen").select(F.col("conversation_id").alias("q_conversation"), F.col("ref_id").alias("unit_id"), "version", to_millis("at").alias("at_ms")).where("at_ms IS NOT NULL")
    told = hits.where("reason IS NOT NULL").join(shown, ["q_conversation", "unit_id", "version"]).where("at_ms <= now_ms AND at_ms >= now_ms - 86400000").groupBy(*pair).agg(F.max(F.col("at_ms") - F.col("now_ms")).alias("ago"))
    state = hits.join(told, pair, "left").withColumn("held", F.when(F.col("reason").isNull(), "below threshold").when(F.col("ago") >= -6 * HOUR, "seen").when(F.col("ago").isNotNull(), "cooling"))
    free = state.where("held IS NULL").select(*pair, "score", "channel", "lineage", "terms", "sources", "conversation_id", "turn_id", "ord", "ms")
    folded = dedupe.greedy(free, evidence=mode == "evidence").select(*pair, "kept", "folded_into", "place")
    j = state.join(folded, pair, "left")
    stage = F.coalesce("held", F.when(~F.col("kept"), "folded").when(F.col("place") <= top, "final").otherwise("below top k"))
    return j.select(*pair, "channel", "score", F.col("place").alias("rank"), "reason", stage.alias("stage"), "folded_into", fusion.reasoned(F.coalesce("reason", F.lit("none")), F.col("coverage"), F.col("sim"), F.col("signals")).alias("why"))


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    """What the engine finds for each query: the best twelve of memories and messages."""
    return engine(spark, d).where("stage = 'final'").select("query_id", "unit_id", "score", "rank", "reason")


def inject_trace(spark: SparkSession, d: str) -> DataFrame:
    """The strict policy, memories before messages, asked by every document that has a text:
    candidates by stage and channel."""
    return engine(spark, d, "inject", "memory", TOP["inject"], every=1).groupBy("stage", "channel").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("n_queries"))


def greedy_folding(spark: SparkSession, d: str) -> DataFrame:
    """Each query's lexical results with what folds into what."""
    u = materialized(_units(spark, d))
    lex = fusion.ranked(lexical.relevance(*lexical.searched(_queries(spark, d), u, phrases=True)).where("n_matched > 0"), "relevance")
    lex = materialized(lex.select("query_id", "unit_id", F.col("relevance").alias("score"), "channel"))
    # each term once and as a number; sources say which messages a memory stands for, and here are none
    hits = lex.join(u.select("unit_id", F.transform(F.array_distinct(T.terms("body")), lambda t: F.xxhash64(t)).alias("terms")), "unit_id")
    none = {c: F.lit(None).cast(t) for c, t in (("lineage", "string"), ("sources", "array<string>"), ("conversation_id", "string"), ("turn_id", "string"), ("ord", "long"), ("ms", "long"))}
    return dedupe.greedy(hits.withColumns(none))


def embedding_states(spark: SparkSession, d: str) -> DataFrame:
    """A cache of vectors for the first version of each episode against the latest texts."""
    provider = vectors.Provider()
    e = table(spark, d, "episodes")
    old = e.groupBy("episode_id").agg(F.min_by("content", "version").alias("text")).select(F.col("episode_id").alias("unit_id"), "text")
    cache = old.select("unit_id", F.lit(provider.key).alias("provider"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), provider.embed(F.col("text")).alias("v"))
    cache = cache.where("unit_id NOT LIKE '%7'")
    now = lexical.latest(e, ["episode_id"], "version").select(F.col("episode_id").alias("unit_id"), F.col("content").alias("text"))
    return vectors.pending(now, cache, provider.key).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def same_episodes(spark: SparkSession, d: str) -> DataFrame:
    """Episodes with the same text and the same sources."""
    return dedupe.same_sources(lexical.latest(table(spark, d, "episodes"), ["episode_id"], "version"), "episode_id", "source_raw_ids", "content")


def same_texts(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.same_content(table(spark, d, "documents"), "doc_id", "text")


def cited_together(spark: SparkSession, d: str) -> DataFrame:
    """Source overlap of successive versions of an episode."""
    e = table(spark, d, "episodes").dropDuplicates(["episode_id", "version"])
    by = Window.partitionBy("episode_id").orderBy("version")
    s = F.coalesce("source_raw_ids", F.array().cast("array<string>"))
    v = e.select("episode_id", "version", s.alias("s"), F.lag(s).over(by).alias("p")).where("p IS NOT NULL")
    return v.select("episode_id", "version", F.round(dedupe.jaccard(F.col("s"), F.col("p")), 4).alias("overlap"), F.size(F.array_except("s", "p")).alias("n_new"))


QUERIES = {
    "term_df": term_df, "informative_terms": informative_terms, "document_phrases": document_phrases, "bm25_documents": bm25_documents, "bm25_episodes": bm25_episodes,
    "coverage_weights": coverage_weights, "lexical_ranking": lexical_ranking, "pool_then_filter": pool_then_filter, "cosine_top": cosine_top, "entity_lexicon": entity_lexicon,
    "entity_weights": entity_weights, "entity_ranking": entity_ranking, "name_mentions": name_mentions, "heat": heat, "recency": recency, "source_quality": source_quality,
    "rank_fusion": rank_fusion, "two_searches": two_searches, "hybrid_retrieval": hybrid, "greedy_folding": greedy_folding, "same_texts": same_texts, "version_overlap": cited_together,
    "query_keywords": query_keywords, "characters_found": characters_found, "frequent_entities": frequent_entities, "inject_trace": inject_trace, "embedding_states": embedding_states, "same_episodes": same_episodes,
}

UNITS = f"""latest AS (SELECT * FROM episodes QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY version DESC) = 1),
units AS (SELECT episode_id AS unit_id, {sql.first_sentence("coalesce(content, '')")} AS title,
  coalesce(content, '') || CASE WHEN coalesce(state, '') <> '' THEN chr(10) || state ELSE '' END || CASE WHEN coalesce(excerpt, '') <> '' THEN chr(10) || excerpt ELSE '' END AS body,
  coalesce(entities, []) AS entities, coalesce(topics, []) AS tags, CASE WHEN status = 'active' THEN 'confirmed' ELSE 'archived' END AS status,
  coalesce(importance, 0.5) AS importance, time_start AS effective_at, coalesce(source_raw_ids, []) AS sources FROM latest)"""
QUERIED = f"""queries AS (SELECT doc_id AS query_id, text FROM documents WHERE doc_id % {EVERY} = 0 AND text IS NOT NULL),
qnorm AS (SELECT query_id, {sql.normalized('text')} AS t FROM queries), seam AS ({sql.seams('qnorm')}),
asked AS (SELECT query_id, term FROM (SELECT query_id, unnest(list_distinct(list_slice(d, 1, 64))) AS term FROM (
  SELECT query_id, list_transform(list_filter(list_zip(t, range(1, len(t) + 1)), lambda z: list_position(t, z[1]) = z[2]), lambda z: z[1]) AS d FROM (SELECT query_id, {sql.terms('text')} AS t FROM queries)))
  ANTI JOIN seam USING (query_id, term) WHERE NOT {sql.is_stop('term')})"""
#: The same with all terms of a text.
QUERIED_WHOLE = QUERIED.replace("list_slice(d, 1, 64)", "d")
_JOINED = lambda c: f"array_to_string({c}, chr(10))"
POSTINGS = f"""tf AS (SELECT unit_id, 'title' AS field, unnest({sql.terms('title')}) AS term FROM units UNION ALL SELECT unit_id, 'body', unnest({sql.terms('body')}) FROM units
  UNION ALL SELECT unit_id, 'ent', unnest({sql.terms(_JOINED('entities'))}) FROM units UNION ALL SELECT unit_id, 'tag', unnest({sql.terms(_JOINED('tags'))}) FROM units),
lengths AS (SELECT unit_id, len({sql.terms('title')}) + len({sql.terms('body')}) + len({sql.terms(_JOINED('entities'))}) + len({sql.terms(_JOINED('tags'))})
  + len(regexp_extract_all({sql.normalized(f"concat_ws(chr(10), title, {_JOINED('entities')}, {_JOINED('tags')}, body)")}, '[{T.CJK}]')) AS tokens FROM units),
total AS (SELECT count(*) AS n, avg(tokens) AS mean FROM lengths)"""
_PART = lambda nt, f: f"(CASE WHEN ln((n - {nt} + 0.5) / ({nt} + 0.5)) > 0 THEN ln((n - {nt} + 0.5) / ({nt} + 0.5)) ELSE 1e-6 END * {f} * 2.2::DOUBLE / ({f} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * tokens / mean)))"
_FIELDS = (("title", "3.0"), ("body", "1.0"), ("ent", "2.0"), ("tag", "1.5"))
BM25 = f"""f AS (SELECT term, unit_id, {', '.join(f"count(*) FILTER (field = '{c}')::DOUBLE AS f_{c}" for c, _ in _FIELDS)} FROM tf GROUP BY ALL),
nt AS (SELECT term, count(*) AS nt, {', '.join(f"count(*) FILTER (f_{c} > 0) AS n_{c}" for c, _ in _FIELDS)} FROM f GROUP BY ALL),
scores AS (SELECT query_id, unit_id, round(sum({_PART('nt', f"({' + '.join(f'f_{c} * {w}::DOUBLE' for c, w in _FIELDS)})")}), 6) AS score,
  round({' + '.join(f"{w}::DOUBLE * round(sum({_PART(f'n_{c}', f'f_{c}')}), 4)" for c, w in _FIELDS)}, 6) AS raw
  FROM asked JOIN nt USING (term) JOIN f USING (term) JOIN lengths USING (unit_id) CROSS JOIN total GROUP BY ALL)"""
DOC_UNITS = "units AS (SELECT doc_id AS unit_id, '' AS title, coalesce(text, '') AS body, []::VARCHAR[] AS entities, []::VARCHAR[] AS tags FROM documents)"
WEIGHTS = """df AS (SELECT term, count(DISTINCT unit_id) AS df FROM tf GROUP BY ALL),
weights AS (SELECT query_id, term, CASE WHEN n >= 8 THEN round(1.0::DOUBLE - 0.5::DOUBLE * coalesce(df, 0) / n, 4) ELSE 1.0 END AS weight FROM asked LEFT JOIN df USING (term) CROSS JOIN total WHERE n < 8 OR coalesce(df, 0) / n <= 0.3)"""
LEXICON = f"""lexicon AS (SELECT entity, count(DISTINCT unit_id) AS df FROM (SELECT unit_id, trim({sql.normalized('e')}) AS entity FROM (SELECT unit_id, unnest(entities) AS e FROM units WHERE status = 'confirmed')) WHERE length(entity) >= 2 GROUP BY ALL),
confirmed AS (SELECT count(*) AS n FROM units WHERE status = 'confirmed'),
eweights AS (SELECT entity, ln(1 + n / (1 + df)) * CASE WHEN n >= 8 AND df / n > 0.3 THEN 0.2::DOUBLE ELSE 1 END AS weight FROM lexicon CROSS JOIN confirmed)"""
_PIECES = f"list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[\\s,，、/|;；]+'), lambda p: {sql.normalized('p')}), lambda p: length(p) > 0))"
KEYWORDS = f"""pieces AS (SELECT query_id, len(list_filter(regexp_split_to_array(text, '[\\s,，、/|;；]+'), lambda p: length({sql.normalized('p')}) > 0)) AS n, unnest({_PIECES}) AS k FROM queries),
keywords AS (SELECT query_id, k FROM pieces WHERE (n > 1 OR length(k) <= 6) AND len(list_filter({sql.terms('k')}, lambda t: NOT {sql.is_stop('t')})) > 0)"""
ENTITY = f"""{KEYWORDS}, whole AS (SELECT query_id, {sql.normalized('text')} AS text FROM queries),
named AS (SELECT DISTINCT query_id, entity, weight FROM (SELECT query_id, entity, weight FROM whole JOIN eweights ON contains(text, entity)
  UNION ALL SELECT query_id, entity, weight FROM keywords JOIN eweights ON contains(entity, k) WHERE length(k) >= 2)),
hits AS (SELECT entity, unit_id, max(factor) AS factor FROM (
  SELECT trim({sql.normalized('e')}) AS entity, unit_id, 1.0::DOUBLE AS factor FROM (SELECT unit_id, unnest(entities) AS e FROM units WHERE status = 'confirmed')
  UNION ALL SELECT entity, unit_id, 0.6::DOUBLE FROM (SELECT unit_id, {sql.normalized("concat_ws(chr(10), title, body)")} AS t FROM units WHERE status = 'confirmed') JOIN (SELECT DISTINCT entity FROM named) ON contains(t, entity)) GROUP BY ALL),
escores AS (SELECT query_id, unit_id, round(sum(weight * factor), 4) AS score FROM named JOIN hits USING (entity) GROUP BY ALL),
eranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM escores QUALIFY rank <= 50)"""
POOL = "pooled AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM scores QUALIFY rank <= {n})"
WANTED = f"""wanted AS (SELECT query_id, CASE WHEN length(p) >= 4 OR regexp_matches(p, '[{T.CJK}].*[{T.CJK}]') THEN p END AS p FROM (SELECT query_id, {sql.phrase('text')} AS p FROM queries))"""
LEXICAL = f"""kept AS (SELECT query_id, unit_id, raw, title, body FROM pooled JOIN units USING (unit_id) WHERE status = 'confirmed'),
tw AS (SELECT query_id, sum(weight) AS whole FROM weights GROUP BY 1), ut AS (SELECT DISTINCT unit_id, term FROM tf),
hit AS (SELECT query_id, unit_id, sum(weight) AS part, count(*) AS n_matched FROM kept JOIN weights USING (query_id) JOIN ut USING (unit_id, term) GROUP BY ALL),
scored AS (SELECT query_id, unit_id, raw, round(coalesce(part / whole, 0), 4) AS coverage, coalesce(n_matched, 0) AS n_matched,
  coalesce(contains({sql.phrase("concat_ws(' ', title, body)")}, p), false) AS phrase, CASE WHEN max(raw) OVER (PARTITION BY query_id) > 0 THEN raw / max(raw) OVER (PARTITION BY query_id) ELSE 0 END AS share
  FROM kept LEFT JOIN hit USING (query_id, unit_id) LEFT JOIN tw USING (query_id) JOIN wanted USING (query_id)),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, unit_id) AS rank FROM (
  SELECT query_id, unit_id, raw, coverage, phrase, round(least(1, 0.65::DOUBLE * coverage + 0.35::DOUBLE * share + CASE WHEN phrase THEN 0.15::DOUBLE ELSE 0 END), 4) AS relevance FROM scored WHERE n_matched > 0) QUALIFY rank <= 50)"""
FUSED = """signals AS (SELECT query_id, unit_id, rank, 'lexical' AS signal, 1.0::DOUBLE AS w FROM lexical UNION ALL SELECT query_id, unit_id, rank, 'entity', 0.5::DOUBLE FROM eranked),
best AS (SELECT query_id, sum(w) / 61 AS best FROM (SELECT DISTINCT query_id, signal, w FROM signals) GROUP BY 1)"""

ORACLES = {
    "lexical_ranking": f"WITH {UNITS}, {QUERIED}, {POSTINGS}, {BM25}, {POOL.format(n=200)}, {WEIGHTS}, {WANTED}, {LEXICAL} SELECT query_id, unit_id, raw, coverage, phrase, relevance, rank FROM lexical",
    "rank_fusion": f"""WITH {UNITS}, {QUERIED}, {POSTINGS}, {BM25}, {POOL.format(n=200)}, {WEIGHTS}, {WANTED}, {LEXICAL}, {LEXICON}, {ENTITY}, {FUSED}
        SELECT query_id, unit_id, round(sum(w / (60 + rank)) / best, 6) AS fused FROM signals JOIN best USING (query_id) GROUP BY query_id, unit_id, best""",
    "term_df": f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct({sql.terms('text')})) AS term FROM documents) GROUP BY term",
    "informative_terms": f"WITH {QUERIED} SELECT * FROM asked",
    "document_phrases": f"""SELECT doc_id, length({sql.phrase('text')})::INT AS n_phrase, len(regexp_extract_all({sql.normalized('text')}, '[{T.CJK}]'))::INT AS n_cjk,
        ceil(w + (l - w) / 3.5::DOUBLE)::INT AS estimate FROM (SELECT doc_id, text, length(coalesce(text, '')) AS l, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[{T.CJK}]', '', 'g')) AS w FROM documents)""",
    "bm25_documents": f"WITH {DOC_UNITS}, {QUERIED_WHOLE}, {POSTINGS}, {BM25}, {POOL.format(n=20)} SELECT query_id, unit_id, score, rank FROM pooled",
    "bm25_episodes": f"WITH {UNITS}, {QUERIED}, {POSTINGS}, {BM25}, {POOL.format(n=50)} SELECT query_id, unit_id, score, raw, rank FROM pooled",
    "coverage_weights": f"WITH {UNITS}, {QUERIED}, {POSTINGS}, {WEIGHTS} SELECT * FROM weights",
    "pool_then_filter": f"WITH {UNITS}, {QUERIED}, {POSTINGS}, {BM25}, {POOL.format(n=200)} SELECT query_id, count(*) AS n_pool, count(*) FILTER (status = 'confirmed') AS n_kept FROM pooled JOIN units USING (unit_id) GROUP BY 1",
    "entity_lexicon": f"WITH {UNITS}, {LEXICON} SELECT * FROM lexicon",
    "entity_weights": f"WITH {UNITS}, {LEXICON} SELECT entity, round(weight, 6) AS weight FROM eweights",
    "entity_ranking": f"WITH {UNITS}, {QUERIED}, {LEXICON}, {ENTITY} SELECT * FROM eranked",
    "name_mentions": f"""WITH n AS (SELECT DISTINCT name FROM (SELECT {sql.normalized('x')} AS name FROM (SELECT unnest(list_concat([name], coalesce(aliases, []))) AS x FROM names) WHERE x IS NOT NULL) WHERE length(name) >= 2),
        o AS (SELECT DISTINCT conversation_id, item_id, {sql.normalized('content')} AS text FROM originals WHERE content IS NOT NULL)
        SELECT conversation_id, name, count(DISTINCT item_id) AS n_messages FROM o JOIN n ON contains(text, name) GROUP BY ALL""",
    "heat": f"""SELECT ref_id, round(s / (s + 2), 4) AS heat FROM (SELECT ref_id, sum(pow(0.5, greatest(age, 0) / 14)) AS s FROM (
        SELECT ref_id, ({NOW_MS} - epoch_ms("at"::TIMESTAMPTZ)) / 86400000 AS age FROM seen WHERE ref_id IS NOT NULL) WHERE age <= 90 GROUP BY 1)""",
    "recency": f"""WITH {UNITS}, h AS (SELECT unit_id, CASE WHEN len(list_filter(tags, lambda t: regexp_matches(t, '^(梗|昵称|日常)·'))) > 0 THEN 365.0 WHEN importance >= 0.8 THEN 365.0 WHEN importance < 0.5 THEN 14.0 ELSE 45.0 END AS half_life,
        ({NOW_MS} - epoch_ms(effective_at::TIMESTAMPTZ)) / 86400000 AS age FROM units)
        SELECT unit_id, half_life::DOUBLE AS half_life, round(0.08::DOUBLE * pow(0.5, greatest(age, 0) / half_life), 4) AS recency FROM h""",
    "source_quality": f"""WITH {UNITS}, c AS (SELECT DISTINCT unit_id, unnest(sources) AS id FROM units), r AS (SELECT id, max(coalesce(speaker = 'user', false)::INT) AS u FROM originals LEFT JOIN {SPEAKERS} ON alias = {SPELT} GROUP BY 1)
        SELECT unit_id, CASE WHEN max(u) = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS quality FROM c JOIN r USING (id) GROUP BY 1""",
    "cosine_top": f"""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, r.vec_id AS key, round(list_dot_product(q.v, r.v), 6) AS sim FROM u q, u r WHERE q.vec_id % {EVERY} = 0),
        m AS (SELECT *, round(avg(sim) OVER (PARTITION BY query_id), 4) AS mean FROM s)
        SELECT query_id, key, sim, mean, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, key) AS rank FROM m WHERE sim >= 0.1 QUALIFY rank <= 50""",
    "query_keywords": f"""WITH {QUERIED}, {KEYWORDS} SELECT query_id, coalesce((SELECT string_agg(k, '|' ORDER BY k) FROM keywords w WHERE w.query_id = q.query_id), '') AS keywords, (SELECT count(*) FROM asked a WHERE a.query_id = q.query_id)::INT AS n_terms,
        nullif(regexp_extract({sql.normalized('text')}, '^[^0-9a-z{T.CJK}]*([{T.CJK}])[^0-9a-z{T.CJK}]*$', 1), '') AS character, regexp_matches({sql.normalized('text')}, '{T.QUOTING}') AS quotes FROM queries q""",
    "characters_found": f"""WITH {UNITS}, c AS (SELECT unit_id, unnest(regexp_extract_all({sql.normalized(f"concat_ws(chr(10), title, {_JOINED('entities')}, {_JOINED('tags')}, body)")}, '[{T.CJK}]')) AS c FROM units),
        g AS (SELECT unit_id, c, count(*) AS n FROM c GROUP BY ALL), q AS (SELECT name_id AS query_id, {sql.normalized('substring(name, 1, 1)')} AS c FROM names)
        SELECT query_id, count(*) AS n_units, sum(n)::BIGINT AS n FROM q JOIN g USING (c) WHERE regexp_full_match(c, '[{T.CJK}]') GROUP BY 1""",
    "frequent_entities": f"WITH {UNITS}, {LEXICON} SELECT entity, df FROM lexicon CROSS JOIN confirmed WHERE n >= 8 AND df / n > 0.3",
    "embedding_states": """WITH o AS (SELECT episode_id, arg_min(content, version) AS t FROM episodes GROUP BY 1), l AS (SELECT episode_id, content FROM episodes QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY version DESC) = 1)
        SELECT CASE WHEN episode_id LIKE '%7' THEN 'pending' WHEN coalesce(t, '') = coalesce(content, '') THEN 'embedded' ELSE 'stale' END AS state, count(*) AS n FROM l JOIN o USING (episode_id) GROUP BY 1""",
    "same_episodes": f"""WITH {UNITS}, x AS (SELECT episode_id, coalesce(content, '') AS t, content IS NULL AS z, list_sort(list_distinct(source_raw_ids)) AS s FROM latest)
        SELECT episode_id, min(episode_id) OVER (PARTITION BY t, z, s) AS class_id, count(*) OVER (PARTITION BY t, z, s) AS n FROM x QUALIFY n > 1""",
    "same_texts": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE text IS NOT NULL QUALIFY n > 1",
    "version_overlap": """WITH e AS (SELECT DISTINCT episode_id, version, coalesce(source_raw_ids, []) AS s FROM episodes), v AS (SELECT *, lag(s) OVER (PARTITION BY episode_id ORDER BY version) AS p FROM e)
        SELECT episode_id, version, round(coalesce(len(list_intersect(s, p))::DOUBLE / nullif(len(list_distinct(list_concat(s, p))), 0), 0), 4) AS overlap, len(list_distinct(list_filter(s, lambda x: NOT list_contains(p, x))))::INT AS n_new FROM v WHERE p IS NOT NULL""",
}
