"""Queries over messages, episodes, relations and what was shown: joins, versions, ingest, time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions.times import local_day, millis_text, to_millis, within_dates
from mnemospark.operators import chunks, ingest, joins, segments, sessions, timewindows, versions
from mnemospark.operators.speakers import with_speaker
from mnemospark.plans.problems import millis_sql
from mnemospark.plans.sql import SPEAKERS, SPELT
from mnemospark.sources.tables import table, with_arrival

HOUR = 3_600_000


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """One row per message with a usable time; ``role`` is its speaker by the aliases."""
    o = with_speaker(table(spark, d, "originals"), table(spark, d, "speakers")).select("conversation_id", "item_id", "id", F.col("speaker").alias("role"), F.length(F.coalesce("content", F.lit(""))).alias("chars"), to_millis("created_at").alias("ms"))
    return o.groupBy("conversation_id", "item_id").agg(F.min(F.struct("ms", "id", "role", "chars")).alias("m")).select("conversation_id", "item_id", "m.*").where("ms IS NOT NULL")


MESSAGES = f"""o AS (SELECT conversation_id, item_id, id, speaker AS role, length(coalesce(content, '')) AS chars, {millis_sql('created_at')} AS ms FROM originals LEFT JOIN {SPEAKERS} ON alias = {SPELT}),
m AS (SELECT * FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY conversation_id, item_id ORDER BY ms NULLS FIRST, id NULLS FIRST, role NULLS FIRST, chars) = 1) WHERE ms IS NOT NULL)"""


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return versions.latest(table(spark, d, "episodes"), ["episode_id"], "version")


LATEST = "latest AS (SELECT * FROM episodes QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY version DESC) = 1)"


def latest_episodes(spark: SparkSession, d: str) -> DataFrame:
    return _latest(spark, d).select("episode_id", "version", "status", "time_start", F.size("source_raw_ids").alias("n_sources"))


def version_history(spark: SparkSession, d: str) -> DataFrame:
    return versions.history(table(spark, d, "episodes"), "episode_id", "version", "status").select("episode_id", "version", "status", "previous", "changed")


def live_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages no archived or merged episode names, by conversation."""
    gone = _latest(spark, d).where("status IN ('archived', 'merged')")
    left = versions.without_tombstones(_messages(spark, d), "id", gone, "source_raw_ids")
    return left.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_live"))


def relation_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Edges with later archived ones re-activated: the latest of (type, src, dst) wins."""
    r = table(spark, d, "relations")
    again = r.where("status = 'archived'").withColumns({"status": F.lit("active"), "created_at": F.lit("2017-01-01T00:00:00.000Z")})
    return versions.upserted(r, again, ["type", "src_id", "dst_id"], "created_at").groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"))


def status_intervals(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "episodes").groupBy("episode_id", F.col("updated_at").alias("at")).agg(F.max("status").alias("status"))
    return versions.intervals(e, "episode_id", "at", "status").select("episode_id", "status", "valid_from", "valid_to")


def unprocessed(spark: SparkSession, d: str) -> DataFrame:
    m = joins.unmentioned(_messages(spark, d), "id", _latest(spark, d), "source_raw_ids")
    return m.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_unprocessed"), F.min("ms").alias("first_ms"))


def said_in_window(spark: SparkSession, d: str) -> DataFrame:
    """Episodes with a source said in the first half of February."""
    said = _messages(spark, d).where(within_dates(millis_text(F.col("ms")), F.lit("2016-02-01"), F.lit("2016-02-15")))
    return joins.overlapping(_latest(spark, d).select("episode_id", "source_raw_ids"), "source_raw_ids", said, "id").select("episode_id")


def sources_stored(spark: SparkSession, d: str) -> DataFrame:
    """How many of an episode's sources are stored as a user's words."""
    said = with_speaker(table(spark, d, "originals"), table(spark, d, "speakers")).where("speaker = 'user'")
    return joins.share_inside(_latest(spark, d), "episode_id", "source_raw_ids", said, "id")


def overlap_episodes(spark: SparkSession, d: str) -> DataFrame:
    """For each episode the one that holds the largest share of its sources."""
    return joins.best_overlap(_latest(spark, d), "episode_id", "source_raw_ids")


def time_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """For each session the six episodes that meet its span, three hours wider, nearest first."""
    s = sessions.message_sessions(table(spark, d, "originals"), to_millis("created_at"))
    left = s.select(F.struct("conversation_id", "start_ms").alias("l_id"), (F.col("start_ms") - 3 * HOUR).alias("l_lo"), (F.col("end_ms") + 3 * HOUR).alias("l_hi"))
    right = _latest(spark, d).select(F.col("episode_id").alias("r_id"), to_millis("time_start").alias("r_lo"), to_millis("time_end").alias("r_hi"))
    n = joins.nearest(joins.interval_overlap(left, right, 6 * HOUR), 6)
    return n.select("l_id.conversation_id", "l_id.start_ms", F.col("r_id").alias("episode_id"), "rank")


def context_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last six messages within a day before each message, as a list of ids."""
    b = joins.before_each(_messages(spark, d), "conversation_id", "ms", ["item_id"], F.col("item_id"), 6, 24 * HOUR)
    return b.select("conversation_id", "item_id", F.array_join("before", ",").alias("before"))


def answered_soon(spark: SparkSession, d: str) -> DataFrame:
    """User messages with an assistant's within three minutes, by conversation."""
    m = _messages(spark, d)
    soon = joins.followed_within(m.where("role = 'user'"), m.where("role = 'assistant'"), "conversation_id", "ms", 3 * 60_000)
    return soon.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_answered"))


def seen_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The version of each episode in force when it was shown."""
    seen = table(spark, d, "seen").select("ref_id", "conversation_id", to_millis("at").alias("at_ms")).distinct()
    e = table(spark, d, "episodes").select(F.col("episode_id").alias("ref_id"), to_millis("updated_at").alias("at_ms"), "version").groupBy("ref_id", "at_ms").agg(F.max("version").alias("in_force"))
    return joins.as_of(seen, e, ["ref_id"], "at_ms", "in_force")


def recently_shown(spark: SparkSession, d: str) -> DataFrame:
    """Cool-down: showings with another of the same unit in the conversation in the 24 hours before."""
    s = table(spark, d, "seen").select("conversation_id", "ref_id", "version", to_millis("at").alias("ms")).where("ms IS NOT NULL").distinct()
    s = s.withColumn("k", F.concat_ws("|", "conversation_id", "ref_id", "version"))
    b = joins.before_each(s, "k", "ms", ["version"], F.col("ms"), 1, 24 * HOUR)
    return b.groupBy("conversation_id").agg(F.count_if(F.size("before") > 0).alias("n_cooling"), F.count_if(F.size("before") == 0).alias("n_free"))


def causes(spark: SparkSession, d: str) -> DataFrame:
    return joins.both_directions(table(spark, d, "relations"), 2).select("node", "direction", "other", "rank")


def provenance(spark: SparkSession, d: str) -> DataFrame:
    """Edge to episode to source message, with what is missing marked, by type of edge."""
    e = _latest(spark, d).select("episode_id", F.explode_outer("source_raw_ids").alias("raw_id"))
    raw = table(spark, d, "originals").select(F.col("id").alias("o_id")).distinct()
    r = table(spark, d, "relations").select("type", "src_id")
    j = r.join(e, r["src_id"] == e["episode_id"], "left").join(raw, F.col("raw_id") == F.col("o_id"), "left")
    return j.groupBy("type").agg(
        F.count(F.lit(1)).alias("n_paths"), F.count_if(F.col("episode_id").isNull()).alias("n_no_episode"), F.count_if(F.col("raw_id").isNotNull() & F.col("o_id").isNull()).alias("n_missing_raw")
    )


def stories(spark: SparkSession, d: str) -> DataFrame:
    """The steps of each conversation's episodes: place, number, before and after, quiet."""
    e = _latest(spark, d).select("episode_id", F.get("topics", F.lit(0)).alias("topic"), "time_start")
    by = Window.partitionBy("topic").orderBy("time_start", "episode_id")
    whole = Window.partitionBy("topic")
    return e.where("topic IS NOT NULL").select(
        "topic", "episode_id", F.row_number().over(by).alias("place"), F.count(F.lit(1)).over(whole).alias("n_steps"), F.lag("episode_id").over(by).alias("before"), F.lead("episode_id").over(by).alias("after"),
        (F.datediff(F.lit("2016-05-15"), F.max(F.substring("time_start", 1, 10)).over(whole)) > 21).alias("quiet"),
    )


def last_steps(spark: SparkSession, d: str) -> DataFrame:
    e = _latest(spark, d).select(F.explode(F.array_distinct("topics")).alias("topic"), "episode_id", "time_start")
    by = Window.partitionBy("topic").orderBy(F.desc("time_start"), "episode_id")
    return e.withColumn("rank", F.row_number().over(by)).where("rank <= 3").select("topic", "episode_id", "rank")


def ingest_classes(spark: SparkSession, d: str) -> DataFrame:
    o = with_arrival(table(spark, d, "originals"))
    return ingest.classified(o, "id", "content", F.col("arrival"))


def ingest_state(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "originals")
    return o.groupBy("source", ingest.hash_state("content", "sha256").alias("state"), ingest.safe_name("conversation_id").alias("safe")).agg(F.count(F.lit(1)).alias("n"))


def derived_ids(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "originals").select("source", "conversation_id", "item_id").distinct()
    return o.select("source", "conversation_id", "item_id", ingest.derived_id("o_", "source", "conversation_id", "item_id").alias("new_id"))


def conflicts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "originals").select("id", ingest.content_hash("content").alias("h"))
    return o.groupBy("id").agg(F.count_distinct("h").alias("n_texts"), F.count(F.lit(1)).alias("n_rows")).where("n_texts > 1")


def session_digests(spark: SparkSession, d: str) -> DataFrame:
    """Per user, day and type of event a hash over the ordered ids: a key for idempotent staging."""
    e = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    return e.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.size("ids").alias("n"), F.sha2(F.array_join(F.transform("ids", lambda x: x.cast("string")), ","), 256).alias("digest"))


def closed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that can no longer grow at the time of the last message."""
    m = _messages(spark, d)
    s = sessions.merge_intervals(m, ["conversation_id"], "ms")
    now = m.agg(F.max("ms")).scalar()
    return sessions.without_open_tail(s, now).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_closed"))


def split_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Long stretches (gaps of up to six hours) cut at their longest pauses."""
    m = _messages(spark, d)
    s = sessions.merge_intervals(m, ["conversation_id"], "ms", 6 * HOUR).select(F.col("conversation_id").alias("_c"), "start_ms", "end_ms")
    day = 24 * HOUR
    s = s.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_ms") / day), F.floor(F.col("end_ms") / day))))
    placed = m.join(s, (m["conversation_id"] == s["_c"]) & (F.floor(m["ms"] / day) == s["_b"]) & (m["ms"] >= s["start_ms"]) & (m["ms"] <= s["end_ms"]))
    rows = placed.select(F.concat_ws("@", "conversation_id", "start_ms").alias("session"), "ms", F.col("item_id").alias("ord"), "chars")
    parts = segments.split_long(rows)
    return parts.groupBy("session", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"))


def packed_windows(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).withColumnRenamed("item_id", "ord")
    w = segments.pack_windows(m)
    return w.groupBy("conversation_id", "stretch", "window").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"))


def episode_spans(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping episodes of one first topic as merged spans."""
    e = _latest(spark, d).select(F.get("topics", F.lit(0)).alias("topic"), to_millis("time_start").alias("lo"), to_millis("time_end").alias("hi")).where("topic IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL")
    return segments.merged_spans(e, "topic", "lo", "hi")


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Messages by day in a zone eight hours east: roles, conversations, characters."""
    m = _messages(spark, d).withColumn("day", F.date_format(local_day(F.timestamp_millis("ms")), "yyyy-MM-dd"))
    return m.groupBy("day").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == "user").alias("n_user"), F.count_distinct("conversation_id").alias("n_conversations"), F.sum("chars").alias("chars")
    )


def month_parts(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).select(F.timestamp_millis("ms").alias("t"))
    day = F.dayofmonth("t")
    return m.groupBy(F.date_format("t", "yyyy-MM").alias("month"), F.when(day <= 10, "first").when(day <= 20, "middle").otherwise("last").alias("part")).agg(F.count(F.lit(1)).alias("n"))


def week_windows(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).select(F.timestamp_millis("ms").alias("t"), "conversation_id")
    return m.groupBy(F.date_format(F.date_trunc("week", "t"), "yyyy-MM-dd").alias("monday")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conversation_id").alias("n_conversations"))


def named_windows(spark: SparkSession, d: str) -> DataFrame:
    """Days that messages name, resolved against when they were said."""
    o = table(spark, d, "originals").select("id", "content", F.to_date(F.timestamp_millis(to_millis("created_at"))).alias("today")).where("today IS NOT NULL").distinct()
    w = o.select("id", timewindows.time_window(F.col("content"), F.col("today")).alias("w")).where("w IS NOT NULL")
    return w.select("id", F.date_format("w.start", "yyyy-MM-dd").alias("start"), F.date_format("w.end", "yyyy-MM-dd").alias("end"))


def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.chunked(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk", "start_at", "end_at", T.token_estimate("text").alias("estimate"))


def chunk_tiling(spark: SparkSession, d: str) -> DataFrame:
    """Whether the chunks of each document tile it: no gap, no overlap, all of it."""
    docs = table(spark, d, "documents").where("text IS NOT NULL AND length(text) > 0")
    c = chunks.chunked(docs, "doc_id", "text").groupBy("doc_id").agg(F.sum(F.length("text")).alias("sum"), F.min("start_at").alias("lo"), F.max("end_at").alias("hi"))
    return docs.select("doc_id", F.length("text").alias("n")).join(c, "doc_id", "left").select("doc_id", ((F.col("sum") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n"))).alias("tiles"))


def budget_sums(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").select(F.coalesce("kind", F.lit("")).alias("kind"), T.token_estimate("text").alias("e"))
    return x.groupBy("kind").agg(F.sum("e").alias("tokens"), (F.sum("e") > 20_000).alias("over"))


def quotes_verified(spark: SparkSession, d: str) -> DataFrame:
    """Quotations in episodes: how many are found in the texts of their sources."""
    norm = lambda c: F.regexp_replace(T.normalized(c), r"[\p{P}\p{S}\p{Z}\s]", "")
    e = _latest(spark, d).select("episode_id", "source_raw_ids", F.explode(F.array_distinct(T.quoted("content"))).alias("q")).select("episode_id", "source_raw_ids", norm("q").alias("q")).where("length(q) >= 4")
    o = table(spark, d, "originals").select(F.col("id").alias("raw_id"), norm("content").alias("t")).distinct()
    j = e.select("episode_id", "q", F.explode("source_raw_ids").alias("raw_id")).join(o, "raw_id").groupBy("episode_id", "q").agg(F.max(F.contains("t", "q")).alias("there"))
    asked = e.select("episode_id", "q").distinct()
    return asked.join(j, ["episode_id", "q"], "left").groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_quotes"), F.count_if(F.coalesce("there", F.lit(False))).alias("n_verified"))


def important_recent(spark: SparkSession, d: str) -> DataFrame:
    """Episodes that ended in the thirty days before, no dream or ritual, most important first."""
    e = _latest(spark, d).where("kind NOT IN ('commitment', 'dream', 'ritual')").where(F.substring("time_end", 1, 10) >= "2016-03-15")
    return e.orderBy(F.desc_nulls_last("importance"), F.desc("time_end"), "episode_id").limit(20).select("episode_id", F.coalesce("importance", F.lit(0.0)).alias("importance"))


def message_stats(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "originals")
    return o.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conversation_id").alias("n_conversations"), F.count_if(F.col("turn_id").isNull()).alias("n_no_turn"))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Delay between a message and its storing, by source: the value at place int(q * n)."""
    o = table(spark, d, "originals").select("source", (to_millis("ingested_at") - to_millis("created_at")).alias("ms")).where("ms IS NOT NULL")
    by = Window.partitionBy("source").orderBy("ms")
    c = o.groupBy("source", "ms").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("n", F.sum("c").over(Window.partitionBy("source")))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * q), F.col("n") - 1), F.col("ms")))
    return c.groupBy("source").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), F.max("ms").alias("most"))


def category_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of active episodes by kind and over all, in one pass."""
    e = _latest(spark, d)
    return e.rollup("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("status") == "active").cast("double")), 6).alias("share_active"), F.grouping("kind").cast("int").alias("is_total"))


QUERIES = {f.__name__: f for f in (
    latest_episodes, version_history, live_messages, relation_upsert, status_intervals, unprocessed, said_in_window, sources_stored, overlap_episodes, time_neighbours, context_tail,
    answered_soon, seen_as_of, recently_shown, causes, provenance, stories, last_steps, ingest_classes, ingest_state, derived_ids, conflicts, session_digests, closed_sessions,
    split_sessions, packed_windows, episode_spans, daily, month_parts, week_windows, named_windows, paragraph_chunks, chunk_tiling, budget_sums, quotes_verified, important_recent,
    message_stats, latency_percentiles, category_rates,
)}

_SESS = f"""{MESSAGES}, l AS (SELECT conversation_id, ms, lag(ms) OVER (PARTITION BY conversation_id ORDER BY ms) AS b FROM m),
k AS (SELECT conversation_id, ms, sum(CASE WHEN b IS NULL OR ms - b > 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS s FROM l),
sess AS (SELECT conversation_id, min(ms) AS start_ms, max(ms) AS end_ms FROM k GROUP BY conversation_id, s)"""
_EST = f"ceil(w + (l - w) / 3.5::DOUBLE)::INT"
_NORM = "regexp_replace({c}, '[\\pP\\pS\\pZ\\s]', '', 'g')"

from mnemospark.plans import sql as _sql  # noqa: E402

ORACLES = {
    "latest_episodes": f"WITH {LATEST} SELECT episode_id, version, status, time_start, len(source_raw_ids)::INT AS n_sources FROM latest",
    "version_history": "WITH e AS (SELECT DISTINCT episode_id, version, status FROM episodes) SELECT *, lag(status) OVER w AS previous, status IS DISTINCT FROM lag(status) OVER w AS changed FROM e WINDOW w AS (PARTITION BY episode_id ORDER BY version)",
    "live_messages": f"WITH {MESSAGES}, {LATEST} SELECT conversation_id, count(*) AS n_live FROM m WHERE id NOT IN (SELECT unnest(source_raw_ids) FROM latest WHERE status IN ('archived', 'merged')) GROUP BY 1",
    "relation_upsert": """WITH b AS (SELECT type, src_id, dst_id, status, created_at, 0 AS x FROM relations UNION ALL SELECT type, src_id, dst_id, 'active', '2017-01-01T00:00:00.000Z', 1 FROM relations WHERE status = 'archived'),
        w AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY type, src_id, dst_id ORDER BY created_at DESC, x DESC) = 1) SELECT type, status, count(*) AS n FROM w GROUP BY ALL""",
    "status_intervals": """WITH e AS (SELECT episode_id, updated_at AS a, max(status) AS status FROM episodes GROUP BY 1, 2), c AS (SELECT * FROM e QUALIFY status IS DISTINCT FROM lag(status) OVER (PARTITION BY episode_id ORDER BY a))
        SELECT episode_id, status, a AS valid_from, lead(a) OVER (PARTITION BY episode_id ORDER BY a) AS valid_to FROM c""",
    "unprocessed": f"WITH {MESSAGES}, {LATEST} SELECT conversation_id, count(*) AS n_unprocessed, min(ms) AS first_ms FROM m WHERE id NOT IN (SELECT unnest(source_raw_ids) FROM latest) GROUP BY 1",
    "said_in_window": f"""WITH {MESSAGES}, {LATEST}, s AS (SELECT id FROM m WHERE strftime(make_timestamp_ms(ms), '%Y-%m-%d') BETWEEN '2016-02-01' AND '2016-02-15')
        SELECT episode_id FROM latest WHERE episode_id IN (SELECT episode_id FROM (SELECT episode_id, unnest(source_raw_ids) AS id FROM latest) SEMI JOIN s USING (id))""",
    "sources_stored": f"""WITH {LATEST}, e AS (SELECT DISTINCT episode_id, unnest(source_raw_ids) AS id FROM latest), u AS (SELECT DISTINCT id FROM originals JOIN {SPEAKERS} ON alias = {SPELT} WHERE speaker = 'user')
        SELECT episode_id, count(*) AS n_ids, count(u.id) AS n_inside, count(*) = count(u.id) AS whole FROM e LEFT JOIN u USING (id) GROUP BY 1""",
    "overlap_episodes": f"""WITH {LATEST}, x AS (SELECT DISTINCT episode_id, unnest(source_raw_ids) AS id FROM latest), n AS (SELECT episode_id, count(*) AS n FROM x GROUP BY 1),
        c AS (SELECT a.episode_id, b.episode_id AS other, count(*) AS c FROM x a JOIN x b USING (id) WHERE a.episode_id <> b.episode_id GROUP BY ALL)
        SELECT episode_id, other, round(c / n, 4) AS share FROM c JOIN n USING (episode_id) WHERE c / n >= 0.6 QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY c / n DESC, other) = 1""",
    "time_neighbours": f"""WITH {_SESS}, {LATEST}, e AS (SELECT episode_id, {millis_sql('time_start')} AS lo, {millis_sql('time_end')} AS hi FROM latest)
        SELECT conversation_id, start_ms, episode_id, row_number() OVER (PARTITION BY conversation_id, start_ms ORDER BY abs(start_ms + end_ms - lo - hi), episode_id) AS rank
        FROM sess JOIN e ON hi >= start_ms - 10800000 AND lo <= end_ms + 10800000 AND lo <= hi QUALIFY rank <= 6""",
    "context_tail": f"""WITH {MESSAGES}, w AS (SELECT conversation_id, item_id, ms, list({{'t': ms, 'v': item_id}}) OVER (PARTITION BY conversation_id ORDER BY ms, item_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS b FROM m)
        SELECT conversation_id, item_id, coalesce(array_to_string(list_transform(list_filter(b, lambda x: x.t >= ms - 86400000), lambda x: x.v), ','), '') AS before FROM w""",
    "answered_soon": f"""WITH {MESSAGES}, a AS (SELECT * FROM m WHERE role = 'assistant'), u AS (SELECT * FROM m WHERE role = 'user')
        SELECT conversation_id, count(*) AS n_answered FROM u WHERE EXISTS (SELECT 1 FROM a WHERE a.conversation_id = u.conversation_id AND a.ms > u.ms AND a.ms <= u.ms + 180000) GROUP BY 1""",
    "seen_as_of": f"""WITH s AS (SELECT DISTINCT ref_id, conversation_id, {millis_sql('"at"')} AS at_ms FROM seen), e AS (SELECT episode_id, {millis_sql('updated_at')} AS u, max(version) AS v FROM episodes GROUP BY 1, 2)
        SELECT s.ref_id, s.conversation_id, s.at_ms, e.v AS in_force FROM s ASOF LEFT JOIN e ON s.ref_id = e.episode_id AND s.at_ms >= e.u""",
    "recently_shown": f"""WITH s AS (SELECT DISTINCT conversation_id, ref_id, version, {millis_sql('"at"')} AS ms FROM seen), l AS (SELECT *, ms - lag(ms) OVER (PARTITION BY conversation_id, ref_id, version ORDER BY ms) AS gap FROM s WHERE ms IS NOT NULL)
        SELECT conversation_id, count(*) FILTER (gap <= 86400000) AS n_cooling, count(*) FILTER (gap IS NULL OR gap > 86400000) AS n_free FROM l GROUP BY 1""",
    "causes": """WITH e AS (SELECT src_id AS node, 'out' AS direction, dst_id AS other, created_at FROM relations WHERE status = 'active' UNION ALL SELECT dst_id, 'in', src_id, created_at FROM relations WHERE status = 'active')
        SELECT node, direction, other, row_number() OVER (PARTITION BY node, direction ORDER BY created_at, other) AS rank FROM e QUALIFY rank <= 2""",
    "provenance": f"""WITH {LATEST}, e AS (SELECT episode_id, unnest(CASE WHEN len(source_raw_ids) > 0 THEN source_raw_ids ELSE [NULL] END) AS raw_id FROM latest), o AS (SELECT DISTINCT id FROM originals)
        SELECT type, count(*) AS n_paths, count(*) FILTER (episode_id IS NULL) AS n_no_episode, count(*) FILTER (raw_id IS NOT NULL AND id IS NULL) AS n_missing_raw FROM relations LEFT JOIN e ON src_id = episode_id LEFT JOIN o ON raw_id = id GROUP BY 1""",
    "stories": f"""WITH {LATEST}, e AS (SELECT episode_id, topics[1] AS topic, time_start FROM latest WHERE len(topics) > 0)
        SELECT topic, episode_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY topic) AS n_steps, lag(episode_id) OVER w AS before, lead(episode_id) OVER w AS after,
        date_diff('day', max(substring(time_start, 1, 10)) OVER (PARTITION BY topic)::DATE, DATE '2016-05-15') > 21 AS quiet FROM e WINDOW w AS (PARTITION BY topic ORDER BY time_start, episode_id)""",
    "last_steps": f"""WITH {LATEST}, e AS (SELECT DISTINCT unnest(topics) AS topic, episode_id, time_start FROM latest) SELECT topic, episode_id, row_number() OVER (PARTITION BY topic ORDER BY time_start DESC, episode_id) AS rank FROM e QUALIFY rank <= 3""",
    "ingest_classes": """WITH o AS (SELECT id, coalesce(content, '') AS t, row_number() OVER () AS r FROM originals), f AS (SELECT id, arg_min(t, r) AS f FROM o GROUP BY 1)
        SELECT id, 1::BIGINT AS added, count(*) FILTER (t = f) - 1 AS existing, count(*) FILTER (t <> f) AS conflicts FROM o JOIN f USING (id) GROUP BY 1""",
    "ingest_state": r"""SELECT source, CASE WHEN sha256 IS NULL OR trim(sha256) = '' THEN 'missing' WHEN lower(sha256) = sha256(coalesce(content, '')) THEN 'ok' ELSE 'different' END AS state,
        coalesce(regexp_full_match(conversation_id, '[A-Za-z0-9][A-Za-z0-9._-]{0,127}') AND NOT contains(conversation_id, '..'), false) AS safe, count(*) AS n FROM originals GROUP BY ALL""",
    "derived_ids": """SELECT DISTINCT source, conversation_id, item_id, 'o_' || substring(sha256(coalesce(source, '') || chr(31) || coalesce(conversation_id, '') || chr(31) || coalesce(item_id, '')), 1, 20) AS new_id FROM originals""",
    "conflicts": "SELECT id, count(DISTINCT coalesce(content, '')) AS n_texts, count(*) AS n_rows FROM originals GROUP BY 1 HAVING count(DISTINCT coalesce(content, '')) > 1",
    "session_digests": """SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*)::INT AS n, sha256(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS digest FROM events GROUP BY 1, 2""",
    "closed_sessions": f"WITH {_SESS} SELECT conversation_id, count(*) AS n_closed FROM sess WHERE (SELECT max(ms) FROM m) - end_ms > 3600000 GROUP BY 1",
    "episode_spans": f"""WITH {LATEST}, e AS (SELECT topics[1] AS topic, {millis_sql('time_start')} AS lo, {millis_sql('time_end')} AS hi FROM latest WHERE len(topics) > 0), f AS (SELECT * FROM e WHERE lo IS NOT NULL AND hi IS NOT NULL),
        g AS (SELECT *, max(hi) OVER (PARTITION BY topic ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM f),
        h AS (SELECT *, sum(CASE WHEN r IS NULL OR lo > r THEN 1 ELSE 0 END) OVER (PARTITION BY topic ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT topic, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM h GROUP BY topic, s""",
    "daily": f"""WITH {MESSAGES} SELECT strftime(make_timestamp_ms(ms + 28800000), '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (role = 'user') AS n_user, count(DISTINCT conversation_id) AS n_conversations, sum(chars)::BIGINT AS chars FROM m GROUP BY 1""",
    "month_parts": f"""WITH {MESSAGES}, t AS (SELECT make_timestamp_ms(ms) AS t FROM m) SELECT strftime(t, '%Y-%m') AS month, CASE WHEN day(t) <= 10 THEN 'first' WHEN day(t) <= 20 THEN 'middle' ELSE 'last' END AS part, count(*) AS n FROM t GROUP BY ALL""",
    "week_windows": f"WITH {MESSAGES} SELECT strftime(date_trunc('week', make_timestamp_ms(ms)), '%Y-%m-%d') AS monday, count(*) AS n, count(DISTINCT conversation_id) AS n_conversations FROM m GROUP BY 1",
    "chunk_tiling": "SELECT doc_id, true AS tiles FROM documents WHERE text IS NOT NULL AND length(text) > 0",
    "budget_sums": f"""SELECT kind, sum(e)::BIGINT AS tokens, sum(e) > 20000 AS over FROM (SELECT kind, {_EST} AS e FROM (SELECT coalesce(kind, '') AS kind, length(coalesce(text, '')) AS l, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[{T.CJK}]', '', 'g')) AS w FROM documents)) GROUP BY 1""",
    "quotes_verified": f"""WITH {LATEST}, q AS (SELECT DISTINCT episode_id, source_raw_ids, {_NORM.format(c=_sql.normalized('x'))} AS q FROM (SELECT episode_id, source_raw_ids, unnest(list_concat(regexp_extract_all(content, '“([^“”]{{1,300}})”', 1),
        regexp_extract_all(content, '「([^「」]{{1,300}})」', 1), regexp_extract_all(content, '『([^『』]{{1,300}})』', 1), regexp_extract_all(content, '"([^"]{{1,300}})"', 1))) AS x FROM latest)),
        a AS (SELECT DISTINCT episode_id, q FROM q WHERE length(q) >= 4), s AS (SELECT DISTINCT episode_id, q, unnest(source_raw_ids) AS id FROM q WHERE length(q) >= 4),
        o AS (SELECT DISTINCT id, {_NORM.format(c=_sql.normalized('content'))} AS t FROM originals), y AS (SELECT DISTINCT episode_id, q FROM s JOIN o USING (id) WHERE contains(t, q))
        SELECT episode_id, count(*) AS n_quotes, count(y.q) AS n_verified FROM a LEFT JOIN y USING (episode_id, q) GROUP BY 1""",
    "important_recent": f"WITH {LATEST} SELECT episode_id, coalesce(importance, 0.0) AS importance FROM latest WHERE kind NOT IN ('commitment', 'dream', 'ritual') AND substring(time_end, 1, 10) >= '2016-03-15' ORDER BY latest.importance DESC NULLS LAST, time_end DESC, episode_id LIMIT 20",
    "message_stats": "SELECT source, count(*) AS n, count(DISTINCT conversation_id) AS n_conversations, count(*) FILTER (turn_id IS NULL) AS n_no_turn FROM originals GROUP BY 1",
    "latency_percentiles": f"""WITH x AS (SELECT source, {millis_sql('ingested_at')} - {millis_sql('created_at')} AS ms FROM originals), y AS (SELECT source, list(ms ORDER BY ms) AS l, count(*) AS n FROM x WHERE ms IS NOT NULL GROUP BY 1)
        SELECT source, l[least(floor(n * 0.5)::BIGINT, n - 1) + 1] AS p50, l[least(floor(n * 0.95)::BIGINT, n - 1) + 1] AS p95, l[n] AS most FROM y""",
    "category_rates": f"WITH {LATEST} SELECT kind, count(*) AS n, round(avg((status = 'active')::INT), 6) AS share_active, grouping(kind)::INT AS is_total FROM latest GROUP BY ROLLUP (kind)",
}
