"""Queries over what is stored and what was recalled: records, logs, look-ups, roll-ups, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions.times import millis_text, to_millis
from mnemospark.operators import ingest, recall, segments, sessions, vectors
from mnemospark.operators.speakers import with_speaker
from mnemospark.operators.versions import latest
from mnemospark.plans.memory import LATEST, MESSAGES, _latest, _messages
from mnemospark.plans.problems import millis_sql
from mnemospark.session import shared_dir
from mnemospark.sources import files
from mnemospark.sources.tables import table, with_arrival
from mnemospark.streaming import runs
from mnemospark.streaming import sessions as state

DAY = 86_400_000


def json_scan(spark: SparkSession, d: str) -> DataFrame:
    """Messages written as JSON lines, some torn, and read back: rows by source and rejects."""
    o = table(spark, d, "originals")
    line = F.to_json(F.struct(*o.columns))
    lines = o.select(F.explode(F.when(F.col("id").endswith("7"), F.array(line, F.substring(line, 1, 30), F.lit(""))).otherwise(F.array(line))).alias("value"))
    path = f"{shared_dir(spark)}/lines"
    lines.write.text(path)
    rows, rejects = files.json_lines(spark, path, files.MESSAGE)
    by = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return by.unionByName(rejects.agg(F.count(F.lit(1)).alias("n")).select(F.lit("(torn)").alias("source"), "n"))


def message_records(spark: SparkSession, d: str) -> DataFrame:
    """Records as rows with defaults, by source."""
    m = files.message_rows(table(spark, d, "originals"))
    return m.groupBy("source").agg(F.count_if(F.col("meta").isNotNull()).alias("n_meta"), F.count_if(F.col("ingested_at").isNull()).alias("n_no_time"), F.count_if(F.col("sha256") == F.sha2("content", 256)).alias("n_true_hash"))


def front_matter(spark: SparkSession, d: str) -> DataFrame:
    """Documents as texts with front matter, read back."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    whole = files.with_front_matter({"id": F.col("doc_id"), "lang": F.col("lang"), "source": F.col("source")}, F.col("text"))
    f = docs.select("doc_id", files.front_matter(whole).alias("f"))
    return f.select("doc_id", F.try_element_at("f.head", F.lit("lang")).alias("lang"), F.try_element_at("f.head", F.lit("source")).alias("source"), F.length("f.body").alias("n"))


def newest_messages(spark: SparkSession, d: str) -> DataFrame:
    """The three newest messages of each conversation, oldest first."""
    by = Window.partitionBy("conversation_id").orderBy(F.desc("ms"), F.desc("item_id"))
    m = _messages(spark, d).withColumn("back", F.row_number().over(by)).where("back <= 3")
    return m.select("conversation_id", "item_id", F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("back"))).alias("place"))


def replay_times(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a session replayed from its start at two minutes each, local to UTC."""
    m = _messages(spark, d).withColumn("day", F.floor(F.col("ms") / DAY))
    by = Window.partitionBy("conversation_id", "day").orderBy("ms", "item_id")
    at = F.col("day") * DAY + (F.row_number().over(by) - 1) * 120_000 - 8 * 3_600_000
    return m.select("conversation_id", "item_id", millis_text(at).alias("at"))


def sampled_turns(spark: SparkSession, d: str) -> DataFrame:
    """A spread sample of 50 user messages: the first by a hash with a fixed seed."""
    m = _messages(spark, d).where("role = 'user'").withColumn("h", F.sha2(F.concat(F.lit("seed-7|"), F.col("id")), 256))
    return m.orderBy("h", "id").limit(50).select("id", "h")


def audit_log(spark: SparkSession, d: str) -> DataFrame:
    """What happened to each episode, newest first, at most five entries."""
    e = table(spark, d, "episodes").dropDuplicates(["episode_id", "version"]).select("episode_id", "version", "status", "updated_at")
    by = Window.partitionBy("episode_id").orderBy(F.desc("version"))
    action = F.when(F.col("version") == 1, "created").when(F.col("status") == "archived", "archived").otherwise("updated")
    return e.withColumn("place", F.row_number().over(by)).where("place <= 5").select("episode_id", "place", "version", action.alias("action"))


def attachments(spark: SparkSession, d: str) -> DataFrame:
    """Registrations by (message, asset): one each, with the last caption that is not blank."""
    o = with_arrival(table(spark, d, "originals")).where("id IS NOT NULL").select("id", F.col("item_id").alias("asset"), F.when(F.col("content").rlike(r"\S"), F.col("content")).alias("caption"), "arrival")
    g = o.groupBy("id", "asset").agg(F.max_by("caption", F.when(F.col("caption").isNotNull(), F.col("arrival"))).alias("caption"), F.count(F.lit(1)).alias("n"))
    return g.select(ingest.derived_id("a_", "id", "asset").alias("attachment_id"), F.sha2(F.coalesce("caption", F.lit("")), 256).alias("caption_hash"), "n")


def turn_locks(spark: SparkSession, d: str) -> DataFrame:
    """One lock per conversation and day: the latest showing, with its unit."""
    s = table(spark, d, "seen").where("session_id IS NOT NULL").select("conversation_id", "session_id", "ref_id", to_millis("at").alias("ms")).where("ms IS NOT NULL")
    return s.groupBy("conversation_id", "session_id").agg(F.max_by("ref_id", F.struct("ms", "ref_id")).alias("ref_id"), F.max("ms").alias("ms"), F.count_distinct("ref_id").alias("n_units"))


def confirmed_once(spark: SparkSession, d: str) -> DataFrame:
    """Units confirmed in a conversation: those that exist, each version once, at its first time."""
    s = table(spark, d, "seen").select("conversation_id", "ref_id", "version", to_millis("at").alias("ms"))
    there = table(spark, d, "episodes").select(F.col("episode_id").alias("ref_id"), "version").distinct()
    return s.join(there, ["ref_id", "version"], "left_semi").groupBy("conversation_id", "ref_id", "version").agg(F.min("ms").alias("first_ms"))


def decided(spark: SparkSession, d: str) -> DataFrame:
    """Sessions as candidates, with the episodes that came of them, by number of episodes."""
    s = sessions.merge_intervals(_messages(spark, d), ["conversation_id"], "ms")
    e = _latest(spark, d).select("episode_id", F.explode("source_raw_ids").alias("id")).join(_messages(spark, d).select("id", "conversation_id", F.col("ms").alias("at")), "id").select("conversation_id", "at", "episode_id").distinct()
    placed = e.join(s.withColumn("b", F.explode(F.sequence(F.floor(F.col("start_ms") / DAY), F.floor(F.col("end_ms") / DAY)))).withColumnRenamed("conversation_id", "_c"), (F.col("conversation_id") == F.col("_c")) & (F.floor(F.col("at") / DAY) == F.col("b")) & F.col("at").between(F.col("start_ms"), F.col("end_ms")))
    n = placed.groupBy(F.col("_c").alias("c"), F.col("start_ms").alias("s")).agg(F.count_distinct("episode_id").alias("k"))
    return s.join(n, s["conversation_id"].eqNullSafe(n["c"]) & (s["start_ms"] == n["s"]), "left").groupBy(F.coalesce("k", F.lit(0)).alias("n_episodes")).agg(F.count(F.lit(1)).alias("n_sessions"))


def supports(spark: SparkSession, d: str) -> DataFrame:
    """For each episode the units whose active edges rest on it, by type of edge."""
    r = table(spark, d, "relations").where("status = 'active'").select("type", "src_id", F.col("dst_id").alias("episode_id"))
    return _latest(spark, d).select("episode_id").join(r, "episode_id").groupBy("episode_id", "type").agg(F.count_distinct("src_id").alias("n"))


def expansions(spark: SparkSession, d: str) -> DataFrame:
    """What each episode rests on, cut to 60 characters, missing messages marked."""
    first = with_arrival(table(spark, d, "originals")).groupBy("id").agg(F.min_by("content", "arrival").alias("content"))
    x = recall.expanded(_latest(spark, d), "episode_id", "source_raw_ids", first, 60)
    return x.select("episode_id", "position", "raw_id", F.length("text").alias("n"), "missing")


def message_lookup(spark: SparkSession, d: str) -> DataFrame:
    """From a message to the episodes that cite it and the edges that rest on those."""
    e = _latest(spark, d).select("episode_id", F.explode(F.array_distinct("source_raw_ids")).alias("id"))
    r = table(spark, d, "relations").where("status = 'active'").groupBy(F.col("dst_id").alias("episode_id")).agg(F.count(F.lit(1)).alias("edges"))
    return e.join(r, "episode_id", "left").groupBy("id").agg(F.count(F.lit(1)).alias("n_episodes"), F.coalesce(F.sum("edges"), F.lit(0)).alias("n_edges"))


def _shown_heat(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "seen").where("ref_id IS NOT NULL AND conversation_id IS NOT NULL")
    return s.groupBy(F.col("conversation_id").alias("query_id"), F.col("ref_id").alias("unit_id")).agg(F.count(F.lit(1)).alias("c"))


def topic_groups(spark: SparkSession, d: str) -> DataFrame:
    """What was shown in each conversation, grouped by first topic: own hit or best member."""
    e = _latest(spark, d).select(F.col("episode_id").alias("unit_id"), F.get("topics", F.lit(0)).alias("group_id"), (F.coalesce("importance", F.lit(0.5)) < 0.5).alias("weak"), (F.size("entities") > 0).alias("named"), F.col("kind"))
    h = _shown_heat(spark, d).join(e, "unit_id").where("group_id IS NOT NULL").select("query_id", "group_id", (F.col("kind") == "").alias("direct"), (F.col("c") / (F.col("c") + 2.0)).alias("score"), "weak", "named")
    return recall.grouped(h)


def final_caps(spark: SparkSession, d: str) -> DataFrame:
    """Of what was shown in each conversation at most two plain episodes, one of another kind
    each, and three in all."""
    e = _latest(spark, d).select(F.col("episode_id").alias("unit_id"), F.when(F.col("kind") == "", "plain").otherwise("special").alias("kind"))
    h = _shown_heat(spark, d).join(e, "unit_id").select("query_id", "unit_id", "kind", F.col("c").alias("score"))
    return recall.capped(h, {"plain": 2, "special": 1}, 3).select("query_id", "unit_id", "place")


def strongest_status(spark: SparkSession, d: str) -> DataFrame:
    """The strongest status of each edge's two ends over all edges between them."""
    rank = F.when(F.col("status") == "active", 2).when(F.col("status") == "archived", 0).otherwise(1)
    return table(spark, d, "relations").groupBy("src_id", "dst_id").agg(F.max_by("status", F.struct(rank, "status")).alias("status"), F.count(F.lit(1)).alias("n"))


def recall_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each episode was shown, in how many conversations, by kind of reference."""
    return table(spark, d, "seen").groupBy("ref_kind", "ref_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("conversation_id").alias("n_conversations"))


def basis(spark: SparkSession, d: str) -> DataFrame:
    """The versions each episode stands on, as one string in order."""
    v = table(spark, d, "episodes").groupBy("episode_id").agg(F.array_sort(F.collect_set("version")).alias("v"))
    return v.select("episode_id", F.array_join(F.transform("v", lambda x: F.concat(F.col("episode_id"), F.lit("@"), x.cast("string"))), ",").alias("basis"))


def retrievable(spark: SparkSession, d: str) -> DataFrame:
    """Messages that a search at the end of March may show, after each exclusion in turn."""
    m = _messages(spark, d)
    rolled = _latest(spark, d).where("status IN ('archived', 'merged')").select(F.explode("source_raw_ids").alias("id"))
    a = recall.without(m, rolled, ["id"])
    now = 1_459_400_000_000
    last = a.groupBy("conversation_id").agg(F.max("ms").alias("last"))
    j = a.join(last, "conversation_id")
    inside = recall.in_session(F.col("conversation_id"), F.col("ms"), F.col("conversation_id"), F.col("last") - 3_600_000)
    return j.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_not_rolled"), F.count_if(F.col("ms") <= now).alias("n_before"), F.count_if((F.col("ms") <= now) & ~inside).alias("n_outside_session"))


def held_back(spark: SparkSession, d: str) -> DataFrame:
    """Showings that six hours (seen) or a day (cooling) after another of the same unit and
    version in the conversation would have been held back."""
    keys = ["conversation_id", "ref_id", "version"]
    s = table(spark, d, "seen").select(*keys, to_millis("at").alias("at_ms")).where("at_ms IS NOT NULL").distinct()
    before = s.withColumn("at_ms", F.col("at_ms") + 1)  # a showing holds back only what comes later
    seen = recall.shown_within(s, before, keys, 6 * 3_600_000).withColumnRenamed("held", "seen")
    both = recall.shown_within(seen, before, keys, 24 * 3_600_000)
    return both.groupBy("conversation_id").agg(F.count_if("seen").alias("n_seen"), F.count_if("held").alias("n_cooling"), F.count(F.lit(1)).alias("n"))


def no_notes(spark: SparkSession, d: str) -> DataFrame:
    """Messages that may be mined: not notes by hand, whatever their type otherwise."""
    o = table(spark, d, "originals").where(F.coalesce(F.col("source_type") != "manual_note", F.lit(True)))
    return o.groupBy("source", "source_type").agg(F.count(F.lit(1)).alias("n"))


def attachment_search(spark: SparkSession, d: str) -> DataFrame:
    """Texts and metadata that have a word, whatever its case: the first hundred by id."""
    o = table(spark, d, "originals").where(F.contains(F.lower(F.concat_ws("\n", "content", "meta")), F.lit("kiln")))
    return o.select("id").distinct().orderBy("id").limit(100)


def episode_views(spark: SparkSession, d: str) -> DataFrame:
    """Episodes as they are shown: gist, text cut to 320 characters, the last entities, labels."""
    e = _latest(spark, d)
    return e.select(
        "episode_id", F.length(F.substring(F.coalesce("content", F.lit("")), 1, 320)).alias("n_text"), F.length(T.gist("excerpt", "content")).alias("n_gist"),
        F.array_join(T.cleaned_labels("entities", 40, 6), "|").alias("labels"),
    )


def message_features(spark: SparkSession, d: str) -> DataFrame:
    """What messages ask and how much they say, by source."""
    o = table(spark, d, "originals")
    f = recall.features(F.col("content"))
    return o.groupBy("source").agg(*[F.count_if(c).alias(n) for n, c in f.items()], F.count_if(recall.content_length(F.col("content")) < recall.TINY_CONTENT).alias("tiny"), F.sum(recall.content_length(F.col("content"))).alias("length"))


def retry_times(spark: SparkSession, d: str) -> DataFrame:
    """Waits after so many failures, taking versions for failures."""
    e = table(spark, d, "episodes").groupBy("episode_id").agg(F.max("version").alias("n"))
    return e.select("episode_id", recall.backoff_seconds(F.col("n")).alias("wait"))


def squashed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(recall.sigmoid(F.col("value") / 100)), 6).alias("mean"), F.round(F.max(recall.sigmoid(F.col("value") / 100)), 6).alias("most"))


def merged_sources(spark: SparkSession, d: str) -> DataFrame:
    """Lists of sources with one id replaced by the smallest and the largest taken out."""
    e = _latest(spark, d).where(F.size("source_raw_ids") > 0).withColumns({"lo": F.array_min("source_raw_ids"), "hi": F.array_max("source_raw_ids")})
    once = recall.replaced_id(F.col("source_raw_ids"), F.col("hi"), F.lit(None).cast("string"))
    return e.select("episode_id", F.size(once).alias("n"), F.coalesce(F.array_min(once) == F.col("lo"), F.lit(False)).alias("kept"), F.size(recall.id_list(F.to_json("source_raw_ids"))).alias("n_json"))


def evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Names as questions: does a message they came from say the name or an alias; by kind."""
    n = table(spark, d, "names")
    q = n.select(F.col("name_id").alias("question_id"), F.coalesce("kind", F.lit("")).alias("category"), F.array(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("expect"), F.array().cast("array<string>").alias("must_not"))
    first = with_arrival(table(spark, d, "originals")).groupBy("id").agg(F.min_by("content", "arrival").alias("text"))
    h = n.select(F.col("name_id").alias("question_id"), F.explode(F.array_distinct("sources")).alias("id")).join(first, "id").select("question_id", "text")
    return recall.pass_rates(recall.evaluated(q, h))


def window_additions(spark: SparkSession, d: str) -> DataFrame:
    """For the first and the middle of each conversation's month the most important episodes."""
    m = _messages(spark, d).groupBy("conversation_id").agg(F.min("ms").alias("ms"))
    first = F.trunc(F.to_date(F.timestamp_millis("ms")), "month")
    lo = F.unix_millis(first.cast("timestamp"))
    w = m.select(F.col("conversation_id").alias("query_id"), lo.alias("lo"), (F.unix_millis(F.add_months(first, 2).cast("timestamp")) - 1).alias("hi"))
    u = _latest(spark, d).where("status = 'active'").select(F.col("episode_id").alias("unit_id"), to_millis("time_start").alias("lo"), to_millis("time_end").alias("hi"), "importance")
    return recall.window_additions(w, u)


def discovery_windows(spark: SparkSession, d: str) -> DataFrame:
    """Short windows of messages: silences of 25 minutes, 1,400 characters, ten messages."""
    w = segments.pack_windows(_messages(spark, d).withColumnRenamed("item_id", "ord"), 25 * 60_000, 1_400, 10)
    return w.groupBy("conversation_id", "stretch", "window").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.min("ms").alias("start_ms"))


def context_lines(spark: SparkSession, d: str) -> DataFrame:
    """The last lines of each conversation's latest day as they are shown."""
    o = with_speaker(table(spark, d, "originals"), table(spark, d, "speakers")).select("conversation_id", "item_id", "speaker", "content", to_millis("created_at").alias("ms")).where("ms IS NOT NULL")
    by = Window.partitionBy("conversation_id").orderBy(F.desc("ms"), F.desc("item_id"), F.desc("content"))
    last = o.withColumn("k", F.row_number().over(by)).where("k <= 6").groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "speaker", F.col("content").alias("text")))).alias("m"))
    return last.select("conversation_id", F.sha2(T.rendered("m"), 256).alias("digest"))


def stream_late_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users with a short watermark over events that arrive out of order, made
    whole by planning again the users who lost late rows."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("t"))
    folder = shared_dir(spark)
    # four deliveries, each with events of all times: the later ones are late
    for i in range(4):
        e.where(F.pmod(F.xxhash64("t", "user_id"), F.lit(4)) == i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = runs.run_available(state.session_stream(stream, "user_id", "t", "30 minutes", "1 hour"), folder=f"{folder}/run")
    emitted = out.select("user_id", F.unix_millis("start_at").alias("start_ms"), F.unix_millis("end_at").alias("end_ms"), "n")
    stored = e.select("user_id", F.unix_millis("t").alias("ms"))
    return state.replanned(emitted, stored, "user_id", "ms", lambda rows: sessions.merge_intervals(rows, ["user_id"], "ms", 30 * 60_000))


def stream_projection(spark: SparkSession, d: str) -> DataFrame:
    """Changes of episodes as a stream: each batch projects the ids it touches and makes their
    vectors, under its own number, so a repeated batch counts once; the latest of each id is
    what a reader sees."""
    provider = vectors.Provider()
    folder = shared_dir(spark)

    def project(batch: DataFrame, n: int) -> None:
        u = latest(batch, ["episode_id"], "version").select(F.col("episode_id").alias("unit_id"), "version", "status", F.coalesce("content", F.lit("")).alias("text"))
        u.withColumns({"hash": F.sha2("text", 256), "v": provider.embed(F.col("text"))}).drop("text").write.mode("overwrite").parquet(f"{folder}/units/batch={n}")

    runs.for_each_batch(runs.file_stream(spark, d, "episodes"), project, f"{folder}/state")
    u = spark.read.parquet(f"{folder}/units")
    top = u.groupBy("unit_id").agg(F.max_by(F.struct("version", "status", "hash", F.size("v").alias("size")), F.struct("version", "batch")).alias("r"))
    return top.groupBy("r.status").agg(F.count(F.lit(1)).alias("n"), F.sum("r.version").alias("versions"), F.min("r.size").alias("dimensions"))


QUERIES = {f.__name__: f for f in (
    json_scan, message_records, front_matter, newest_messages, replay_times, sampled_turns, audit_log, attachments, turn_locks, confirmed_once, decided, supports, expansions, message_lookup,
    topic_groups, final_caps, strongest_status, recall_counts, basis, retrievable, held_back, no_notes, attachment_search, episode_views, message_features, retry_times, squashed, merged_sources,
    evaluation, window_additions, discovery_windows, context_lines, stream_late_sessions, stream_projection,
)}

_FIRST = "first AS (SELECT id, arg_min(coalesce(content, chr(0)), r) AS content FROM (SELECT id, content, row_number() OVER () AS r FROM originals) GROUP BY 1)"
_HITS = "h AS (SELECT conversation_id AS query_id, ref_id AS unit_id, count(*) AS c FROM seen WHERE ref_id IS NOT NULL AND conversation_id IS NOT NULL GROUP BY ALL)"
_LENGTH = lambda c: f"length(regexp_replace(regexp_replace(coalesce({c}, ''), '{recall.STAGE}', '', 'g'), '{recall.FILLER}', '', 'g'))"

ORACLES = {
    "json_scan": "SELECT source, count(*) AS n FROM originals GROUP BY 1 UNION ALL SELECT '(torn)', count(*) FROM originals WHERE id LIKE '%7'",
    "message_records": """SELECT source, count(*) FILTER (json_valid(meta) AND json_type(meta) = 'OBJECT') AS n_meta, count(*) FILTER (coalesce(trim(ingested_at), '') = '') AS n_no_time,
        count(*) FILTER (coalesce(nullif(lower(trim(sha256)), ''), sha256(coalesce(content, ''))) = sha256(coalesce(content, ''))) AS n_true_hash FROM originals GROUP BY 1""",
    "front_matter": r"SELECT doc_id, trim(lang) AS lang, trim(source) AS source, length(regexp_replace(text, '\r\n?', chr(10), 'g'))::INT AS n FROM documents WHERE text IS NOT NULL",
    "newest_messages": f"""WITH {MESSAGES}, b AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY ms DESC, item_id DESC) AS back FROM m QUALIFY back <= 3)
        SELECT conversation_id, item_id, row_number() OVER (PARTITION BY conversation_id ORDER BY back DESC)::INT AS place FROM b""",
    "replay_times": f"""WITH {MESSAGES} SELECT conversation_id, item_id, strftime(make_timestamp_ms((ms // 86400000) * 86400000 + (row_number() OVER (PARTITION BY conversation_id, ms // 86400000 ORDER BY ms, item_id) - 1) * 120000 - 28800000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS "at" FROM m""",
    "sampled_turns": f"WITH {MESSAGES} SELECT id, sha256('seed-7|' || id) AS h FROM m WHERE role = 'user' ORDER BY h, id LIMIT 50",
    "audit_log": """WITH e AS (SELECT DISTINCT episode_id, version, status FROM episodes) SELECT episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY version DESC)::INT AS place, version,
        CASE WHEN version = 1 THEN 'created' WHEN status = 'archived' THEN 'archived' ELSE 'updated' END AS action FROM e QUALIFY place <= 5""",
    "attachments": r"""WITH o AS (SELECT id, item_id, CASE WHEN regexp_matches(content, '\S') THEN content END AS c, row_number() OVER () AS r FROM originals WHERE id IS NOT NULL)
        SELECT 'a_' || substring(sha256(id || chr(31) || coalesce(item_id, '')), 1, 20) AS attachment_id, sha256(coalesce(arg_max(c, r) FILTER (c IS NOT NULL), '')) AS caption_hash, count(*) AS n FROM o GROUP BY id, item_id""",
    "turn_locks": f"""WITH s AS (SELECT conversation_id, session_id, ref_id, {millis_sql('"at"')} AS ms FROM seen WHERE session_id IS NOT NULL)
        SELECT conversation_id, session_id, arg_max(ref_id, (ms, ref_id)) AS ref_id, max(ms) AS ms, count(DISTINCT ref_id) AS n_units FROM s WHERE ms IS NOT NULL GROUP BY 1, 2""",
    "confirmed_once": f"""SELECT conversation_id, ref_id, version, min({millis_sql('"at"')}) AS first_ms FROM seen WHERE (ref_id, version) IN (SELECT (episode_id, version) FROM episodes) GROUP BY 1, 2, 3""",
    "decided": f"""WITH {MESSAGES}, {LATEST}, l AS (SELECT conversation_id, ms, lag(ms) OVER (PARTITION BY conversation_id ORDER BY ms) AS b FROM m),
        k AS (SELECT conversation_id, ms, sum(CASE WHEN b IS NULL OR ms - b > 3600000 THEN 1 ELSE 0 END) OVER (PARTITION BY conversation_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS s FROM l),
        sess AS (SELECT conversation_id, min(ms) AS lo, max(ms) AS hi FROM k GROUP BY conversation_id, s), e AS (SELECT DISTINCT m.conversation_id, m.ms, episode_id FROM (SELECT episode_id, unnest(source_raw_ids) AS id FROM latest) JOIN m USING (id)),
        n AS (SELECT sess.conversation_id, lo, count(DISTINCT episode_id) AS k FROM sess LEFT JOIN e ON e.conversation_id = sess.conversation_id AND e.ms BETWEEN lo AND hi GROUP BY 1, 2) SELECT k AS n_episodes, count(*) AS n_sessions FROM n GROUP BY 1""",
    "supports": f"WITH {LATEST} SELECT dst_id AS episode_id, type, count(DISTINCT src_id) AS n FROM relations WHERE status = 'active' AND dst_id IN (SELECT episode_id FROM latest) GROUP BY 1, 2",
    "expansions": f"""WITH {LATEST}, {_FIRST}, e AS (SELECT episode_id, unnest(source_raw_ids) AS raw_id, generate_subscripts(source_raw_ids, 1) - 1 AS position FROM latest)
        SELECT episode_id, position::INT AS position, raw_id, CASE WHEN content = chr(0) THEN NULL WHEN length(content) > 60 THEN 61 ELSE length(content) END::INT AS n, first.id IS NULL AS missing FROM e LEFT JOIN first ON raw_id = id WHERE raw_id IS NOT NULL""",
    "message_lookup": f"""WITH {LATEST}, e AS (SELECT DISTINCT episode_id, unnest(source_raw_ids) AS id FROM latest), r AS (SELECT dst_id AS episode_id, count(*) AS c FROM relations WHERE status = 'active' GROUP BY 1)
        SELECT id, count(*) AS n_episodes, coalesce(sum(c), 0)::BIGINT AS n_edges FROM e LEFT JOIN r USING (episode_id) GROUP BY 1""",
    "topic_groups": f"""WITH {LATEST}, {_HITS}, x AS (SELECT query_id, topics[1] AS group_id, kind = '' AS direct, c / (c + 2.0::DOUBLE) AS score, coalesce(importance, 0.5) < 0.5 AS weak, coalesce(len(entities), 0) > 0 AS named FROM h JOIN latest ON unit_id = episode_id WHERE len(topics) > 0)
        SELECT query_id, group_id, round(max(CASE WHEN direct THEN score ELSE score * 0.95::DOUBLE END), 4) AS score, count(*) AS n, bool_and(weak) AS all_weak, bool_or(named) AS any_named FROM x WHERE group_id IS NOT NULL GROUP BY 1, 2""",
    "final_caps": f"""WITH {LATEST}, {_HITS}, x AS (SELECT query_id, unit_id, CASE WHEN kind = '' THEN 'plain' ELSE 'special' END AS kind, c FROM h JOIN latest ON unit_id = episode_id),
        y AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY c DESC, unit_id) AS k FROM x) SELECT query_id, unit_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, kind, unit_id)::INT AS place FROM y WHERE k <= CASE kind WHEN 'plain' THEN 2 ELSE 1 END QUALIFY place <= 3""",
    "strongest_status": "SELECT src_id, dst_id, arg_max(status, (CASE status WHEN 'active' THEN 2 WHEN 'archived' THEN 0 ELSE 1 END, status)) AS status, count(*) AS n FROM relations GROUP BY 1, 2",
    "recall_counts": "SELECT ref_kind, ref_id, count(*) AS n, count(DISTINCT conversation_id) AS n_conversations FROM seen GROUP BY 1, 2",
    "basis": "SELECT episode_id, string_agg(episode_id || '@' || version, ',' ORDER BY version) AS basis FROM (SELECT DISTINCT episode_id, version FROM episodes) GROUP BY 1",
    "retrievable": f"""WITH {MESSAGES}, {LATEST}, a AS (SELECT * FROM m WHERE id NOT IN (SELECT unnest(source_raw_ids) FROM latest WHERE status IN ('archived', 'merged'))), l AS (SELECT *, max(ms) OVER (PARTITION BY conversation_id) AS last FROM a)
        SELECT conversation_id, count(*) AS n_not_rolled, count(*) FILTER (ms <= 1459400000000) AS n_before, count(*) FILTER (ms <= 1459400000000 AND ms < last - 3600000) AS n_outside_session FROM l GROUP BY 1""",
    "held_back": f"""WITH s AS (SELECT DISTINCT conversation_id, ref_id, version, {millis_sql('"at"')} AS ms FROM seen), g AS (SELECT *, ms - lag(ms) OVER (PARTITION BY conversation_id, ref_id, version ORDER BY ms) - 1 AS gap FROM s WHERE ms IS NOT NULL)
        SELECT conversation_id, count(*) FILTER (gap <= 21600000) AS n_seen, count(*) FILTER (gap <= 86400000) AS n_cooling, count(*) AS n FROM g GROUP BY 1""",
    "no_notes": "SELECT source, source_type, count(*) AS n FROM originals WHERE source_type IS DISTINCT FROM 'manual_note' GROUP BY 1, 2",
    "attachment_search": "SELECT DISTINCT id FROM originals WHERE contains(lower(concat_ws(chr(10), content, meta)), 'kiln') ORDER BY id LIMIT 100",
    "episode_views": rf"""WITH {LATEST} SELECT episode_id, least(length(coalesce(content, '')), 320)::INT AS n_text, length(coalesce(nullif(trim(excerpt), ''), substring(content, 1, 120), ''))::INT AS n_gist,
        coalesce(array_to_string((SELECT list(x ORDER BY p) FROM (SELECT x, min(p) AS p FROM (SELECT substring(trim(regexp_replace(entities[i], '\s+', ' ', 'g')), 1, 40) AS x, i AS p FROM range(1, len(entities) + 1) r(i)) WHERE length(x) > 0 GROUP BY x ORDER BY p LIMIT 6)), '|'), '') AS labels FROM latest""",
    "message_features": f"""SELECT source, {', '.join(f"count(*) FILTER (regexp_matches(content, '{p}')) AS {n}" for n, p in recall.FEATURES.items())}, count(*) FILTER ({_LENGTH('content')} < 4) AS tiny, sum({_LENGTH('content')})::BIGINT AS length FROM originals GROUP BY 1""",
    "retry_times": "SELECT episode_id, least(300.0 * pow(2, max(version) - 1), 21600)::DOUBLE AS wait FROM episodes GROUP BY 1",
    "squashed": "SELECT event_type, round(avg(1 / (1 + exp(-value / 100))), 6) AS mean, round(max(1 / (1 + exp(-value / 100))), 6) AS most FROM events GROUP BY 1",
    "merged_sources": f"""WITH {LATEST}, x AS (SELECT episode_id, source_raw_ids AS s, list_min(source_raw_ids) AS lo, list_max(source_raw_ids) AS hi FROM latest WHERE len(source_raw_ids) > 0)
        SELECT episode_id, len(list_distinct(list_filter(s, lambda i: i <> hi)))::INT AS n, coalesce(list_min(list_filter(s, lambda i: i <> hi)) = lo, false) AS kept, len(s)::INT AS n_json FROM x""",
    "evaluation": f"""WITH {_FIRST}, q AS (SELECT name_id, coalesce(kind, '') AS category, list_concat([name], coalesce(aliases, [])) AS w FROM names), h AS (SELECT DISTINCT name_id, unnest(sources) AS id FROM names),
        j AS (SELECT q.name_id, category, bool_or(len(list_filter(w, lambda x: contains(lower(coalesce(content, '')), lower(x)))) > 0) AS ok FROM q LEFT JOIN h USING (name_id) LEFT JOIN first USING (id) GROUP BY 1, 2)
        SELECT category, count(*) AS n, count(*) FILTER (ok) AS n_passed, round(avg(coalesce(ok, false)::INT), 6) AS rate, grouping(category)::INT AS is_total FROM j GROUP BY ROLLUP (category)""",
    "window_additions": f"""WITH {MESSAGES}, {LATEST}, c AS (SELECT conversation_id, date_trunc('month', make_timestamp_ms(min(ms))) AS f FROM m GROUP BY 1), w AS (SELECT conversation_id AS query_id, epoch_ms(f) AS lo, epoch_ms(f + INTERVAL 2 MONTH) - 1 AS hi FROM c),
        e AS (SELECT episode_id AS unit_id, {millis_sql('time_start')} AS l, {millis_sql('time_end')} AS h, round(0.3::DOUBLE + 0.4::DOUBLE * coalesce(importance, 0.5), 4) AS score FROM latest WHERE status = 'active')
        SELECT query_id, unit_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id)::INT AS rank FROM w JOIN e ON h >= lo AND l <= hi AND l <= h QUALIFY rank <= 4""",
    "stream_late_sessions": """WITH m AS (SELECT user_id, epoch_us(ts) // 1000 AS ms FROM events WHERE ts IS NOT NULL), l AS (SELECT *, lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS b FROM m),
        n AS (SELECT *, sum(CASE WHEN b IS NULL OR ms - b > 1800000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS s FROM l)
        SELECT user_id, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS n FROM n GROUP BY user_id, s""",
    "stream_projection": f"WITH {LATEST} SELECT status, count(*) AS n, sum(version)::BIGINT AS versions, 256 AS dimensions FROM latest GROUP BY 1",
}
