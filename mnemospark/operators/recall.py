"""What surrounds a search: who may be shown what, grouping, caps, additions, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.operators import joins

DAY_MS = 86_400_000


def without(candidates: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates but those named; a null never names any."""
    return candidates.join(excluded.select(*keys).distinct(), keys, "left_anti")


def in_session(conversation: Column, at_ms: Column, own: Column, since_ms: Column) -> Column:
    """Whether a message belongs to the session that asks: its conversation, at or after its
    beginning. What has no time or conversation does not."""
    return F.coalesce((conversation == own) & (at_ms >= since_ms), F.lit(False))


def shown_within(asked: DataFrame, shown: DataFrame, keys: list[str], reach_ms: int) -> DataFrame:
    """``asked`` (keys, ``at_ms``) with ``held``: whether the same keys were shown (keys,
    ``at_ms``) in the time of ``reach_ms`` before, the moment itself included.

    It is the last showing at or before that counts, found by time buckets, so no key's rows
    are paired with each other.
    """
    last = joins.as_of(asked, shown.select(*keys, "at_ms", F.col("at_ms").alias("_last")), keys, "at_ms", "_last")
    return last.withColumn("held", F.coalesce(F.col("at_ms") - F.col("_last") <= reach_ms, F.lit(False))).drop("_last")


def grouped(hits: DataFrame) -> DataFrame:
    """``query_id, group_id, score, n, all_weak, any_named`` of hits (``query_id, group_id,
    direct, score, weak, named``): a group scores as its own hit or as 95 hundredths of the
    best of its members, whichever is more."""
    return hits.groupBy("query_id", "group_id").agg(
        F.round(F.max(F.when(F.col("direct"), F.col("score")).otherwise(F.col("score") * 0.95)), 4).alias("score"), F.count(F.lit(1)).alias("n"),
        F.min(F.col("weak")).alias("all_weak"), F.max(F.col("named")).alias("any_named"),
    )


def capped(hits: DataFrame, each: dict[str, int], total: int) -> DataFrame:
    """The best hits of a query: at most so many of each kind, and so many in all; ties by the
    order of the kinds, then by unit. Limits apply before the shuffle too."""
    order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(each)], F.lit(len(each)))
    most = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in each.items()], F.lit(0))
    kind = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "unit_id")
    first = hits.withColumn("_k", F.row_number().over(kind)).where(F.col("_k") <= max(each.values())).where(F.col("_k") <= most)
    whole = Window.partitionBy("query_id").orderBy(F.desc("score"), order, "unit_id")
    return first.withColumn("place", F.row_number().over(whole)).where(F.col("place") <= total).drop("_k")


def window_additions(windows: DataFrame, units: DataFrame, k: int = 4) -> DataFrame:
    """``query_id, unit_id, score``: for queries that name a time (``query_id, lo, hi`` in
    milliseconds) the k most important units of it (``unit_id, lo, hi, importance``).

    Equal windows are one, however many queries name them, and a unit counts for a month at
    most once: windows of more than a month are met through the months they touch, each cut
    to its k best, so no window is paired with all units.
    """
    w = windows.select("lo", "hi").distinct().withColumn("w", F.xxhash64("lo", "hi"))
    score = F.round(0.3 + 0.4 * F.coalesce("importance", F.lit(0.5)), 4)
    u = units.select("unit_id", F.col("lo").alias("u_lo"), F.col("hi").alias("u_hi"), score.alias("score")).where("u_lo <= u_hi")
    bucket = 31 * DAY_MS
    lay = lambda a, b: F.explode_outer(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)))
    spans = w.withColumn("b", lay("lo", "hi"))
    inside = (F.col("lo") <= F.col("b") * bucket) & (F.col("hi") >= (F.col("b") + 1) * bucket - 1)
    laid = u.withColumn("b", lay("u_lo", "u_hi"))
    # buckets a window covers whole need only their k best units
    by_bucket = Window.partitionBy("b").orderBy(F.desc("score"), "unit_id")
    best = laid.withColumn("_r", F.row_number().over(by_bucket)).where(F.col("_r") <= k).drop("_r")
    whole = spans.where(inside).join(best, "b").select("w", "unit_id", "score")
    edge = spans.where(~inside).join(laid, "b").where((F.col("u_hi") >= F.col("lo")) & (F.col("u_lo") <= F.col("hi"))).select("w", "unit_id", "score")
    by = Window.partitionBy("w").orderBy(F.desc("score"), "unit_id")
    top = whole.unionByName(edge).distinct().withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return windows.withColumn("w", F.xxhash64("lo", "hi")).join(top, "w").select("query_id", "unit_id", "score", "rank")


def evaluated(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """``question_id, category, passed, n_hits`` of questions (``question_id, category, expect
    array<array<string>>, must_not array<string>``) against hits (``question_id, text``).

    A question passes when each of its groups has a word that some hit contains and no hit
    contains what it must not. Words and hits of one question meet by its id.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    groups = questions.select("question_id", F.posexplode("expect").alias("g", "any"))
    inside = groups.join(hits, "question_id").groupBy("question_id", "g").agg(F.max(F.exists("any", lambda w: F.contains(low("text"), F.lower(w)))).alias("ok"))
    good = inside.groupBy("question_id").agg(F.count_if("ok").alias("n_ok"))
    bad = questions.select("question_id", "must_not").join(hits, "question_id").groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_hits"), F.max(F.exists(F.coalesce("must_not", F.array().cast("array<string>")), lambda w: F.contains(low("text"), F.lower(w)))).alias("leaks")
    )
    j = questions.join(good, "question_id", "left").join(bad, "question_id", "left")
    return j.select(
        "question_id", "category", ((F.coalesce("n_ok", F.lit(0)) == F.size("expect")) & ~F.coalesce("leaks", F.lit(False))).alias("passed"), F.coalesce("n_hits", F.lit(0)).alias("n_hits")
    )


def pass_rates(results: DataFrame) -> DataFrame:
    """By category and over all, in one pass."""
    return results.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("rate"), F.grouping("category").cast("int").alias("is_total"))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def backoff_seconds(failures: Column) -> Column:
    """Five minutes, doubled with every failure after the first, six hours at most."""
    return F.least(F.lit(300.0) * F.pow(F.lit(2.0), failures - 1), F.lit(21600.0))


def id_list(c: Column | str) -> Column:
    """A list of strings in JSON; anything else is an empty list."""
    return F.coalesce(F.from_json(F.col(c) if isinstance(c, str) else c, "array<string>"), F.array().cast("array<string>"))


def replaced_id(ids: Column, old: Column, new: Column) -> Column:
    """An id replaced by another in a list, without repeats; taken out where the other is null."""
    return F.array_distinct(F.array_compact(F.transform(ids, lambda x: F.when(x == old, new).otherwise(x))))


# Fixed values that must equal the reference's: stage directions in brackets, particles, and
# the words that ask, lean on the past, ask when something was said, or point back.
STAGE = r"[（(][^（）()]*[）)]"
FILLER = r"亲爱的|喂|嘛|呀|啊|呢|吧|哦|噢|嗯|啦|哈|嘿|诶|欸|哎|～|~|[\s，。！？!?,.、…·]"
FEATURES = {
    "recall": "上次|上回|还记得|记不记得|记得吗|那次|那回|那天|之前|以前|说过|讲过|聊过",
    "history": "上次|上回|还记得|记不记得|记得吗|那次|那回|那天|之前|以前|说过|讲过|聊过|答应过|答应我|说好|约好|约定|来着|那个人|那家",
    "mention": "说过|说起|聊过|聊到|提到|提起|讲过|告诉过|跟我说|和我说|问过",
    "question": "[?？]|吗|呢|什么|怎么|怎样|哪|谁|几|多少|为什么|记得|记不记得|还记|那次|那段|那天|上次|之前|以前|是不是",
    "referent": "那个|这个|那件|这件|那次|这次|那回|那家|这家|那里|那边|这边|那块|这块|那本|这本|那首|这首|那张|这张|那部|这部|那位|那款|这款|那种|这种|那条|这条|它|刚才说的|刚刚说的|你说的那|上面说的",
}
TINY_CONTENT, TINY_SIMILARITY = 4, 0.65


def content_length(text: Column) -> Column:
    """Characters that say something: without stage directions, particles and punctuation."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), STAGE, ""), FILLER, ""))


def features(text: Column) -> dict[str, Column]:
    """Whether a text asks, leans on the past, asks when something was said, or points back."""
    return {name: F.coalesce(text.rlike(pattern), F.lit(False)) for name, pattern in FEATURES.items()}


def near_enough_for_tiny(length: Column, sim: Column, named: Column) -> Column:
    """Messages of hardly any content take only what is named or close in meaning."""
    return (length >= TINY_CONTENT) | F.coalesce(named, F.lit(False)) | F.coalesce(sim >= TINY_SIMILARITY, F.lit(False))


def expanded(units: DataFrame, key: str, sources: str, messages: DataFrame, width: int = 400) -> DataFrame:
    """``key, position, raw_id, text, missing``: what a unit rests on, cut to a width, in the
    order it names them; ids without a message are marked."""
    e = units.select(key, F.posexplode_outer(sources).alias("position", "raw_id")).where("raw_id IS NOT NULL")
    m = messages.select(F.col("id").alias("_m"), "content")
    j = e.join(m, F.col("raw_id") == F.col("_m"), "left")
    text = F.when(F.length("content") > width, F.concat(F.substring("content", 1, width), F.lit("…"))).otherwise(F.col("content"))
    return j.select(key, "position", "raw_id", text.alias("text"), F.col("_m").isNull().alias("missing"))
