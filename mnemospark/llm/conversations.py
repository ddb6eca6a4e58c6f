"""Rebuilding conversations from message rows with keyed streaming state.

Two keyed states follow each other in one stream. The first holds the messages of a
conversation and time slice, however late or out of order they come, and is emitted as a
summary of the slice's turns once the watermark has passed its end. The second holds the
summaries of a conversation and emits its verdict when it is closed: when nothing came for
the timeout, in event time. So a conversation that holds a third of all messages is as many
pieces of state as it has slices and then one row per slice, and never one group of messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions.times import to_millis
from mnemospark.llm.characters import VISIBLE_JAVA
from mnemospark.operators.speakers import with_speaker
from mnemospark.session import shared_dir
from mnemospark.sources.tables import with_arrival
from mnemospark.streaming.runs import replayed

SLICE_MS = 3600 * 1000
#: Messages of one conversation and slice above which it is cut into seconds.
DENSE = 2000


def first_delivered(originals: DataFrame) -> DataFrame:
    """One copy of each message: the first row to arrive.

    The minimum of structs combines before the shuffle. Rows without an item_id cannot be
    recognised as copies; each counts as a message of its own.
    """
    o = with_arrival(originals).select("conversation_id", "item_id", "arrival", "role", "content", "created_at", "ingested_at")
    o = o.withColumn("key", F.coalesce("item_id", F.concat(F.lit("\u0000"), F.col("arrival.file"), F.lit("\u0000"), F.col("arrival.row").cast("string"))))
    first = o.groupBy("conversation_id", "key").agg(F.min_by(F.struct("item_id", "role", "content", "created_at", "ingested_at", "arrival"), F.col("arrival")).alias("m"))
    return first.select("conversation_id", "m.*")


def spoken(messages: DataFrame, speakers: DataFrame) -> DataFrame:
    """Adds ``speaker`` (null: unknown), ``ms`` (null: no usable time) and ``visible``."""
    return with_speaker(messages, speakers).withColumn("ms", to_millis("created_at")).withColumn("visible", F.coalesce(F.col("content").rlike(VISIBLE_JAVA), F.lit(False)))


def placed(messages: DataFrame, dense: int = DENSE) -> DataFrame:
    """Adds ``part`` (null, or the second within a crowded slice) and ``at``, the event time.

    A message without a usable time is streamed by the time it was stored, or with the first
    possible slice; it takes part in the verdict and in no turn. Slices that hold more than
    ``dense`` messages of a conversation are few, and are cut into seconds.
    """
    at = F.coalesce("ms", to_millis("ingested_at"), F.lit(0))
    m = messages.withColumn("_at", at).withColumn("_slice", F.floor(F.col("_at") / SLICE_MS))
    crowded = m.groupBy(F.col("conversation_id").alias("_c"), F.col("_slice").alias("_s")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > dense).drop("_n")
    m = m.join(crowded, F.col("conversation_id").eqNullSafe(F.col("_c")) & (F.col("_slice") == F.col("_s")), "left")
    part = F.when(F.col("_s").isNotNull(), F.floor(F.col("_at") / 1000))
    return m.withColumns({"part": part, "at": F.timestamp_millis("_at")}).drop("_at", "_slice", "_c", "_s")


def _runs(turns: Column, new: Column | None = None) -> Column:
    """Runs of one speaker in an ordered array of (s, v, ...): array of (s, first, last), the
    places of a run. One pass over neighbours finds where runs begin."""
    n = F.size(turns)
    at = lambda i: F.element_at(turns, i)
    begins = lambda i: (i == 1) | (at(i)["s"] != at(F.greatest(i - 1, F.lit(1)))["s"]) | (at(i)["gap"] if new is not None else F.lit(False))
    starts = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), begins)
    return F.zip_with(starts, F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), lambda a, b: F.struct(a.alias("a"), F.coalesce(b - 1, n).alias("b")))


def slice_summary(messages: Column) -> Column:
    """Messages of a slice in order (array of ``s, v``, users and assistants only) as the runs
    at its ends and one verdict on those in between.

    Runs 2 to n-1 of a slice are whole; whether they are answered among themselves is decided
    here (``open``). The first and last run may go on in other slices, so the two at each end
    are handed on, in order, with ``gap`` where runs between them were left out and
    ``judged`` where the follower of a run was already looked at.
    """
    run = lambda x: F.struct(F.element_at(messages, x["a"])["s"].alias("s"), F.exists(F.slice(messages, x["a"], x["b"] - x["a"] + 1), lambda y: y["v"]).alias("v"))
    runs = F.transform(_runs(messages), run)

    def ends(r: Column) -> Column:
        n = F.size(r)
        inner = F.exists(
            F.when(n > 3, F.sequence(F.lit(2), n - 2)).otherwise(F.array().cast("array<int>")),
            lambda i: (F.element_at(r, i)["s"] == "user") & F.element_at(r, i)["v"] & ~F.element_at(r, i + 1)["v"],
        )
        places = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: (i <= 2) | (i >= n - 1))
        kept = F.transform(places, lambda i: F.struct(
            F.element_at(r, i)["s"].alias("s"), F.element_at(r, i)["v"].alias("v"), ((i >= 2) & (i <= n - 2)).alias("judged"), ((i == n - 1) & (n > 4)).alias("gap"),
        ))
        return F.struct(inner.alias("open"), kept.alias("ends"))

    # the runs are bound to a variable, so that they are found once
    return F.element_at(F.transform(F.array(runs), ends), 1)


def conversation_verdict(slices: Column) -> Column:
    """``first_speaker, unanswered`` from the summaries of a conversation's slices in order."""
    ends = F.flatten(F.transform(slices, lambda x: x["ends"]))

    def judge(e: Column) -> Column:
        part = lambda x: F.slice(e, x["a"], x["b"] - x["a"] + 1)
        turns = F.transform(_runs(e, F.lit(True)), lambda x: F.struct(
            F.element_at(e, x["a"])["s"].alias("s"), F.exists(part(x), lambda y: y["v"]).alias("v"), F.exists(part(x), lambda y: y["judged"]).alias("judged"),
        ))
        bad = lambda t: F.exists(F.when(F.size(t) > 0, F.sequence(F.lit(1), F.size(t))).otherwise(F.array().cast("array<int>")), lambda i: (
            (F.element_at(t, i)["s"] == "user") & F.element_at(t, i)["v"] & ~F.element_at(t, i)["judged"] & ~F.coalesce(F.try_element_at(t, i + 1)["v"], F.lit(False))
        ))
        return F.struct(F.get(e, F.lit(0))["s"].alias("first_speaker"), F.element_at(F.transform(F.array(turns), bad), 1).alias("unanswered"))

    verdict = F.element_at(F.transform(F.array(ends), judge), 1)
    return F.struct(verdict["first_speaker"].alias("first_speaker"), (verdict["unanswered"] | F.exists(slices, lambda x: x["open"])).alias("unanswered"))


def slice_stream(messages: DataFrame, delay: str) -> DataFrame:
    """Closed slices of a stream of messages (``conversation_id, at, part, ms, row, s, v``):
    ``conversation_id, at, slice, summary, shown, odd``.

    Emitted in append mode once the watermark, ``delay`` behind the latest event, has passed
    a slice; until then late messages are taken into its state.
    """
    talk = F.col("s").isin("user", "assistant")
    usable = talk & F.col("ms").isNotNull()
    return (
        messages.withWatermark("at", delay)
        .groupBy("conversation_id", F.window("at", f"{SLICE_MS} milliseconds").alias("w"), "part")
        .agg(
            F.collect_list(F.when(usable, F.struct("ms", "row", "s", "v"))).alias("m"),
            F.max(talk & F.col("v")).alias("shown"), F.max((F.col("s") == "?") | F.col("ms").isNull()).alias("odd"),
        )
        .select(
            "conversation_id", F.window_time("w").alias("at"), F.struct(F.unix_millis("w.start").alias("w"), F.coalesce("part", F.lit(0)).alias("part")).alias("slice"),
            slice_summary(F.array_sort("m")).alias("summary"), "shown", "odd",
        )
    )


def verdict_stream(slices: DataFrame, timeout: str) -> DataFrame:
    """``conversation_id, defects`` of each conversation as it closes: when the watermark is
    the timeout past its last slice. A conversation without a defect is a valid one."""
    closed = (
        slices.groupBy("conversation_id", F.session_window("at", timeout).alias("w"))
        .agg(F.array_sort(F.collect_list(F.struct("slice", "summary"))).alias("x"), F.max("shown").alias("shown"), F.max("odd").alias("odd"))
        .select("conversation_id", "shown", "odd", conversation_verdict(F.transform("x", lambda x: x["summary"])).alias("v"))
    )
    found = F.when(~F.col("shown"), F.array(F.lit("empty"))).otherwise(
        F.array_compact(F.array(F.when(F.col("odd") | F.coalesce(F.col("v.first_speaker") == "assistant", F.lit(False)), F.lit("broken")), F.when(F.col("v.unanswered"), F.lit("unanswered"))))
    )
    return closed.select("conversation_id", found.alias("defects"))


def conversations(messages: DataFrame, delay: str = "24 hours", timeout: str = "30 days") -> DataFrame:
    """The whole stream, for endless input: verdicts of conversations as they close.

    A message later than the delay is dropped by the engine, and one that comes after the
    timeout of its conversation begins another; a run over the stored table (:func:`judged`)
    stays the whole truth.
    """
    return verdict_stream(slice_stream(messages, delay), timeout)


def prepared(spark: SparkSession, originals: DataFrame, speakers: DataFrame, folder: str, text: bool = False) -> str:
    """Writes the first delivery of each message in the form that is streamed, and with its
    text if that is asked for, and returns the path."""
    m = placed(spoken(first_delivered(originals), speakers))
    kept = m.select("conversation_id", "ms", F.col("arrival").alias("row"), F.coalesce("speaker", F.lit("?")).alias("s"), F.col("visible").alias("v"), "part", "at", *(["content"] if text else []))
    kept.write.parquet(f"{folder}/messages")
    return f"{folder}/messages"


def judged(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """``conversation_id, defects`` of every conversation of a prepared table.

    The delay and the timeout are as long as all of the table, so no message is late and no
    conversation closes before all are in, whatever the order of files and the number of
    micro-batches; the mark that follows in a second run closes them all.
    """
    narrow = ["conversation_id", "ms", "row", "s", "v", "part", "at"]
    return replayed(path, "at", lambda s, delay: conversations(s.select(*narrow), f"{delay} milliseconds", f"{delay + SLICE_MS} milliseconds"), spark, files_per_batch)


def defects(spark: SparkSession, originals: DataFrame, speakers: DataFrame) -> DataFrame:
    """``conversation_id, defect`` of each conversation that must be dropped.

    ``empty``: no message of a user or assistant has a visible character (then no other
    defect). ``broken``: an unknown speaker, an unusable time, or the assistant begins.
    ``unanswered``: a visible user turn without a visible assistant turn right after it.
    Messages of equal time follow each other as they arrived. An empty table has no defect;
    a null conversation_id is a conversation like any other.
    """
    path = prepared(spark, originals, speakers, shared_dir(spark))
    return judged(spark, path).select("conversation_id", F.explode("defects").alias("defect"))


def rebuilt(spark: SparkSession, originals: DataFrame, speakers: DataFrame) -> DataFrame:
    """The conversations without a defect, one row per message in order:
    ``conversation_id, position, turn, speaker, created_ms, text``.

    Position counts from 1 within the conversation. It is the number of messages in earlier
    slices plus the place within the slice, so no task sorts a whole conversation. Messages
    of speaker none are left out. A conversation is a run of rows and not one array, because
    its length has no bound; ``collect_list`` over (conversation_id) gives the array where
    it is short enough.
    """
    path = prepared(spark, originals, speakers, shared_dir(spark), text=True)
    valid = judged(spark, path).where(F.size("defects") == 0).select(F.col("conversation_id").alias("_d"))
    said = spark.read.parquet(path).where(F.col("s").isin("user", "assistant") & F.col("ms").isNotNull()).select("conversation_id", "ms", "row", F.col("s").alias("speaker"), "content", "part")
    said = said.join(valid, said["conversation_id"].eqNullSafe(valid["_d"]), "left_semi")
    said = said.withColumn("slice", F.struct(F.floor(F.col("ms") / SLICE_MS).alias("w"), F.coalesce("part", F.lit(0)).alias("part"))).drop("part")
    inside = Window.partitionBy("conversation_id", "slice").orderBy("ms", "row")
    said = said.withColumn("_p", F.row_number().over(inside)).withColumn("_new", F.coalesce((F.lag("speaker").over(inside) != F.col("speaker")).cast("int"), F.lit(0)))
    said = said.withColumn("_t", F.sum("_new").over(inside))
    per = said.groupBy("conversation_id", "slice").agg(
        F.count(F.lit(1)).alias("n"), F.max("_t").alias("changes"), F.min_by("speaker", "_p").alias("s0"), F.max_by("speaker", "_p").alias("s1")
    )
    order = Window.partitionBy("conversation_id").orderBy("slice")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    border = F.coalesce((F.lag("s1").over(order) != F.col("s0")).cast("int"), F.lit(0))
    per = per.withColumn("_border", border).select(
        F.col("conversation_id").alias("_c"), F.col("slice").alias("_s"),
        F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("_before"),
        (F.sum("_border").over(up_to) + F.coalesce(F.sum("changes").over(so_far), F.lit(0))).alias("_turns"),
    )
    return said.join(per, said["conversation_id"].eqNullSafe(per["_c"]) & (said["slice"] == per["_s"])).select(
        "conversation_id", (F.col("_before") + F.col("_p")).alias("position"), (F.col("_turns") + F.col("_t") + 1).alias("turn"),
        "speaker", F.col("ms").alias("created_ms"), F.col("content").alias("text"),
    )
