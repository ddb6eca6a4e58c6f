"""Joins on times, arrays and sets, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def unmentioned(rows: DataFrame, key: str, lists: DataFrame, ids: str) -> DataFrame:
    """Rows whose key occurs in none of the lists."""
    seen = lists.select(F.explode(ids).alias("_id")).distinct()
    return rows.join(seen, rows[key] == seen["_id"], "left_anti")


def overlapping(lists: DataFrame, ids: str, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``lists`` with at least one of their ids among ``wanted``; each row once."""
    marked = lists.withColumn("_row", F.monotonically_increasing_id())
    hit = marked.select("_row", F.explode(ids).alias("_id")).join(wanted.select(F.col(key).alias("_id")), "_id", "left_semi").select("_row").distinct()
    return marked.join(hit, "_row", "left_semi").drop("_row")


def share_inside(lists: DataFrame, row: str, ids: str, wanted: DataFrame, key: str) -> DataFrame:
    """``row, n_ids, n_inside, whole``: how many of a row's ids are among ``wanted``."""
    e = lists.select(row, F.explode(F.array_distinct(ids)).alias("_id"))
    w = wanted.select(F.col(key).alias("_w")).distinct()
    j = e.join(w, e["_id"] == w["_w"], "left")
    return j.groupBy(row).agg(F.count(F.lit(1)).alias("n_ids"), F.count("_w").alias("n_inside")).withColumn("whole", F.col("n_ids") == F.col("n_inside"))


def best_overlap(lists: DataFrame, row: str, ids: str, least: float = 0.6) -> DataFrame:
    """``row, other, share``: for each list the one that holds the largest share of its ids,
    when that is at least ``least``; ties by the smaller other.

    Lists with the same ids are one class, so copies make no pairs. A class is compared with
    those that share one of its rarest ids: to hold ``least`` of n ids, another must have one
    of the n - ceil(least * n) + 1 rarest, so a very common id is asked for only by lists
    that have hardly any other. Pairs are counted and not kept.
    """
    own = lists.select(F.col(row).alias("r"), F.array_sort(F.array_distinct(ids)).alias("ids")).where(F.size("ids") > 0)
    # of a class the two smallest rows suffice to name the smallest other of each
    classes = own.groupBy("ids").agg(F.min("r").alias("r0"), F.count_distinct("r").alias("members")).withColumn("a", F.xxhash64("ids", F.lit("class")))
    e = classes.select("a", F.size("ids").alias("n"), F.explode("ids").alias("_id"))
    freq = e.groupBy("_id").agg(F.count(F.lit(1)).alias("df"))
    rare = Window.partitionBy("a").orderBy("df", "_id")
    asked = e.join(freq, "_id").withColumn("k", F.row_number().over(rare)).where(F.col("k") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1)
    pairs = asked.select("a", "_id").join(e.select(F.col("a").alias("b"), "_id"), "_id").where("a <> b").select("a", "b").distinct()
    common = pairs.join(e.select("a", "n", "_id"), "a").join(e.select(F.col("a").alias("b"), "_id"), ["b", "_id"]).groupBy("a", "b", "n").agg(F.count(F.lit(1)).alias("c"))
    share = common.withColumn("share", F.col("c") / F.col("n")).where(F.col("share") >= least)
    named = share.join(classes.select(F.col("a").alias("b"), F.col("r0").alias("other")), "b").select("a", "other", "share")
    best = named.groupBy("a").agg(F.min_by(F.struct("other", "share"), F.struct(-F.col("share"), F.col("other"))).alias("m"))
    members = own.join(classes, "ids").join(best, "a", "left")
    # the other copies of a list hold all of it: for all but the first the first one, for the first the next
    twins = own.join(classes.where("members > 1"), "ids").where("r <> r0").groupBy("a").agg(F.min("r").alias("r1"))
    members = members.join(twins, "a", "left")
    twin = F.when(F.col("members") > 1, F.struct(F.when(F.col("r") == F.col("r0"), F.col("r1")).otherwise(F.col("r0")).alias("other"), F.lit(1.0).alias("share")))
    first = F.when(F.col("m").isNull() | ((F.col("m.share") <= 1.0) & twin.isNotNull() & ((F.col("m.share") < 1.0) | (twin["other"] < F.col("m.other")))), twin).otherwise(F.col("m"))
    return members.select(F.col("r").alias(row), first.alias("f")).where("f IS NOT NULL").select(row, "f.other", F.round("f.share", 4).alias("share"))


def interval_overlap(left: DataFrame, right: DataFrame, bucket_ms: int) -> DataFrame:
    """Pairs of intervals that meet: ``left`` (``l_id, l_lo, l_hi``) and ``right`` (``r_id,
    r_lo, r_hi``), all in milliseconds, ends included.

    Intervals are laid into the buckets of time they touch and pairs arise per bucket; a
    pair is taken in the first bucket both touch, so once. A bucket of about the usual
    length of an interval keeps both the copies and the false pairs few.
    """
    lay = lambda d, lo, hi: d.where(F.col(lo) <= F.col(hi)).withColumn("bucket", F.explode(F.sequence(F.floor(F.col(lo) / bucket_ms), F.floor(F.col(hi) / bucket_ms))))
    a, b = lay(left, "l_lo", "l_hi"), lay(right, "r_lo", "r_hi")
    first = F.floor(F.greatest("l_lo", "r_lo") / bucket_ms)
    return a.join(b, "bucket").where((F.col("r_hi") >= F.col("l_lo")) & (F.col("r_lo") <= F.col("l_hi")) & (F.col("bucket") == first)).drop("bucket")


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k right intervals of each left one whose middle is nearest; ties by id."""
    away = F.abs((F.col("l_lo") + F.col("l_hi")) - (F.col("r_lo") + F.col("r_hi")))
    by = Window.partitionBy("l_id").orderBy(away, "r_id")
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def before_each(messages: DataFrame, group: str, ms: str, order: list[str], value: Column, k: int, reach_ms: int) -> DataFrame:
    """Adds ``before``: the last k values before a message in its group, not older than
    ``reach_ms``, in order.

    The group is cut into buckets of the length of the reach and every message also stands,
    as context, in the bucket after its own. What a message may look back on is then in its
    bucket, and a group of any size is as many windows as it has buckets.
    """
    own = messages.withColumn("_v", value).withColumn("_b", F.floor(F.col(ms) / reach_ms)).withColumn("_ctx", F.lit(False))
    both = own.unionByName(own.withColumn("_b", F.col("_b") + 1).withColumn("_ctx", F.lit(True)))
    by = Window.partitionBy(group, "_b").orderBy(ms, *order).rowsBetween(-k, -1)
    last = F.collect_list(F.struct(F.col(ms).alias("t"), F.col("_v").alias("v"))).over(by)
    seen = both.withColumn("_l", last).where("NOT _ctx")
    kept = F.transform(F.filter("_l", lambda x: x["t"] >= F.col(ms) - reach_ms), lambda x: x["v"])
    return seen.withColumn("before", kept).drop("_l", "_v", "_b", "_ctx")


def followed_within(left: DataFrame, right: DataFrame, key: str, ms: str, reach_ms: int) -> DataFrame:
    """Left rows with a right row of the same key later by at most ``reach_ms``.

    A hot key is split by time: a right row can only follow from its own bucket or the one
    before it."""
    a = left.withColumn("_b", F.floor(F.col(ms) / reach_ms))
    at = right.select(F.col(key).alias("_k"), F.col(ms).alias("_t"))
    b = at.withColumn("_rb", F.explode(F.array(F.floor(F.col("_t") / reach_ms), F.floor(F.col("_t") / reach_ms) - 1)))
    on = (a[key] == b["_k"]) & (a["_b"] == b["_rb"]) & (b["_t"] > a[ms]) & (b["_t"] <= a[ms] + reach_ms)
    return a.join(b, on, "left_semi").drop("_b")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, bucket: int = 7 * 24 * HOUR_MS, or_first: bool = False) -> DataFrame:
    """Adds to each left row the value of the last right row of its keys at or before it.

    A key's rows are cut into buckets of time, so a hot key is as many windows as it has
    buckets; the last value of earlier buckets is carried into each by a window over buckets.
    Rows of one time: right ones count as before left ones. With ``or_first`` a left row
    before every right one gets the first. ``at`` is a number (milliseconds) or a timestamp;
    a null time or key finds nothing.
    """
    cols = left.columns
    number = lambda c: F.unix_millis(F.col(c).cast("timestamp")) if left.schema[at].dataType.simpleString().startswith("timestamp") else F.col(c)
    cut = F.floor(number(at) / bucket)
    a = left.select(*cols, cut.alias("_b"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(*[F.col(c) if c in (*keys, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols], cut.alias("_b"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    both = a.unionByName(b)
    names = [f"_k{i}" for i in range(len(keys))]
    last = both.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_b").alias("_c")).agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col(at))).alias("_l"))
    over = Window.partitionBy(*names).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*names, "_c", F.last("_l", ignorenulls=True).over(over).alias("_carry"))
    by = Window.partitionBy(*keys, "_b").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_in", F.last("_v", ignorenulls=True).over(by)).where("_side = 1")
    found = seen.join(carried, [*[F.col(k) == F.col(n) for k, n in zip(keys, names)], F.col("_b") == F.col("_c")], "left")
    result = F.when(F.col(at).isNotNull(), F.coalesce("_in", "_carry"))
    if or_first:
        first = right.where(F.col(at).isNotNull()).groupBy(*[F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)]).agg(F.min_by(value, at).alias("_first"))
        found = found.join(first, [F.col(k) == F.col(f"_f{i}") for i, k in enumerate(keys)], "left")
        result = F.coalesce(result, F.col("_first"))
    return found.select(*cols, result.alias(value))


def both_directions(edges: DataFrame, k: int) -> DataFrame:
    """``node, direction, other, rank``: up to k neighbours of each node by either side of
    its active edges, earliest first. The limit per node applies before the shuffle too, so
    a node with a third of the edges is cut down where they are read."""
    active = edges.where("status = 'active'")
    out = active.select(F.col("src_id").alias("node"), F.lit("out").alias("direction"), F.col("dst_id").alias("other"), "created_at")
    into = active.select(F.col("dst_id").alias("node"), F.lit("in").alias("direction"), F.col("src_id").alias("other"), "created_at")
    by = Window.partitionBy("node", "direction").orderBy("created_at", "other")
    return out.unionByName(into).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
