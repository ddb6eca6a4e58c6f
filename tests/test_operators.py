"""Operators against brute force and on awkward input."""

import random

from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions.times import to_millis, within_dates
from mnemospark.operators import chunks, dedupe, delivery, fusion, ingest, joins, segments, sessions, timewindows, vectors, versions

HOUR = 3_600_000


def brute_sessions(rows, gap):
    by = {}
    for k, t in rows:
        if t is not None:
            by.setdefault(k, []).append(t)
    out = []
    for k, ts in by.items():
        ts.sort()
        start = before = ts[0]
        n = 1
        for t in ts[1:]:
            if t - before > gap:
                out.append((k, start, before, n))
                start, n = t, 0
            before = t
            n += 1
        out.append((k, start, before, n))
    return sorted(out, key=str)


def test_sessions_equal_brute_force(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "hot", "hot", "hot", None]), r.choice([None, *range(0, 40 * HOUR, HOUR // 3)])) for _ in range(600)]
    df = spark.createDataFrame(rows, "k string, t long").withColumn("n", F.lit("clash"))
    got = sorted(map(tuple, sessions.merge_intervals(df, ["k"], "t").collect()), key=str)
    assert got == brute_sessions(rows, HOUR)


def test_session_gap_is_inclusive_to_the_millisecond(spark):
    df = spark.createDataFrame([("a", 0), ("a", HOUR), ("b", 0), ("b", HOUR + 1)], "k string, t long")
    got = {(r["k"], r["n"]) for r in sessions.merge_intervals(df, ["k"], "t").collect()}
    assert got == {("a", 2), ("b", 1)}
    assert sessions.merge_intervals(df.limit(0), ["k"], "t").count() == 0


def test_message_sessions_count_copies_once(spark):
    rows = [("c", "1", 0), ("c", "1", 0), ("c", "2", 5), ("c", None, 9), ("c", None, 9), ("c", "3", None)]
    df = spark.createDataFrame(rows, "conversation_id string, item_id string, ms long")
    assert [r["n_messages"] for r in sessions.message_sessions(df, F.col("ms")).collect()] == [4]


def test_times(spark):
    cases = {
        "2016-01-01T00:20:38.774Z": 1451607638774, "2015-12-31T19:20:38.774-05:00": 1451607638774, "2016-01-01 00:20:38.774": 1451607638774, "1451607638774": 1451607638774,
        "2016-01-01T08:20:38.774+0800": 1451607638774, " 2016-01-01T00:20:38Z ": 1451607638000, "2016-01-01": 1451606400000,
        "0000-00-00T00:00:00Z": None, "2016-02-30T00:00:00Z": None, "pending": None, "": None, "NaN": None, "12:30": None, "2016-01-01T25:00:00Z": None,
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "s string").select("s", to_millis("s").alias("ms"))
    assert {r["s"]: r["ms"] for r in df.collect()} == cases | {None: None}
    ok = spark.createDataFrame([("2016-02-01T10:00:00Z",), (None,)], "s string").select(within_dates(F.col("s"), F.lit("2016-02-01"), F.lit("2016-02")).alias("k")).collect()
    assert [r["k"] for r in ok] == [True, False]


def test_one_copy_of_each_message(spark):
    rows = [("c", "1", 5, "b"), ("c", "1", 3, "a"), ("c", "1", None, "z"), ("c", "2", None, "x"), ("c", None, 1, "n"), ("c", None, 1, "n"), (None, "1", 2, "m"), ("c", "4", 1, "same"), ("c", "4", 1, "same")]
    df = spark.createDataFrame(rows, "conversation_id string, item_id string, at long, n_copies string").withColumn("_m_item_id", F.lit(1))
    kept = sorted(((r["conversation_id"], r["item_id"], r["at"], r["n_copies"]) for r in delivery.one_copy(df, F.col("at")).collect()), key=str)
    assert kept == sorted([("c", "1", 3, "a"), ("c", "2", None, "x"), ("c", None, 1, "n"), ("c", None, 1, "n"), (None, "1", 2, "m"), ("c", "4", 1, "same")], key=str)
    found = {r["item_id"]: (r["n_copies"], r["first_ingested_ms"]) for r in delivery.repeated(df, F.col("at")).collect()}
    assert found == {"1": (3, 3), "4": (2, 1)}
    assert delivery.absorbed(df, df, F.col("at")).where("item_id IS NOT NULL AND conversation_id IS NOT NULL").count() == 3
    assert delivery.one_copy(df.limit(0), F.col("at")).count() == 0


def test_terms(spark):
    df = spark.createDataFrame([("我想种蚕豆，ＡBC x1 好",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.terms("t")).collect()] == [["我想", "想种", "种蚕", "蚕豆", "abc", "x1", "好"], [], []]
    q = spark.createDataFrame([("他说“先去退款”和「好」, \"yes\"",)], "t string").select(T.quoted("t")).first()[0]
    assert q == ["先去退款", "好", "yes"]


def test_before_each_equals_brute_force(spark):
    r = random.Random(2)
    rows = [("hot", i, r.randrange(0, 100 * HOUR)) for i in range(300)]
    got = joins.before_each(spark.createDataFrame(rows, "k string, i int, t long"), "k", "t", ["i"], F.col("i"), 6, 24 * HOUR).collect()
    order = sorted(rows, key=lambda x: (x[2], x[1]))
    for row in got:
        at = order.index((row["k"], row["i"], row["t"]))
        assert row["before"] == [i for _, i, t in order[max(0, at - 6) : at] if t >= row["t"] - 24 * HOUR]


def test_interval_overlap_equals_brute_force(spark):
    r = random.Random(3)
    make = lambda n: [(i, a, a + r.choice([0, 5, 300])) for i, a in ((i, r.randrange(2000)) for i in range(n))]
    left, right = make(60), make(60)
    a = spark.createDataFrame(left, "l_id int, l_lo long, l_hi long")
    b = spark.createDataFrame(right, "r_id int, r_lo long, r_hi long")
    got = sorted((x["l_id"], x["r_id"]) for x in joins.interval_overlap(a, b, 100).collect())
    assert got == sorted((i, j) for i, lo, hi in left for j, lo2, hi2 in right if hi2 >= lo and lo2 <= hi)


def test_followed_within(spark):
    a = spark.createDataFrame([("k", 0), ("k", 99), ("k", 300)], "k string, t long")
    b = spark.createDataFrame([("k", 100), ("k", 199), ("k", 300)], "k string, t long")
    assert sorted(r["t"] for r in joins.followed_within(a, b, "k", "t", 100).collect()) == [0, 99]


def test_split_long_fits_and_cuts_at_pauses(spark):
    r = random.Random(4)
    t, rows = 0, []
    for i in range(200):
        t += r.choice([1, 1, 1, 50, 7])
        rows.append(("s", t, f"{i:03d}", 100))
    parts = segments.split_long(spark.createDataFrame(rows, "session string, ms long, ord string, chars int"), most=20).collect()
    assert len(parts) == 200
    by = {}
    for p in parts:
        by.setdefault(p["part"], []).append(p["ord"])
    assert all(len(v) <= 20 for v in by.values())
    spans = sorted((min(v), max(v), len(v)) for v in by.values())
    assert all(int(b) - int(a) + 1 == n for a, b, n in spans)


def test_pack_windows_bounds(spark):
    r = random.Random(5)
    rows = [("c", r.randrange(0, 50 * HOUR), str(i), r.randrange(1, 900)) for i in range(200)]
    got = segments.pack_windows(spark.createDataFrame(rows, "conversation_id string, ms long, ord string, chars int")).collect()
    assert len(got) == 200
    by = {}
    for g in got:
        by.setdefault((g["stretch"], g["window"]), []).append(g)
    for v in by.values():
        assert len(v) <= 24 and (len(v) == 1 or sum(x["chars"] for x in v) <= 2600)
        ts = sorted(x["ms"] for x in v)
        assert all(b - a <= 3 * HOUR for a, b in zip(ts, ts[1:]))


def test_reciprocal_ranks_arithmetic(spark):
    lex = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, unit_id string, rank int")
    ent = spark.createDataFrame([(1, "b", 1)], "query_id int, unit_id string, rank int")
    got = {r["unit_id"]: r["fused"] for r in fusion.reciprocal_ranks({"lexical": lex, "entity": ent}).collect()}
    best = 1.5 / 61
    assert got == {"a": round((1 / 61) / best, 6), "b": round((1 / 62 + 0.5 / 61) / best, 6)}


def test_two_searches(spark):
    a = spark.createDataFrame([(1, "x", 2.0), (1, "y", 1.0)], "query_id int, unit_id string, score double")
    b = spark.createDataFrame([(1, "x", 1.0), (1, "z", 1.0)], "query_id int, unit_id string, score double")
    assert {r["unit_id"]: r["score"] for r in fusion.two_searches(a, b).collect()} == {"x": 2.3, "y": 1.0, "z": 0.85}


def test_greedy_fold(spark):
    rows = [(1, "a", 3.0, None, ["p", "q", "r", "s", "t"], ["z"]), (1, "b", 2.0, None, ["p", "q", "r", "s", "t"], []), (1, "z", 1.0, None, ["k"], []), (1, "c", 0.5, "L", ["m"], []), (1, "d", 0.4, "L", ["n"], [])]
    df = spark.createDataFrame(rows, "query_id int, unit_id string, score double, lineage string, terms array<string>, sources array<string>")
    none = {c: F.lit(None).cast(t) for c, t in (("conversation_id", "string"), ("turn_id", "string"), ("ord", "long"), ("ms", "long"))}
    df = df.withColumns(none).withColumn("channel", F.when(F.col("unit_id") == "z", "message").otherwise("memory"))
    assert {r["unit_id"]: r["folded_into"] for r in dedupe.greedy(df).collect()} == {"a": None, "b": "a", "z": "a", "c": None, "d": "c"}


def test_cosine_equals_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(6)
    v = r.normal(size=(200, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None), (998, [0.0] * 8)], "key int, v array<double>")
    asked = rows.where("key % 50 = 0").withColumnRenamed("key", "query_id")
    got = {(x["query_id"], x["key"]): x["rank"] for x in vectors.top_by_cosine(rows, asked, k=5, floor=0.2).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 200, 50):
        s = np.round(u @ u[q], 6)
        best = sorted((i for i in range(200) if s[i] >= 0.2), key=lambda i: (-s[i], i))[:5]
        assert [i for i, _ in sorted(((k, n) for (a, k), n in got.items() if a == q), key=lambda x: x[1])] == best


def test_chunks_tile_any_text():
    r = random.Random(7)
    for _ in range(300):
        text = "".join(r.choice(["好的。", "word ", "End. ", "\n\n", "\n", "长" * r.randrange(1, 400), "!", "?"]) for _ in range(r.randrange(0, 40)))
        ends = chunks.chunk_ends(text)
        assert ends == sorted(set(ends)) and (not text or ends[-1] == len(text))
        assert all(b - a <= 2 * chunks.CHUNK for a, b in zip([0, *ends], ends))


def test_versions(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), ("b", None, "n"), ("b", 1, "m")], "k string, version int, s string")
    assert {(r["k"], r["s"]) for r in versions.latest(log, ["k"], "version").collect()} == {("a", "y"), ("b", "m")}
    ev = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y")], "k string, t int, s string")
    assert sorted((r["s"], r["valid_from"], r["valid_to"]) for r in versions.intervals(ev, "k", "t", "s").collect()) == [("x", 1, 3), ("y", 3, None)]


def test_ingest(spark):
    df = spark.createDataFrame([("i", "a", 1), ("i", "b", 2), ("i", "a", 3), ("j", None, 1)], "id string, content string, o int")
    got = {r["id"]: (r["added"], r["existing"], r["conflicts"]) for r in ingest.classified(df, "id", "content", F.col("o")).collect()}
    assert got == {"i": (1, 1, 1), "j": (1, 0, 0)}
    again = {r["id"]: (r["added"], r["existing"], r["conflicts"]) for r in ingest.classified(df, "id", "content", F.col("o"), df.where("o = 1")).collect()}
    assert again == {"i": (0, 2, 1), "j": (0, 1, 0)}
    safe = spark.createDataFrame([("ok-1",), ("../x",), ("a/b",), (None,)], "s string").select(ingest.safe_name("s")).collect()
    assert [r[0] for r in safe] == [True, False, False, False]


def test_named_windows(spark):
    cases = [
        ("2016年3月5日去的", "2016-03-05", "2016-03-05"), ("2016年2月", "2016-02-01", "2016-02-29"), ("2月30日", None, None), ("12月24日那次", "2015-12-24", "2015-12-24"),
        ("昨天说的", "2016-03-15", "2016-03-15"), ("前天", "2016-03-14", "2016-03-14"), ("上周", "2016-03-07", "2016-03-13"), ("这周", "2016-03-14", "2016-03-16"),
        ("上个月", "2016-02-01", "2016-02-29"), ("上个月中旬", "2016-02-11", "2016-02-20"), ("三个月前", "2015-12-01", "2015-12-31"), ("去年", "2015-01-01", "2015-12-31"),
        ("5天前", "2016-03-06", "2016-03-15"), ("最近", "2016-03-06", "2016-03-16"), ("没有时间", None, None), (None, None, None),
    ]
    df = spark.createDataFrame([(c[0], i) for i, c in enumerate(cases)], "t string, i int").select("i", timewindows.time_window(F.col("t"), F.lit("2016-03-16").cast("date")).alias("w"))
    got = {r["i"]: (str(r["w"]["start"]), str(r["w"]["end"])) if r["w"] else (None, None) for r in df.collect()}
    assert [got[i] for i in range(len(cases))] == [(a, b) for _, a, b in cases]
