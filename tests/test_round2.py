"""Operators without an SQL form, against brute force, golden values and shuffled input."""

import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark import session as session_module
from mnemospark.functions import text as T
from mnemospark.functions.times import to_millis
from mnemospark.operators import dedupe, delivery, joins, recall, segments, sessions, timewindows, vectors
from mnemospark.plans import catalog
from mnemospark.sources import files as sources
from mnemospark.streaming import sessions as state

from .conftest import DATA

HOUR = 3_600_000
MINUTE = 60_000

# Golden values: what is asked on 2 October 2026, and the days meant.
WINDOWS = {
    "5月底那次": ("2026-05-21", "2026-05-31"), "九月中旬聊了什么": ("2026-09-11", "2026-09-20"), "8月初": ("2026-08-01", "2026-08-10"), "6月份我们去哪了": ("2026-06-01", "2026-06-30"),
    "2026年5月下旬": ("2026-05-21", "2026-05-31"), "12月": ("2025-12-01", "2025-12-31"), "10月初": ("2026-10-01", "2026-10-02"), "上个月初": ("2026-09-01", "2026-09-10"), "上个月": ("2026-09-01", "2026-09-30"),
    "月底的时候": ("2026-09-21", "2026-09-30"), "三个月前": ("2026-07-01", "2026-07-31"), "两个月前": ("2026-08-01", "2026-08-31"), "9月28日去哪了": ("2026-09-28", "2026-09-28"), "昨天": ("2026-10-01", "2026-10-01"),
    "上午什么时候喝过啦": ("2026-10-02", "2026-10-02"), "刚才说的那个": ("2026-10-02", "2026-10-02"), "今早吃了什么": ("2026-10-02", "2026-10-02"), "今天好累": ("2026-10-02", "2026-10-02"),
    "上周": ("2026-09-21", "2026-09-27"), "上上周": ("2026-09-14", "2026-09-20"), "这周": ("2026-09-28", "2026-10-02"), "去年": ("2025-01-01", "2025-12-31"), "今年": ("2026-01-01", "2026-10-02"), "三天前": ("2026-09-22", "2026-10-01"),
    "最近": ("2026-09-22", "2026-10-02"), "2月30日": None, "月亮好圆": None, "我们聊聊香菜": None, "那天下午": None, "周三早上": None, "上次早上你说": None, "": None, None: None,
}


def test_time_windows(spark):
    df = spark.createDataFrame([(k,) for k in WINDOWS], "t string")
    got = {r["t"]: r["w"] for r in df.select("t", timewindows.time_window(F.col("t"), F.lit("2026-10-02").cast("date")).alias("w")).collect()}
    assert {k: (str(w["start"]), str(w["end"])) if w else None for k, w in got.items()} == WINDOWS
    left = {"5月底的冰淇淋": "冰淇淋", "三个月前的香菜": "香菜"}
    df = spark.createDataFrame([(k,) for k in left], "t string")
    assert {r[0]: r[1] for r in df.select("t", timewindows.residual(F.col("t"))).collect()} == left


def test_terms_and_stop_terms(spark):
    stop = dict.fromkeys("今天 觉得 喜欢 一个 user ai 我的 了吗 a 7".split(), True) | dict.fromkeys("灯塔 初雪 拿铁 iphone 16 猫".split(), False)
    df = spark.createDataFrame([(k,) for k in stop], "t string")
    assert {r[0]: r[1] for r in df.select("t", T.is_stop(F.col("t"))).collect()} == stop
    seams = {"今天觉得": {"今天", "天觉", "觉得"}, "今天天气": {"今天", "天天"}, "不喜欢香菜": {"不喜", "喜欢", "欢香"}, "灯塔": set()}
    df = spark.createDataFrame([(k,) for k in seams], "t string")
    assert {r[0]: set(r[1]) for r in df.select("t", T.seam_terms("t")).collect()} == seams
    words = {"雨声 心跳": ["雨声", "心跳"], "灯塔": ["灯塔"], "今天 觉得": [], "我想听听灯塔守望者的故事": []}
    df = spark.createDataFrame([(k,) for k in words], "t string")
    assert {r[0]: r[1] for r in df.select("t", T.keywords("t")).collect()} == words


def cut_brute(rows, most, chars):
    """Recursive cutting of one session's (ms, ord, chars) rows."""
    if len(rows) == 1 or (len(rows) <= most and sum(r[2] for r in rows) <= chars):
        return [rows]
    n = len(rows)
    lo = max(n // 5, 1)
    at = max(range(lo, max(n - n // 5, lo + 1)), key=lambda i: (rows[i][0] - rows[i - 1][0], -i))
    return cut_brute(rows[:at], most, chars) + cut_brute(rows[at:], most, chars)


@pytest.mark.parametrize(("part_rows", "rounds"), [(10**6, None), (40, None), (40, 1), (40, 0)])
def test_split_long_keeps_every_row(spark, part_rows, rounds):
    r = random.Random(3)
    rows = []
    for s in range(4):
        t = 0
        for i in range(200 if s == 0 else 30):
            t += r.choice([1, 5, 5, 60, 700]) * MINUTE
            rows.append((f"s{s}", t, f"{i:04d}", r.randrange(0, 900)))
    got = segments.split_long(spark.createDataFrame(rows, "session string, ms long, ord string, chars long"), 20, 6000, part_rows, rounds).collect()
    assert Counter((x["session"], x["ms"], x["ord"], x["chars"]) for x in got) == Counter(rows)
    by = defaultdict(list)
    for x in got:
        by[x["session"], x["part"]].append((x["ms"], x["ord"], x["chars"]))
    want = {(s, tuple(p)) for s in {x[0] for x in rows} for p in cut_brute(sorted((a[1], a[2], a[3]) for a in rows if a[0] == s), 20, 6000)}
    assert {(s, tuple(sorted(p))) for (s, _), p in by.items()} == want


def test_sessions_do_not_depend_on_the_order_of_files(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.choice(["hot"] * 5 + ["a", "b", None]), f"i{r.randrange(300)}" if r.random() < 0.97 else None, r.choice([str(1451606400000 + r.randrange(0, 90) * 20 * MINUTE), str(1451606400000 + r.randrange(10**9)), None, "soon"])) for _ in range(500)]
    m = spark.createDataFrame(rows, "conversation_id string, item_id string, created_at string").withColumn("at", F.lit("clash"))
    want = sorted(map(str, sessions.message_sessions(m, to_millis("created_at")).select("conversation_id", "start_ms", "end_ms", "n_messages", "duration_ms").collect()))
    shuffled = m.repartition(7, F.xxhash64("item_id", "created_at"))
    got = state.message_sessions(shuffled, to_millis("created_at"), files_per_batch=1)
    assert sorted(map(str, got.select("conversation_id", "start_ms", "end_ms", "n_messages", "duration_ms").collect())) == want
    assert state.message_sessions(m.limit(0), to_millis("created_at")).count() == 0


def test_delivery_splits_and_ranks(spark, monkeypatch):
    monkeypatch.setattr(delivery, "SHARE", 3)
    r = random.Random(5)
    rows = [(r.choice(["c", "d"]), r.choice(["hot"] * 6 + [f"i{k}" for k in range(60)]), r.choice(["5", "7", None, ""]), r.choice("xyz"), None) for _ in range(300)] + [(None, "hot", "1", "n", None), ("c", None, "1", "n", None), ("c", None, "1", "n", None)]
    df = spark.createDataFrame(rows, "conversation_id string, item_id string, ingested_at string, _m string, _m_n string")
    got = delivery.one_copy(df, F.col("ingested_at").try_cast("long")).collect()
    by = defaultdict(list)
    for x in rows:
        if x[0] is not None and x[1] is not None:
            by[x[:2]].append(x)
    at = lambda x: (not x[2], int(x[2] or 0), (x[2] is not None, x[2] or ""), x[3])
    want = [min(v, key=at) for v in by.values()] + [x for x in rows if x[0] is None or x[1] is None]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    rep = {tuple(x)[:2]: tuple(x)[2:] for x in delivery.repeated(df, F.col("ingested_at").try_cast("long")).collect()}
    assert rep == {k: (min((int(x[2]) for x in v if x[2]), default=None), len(v)) for k, v in by.items() if len(v) > 1}


def test_as_of_by_buckets(spark):
    r = random.Random(6)
    left = [(r.choice(["a", "b", "z"]), r.choice([r.randrange(1000), None]), i) for i in range(120)]
    right = list({(k, t): (k, t, f"v{k}{t}") for k, t in ((r.choice("ab"), r.randrange(1000)) for _ in range(60))}.values())
    a, b = spark.createDataFrame(left, "k string, t long, n int"), spark.createDataFrame(right, "k string, t long, v string")
    for first in (False, True):
        want = {}
        for k, t, n in left:
            before = [x for x in right if x[0] == k and t is not None and x[1] <= t]
            mine = [x for x in right if x[0] == k]
            want[n] = max(before, key=lambda x: x[1])[2] if before else min(mine, key=lambda x: x[1])[2] if first and mine else None
        got = {x["n"]: x["v"] for x in joins.as_of(a, b, ["k"], "t", "v", bucket=70, or_first=first).collect()}
        assert got == want


def test_best_overlap_equals_all_pairs(spark):
    r = random.Random(7)
    rows = [(f"e{i:02d}", [f"s{r.choice([0, 0, 0, r.randrange(12)])}" for _ in range(r.randrange(0, 5))]) for i in range(60)]
    got = {x["k"]: (x["other"], x["share"]) for x in joins.best_overlap(spark.createDataFrame(rows, "k string, ids array<string>"), "k", "ids").collect()}
    want = {}
    for k, ids in rows:
        shares = [(-len(set(ids) & set(o)) / len(set(ids)), j) for j, o in rows if j != k and ids]
        if shares and -min(shares)[0] >= 0.6:
            want[k] = (min(shares)[1], round(-min(shares)[0], 4))
    assert got == want


def test_folding_of_messages_and_memories(spark):
    schema = "query_id int, unit_id string, score double, channel string, lineage string, terms array<string>, sources array<string>, conversation_id string, turn_id string, ord long, ms long"
    words = lambda s: list(s)
    rows = [
        (1, "m1", 0.9, "message", None, words("abcde"), ["m1"], "c", None, 1, 0),
        (1, "m2", 0.8, "message", None, words("fghij"), ["m2"], "c", None, 2, 60_000),  # next to m1, within ten minutes
        (1, "m3", 0.7, "message", None, words("klmno"), ["m3"], "c", "t", 9, 0),
        (1, "e1", 0.6, "memory", "l", words("pqrst"), ["m3"], None, None, None, None),  # stands for m3 and takes its place
        (1, "e2", 0.5, "memory", "l", words("uvwxy"), ["m4"], None, None, None, None),  # of the lineage of e1
        (1, "m4", 0.4, "message", None, words("12345"), ["m4"], "d", None, 1, 0),  # a source of e2, which e1 took over
        (1, "e3", 0.3, "memory", "k", words("pqrst"), [], None, None, None, None),  # the terms of e1
        (2, "m1", 0.9, "message", None, None, None, None, None, None, None),
    ]
    got = {(r["query_id"], r["unit_id"]): (r["kept"], r["folded_into"], r["why"], r["place"]) for r in dedupe.greedy(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        (1, "m1"): (True, None, None, 1), (1, "m2"): (False, "m1", "same turn", None), (1, "m3"): (False, "e1", "source of", None), (1, "e1"): (True, None, None, 2), (1, "e2"): (False, "e1", "lineage", None),
        (1, "m4"): (False, "e1", "source of", None), (1, "e3"): (False, "e1", "near copy", None), (2, "m1"): (True, None, None, 1),
    }
    kept = {r["unit_id"] for r in dedupe.greedy(spark.createDataFrame(rows, schema), evidence=True).where("query_id = 1 AND kept").collect()}
    assert kept == {"m1", "m3", "e1", "m4"}


def test_engine_trace(spark):
    """Every candidate has one stage, places count from 1, and no more than asked come out."""
    rows = catalog.QUERIES["hybrid_retrieval"](spark, DATA).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["query_id"]].append(r["rank"])
    assert rows and all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 12 for v in by.values()) and all(r["reason"] for r in rows)


def test_index_finds_nearly_all(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.col("embedding").alias("v"))
    q = e.where("key % 50 = 0").select(F.col("key").alias("query_id"), F.col("v"))
    exact = {(r["query_id"], r["key"]) for r in vectors.top_by_cosine(e, q, 50, 0.1).collect()}
    found = vectors.top_by_index(e, q, 50, 0.1)
    assert len({(r["query_id"], r["key"]) for r in found.collect()} & exact) / len(exact) >= 0.9
    whole = {(r["query_id"], r["key"], r["rank"]) for r in vectors.top_by_index(e, q, 50, 0.1, probes=32).collect()}
    assert whole == {(r["query_id"], r["key"], r["rank"]) for r in vectors.top_by_cosine(e, q, 50, 0.1).collect()}
    mean = {r["query_id"]: r["mean"] for r in vectors.with_mean(found, e, q).collect()}
    assert mean == {r["query_id"]: r["mean"] for r in vectors.top_by_cosine(e, q, 50, 0.1).collect()}


def test_hashed_embedding_is_a_function_of_the_text():
    texts = ["Kiln", "kiln", "", None, "好的", "the gate was fixed", "the gate is fixed", "tram"]
    m = vectors.hashed_matrix(texts)
    assert np.allclose(m[0], m[1]) and not m[2].any() and not m[3].any()
    assert np.allclose(np.linalg.norm(m[4:], axis=1), 1) and m[5] @ m[6] > 0.6 > abs(m[5] @ m[7])
    assert all(np.allclose(vectors.hashed_matrix([t])[0], x) for t, x in zip(texts, m))


def test_json_lines_tell_torn_ones(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "content": "x"}\n\n{"id": "2", "cont\n{"id": "3", "extra": 5}\nplain\n')
    rows, bad = sources.json_lines(spark, str(tmp_path), sources.MESSAGE)
    assert sorted((r["id"], r["content"]) for r in rows.collect()) == [("1", "x"), ("3", None)] and bad.count() == 2
    whole = tmp_path / "docs"
    whole.mkdir()
    (whole / "a.json").write_text(json.dumps({"id": "1", "content": "x"}, indent=1))
    (whole / "b.json").write_text('{"id": ')
    rows, bad = sources.json_lines(spark, str(whole), sources.MESSAGE, multi_line=True)
    assert [r["id"] for r in rows.collect()] == ["1"] and bad.count() == 1
    sources.append_json(spark.createDataFrame([("s", "1"), ("t", "2")], "source string, id string"), str(tmp_path / "log"), ("source",))
    sources.append_json(spark.createDataFrame([("s", "3")], "source string, id string"), str(tmp_path / "log"), ("source",))
    assert sorted(r["id"] for r in spark.read.schema("id string, source string").json(str(tmp_path / "log")).collect()) == ["1", "2", "3"]
    grown = sources.evolved(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, 3)], "a int, b int"))
    assert sorted(map(str, map(tuple, grown.collect()))) == ["(1, None)", "(2, 3)"]


def test_front_matter(spark):
    rows = [("---\na: 1\nb: x: y\na: 2\n---\nbody\n",), ("no head",), ("---\n---\nz",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(sources.front_matter(F.col("t"))).collect()]
    assert (got[0]["head"], got[0]["body"]) == ({"a": "2", "b": "x: y"}, "body\n") and (got[1]["head"], got[1]["body"]) == ({}, "no head") and got[2]["body"] == "z" and got[3]["body"] is None


def test_evaluation(spark):
    q = spark.createDataFrame([("q1", "a", [["Kiln", "oven"], ["gate"]], []), ("q2", "a", [["x"]], ["no"]), ("q3", "b", [["zzz"]], [])], "question_id string, category string, expect array<array<string>>, must_not array<string>")
    h = spark.createDataFrame([("q1", "the kiln"), ("q1", "a gate"), ("q2", "x"), ("q2", "NO way")], "question_id string, text string")
    got = {r["question_id"]: (r["passed"], r["n_hits"]) for r in recall.evaluated(q, h).collect()}
    assert got == {"q1": (True, 2), "q2": (False, 2), "q3": (False, 0)}


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Elsewhere:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Elsewhere
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(ValueError, match="checkpoint"):
        session_module.shared_dir(Session)


@pytest.mark.parametrize("name", ["two_searches", "greedy_folding", "split_sessions", "packed_windows", "discovery_windows", "named_windows", "context_lines", "last_view_before_purchase"])
def test_queries_without_sql_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_packed_windows_equal_a_loop(spark):
    got = defaultdict(list)
    for r in catalog.QUERIES["packed_windows"](spark, DATA).collect():
        got[r["conversation_id"]].append((r["start_ms"], r["n"], r["chars"]))
    from mnemospark.plans import memory

    by = defaultdict(list)
    for r in memory._messages(spark, DATA).collect():
        by[r["conversation_id"]].append((r["ms"], r["item_id"], r["chars"]))
    want = {}
    for c, ms in by.items():
        out, last = [], None
        for t, _, n in sorted(ms):
            if not out or t - last > 3 * HOUR or out[-1][1] >= 24 or out[-1][2] + n > 2600:
                out.append([t, 0, 0])
            out[-1][1] += 1
            out[-1][2] += n
            last = t
        want[c] = sorted(map(tuple, out))
    assert {c: sorted(v) for c, v in got.items()} == want
