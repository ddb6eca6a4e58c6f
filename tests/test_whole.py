"""Queries that do the whole job, by brute force."""

import math
from collections import Counter

from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.functions.times import to_millis
from mnemospark.operators import sessions
from mnemospark.plans import catalog, memory

from .conftest import DATA

HOUR = 3_600_000


def test_time_neighbours_of_all_conversations(spark, duck):
    from mnemospark.sources.tables import table

    found = sessions.message_sessions(table(spark, DATA, "originals"), to_millis("created_at")).collect()
    spans = memory._latest(spark, DATA).select("episode_id", to_millis("time_start").alias("lo"), to_millis("time_end").alias("hi")).where("lo <= hi").collect()
    want = set()
    for s in found:
        a, b = s["start_ms"], s["end_ms"]
        near = sorted((abs(a + b - e["lo"] - e["hi"]), e["episode_id"]) for e in spans if e["hi"] >= a - 3 * HOUR and e["lo"] <= b + 3 * HOUR)
        want |= {(s["conversation_id"], a, e, k + 1) for k, (_, e) in enumerate(near[:6])}
    query = catalog.QUERIES["time_neighbours"](spark, DATA)
    assert "WindowGroupLimit" in query._jdf.queryExecution().executedPlan().toString()  # six per session and task before the shuffle
    got = {tuple(r) for r in query.select("conversation_id", "start_ms", "episode_id", "rank").collect()}
    assert got == want and any(c == "main-thread" for c, *_ in got)


def test_two_searches_read_the_whole_text(spark, files, tmp_path):
    words = "kiln glaze oven bread river stone lantern copper meadow harbour violin pepper".split()
    rows = [(i, " ".join(words[(i * k) % 12] for k in range(1, 4 + i % 5))) for i in range(1, 50)]
    # the last words stand behind character 80; one query is short
    rows += [(0, "kiln " * 20 + "violin pepper"), (50, "river stone")]
    docs = files([(i, t) for i, t in rows], "doc_id long, text string").withColumn("effective_at", F.lit("2016-01-01").cast("timestamp"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["query_id"], r["unit_id"]): r["score"] for r in catalog.QUERIES["two_searches"](spark, str(tmp_path)).collect()}

    texts = {r["doc_id"]: r for r in docs.select("doc_id", "text", T.terms("text").alias("terms")).collect()}
    tf = {i: Counter(r["terms"]) for i, r in texts.items()}
    df = Counter(t for c in tf.values() for t in c)
    n, mean = len(tf), sum(len(r["terms"]) for r in texts.values()) / len(tf)

    def search(text):
        asked = set(text.split())
        scores = {}
        for i, c in tf.items():
            if asked & set(c):
                idf = {t: max(math.log((n - df[t] + 0.5) / (df[t] + 0.5)), 0) or 1e-6 for t in asked & set(c)}
                scores[i] = round(sum(w * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(texts[i]["terms"]) / mean)) for t, w in idf.items()), 6)
        return dict(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:20])

    want = {}
    for q in (0, 50):
        a, b = search(texts[q]["text"][:40]), search(texts[q]["text"])
        for i in a.keys() | b.keys():
            want[q, i] = 1.15 * max(a[i], b[i]) if i in a and i in b else a[i] if i in a else 0.85 * b[i]
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)
