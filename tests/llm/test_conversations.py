import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mnemospark.llm import conversations as C
from mnemospark.streaming.runs import run_available

SPEAKERS = [("user", "user"), ("Human ", "user"), ("assistant", "assistant"), ("tool", "none"), (None, "user")]
SCHEMA = "conversation_id string, item_id string, role string, content string, created_at string, ingested_at string, speaker string, ms int"


def brute(rows):
    """Defects and kept conversations of messages in order of arrival."""
    known = {a.strip().lower(): s for a, s in SPEAKERS if a is not None}
    first, n = {}, 0
    for r in rows:
        n += 1
        first.setdefault((r[0], r[1] if r[1] is not None else ("none", n)), (n, *r))
    by = defaultdict(list)
    for (c, _), (at, _, _, role, content, created, *_) in first.items():
        s = known.get(role.strip().lower()) if role is not None else None
        ms = int(created) if created is not None and created.isdigit() else None
        by[c].append((ms, at, s, bool(content and content.strip(" ​　\n")), content))
    found, kept = set(), {}
    for c, ms in by.items():
        if not any(s in ("user", "assistant") and v for _, _, s, v, _ in ms):
            found.add((c, "empty"))
            continue
        turns, order = [], []
        for t, at, s, v, text in sorted((m for m in ms if m[0] is not None and m[2] in ("user", "assistant")), key=lambda m: m[:2]):
            if turns and turns[-1][0] == s:
                turns[-1][1] |= v
            else:
                turns.append([s, v])
            order.append((len(turns), s, text))
        if any(m[0] is None or m[2] is None for m in ms) or (turns and turns[0][0] == "assistant"):
            found.add((c, "broken"))
        if any(s == "user" and v and not (i + 1 < len(turns) and turns[i + 1][1]) for i, (s, v) in enumerate(turns)):
            found.add((c, "unanswered"))
        if c not in {x for x, _ in found}:
            kept[c] = order
    return found, kept


@pytest.fixture
def speakers(spark):
    return spark.createDataFrame(SPEAKERS, "alias string, speaker string")


def messages(seed, n=400):
    r = random.Random(seed)
    hour = 3_600_000
    rows = []
    for i in range(n):
        c = r.choice(["hot"] * 4 + ["a", "b", "c", "d", "e", None])
        good = c in ("hot", "a")
        role = r.choice(["user", "assistant"]) if good else r.choice(["user", "Human", " ASSISTANT", "tool", "who?", None])
        created = str(1451606400000 + r.randrange(0, 40) * hour + i) if good or r.random() < 0.95 else r.choice([None, "", "soon"])
        content = r.choice(["hi", "x", "", " ​", None]) if not good else "hi"
        rows.append((c, r.choice([f"{i}", f"{i}", f"{max(i - 3, 0)}", None]), role, content, created, None, "clash", 1))
    # a conversation that is whole: user and assistant by turns over many slices
    rows += [("whole", f"w{i}", ["user", "assistant"][i % 2], f"t{i}", str(1451606400000 + i * 2 * hour), None, "clash", 1) for i in range(30)]
    rows += [("silent", "1", "user", "　", "1451606400000", None, "clash", 1), ("tools", "1", "tool", "log", "1451606400000", None, "clash", 1)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_defects_and_rebuilt_equal_brute_force(spark, files, speakers, seed):
    rows = messages(seed)
    o = files(rows, SCHEMA)
    found, kept = brute(rows)
    assert {tuple(x) for x in C.defects(spark, o, speakers).collect()} == found
    got = defaultdict(list)
    for r in C.rebuilt(spark, o, speakers).orderBy("conversation_id", "position").collect():
        got[r["conversation_id"]].append((r["turn"], r["speaker"], r["text"]))
        assert r["position"] == len(got[r["conversation_id"]])
    assert dict(got) == kept and "whole" in kept


def test_empty_table(spark, files, speakers):
    o = files([("c", "1", "user", "x", "1451606400000", None, "", 1)], SCHEMA).where("false")
    assert C.defects(spark, files([], SCHEMA, "none"), speakers).count() == 0
    assert o.count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_many_batches_and_shuffled_files_change_nothing(spark, files, speakers, tmp_path, seed):
    """One file per micro-batch, in any order: no message is lost and no verdict changes."""
    rows = messages(seed, 300)
    found, kept = brute(rows)
    o = files(rows, SCHEMA)
    path = C.prepared(spark, o, speakers, str(tmp_path / "p"))
    stored = spark.read.parquet(path)
    # files in an order that has nothing to do with time
    for i in range(6):
        stored.where(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(6)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "shuffled"))
    got = C.judged(spark, str(tmp_path / "shuffled"), files_per_batch=1).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {(r["conversation_id"], x) for r in got for x in r["defects"]} == found


def test_crowded_slices_are_cut(spark, files, speakers, monkeypatch):
    rows = messages(5, 300)
    monkeypatch.setattr(C.placed, "__defaults__", (3,))
    o = files(rows, SCHEMA)
    assert C.placed(C.spoken(C.first_delivered(o), speakers)).where("part IS NOT NULL").count() > 0
    assert {tuple(x) for x in C.defects(spark, o, speakers).collect()} == brute(rows)[0]


def test_a_conversation_closes_on_timeout(spark, tmp_path):
    """Two batches of an endless stream: what comes late but within the delay is still taken
    in, and a conversation is emitted when nothing came for the timeout."""
    schema = "conversation_id string, ms long, row struct<file:string,row:long>, s string, v boolean, part long, at timestamp"

    def add(name, rows):
        spark.createDataFrame([(c, ms, ("f", i), s, v) for i, (c, ms, s, v) in enumerate(rows)], "conversation_id string, ms long, row struct<file:string,row:long>, s string, v boolean").withColumns(
            {"part": F.lit(None).cast("long"), "at": F.timestamp_millis("ms")}
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    hour = 3_600_000
    add("1", [("c", 0, "user", True), ("c", 3 * hour, "user", True), ("d", 0, "user", True)])
    add("2", [("c", hour, "assistant", True), ("c", 4 * hour, "assistant", True)])
    add("3", [("z", 90 * hour, "user", True)])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = run_available(C.conversations(stream, "6 hours", "24 hours")).collect()
    assert {(r["conversation_id"], tuple(r["defects"])) for r in out} == {("c", ()), ("d", ("unanswered",))}
