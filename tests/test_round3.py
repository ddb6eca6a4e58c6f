"""Work that must not grow with its own square, and rankings that must stay whole without pairs."""

import math
import random

import pytest

from mnemospark.functions import text as T
from mnemospark.operators import entities, vectors


def test_keywords_make_the_pieces_of_a_text_once(spark):
    """Not once again for each piece: a text of n pieces took n times n normal forms."""
    many = " ".join(f"Word{i}" for i in range(3000))
    df = spark.createDataFrame([(many,), ("ABCDEFG",), ("Abc",), ("的 Abc",), ("",), (None,)], "text string").select(T.keywords("text").alias("k"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    got = [r.k for r in df.collect()]
    assert got == [[f"word{i}" for i in range(3000)], [], ["abc"], ["abc"], [], None]


def cast(n=400, asked=30):
    r = random.Random(3)
    names = ["river ann", "the coach", "old smith", "ba", "外婆", "室友", "coach tan"]
    said = lambda k: " ".join(r.choices([*names, "walks", "home", "again"], k=k))
    units = [(f"u{r.randrange(10**6):06d}-{i}", said(1), said(r.randint(1, 6)), r.sample(names, r.randint(0, 2)), "archived" if i % 11 == 0 else "confirmed") for i in range(n)]
    queries = [(i, said(r.randint(1, 8))) for i in range(asked)] + [(asked, "nothing, here"), (asked + 1, "coach"), (asked + 2, "coach")]
    return units, queries


def by_hand(units, queries, depth):
    here = [u for u in units if u[4] == "confirmed"]
    df = {e: sum(e in u[3] for u in here) for u in here for e in u[3]}
    weight = {e: math.log(1 + len(here) / (1 + k)) * (0.2 if k / len(here) > 0.3 else 1) for e, k in df.items()}
    out = {}
    for q, text in queries:
        words = text.replace(",", " ").split()
        asks = {e for e in df if e in text or any(len(w) >= 2 and w in e for w in words if len(words) > 1 or len(w) <= 6)}
        found = []
        for u in here:
            body = f"{u[1]}\n{u[2]}"
            hit = {e: 1.0 if e in u[3] else 0.6 for e in asks if e in u[3] or e in body}
            if hit:
                found.append((-round(sum(weight[e] * f for e, f in sorted(hit.items())), 4), u[0]))
        out |= {(q, u): (-s, i + 1) for i, (s, u) in enumerate(sorted(found)[:depth])}
    return out


@pytest.mark.parametrize("few, block, part", [(256, 2_000, 60_000), (0, 3, 7)])
def test_entity_ranking_compares_sets_and_ways_once(spark, monkeypatch, few, block, part):
    """Whole rankings, though a query and a unit that have an entity in common are no row: only
    the distinct sets asked for and the distinct ways to hold entities meet."""
    for name, value in (("FEW", few), ("BLOCK", block), ("PART", part)):
        monkeypatch.setattr(entities, name, value)
    met, meet = [], entities._best_sets
    monkeypatch.setattr(entities, "_best_sets", lambda asked, held, *more: met.append((asked.count(), held.count())) or meet(asked, held, *more))
    units, queries = cast()
    u = spark.createDataFrame(units, "unit_id string, title string, body string, entities array<string>, status string")
    q = spark.createDataFrame(queries, "query_id long, text string")
    got = {(r.query_id, r.unit_id): (r.score, r["rank"]) for r in entities.scores(q, u, 20).collect()}
    want = by_hand(units, queries, 20)
    assert got.keys() == want.keys()
    for k, (score, rank) in want.items():
        assert got[k] == (pytest.approx(score, abs=1e-6), rank)
    ((sets, ways),) = met
    assert sets < len({q for q, _ in want}) and ways < len(units)


def test_stored_vectors_are_packed_and_lose_nothing(spark):
    """The engine writes and shuffles a vector per message: not 2 kB each, and the same ranking."""
    r = random.Random(5)
    texts = [("".join(r.choices("abcdefghij 外婆室友", k=r.randint(0, 40))), i) for i in range(300)] + [("ab" * 200_000, 300), (None, 301), ("", 302)]
    t = spark.createDataFrame(texts, "text string, key long")
    p = vectors.Provider()
    packed, whole = (t.select("key", c.alias("v")).persist() for c in (p.stored(t["text"]), p.embed(t["text"])))
    sizes = {x.key: len(x.v) for x in packed.collect()}
    assert all(n == vectors.DIMENSIONS for k, n in sizes.items() if k != 300) and sizes[300] == 4 * vectors.DIMENSIONS
    asked = whole.where("key < 40").withColumnRenamed("key", "query_id")
    found = [{(x.query_id, x.key): (x.sim, x["rank"]) for x in vectors.top_by_index(rows, asked, k=10, floor=0.0, lists=4, probes=4).collect()} for rows in (packed, whole)]
    assert found[0] == found[1] and len(found[0]) >= 390
    assert vectors.with_mean(t.select("key").limit(0).selectExpr("0L AS query_id"), packed, asked).count() == 0
