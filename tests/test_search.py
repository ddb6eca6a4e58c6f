"""Searches of many queries: whole results from many small parts, and no pairs that share a term."""

import math
import random

import pytest

from mnemospark.operators import lexical, search
from mnemospark.plans import retrieval


def made(spark, n=700, asked=40):
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    some = lambda k: " ".join(r.choices(words, [1 / (i + 1) for i in range(60)], k=k))
    units = [("memory", f"u{i:04d}", some(2), some(r.randint(1, 30)), [some(1)] * (i % 3), [some(1)] * (i % 2), "confirmed") for i in range(n)]
    units += [("memory", f"v{i:04d}", *u[2:]) for i, u in enumerate(units[:200])]  # the same texts again: ties
    queries = [(i, some(r.randint(1, 30))) for i in range(asked)] + [(asked, ""), (asked + 1, "nowhere")]
    u = spark.createDataFrame(units, "channel string, unit_id string, title string, body string, entities array<string>, tags array<string>, status string")
    return units, queries, u, spark.createDataFrame(queries, "query_id long, text string")


def brute(units, queries, size):
    n = len(units)
    fields = [dict(zip(search.FIELDS, (u[2].split(), u[3].split(), u[4], u[5]))) for u in units]
    tokens = [sum(map(len, f.values())) for f in fields]
    mean, out = sum(tokens) / n, {}
    df = lambda t, c: sum(t in f[c] if c else any(t in x for x in f.values()) for f in fields)
    idf = lambda t, c: max(math.log((n - df(t, c) + 0.5) / (df(t, c) + 0.5)), 1e-6)
    known = {(t, c): (idf(t, c), df(t, c)) for t in {t for _, q in queries for t in q.split()} for c in (None, *search.FIELDS)}
    for q, text in queries:
        terms = set(text.split())
        found = []
        for u, f, size_ in zip(units, fields, tokens):
            norm = 1.2 * (0.25 + 0.75 * size_ / mean)
            here = [t for t in terms if any(t in x for x in f.values())]
            if here:
                part = lambda t, c, k, norm=norm: known[t, c][0] * k * 2.2 / (k + norm)
                score = sum(part(t, None, sum(w * f[c].count(t) for c, w in search.FIELDS.items())) for t in here)
                raw = sum(w * round(sum(part(t, c, f[c].count(t)) for t in here if t in f[c]), 4) for c, w in search.FIELDS.items())
                weight = {t: round(1 - 0.5 * known[t, None][1] / n, 4) for t in terms if known[t, None][1] / n <= 0.3}
                kept = [t for t in here if t in weight]
                found.append((-round(score, 6), u[1], raw, round(sum(weight[t] for t in kept) / sum(weight.values()), 4) if weight else 0.0, len(kept)))
        for rank, (score, unit, raw, cover, many) in enumerate(sorted(found)[:size]):
            out[q, unit] = (-score, rank + 1, raw, cover, many)
    return out


@pytest.mark.parametrize("part, block, step", [(60_000, 30_000, 8192), (90, 11, 16)])
def test_pool_and_coverage_equal_brute_force(spark, monkeypatch, part, block, step):
    """However units and queries are cut, each pool is whole, in order, with ties by unit."""
    for name, value in (("PART", part), ("BLOCK", block), ("STEP", step), ("PLACES", 500)):
        monkeypatch.setattr(search, name, value)
    units, queries, u, q = made(spark)
    s = lexical.searched(q, u)
    best = lexical.bm25_pool(*s, 25).persist()
    got = {(r.query_id, r.unit_id): r for r in best.join(lexical.coverage(*s, best), ["query_id", "channel", "unit_id"]).collect()}
    want = brute(units, queries, 25)
    assert set(got) == set(want)
    for k, (score, rank, raw, cover, many) in want.items():
        assert (got[k].rank, got[k].n_matched) == (rank, many)
        assert got[k].score == pytest.approx(score, abs=2e-6) and got[k].raw == pytest.approx(raw, abs=1e-3) and got[k].coverage == pytest.approx(cover, abs=2e-4)


def no_pairs(df):
    """Queries and postings are not joined, so what is shuffled is no pair that shares a term."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan


def test_bm25_documents_makes_no_pairs(spark):
    no_pairs(retrieval.bm25_documents(spark, "/root/testdata/sf0.001"))


@pytest.mark.parametrize("name", ["lexical_ranking", "bm25_episodes", "greedy_folding", "pool_then_filter", "two_searches"])
def test_searches_join_no_postings(spark, monkeypatch, name):
    """A search needs no table of postings to be joined with queries."""

    def none(units):
        raise AssertionError("postings are joined")

    monkeypatch.setattr(lexical, "postings", none)
    assert retrieval.QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_search_without_units(spark):
    *_, u, q = made(spark, 10, 3)
    s = lexical.searched(q, u.limit(0))
    best = lexical.bm25_pool(*s, 5)
    assert best.count() == 0 and lexical.coverage(*s, best).count() == 0
