"""Searches whose parts give packed pools, and foldings without texts."""

import pytest

from mnemospark.operators import lexical, search
from mnemospark.plans import retrieval
from tests.test_search import brute, made


@pytest.mark.parametrize("enough", [1, 4])
def test_queries_with_more_in_a_part_are_asked_again(spark, monkeypatch, enough):
    """Parts that give far too few at first take nothing from a pool."""
    monkeypatch.setattr(search, "PART", 90)
    monkeypatch.setattr(search, "_enough", lambda size, parts: enough)
    units, queries, u, q = made(spark)
    got = {(r.query_id, r.unit_id): (r.rank, r.score) for r in lexical.bm25_pool(*lexical.searched(q, u), 25).collect()}
    want = brute(units, queries, 25)
    assert {k: r for k, (r, _) in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(v[0], abs=2e-6) for k, v in want.items())


def test_a_part_gives_one_row_per_query_and_few_units(spark):
    """What is shuffled is a row per query and part, with a share of the pool and not all of it."""
    *_, u, q = made(spark)
    plan = lexical.bm25_pool(*lexical.searched(q, u), 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "hits" in plan
    assert search._enough(200, 8) < 70 and search._enough(200, 1) == 200 and search._enough(20, 12) <= 20


def test_folding_shuffles_numbers_and_no_texts(spark, monkeypatch):
    """What comes to the fold are terms as numbers, each once, and it folds as strings do."""
    seen = []
    fold = retrieval.dedupe.greedy
    monkeypatch.setattr(retrieval.dedupe, "greedy", lambda hits: seen.append(hits) or fold(hits))
    got = retrieval.greedy_folding(spark, "/root/testdata/sf0.001").collect()
    assert dict(seen[0].dtypes)["terms"] == "array<bigint>"
    units = retrieval._units(spark, "/root/testdata/sf0.001").select("unit_id", retrieval.T.terms("body").alias("terms"), "sources")
    assert sorted(fold(seen[0].drop("terms", "sources").join(units, "unit_id")).collect(), key=str) == sorted(got, key=str)


def test_rank_fusion_joins_no_postings(spark, monkeypatch):
    """Its lexical ranking searches by parts: no pairs that share a term are rows."""

    def none(units):
        raise AssertionError("postings are joined")

    monkeypatch.setattr(lexical, "postings", none)
    assert retrieval.rank_fusion(spark, "/root/testdata/sf0.001").count()


def test_two_searches_ask_again_for_both(spark, monkeypatch):
    """A query is told apart from its double by a number beside it, also where it is asked again."""
    want = sorted(retrieval.two_searches(spark, "/root/testdata/sf0.001").collect())
    monkeypatch.setattr(search, "_enough", lambda size, parts: 2)
    assert sorted(retrieval.two_searches(spark, "/root/testdata/sf0.001").collect()) == want
