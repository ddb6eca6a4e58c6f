import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from mnemospark.llm import packing as P


def fewest(sizes, capacity):
    """The fewest containers, by trying."""
    best = len(sizes)

    def place(i, boxes):
        nonlocal best
        if len(boxes) >= best:
            return
        if i == len(sizes):
            best = len(boxes)
            return
        for b in range(len(boxes)):
            if boxes[b] + sizes[i] <= capacity:
                boxes[b] += sizes[i]
                place(i + 1, boxes)
                boxes[b] -= sizes[i]
        place(i + 1, [*boxes, sizes[i]])

    place(0, [])
    return best


def test_bound_never_exceeds_the_optimum():
    r = random.Random(1)
    tight = 0
    for _ in range(150):
        capacity = r.choice([10, 12, 17])
        sizes = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 9))), reverse=True)
        bound, best = P.lower_bound(np.array(sizes), capacity), fewest(sizes, capacity)
        boxes = P.best_fit_decreasing(np.array(sizes), capacity)
        used = np.bincount(boxes, weights=sizes)
        assert -(-sum(sizes) // capacity) <= bound <= best <= len(used) and used.max() <= capacity
        tight += bound == best
    assert tight > 120
    assert P.lower_bound(np.array([], dtype=int), 10) == 0 and P.lower_bound(np.array([6, 6, 6]), 10) == 3


def test_best_fit_takes_the_fullest():
    boxes = P.best_fit_decreasing(np.array([7, 6, 3, 4]), 10).tolist()
    assert boxes == [0, 1, 0, 1]


def items(spark, sizes, capacity):
    return spark.createDataFrame([(1, capacity, i, 0, s) for i, s in enumerate(sizes)], "budget_id int, capacity int, key long, piece int, size int")


def check(rows, sizes, capacity):
    assert sorted(r["key"] for r in rows) == list(range(len(sizes)))
    by = {}
    for r in rows:
        if r["size"]:
            by.setdefault(r["container"], []).append(r["size"])
        else:
            assert r["container"] is None
    assert all(sum(v) <= capacity for v in by.values())
    return len(by)


def test_every_item_lies_in_one_container(spark):
    r = random.Random(2)
    sizes = [r.choice([0, 100, r.randint(1, 100), r.randint(1, 30)]) for _ in range(600)]
    rows = P.pack(items(spark, sizes, 100), part_items=50).collect()
    n = check(rows, sizes, 100)
    assert n <= P.lower_bound(np.array(sizes), 100) * 1.05 + 1


def test_exchange_helps_where_partitions_leave_gaps(spark):
    r = random.Random(3)
    sizes = [r.randint(34, 60) for _ in range(400)]
    alone = check(P.pack(items(spark, sizes, 100), part_items=15, rounds=0).collect(), sizes, 100)
    together = check(P.pack(items(spark, sizes, 100), part_items=15).collect(), sizes, 100)
    assert together <= alone


def test_documents_and_budgets(spark):
    docs = spark.createDataFrame([(1, "word " * 30), (2, None), (3, ""), (4, "hello"), (4, "hello"), (None, "x")], "doc_id long, text string").withColumn("size", F.lit("clash"))
    budgets = spark.createDataFrame([(1, "a", "byte_bpe_50k", 8), (2, "b", "byte_bpe_50k", 100), (3, "c", None, 5), (4, "d", "byte_bpe_50k", None)], "budget_id int, label string, tokenizer string, capacity int")
    rows = P.pack(P.document_items(docs, budgets)).collect()
    one = [r for r in rows if r["budget_id"] == 1 and r["key"] == 1]
    assert sorted(r["piece"] for r in one) == list(range(len(one))) and sum(r["size"] for r in one) == 31 and sorted(r["size"] for r in one)[:1] == [31 % 8]
    assert len([r for r in rows if r["budget_id"] == 2 and r["key"] == 1]) == 1
    assert {r["budget_id"] for r in rows} == {1, 2} and len([r for r in rows if r["key"] == 4]) == 4
    report = {r["budget_id"]: r for r in P.fill_report(P.pack(P.document_items(docs, budgets))).collect()}
    assert all(r["bound"] <= r["n_containers"] for r in report.values()) and report[1]["n_tokens"] == sum(r["size"] for r in rows if r["budget_id"] == 1)
    assert P.pack(P.document_items(docs.limit(0), budgets)).count() == 0
    assert P.pack(P.document_items(docs, budgets.limit(0))).count() == 0
    assert len(list(itertools.chain(rows))) == len(rows)
