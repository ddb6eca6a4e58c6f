"""Filling containers of fixed capacity with documents, certified by lower bounds.

Items are spread over partitions of bounded size and packed there by best-fit decreasing. A
dual-feasible function maps sizes so that whatever fits one container keeps a total of at
most one; the mapped total is therefore a lower bound on the containers any packing needs.
A partition that meets its bound is certified optimal and done. Partitions with a gap give
the documents of their unfilled containers into a common pool, which is spread anew, into
other company, and packed again; a round counts only if it needs fewer containers, and rounds
go on as long as one does.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.tokens import TOKENIZERS, token_counts
from mnemospark.session import shared_dir

#: Items of one partition, which is what one task packs.
PART_ITEMS = 20_000

_PACKED = "budget_id int, capacity int, key long, piece int, size int, round int, part long, bin int, bins int, bound int"


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best bound of two families of dual-feasible functions.

    The first, for every l up to half the capacity: sizes above capacity - l count as
    whole, those below l as nothing, others as they are. The second, for k up to 30: a size
    counts as floor((k + 1) x / capacity) / k, or as it is where that is without remainder.
    """
    sizes = sizes[sizes > 0]
    if not len(sizes):
        return 0
    counts = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    return bound_of_counts(counts, capacity)


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    size = np.arange(capacity + 1, dtype=np.int64)
    number = np.concatenate([[0], np.cumsum(counts)])
    weight = np.concatenate([[0], np.cumsum(counts * size)])
    small = np.arange(0, capacity // 2 + 1)
    whole = (number[capacity + 1] - number[capacity - small + 1]) * capacity
    middle = weight[capacity - small + 1] - weight[small]
    best = int(-(-(whole + middle).max() // capacity))
    there = np.flatnonzero(counts)
    for k in range(1, 31):
        steps = there * (k + 1)
        exact = steps % capacity == 0
        # in units of 1 / (k * capacity)
        value = np.where(exact, there * k, (steps // capacity) * capacity)
        best = max(best, int(-(-int((value * counts[there]).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item: the fullest one it still fits in, larger items first.

    Containers are kept by their free space, and the set bits of one integer say which
    free spaces exist, so the best fit is its lowest set bit from the size on.
    """
    out = np.zeros(len(sizes), dtype=np.int32)
    open_by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            held = open_by_space[space]
            box = held.pop()
            if not held:
                spaces &= ~(1 << space)
        else:
            space, box = capacity, made
            made += 1
        out[i] = box
        left = space - size
        if left:
            open_by_space[left].append(box)
            spaces |= 1 << left
    return out


def items_of(sizes: DataFrame, budgets: list[tuple[int, int]]) -> DataFrame:
    """``budget_id, capacity, key, piece, size``: a row for each document and budget.

    Only a document larger than the capacity is split, into pieces of just the capacity and
    a rest. ``sizes`` has ``key, n_tokens``; ``budgets`` are (budget_id, capacity).
    """
    each = F.array(*[F.struct(F.lit(i).alias("budget_id"), F.lit(c).alias("capacity")) for i, c in budgets])
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity")) - 1, F.lit(0)).cast("int"))
    return (
        sizes.select("key", "n_tokens", F.explode(each).alias("b"))
        .select("key", "n_tokens", "b.budget_id", "b.capacity")
        .select("budget_id", "capacity", "key", "n_tokens", F.explode(pieces).alias("piece"))
        .select("budget_id", "capacity", "key", "piece", F.least(F.col("capacity"), F.col("n_tokens") - F.col("piece") * F.col("capacity")).cast("int").alias("size"))
    )


def _packer(number: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key", "piece"], ascending=[False, True, True], kind="stable")
        capacity = int(pdf["capacity"].iloc[0])
        sizes = pdf["size"].to_numpy()
        boxes = best_fit_decreasing(sizes, capacity)
        return pdf[["budget_id", "capacity", "key", "piece", "size"]].assign(
            round=number, part=pdf["part"].iloc[0], bin=boxes, bins=int(boxes.max()) + 1, bound=lower_bound(sizes, capacity)
        )

    return pack


def _pack_round(items: DataFrame, number: int, part_items: int) -> DataFrame:
    """Spreads the items of each budget evenly by hash and packs every part by itself."""
    counts = items.groupBy("budget_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(part_items)).alias("parts"))
    spread = items.join(counts, "budget_id").withColumn("part", F.pmod(F.xxhash64("key", "piece", F.lit(number)), F.col("parts"))).drop("parts")
    return spread.groupBy("budget_id", "part").applyInPandas(_packer(number), _PACKED)


def pack(items: DataFrame, part_items: int = PART_ITEMS, rounds: int | None = None) -> DataFrame:
    """``budget_id, capacity, key, piece, size, container, certified`` with every item in one
    container.

    ``certified`` says that the part the container belongs to needs no container more than
    its lower bound, so no packing of it is better. Rounds end when every part of a budget is
    certified or a round saves no container (``rounds`` bounds them in tests).

    Items of size 0 take no space and lie in no container (null). Pieces that fill a
    container by themselves pass without packing. Every round is written to the shared
    folder and read again, so lost executors cost no more than the running round. Repeated
    rows are items of their own; an empty table gives an empty result.
    """
    spark: SparkSession = items.sparkSession
    folder = shared_dir(spark)

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    items = keep(items, "items")
    loose = items.where("size > 0 AND size < capacity")
    done = []
    state = keep(_pack_round(loose, 0, part_items), "round0")
    for number in itertools.count(1) if rounds is None else range(1, rounds + 1):
        fill = state.groupBy("budget_id", "part", "bin").agg(F.sum("size").alias("filled"))
        marked = state.join(fill, ["budget_id", "part", "bin"])
        open_ = (F.col("bins") > F.col("bound")) & (F.col("filled") < F.col("capacity"))
        boxes = state.select("budget_id", "part", "bins", "bound").distinct().groupBy("budget_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bins") - F.col("bound")).alias("gap"))
        if not boxes.where("gap > 0 AND n > 1").take(1):
            break
        settled = keep(marked.where(~open_).drop("filled"), f"settled{number}")
        pool = marked.where(open_)
        again = keep(_pack_round(pool.select("budget_id", "capacity", "key", "piece", "size"), number, part_items), f"round{number}")
        before = pool.select("budget_id", "part", "bin").distinct().groupBy("budget_id").agg(F.count(F.lit(1)).alias("before"))
        after = again.select("budget_id", "part", "bins").distinct().groupBy("budget_id").agg(F.sum("bins").alias("after"))
        better = keep(before.join(after, "budget_id").select("budget_id", (F.col("after") < F.col("before")).alias("better")), f"better{number}")
        done.append(settled)
        done.append(pool.drop("filled").join(better.where("NOT better"), "budget_id", "left_semi"))
        state = again.join(better.where("better"), "budget_id", "left_semi")
    for other in done:
        state = state.unionByName(other)
    name = F.concat_ws("-", F.col("round"), F.col("part"), F.col("bin"))
    packed = state.select("budget_id", "capacity", "key", "piece", "size", name.alias("container"), (F.col("bins") <= F.col("bound")).alias("certified"))
    full = items.where("size = capacity").select("budget_id", "capacity", "key", "piece", "size", F.concat_ws("-", F.lit("full"), F.col("key"), F.col("piece")).alias("container"), F.lit(True).alias("certified"))
    nothing = items.where("size = 0").select("budget_id", "capacity", "key", "piece", "size", F.lit(None).cast("string").alias("container"), F.lit(None).cast("boolean").alias("certified"))
    return packed.unionByName(full).unionByName(nothing)


def document_items(documents: DataFrame, budgets: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """Items of all documents for all budgets, sizes in tokens of the budget's tokenizer.

    The budgets are read to the driver: their table is a setting of a few rows and does not
    grow. Those without a tokenizer or a positive capacity hold nothing, and a document
    without a doc_id cannot be named and has no item.
    """
    by: dict[str, list[tuple[int, int]]] = {}
    for r in budgets.where("capacity > 0 AND tokenizer IS NOT NULL AND budget_id IS NOT NULL").select("budget_id", "tokenizer", "capacity").distinct().orderBy("budget_id").collect():
        by.setdefault(r["tokenizer"], []).append((int(r["budget_id"]), int(r["capacity"])))
    items = None
    for t in sorted(by):
        sizes = token_counts(documents.where(F.col("doc_id").isNotNull()), tokenizer=t, folder=folder).select(F.col("doc_id").cast("long").alias("key"), "n_tokens")
        one = items_of(sizes, by[t])
        items = one if items is None else items.unionByName(one)
    if items is None:
        items = items_of(documents.select(F.col("doc_id").cast("long").alias("key"), F.lit(0).alias("n_tokens")), [(0, 1)]).where(F.lit(False))
    return items


def fill_report(packed: DataFrame) -> DataFrame:
    """Per budget: items, tokens, containers, the bound over all items and the share filled.

    The bound is taken over the counts of each size, at most one row per unit of capacity.
    """
    counts = packed.where("size > 0").groupBy("budget_id", "capacity", "size").agg(F.count(F.lit(1)).alias("n"))

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        held = np.zeros(capacity + 1, dtype=np.int64)
        held[pdf["size"].to_numpy()] = pdf["n"].to_numpy()
        return pd.DataFrame({"budget_id": [pdf["budget_id"].iloc[0]], "bound": [bound_of_counts(held, capacity)]})

    bounds = counts.groupBy("budget_id").applyInPandas(bound, "budget_id int, bound long")
    boxes = packed.groupBy("budget_id", "capacity", "container").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("filled"), F.max("certified").alias("certified"))
    total = boxes.groupBy("budget_id", "capacity").agg(F.count_if("certified").alias("n_certified"), F.sum("n").alias("n_items"), F.sum("filled").alias("n_tokens"), F.count("container").alias("n_containers"))
    return total.join(bounds, "budget_id", "left").select(
        "budget_id", "capacity", "n_items", "n_tokens", "n_containers", "n_certified", F.coalesce("bound", F.lit(0)).alias("bound"),
        F.round(F.try_divide(F.col("n_tokens"), F.col("n_containers") * F.col("capacity")), 6).alias("filled"),
    )
