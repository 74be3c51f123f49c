"""Sequential assignment problems: bin packing, balanced partitions, dynamic batches.

Their scope is one training batch: here the documents of a block of 512 ids, a
uid being eight ids. Each batch is solved by itself in Python, so any number of
batches are solved at once and none is larger than its block.
"""

from __future__ import annotations

import heapq
import itertools

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.registry import query
from weftline.sources.tables import table


def best_fit(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each sequence: longest first, each into the fullest bin that it fits. Longer ones count as ``capacity``."""
    bins: list[int] = []
    places = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = min(lengths[i], capacity)
        fits = [(bins[b], -b) for b in range(len(bins)) if bins[b] + n <= capacity]
        b = -max(fits)[1] if fits else len(bins)
        if not fits:
            bins.append(0)
        bins[b] += n
        places[i] = b
    return places


def balanced(costs: list[int], k: int, equal: bool = False) -> list[int]:
    """The part of each item by largest differencing: the two most uneven partial partitions are merged, heaviest against lightest.

    ``equal``: every part gets the same number of items, which ``k`` must
    divide; the first partial partitions are then ``k`` items of similar cost.
    """
    if equal and len(costs) % k:
        raise ValueError(f"{len(costs)} items don't make {k} equal parts")
    order = sorted(range(len(costs)), key=lambda i: (costs[i], i))
    size = k if equal else 1
    states = []
    for at in range(0, len(order), size):
        parts = [(0, ())] * (k - size) + [(costs[i], (i,)) for i in order[at : at + size]]
        states.append((parts[0][0] - parts[-1][0], at, parts))
    heapq.heapify(states)
    tick = len(costs)
    while len(states) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(states), heapq.heappop(states)
        merged = sorted((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True))
        heapq.heappush(states, (merged[0][0] - merged[-1][0], tick, merged))
        tick += 1
    out = [0] * len(costs)
    if states:
        for part, (_, items) in enumerate(states[0][2]):
            for i in items:
                out[i] = part
    return out


def workload(n: int) -> int:
    """The cost of a sequence of ``n`` tokens: linear and quadratic parts of a transformer's layers."""
    return 24576 * n + n * n


def checked(costs: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """The items of each part in order; every part has one."""
    if len(costs) < k:
        raise ValueError(f"{len(costs)} items for {k} parts")
    parts: list[list[int]] = [[] for _ in range(k)]
    for i, p in enumerate(balanced(costs, k, equal)):
        parts[p].append(i)
    for p in parts:  # zero costs may leave a part empty
        if not p:
            largest = max(parts, key=len)
            p.append(largest.pop())
    return [sorted(p) for p in parts]


def places(parts: list[list[int]], n: int) -> list[int]:
    """The part of each of ``n`` items."""
    out = [0] * n
    for p, items in enumerate(parts):
        for i in items:
            out[i] = p
    return out


def group_balanced(costs: list[int], uids: list, k: int) -> list[int]:
    """The part of each item, where a run of items with one uid stays together and every part gets as many runs."""
    runs = [list(items) for _, items in itertools.groupby(range(len(uids)), key=lambda i: uids[i])]
    groups = checked([sum(workload(costs[i]) for i in items) for items in runs], k, equal=True)
    return places([[i for g in part for i in runs[g]] for part in groups], len(costs))


def small_at_both_ends(parts: list[list[int]], costs: list[int]) -> list[list[int]]:
    """Parts in an order that begins and ends with light ones, so that warming up and cooling down wait little."""
    heavy_first = sorted(parts, key=lambda p: (sum(costs[i] for i in p), p[0]), reverse=True)
    return heavy_first[::2][::-1] + heavy_first[1::2]


def rank_order(lengths: list[int], ranks: int) -> list[int]:
    """The new place of each item: equal parts of like workload follow one another, each with its light items at both ends."""
    costs = [workload(n) for n in lengths]
    order = []
    for part in checked(costs, ranks, equal=True):
        by_cost = sorted(part, key=lambda i: (costs[i], i))
        order += by_cost[::2] + by_cost[1::2][::-1]
    return places([[i] for i in order], len(lengths))


def least_loaded(costs: list[int], k: int) -> list[int]:
    """Each item in order to the part with the least so far."""
    heap = [(0, p) for p in range(k)]
    out = []
    for c in costs:
        load, p = heapq.heappop(heap)
        out.append(p)
        heapq.heappush(heap, (load + c, p))
    return out


def dynamic_batches(lengths: list[int], cap: int, multiple: int = 1, least: int = 1) -> list[int]:
    """Batches of at most ``cap`` tokens, light ones first and last.

    As many as the total asks for, at least ``least`` and a multiple of
    ``multiple``, balanced by workload; while one is over the cap there are
    more. A sequence longer than the cap is an error.
    """
    if not lengths:
        return []
    if max(lengths) > cap:
        raise ValueError(f"a sequence of {max(lengths)} tokens is over the cap of {cap}")
    costs = [workload(n) for n in lengths]
    k = max(least, -(-sum(lengths) // cap))
    while True:
        k = min(-(-k // multiple) * multiple, len(lengths))
        parts = checked(costs, k)
        if k == len(lengths) or all(sum(lengths[i] for i in p) <= cap for p in parts):
            return places(small_at_both_ends(parts, costs), len(lengths))
        k += 1


def assign(docs: DataFrame, solve, column: str) -> DataFrame:
    """``solve(lengths, uids)`` for the documents of each block of 512 ids, which bounds the rows of a task. Lengths are cut to 32,768."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("doc_id")
        return pd.DataFrame({"doc_id": part["doc_id"], "block": part["block"], column: solve(part["n_chars"].tolist(), (part["doc_id"] // 8).tolist())})

    blocks = docs.select("doc_id", F.least("n_chars", F.lit(32768)).alias("n_chars"), F.floor(F.col("doc_id") / 512).alias("block"))
    return blocks.groupBy("block").applyInPandas(one, f"doc_id bigint, block bigint, {column} int")


def divisor(n: int, most: int = 8) -> int:
    return max(d for d in range(1, most + 1) if n % d == 0)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("bin_packing")
def bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(_docs(spark, sf_dir), lambda x, _: best_fit(x, 8192), "bin")


@query("balanced_partition")
def balanced_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(_docs(spark, sf_dir), lambda x, _: balanced(x, 8), "part")


@query("least_loaded_partition")
def least_loaded_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(_docs(spark, sf_dir), lambda x, _: least_loaded(x, 8), "part")


@query("dynamic_token_batches")
def dynamic_token_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(_docs(spark, sf_dir), lambda x, _: dynamic_batches(x, 32768), "batch")


@query("balanced_equal_parts")
def balanced_equal_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(_docs(spark, sf_dir), lambda x, _: places(checked(x, divisor(len(x)), equal=True), len(x)), "part")


@query("group_balanced_partition")
def group_balanced_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(_docs(spark, sf_dir), lambda x, uids: group_balanced(x, uids, divisor(len(set(uids)))), "part")


@query("rank_balanced_order")
def rank_balanced_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(_docs(spark, sf_dir), lambda x, _: rank_order(x, divisor(len(x))), "place")


def end_padding(rows: DataFrame, order: str, n: int, last: bool = False) -> DataFrame:
    """``rows`` and ``n`` copies of the first row by ``order``, or of the last; ``copy`` numbers them from 1, rows of their own have 0."""
    end = rows.orderBy(F.desc(order) if last else F.asc(order)).limit(1)
    return rows.withColumn("copy", F.lit(0)).unionByName(end.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n)))))


@query(
    "end_row_padding",
    "SELECT event_id, event_type, 0 AS copy FROM events UNION ALL SELECT event_id, event_type, CAST(c AS INTEGER) FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 1), range(1, 8) t(c)",
)
def end_row_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return end_padding(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 7, last=True)
