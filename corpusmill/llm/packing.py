"""Filling fixed-capacity containers with items (problem 9).

The method: vector best fit. A container has three capacities: tokens, documents, and attention cost (the
sum of squared lengths, in units of the square of the token capacity). The last is less than what one item as long as a
container costs, so that containers with one long item take less beside it than they have room for; an item that
costs more alone has a container of its own. An item goes into the open container in
which, under all three, the weighted dot product of what it needs and what is left is largest relative to
what is left, so that the tightest fitting container wins; only if none can take it a new one is opened.

Items are taken in order of falling size (best fit decreasing) within blocks of a bounded number of items.
Blocks are drawn by a hash of the item's key, so that each block sees the whole range of sizes; each leaves
at most a few containers that aren't full.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.frames import groups

#: Items of a block, and the most tasks that blocks are spread over.
BLOCK_ITEMS, MAX_TASKS = 8_192, 10_000
MAX_ITEMS, MAX_COST = 256, 0.75
WEIGHTS = (1.0, 0.05, 0.05)


def best_fit(sizes: np.ndarray, capacity: int, max_items: int, max_cost: float) -> np.ndarray:
    """The container of each item, sizes in falling order and none above ``capacity``."""
    placed = np.empty(len(sizes), dtype=np.int64)
    left = np.empty((0, 3))
    ids = np.empty(0, dtype=np.int64)
    used = 0
    full = np.array([capacity, max_items, max_cost], dtype=float)
    weights = np.array(WEIGHTS) / full**2
    smallest = sizes[-1] if len(sizes) else 0
    for i, size in enumerate(sizes):
        need = np.array([size, 1.0, (size / capacity) ** 2])
        fits = np.flatnonzero((left >= need - 1e-9).all(axis=1))
        if len(fits):
            room = left[fits]
            # need · room / |room|²: 1 where an item fills the container to the brim
            score = (room * need) @ weights / np.maximum((room * room) @ weights, 1e-12)
            at = fits[np.argmax(score)]
        else:
            left = np.vstack([left, full])
            ids = np.append(ids, used)
            used += 1
            at = len(left) - 1
        left[at] -= need
        placed[i] = ids[at]
        if left[at, 0] < max(smallest, 1) or left[at, 1] < 1 or left[at, 2] < (smallest / capacity) ** 2 - 1e-9:
            left = np.delete(left, at, axis=0)
            ids = np.delete(ids, at)
    return placed


def pack(
    items: DataFrame, key: str, size: str, capacity: int, max_items: int = MAX_ITEMS, max_cost: float = MAX_COST, block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """Items to containers: ``key``, piece, size, container (a string).

    An item is never split unless it exceeds ``capacity`` alone: it then gives full containers of its own
    (pieces 0, 1, ...), and its last piece is packed like any other. Items of size 0 or null take no space
    and come out with piece 0, size 0 and container ''. Repeated keys are separate items. No container
    has more than ``capacity``, ``max_items`` items or ``max_cost``, unless it has one item alone.
    """
    sized = items.select(F.col(key), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("int").alias("size"))
    whole = F.floor(F.col("size") / capacity).cast("int")
    pieces = sized.where("size > 0").select(
        key,
        F.explode(
            F.concat(
                F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda i: F.struct(i.alias("piece"), F.lit(capacity).alias("size")))).otherwise(
                    F.array().cast("array<struct<piece:int,size:int>>")
                ),
                F.when(F.col("size") % capacity > 0, F.array(F.struct(whole.alias("piece"), (F.col("size") % capacity).alias("size")))).otherwise(
                    F.array().cast("array<struct<piece:int,size:int>>")
                ),
            )
        ).alias("p"),
    ).select(key, "p.piece", "p.size")
    blocks = max(1, -(-sized.count() // block_items))
    # Keys go through pandas as strings, as whole numbers beside a null would become floats there.
    salted = pieces.select(F.pmod(F.xxhash64(key, "piece"), F.lit(blocks)).alias("block"), F.col(key).cast("string").alias(key), "piece", "size")

    n_tasks = min(blocks, MAX_TASKS)

    def fill(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block, rows in groups(batches, "block"):
            rows = rows.sort_values(["size", key, "piece"], ascending=[False, True, True])
            at = best_fit(rows["size"].to_numpy(), capacity, max_items, max_cost)
            yield pd.DataFrame({key: rows[key], "piece": rows["piece"], "size": rows["size"], "container": [f"{block}-{a}" for a in at]})

    kind = items.schema[key].dataType.simpleString()
    placed = salted.repartitionById(n_tasks, (F.col("block") % n_tasks).cast("int")).sortWithinPartitions("block")
    packed = placed.mapInPandas(fill, f"`{key}` string, piece int, size int, container string").withColumn(key, F.col(key).cast(kind))
    empty = sized.where("size = 0").select(key, F.lit(0).alias("piece"), "size", F.lit("").alias("container"))
    return packed.unionByName(empty)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: n_containers, n_tokens, fill (share of all room that is used), and the most tokens, items and cost of a container.

    ``packed``: container, size. Items without a container don't count; without any container, fill and the most are null.
    """
    each = packed.where("container <> ''").groupBy("container").agg(
        F.sum("size").alias("tokens"), F.count("*").alias("items"), F.sum(F.pow(F.col("size") / capacity, F.lit(2))).alias("cost")
    )
    return each.agg(
        F.count("*").alias("n_containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"), F.round(F.sum("tokens") / (F.count("*") * capacity), 6).alias("fill"),
        F.max("tokens").alias("most_tokens"), F.max("items").alias("most_items"), F.round(F.max("cost"), 6).alias("most_cost"),
    )
