"""Connected components by alternating stars over written tables.

Links of a counted, bounded number are joined by one task. Beyond that, each round turns every neighbourhood into a star around its smallest member, first for the larger
neighbours, then for the smaller ones; the rounds grow with the logarithm of the longest chain. Minima are
written before they are joined, so that a hub's rows can be split among tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.scratch import Scratch

ONE_TASK = 1_000_000  # links that one task may hold: 16 MB


def least_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches by the links (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        after = root.copy()
        np.minimum.at(after, root[i], low)
        np.minimum.at(after, root[j], low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _in_one_task(batches):
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = least_reached(len(ids), place[: len(u)], place[len(u) :])
    own = root != np.arange(len(ids))
    yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], names=["id", "root"])


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(a, b) links to (id, root): each linked id but the roots, with the smallest id it reaches.

    Nulls and loops are ignored; repeated links are harmless; without links the result is empty.
    """
    link = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = scratch.keep(link, f"{name}-0")
    if current.count() <= ONE_TASK:
        return scratch.keep(current.coalesce(1).mapInArrow(_in_one_task, "id long, root long"), f"{name}-one")
    seen, turn = None, 0
    while True:
        mark = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or mark[0] == 0:
            return current.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen, turn = mark, turn + 1
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), f"{name}-{turn}a")
        large = scratch.keep(current.join(least, F.col("v") == F.col("k")).select("u", F.col("m").alias("v")).distinct(), f"{name}-{turn}b")
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m"), f"{name}-{turn}c")
        moved = large.join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        star = least.select(F.col("k").alias("u"), F.col("m").alias("v"))
        following = scratch.keep(moved.unionByName(star).distinct(), f"{name}-{turn}")
        for old in (f"{name}-{turn - 1}", f"{name}-{turn}a", f"{name}-{turn}b", f"{name}-{turn}c"):
            scratch.drop(old)
        current = following
