"""Vectors within a distance of stated query vectors, compared in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 4096  # vectors of a tile
BLOCK = 512  # query vectors that meet a tile at once


def matches_within(queries: DataFrame, vectors: DataFrame, gate: float, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """For each of ``queries`` (id, vector, label) how many other ``vectors`` of its length lie within ``gate``: id, n, n_same (label).

    Queries go to blocks and vectors to tiles of bounded size; each block meets each tile in one task, and only
    counts leave it. A null vector matches nothing; a query without a match has 0.
    """
    blocks, tiles = 1 + queries.count() // block, 1 + vectors.count() // tile
    sound = lambda df: df.filter(F.col("vector").isNotNull()).select("id", F.col("vector").cast("array<double>").alias("vector"), "label", F.size("vector").alias("dim"))
    number = lambda many: F.pmod(F.xxhash64("id"), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    left = sound(queries).select("*", number(blocks).alias("b")).select("*", every(tiles).alias("t"))
    right = sound(vectors).select("*", number(tiles).alias("t")).select("*", every(blocks).alias("b"))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        n, same = np.zeros(a.num_rows, np.int64), np.zeros(a.num_rows, np.int64)
        if a.num_rows and b.num_rows:
            dim = a.column("dim")[0].as_py()
            x, y = (t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim) for t in (a, b))
            ids, labels = b.column("id").to_numpy(), np.array(b.column("label").to_pylist(), object)
            for k, (own, label) in enumerate(zip(a.column("id").to_pylist(), a.column("label").to_pylist(), strict=True)):
                near = (np.sqrt(((y - x[k]) ** 2).sum(1)) <= gate) & (ids != own)
                n[k] = near.sum()
                same[k] = (near & (labels == label)).sum() if label is not None else 0
        return pa.table({"id": a.column("id").cast(pa.int64()), "n": pa.array(n), "n_same": pa.array(same)})

    keys = ["b", "t", "dim"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "id long, n long, n_same long")
    sums = found.groupBy(F.col("id").alias("_id")).agg(F.sum("n").alias("n"), F.sum("n_same").alias("n_same"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return queries.select("id").join(sums, F.col("id") == F.col("_id"), "left").select("id", zero("n"), zero("n_same"))
