"""Near duplicates among embeddings: PCA-ordered tiled comparison.

Vectors are compared within a label by cosine. Equal vectors are one class. Classes are rotated onto the
principal axes of all vectors (which keeps every cosine) and dealt to cells along the first axis, wide
enough that linked vectors lie in the same or neighbouring cells; crowded cells are split into tiles of a
bounded size, and each pair of tiles that may hold links is one task. Inside a tile pair the leading
dimensions are multiplied first; the rest of a product is bounded by the norms of the remaining suffixes,
and pairs that can no longer reach the threshold are left. What is left is decided by the cosine in double
precision. Tasks return link counts and a spanning forest, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.components import connected_components, least_reached
from lodestrata.llm.scratch import Scratch

COSINE = 0.93
TILE = 2048
ROWS = 256  # rows of a tile that are compared at once
LEAD = 8


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column of equal lengths as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their norms, scaled first so that extreme components neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length, the axes of the summed second moments, largest first (one small matrix a length)."""

    def sums(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = batch.column(0).to_numpy()
            for dim in np.unique(lengths).tolist():
                x = unit(_matrix(batch.column(1).filter(pa.array(lengths == dim)), dim))
                total[dim] = total.get(dim, 0) + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m.tobytes() for m in total.values()], pa.binary())], names=["dim", "m"])

    def add(table):
        total = sum(np.frombuffer(m) for m in table.column("m").to_pylist())
        return pa.table({"dim": table.column("dim").slice(0, 1), "m": pa.array([total.tobytes()], pa.binary())})

    schema = "dim int, m binary"
    rows = classes.select("dim", "embedding").mapInArrow(sums, schema).groupBy("dim").applyInArrow(add, schema).collect()
    out = {}
    for r in rows:
        values, vectors = np.linalg.eigh(np.frombuffer(r.m).reshape(r.dim, r.dim))
        out[r.dim] = vectors[:, np.argsort(-values, kind="stable")]
    return out


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) with cosine(a[i], b[j]) >= cosine, decided in double precision."""
    ua, ub = unit(a), unit(b)
    ra, rb = ua @ axes, ub @ axes
    dim = a.shape[1]
    steps = [0]
    while steps[-1] < dim:
        steps.append(min(dim, max(LEAD, 2 * steps[-1])))
    suffix = lambda r: [np.sqrt(np.maximum((r[:, s:] ** 2).sum(1), 0)) for s in steps[1:]]
    rest_a, rest_b = suffix(ra), suffix(rb)
    least = cosine - 1e-9
    found_i, found_j = [], []
    for at in range(0, len(a), ROWS):
        part = slice(at, at + ROWS)
        product = ra[part, : steps[1]] @ rb[:, : steps[1]].T
        i, j = np.nonzero(product + np.outer(rest_a[0][part], rest_b[0]) >= least)
        value = product[i, j]
        for k in range(1, len(steps) - 1):
            if not len(i):
                break
            lo, hi = steps[k], steps[k + 1]
            if len(i) > product.size // 16:
                value = value + (ra[part, lo:hi] @ rb[:, lo:hi].T)[i, j]
            else:
                value = value + np.einsum("nd,nd->n", ra[part, lo:hi][i], rb[:, lo:hi][j])
            keep = value + rest_a[k][part][i] * rest_b[k][j] >= least
            i, j, value = i[keep], j[keep], value[keep]
        if not len(i):
            continue
        if len(i) > product.size // 16:
            exact = (ua[part] @ ub.T)[i, j]
        else:
            exact = np.einsum("nd,nd->n", ua[part][i], ub[j])
        keep = exact >= cosine
        found_i.append(i[keep] + at)
        found_j.append(j[keep])
    if not found_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def near_duplicates(vectors: DataFrame, scratch: Scratch, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """Links among ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a label,
    link with nothing, as do vectors of different lengths. Repeated rows count as vectors each; an empty
    table gives an empty table; other columns are ignored.
    """
    sound = F.col("embedding").isNotNull() & F.col("label").isNotNull()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(sound & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", F.when(sound, F.col("embedding")).alias("embedding"))
    cid = F.xxhash64("label", F.transform("embedding", lambda x: x + F.lit(0).cast("float")))
    rows = rows.withColumn("cid", F.when(F.col("embedding").isNotNull(), cid))
    classes = rows.filter("cid is not null").groupBy("cid", "label").agg(F.any_value("embedding").alias("embedding"), F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    classes = scratch.keep(classes.withColumn("dim", F.size("embedding")), "classes")
    axes = principal_axes(classes)
    shared = vectors.sparkSession.sparkContext.broadcast(axes)
    width = float(np.sqrt(2 - 2 * cosine)) + 1e-9

    def cells(batches):
        for batch in batches:
            lengths = batch.column(1).to_numpy()
            cell = np.zeros(len(lengths), np.int32)
            for dim in np.unique(lengths).tolist():
                own = lengths == dim
                x = unit(_matrix(batch.column(2).filter(pa.array(own)), dim))
                cell[own] = np.floor(x @ shared.value[dim][:, 0] / width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32())], names=["cid", "cell"])

    placed = classes.select("cid", "dim", "embedding").mapInArrow(cells, "cid long, cell int")
    placed = scratch.keep(classes.select("cid", "label", "dim", "embedding", "copies").join(placed, "cid"), "placed")
    group = ["label", "dim", "cell"]
    tiles = scratch.keep(placed.groupBy(*group).agg(F.ceil(F.count("*") / tile).cast("int").alias("k")), "tiles")
    beside = lambda step, name: tiles.select("label", "dim", (F.col("cell") + step).alias("cell"), F.col("k").alias(name))
    known = placed.join(tiles, group).join(beside(-1, "k_up"), group, "left").join(beside(1, "k_down"), group, "left")
    own = F.pmod(F.xxhash64("cid", F.lit(1)), F.col("k")).cast("int")
    known = known.withColumn("t", own)

    def with_tile(other_cell, first, last, left: bool):
        """Pairs of this row's tile with tiles first..last of another cell; ``left``: this row's tile comes first."""
        spread = F.when(first <= last, F.sequence(first, last))
        mine, theirs = F.struct(F.col("cell").alias("c"), F.col("t").alias("t")), lambda u: F.struct(other_cell.alias("c"), u.alias("t"))
        return F.transform(spread, lambda u: F.struct((mine if left else theirs(u)).alias("a"), (theirs(u) if left else mine).alias("b"), F.lit(left).alias("left")))

    cell, t = F.col("cell"), F.col("t")
    pairs = F.array_compact(F.array(with_tile(cell, t, F.col("k") - 1, True), with_tile(cell, F.lit(0), t - 1, False), with_tile(cell + 1, F.lit(0), F.col("k_up") - 1, True), with_tile(cell - 1, F.lit(0), F.col("k_down") - 1, False)))
    dealt = known.select("label", "dim", "cid", "embedding", "copies", F.explode(F.flatten(pairs)).alias("p"))
    dealt = dealt.select("label", "dim", "p.a", "p.b", "p.left", "cid", "embedding", "copies")
    schema = T.StructType([T.StructField("cid", T.LongType()), T.StructField("root", T.LongType()), T.StructField("links", T.LongType())])

    def compare(table):
        dim = table.column("dim")[0].as_py()
        left = table.column("left").to_numpy(zero_copy_only=False).astype(bool)
        x = _matrix(table.column("embedding"), dim)
        ids, copies = table.column("cid").to_numpy(), table.column("copies").to_numpy()
        within = table.column("a")[0].as_py() == table.column("b")[0].as_py()
        a = np.flatnonzero(left)
        b = a if within else np.flatnonzero(~left)
        if not len(a) or not len(b):
            return schema_table([], [], [])
        i, j = linked_pairs(x[a], x[b], shared.value[dim], cosine)
        i, j = a[i], b[j]
        if within:
            i, j = i[i != j], j[i != j]
        links = np.bincount(i, copies[j], len(x)) + (0 if within else np.bincount(j, copies[i], len(x)))
        root = least_reached(len(x), i, j)
        own = links > 0
        return schema_table(ids[own], ids[root[own]], links[own].astype(np.int64))

    def schema_table(ids, roots, links):
        return pa.table({"cid": pa.array(ids, pa.int64()), "root": pa.array(roots, pa.int64()), "links": pa.array(links, pa.int64())})

    found = scratch.keep(dealt.groupBy("label", "dim", "a", "b").applyInArrow(compare, schema), "found")
    roots = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), scratch)
    named = classes.select("cid", "first", "copies").join(roots.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = named.join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
    named = scratch.keep(named, "named")
    smallest = named.groupBy("root").agg(F.min("first").alias("least"))
    result = scratch.keep(named.join(smallest, "root").select("cid", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "result")
    out = rows.select("vec_id", "cid").join(result, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
