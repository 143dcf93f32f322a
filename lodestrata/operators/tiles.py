"""Rasters as tiles of arrays: neighbourhoods by an exchange of borders, footprints by runs of valid cells.

A tile (by, tx, ty, values) holds ``size`` rows of ``size`` cells, row by row; null and NaN cells are not valid. A
neighbourhood needs only the borders of the eight tiles around, so those are sent and the tiles stay where they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.stages import Stages
from lodestrata.geometry.dissolve import dissolved

_SIDES = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0)]


def from_cells(grid: DataFrame, by: list[str], size: int) -> DataFrame:
    """Tiles (by, tx, ty, values) of a grid in long form (by, row, col, value, valid); cells that are missing or not valid are null."""
    tx, ty = F.floor(F.col("col") / size).cast("long"), F.floor(F.col("row") / size).cast("long")
    place = (F.col("row") - ty * size) * size + (F.col("col") - tx * size)
    cells = grid.filter("valid").select(*by, tx.alias("tx"), ty.alias("ty"), place.cast("int").alias("at"), F.col("value").cast("double").alias("value"))
    held = cells.groupBy(*by, "tx", "ty").agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("m"))  # at most size * size entries
    return held.select(*by, "tx", "ty", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: F.try_element_at("m", k)).alias("values"))


def _borders(tiles: DataFrame, by: list[str], size: int) -> DataFrame:
    """What each tile sends to its neighbours: (by, tx, ty of the receiver, dx, dy of the sender, strip)."""
    last = size - 1
    strips = []
    for dx, dy in _SIDES:
        rows = [last] if dy == -1 else [0] if dy == 1 else range(size)
        cols = [last] if dx == -1 else [0] if dx == 1 else range(size)
        picked = F.array(*[F.lit(r * size + c + 1) for r in rows for c in cols])
        strips.append(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.transform(picked, lambda k: F.element_at("values", k)).alias("strip")))
    sent = tiles.select(*by, "tx", "ty", F.explode(F.array(*strips)).alias("s"))
    return sent.select(*by, (F.col("tx") - F.col("s.dx")).alias("tx"), (F.col("ty") - F.col("s.dy")).alias("ty"), F.col("s.dx").alias("dx"), F.col("s.dy").alias("dy"), F.col("s.strip").alias("strip"))


def tile_slopes(tiles: DataFrame, by: list[str], size: int, resolution: float = 1.0) -> DataFrame:
    """(by, tx, ty, slope): degrees by Horn's weights for every cell, null where one of the nine cells is not valid.

    Cells at the border of a tile use the cells of its neighbours; where there is none they are null.
    """
    keys = [*by, "tx", "ty"]
    around = _borders(tiles, by, size).groupBy(*keys).agg(F.collect_list(F.struct("dx", "dy", "strip")).alias("around"))  # at most eight
    a, b = tiles.alias("a"), around.alias("b")
    met = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left").select("a.*", "around")

    def run(batches):
        for batch in batches:
            out = []
            for values, sides in zip(batch["values"].to_pylist(), batch["around"].to_pylist(), strict=True):
                z = np.full((size + 2, size + 2), np.nan)
                z[1:-1, 1:-1] = np.array(values, float).reshape(size, size)
                for s in sides or []:
                    strip = np.array(s["strip"], float)
                    rows = {-1: slice(0, 1), 0: slice(1, -1), 1: slice(size + 1, None)}[s["dy"]]
                    cols = {-1: slice(0, 1), 0: slice(1, -1), 1: slice(size + 1, None)}[s["dx"]]
                    z[rows, cols] = strip.reshape(z[rows, cols].shape)
                part = lambda r, c: z[1 + r : 1 + r + size, 1 + c : 1 + c + size]  # noqa: B023, E731
                x = sum((2 if r == 0 else 1) * (part(r, 1) - part(r, -1)) for r in (-1, 0, 1)) / (8 * resolution)
                y = sum((2 if c == 0 else 1) * (part(1, c) - part(-1, c)) for c in (-1, 0, 1)) / (8 * resolution)
                whole = np.degrees(np.arctan(np.hypot(x, y))) + part(0, 0) * 0
                out.append([None if np.isnan(v) else v for v in whole.reshape(-1).tolist()])
            yield pa.RecordBatch.from_arrays([*[batch[k] for k in keys], pa.array(out, pa.list_(pa.float64()))], names=[*keys, "slope"])

    schema = met.select(*keys, F.col("values").alias("slope")).schema
    return met.select(*keys, "values", "around").mapInArrow(run, schema)


def to_cells(tiles: DataFrame, by: list[str], size: int, values: str, name: str) -> DataFrame:
    """Cells (by, row, col, name) of tiles; null cells are left out."""
    at = tiles.select(*by, "tx", "ty", F.posexplode(values).alias("k", name)).filter(F.col(name).isNotNull())
    return at.select(*by, (F.col("ty") * size + F.expr(f"k div {size}")).cast("int").alias("row"), (F.col("tx") * size + F.col("k") % size).cast("int").alias("col"), name)


def valid_footprint(tiles: DataFrame, by: list[str], size: int, stages: Stages) -> DataFrame:
    """(by, label, ring, area, length): the boundary of the valid cells of each raster, a cell being a unit square at (col, row).

    Runs of valid cells in a row are boxes, and their union is dissolved over the grid of tiles; cells that touch in a
    corner only are apart, and holes have negative areas.
    """
    def run(batches):
        for batch in batches:
            at, rings = [], []
            for k, (tx, ty, values) in enumerate(zip(batch["tx"].to_pylist(), batch["ty"].to_pylist(), batch["values"].to_pylist(), strict=True)):
                ok = ~np.isnan(np.array(values, float).reshape(size, size))
                step = np.diff(np.pad(ok.astype(np.int8), ((0, 0), (1, 1))), axis=1)
                for (row, lo), (_, hi) in zip(np.argwhere(step == 1), np.argwhere(step == -1), strict=True):
                    x0, x1, y0 = float(tx * size + lo), float(tx * size + hi), float(ty * size + row)
                    at.append(k)
                    rings.append([[[[x0, y0], [x1, y0], [x1, y0 + 1], [x0, y0 + 1], [x0, y0]]]])
            index = pa.array(np.array(at, np.int64))
            four = pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))
            yield pa.RecordBatch.from_arrays([*[batch[k].take(index) for k in by], pa.array(rings, four)], names=[*by, "region"])

    types = dict(tiles.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in by), "region array<array<array<array<double>>>>"])
    boxes = tiles.select(*by, "tx", "ty", "values").mapInArrow(run, schema)
    return dissolved(boxes, by, "region", float(size), stages)


def block_samples(tiles: DataFrame, by: list[str], size: int) -> DataFrame:
    """(by, tx, ty, samples, n_valid): the middle 3 by 3 cells of each tile, row by row, and how many of them are valid."""
    middle = size // 2
    picked = F.array(*[F.lit((middle + r) * size + middle + c + 1) for r in (-1, 0, 1) for c in (-1, 0, 1)])
    rows = tiles.select(*by, "tx", "ty", F.transform(picked, lambda k: F.element_at("values", k)).alias("samples"))
    return rows.withColumn("n_valid", F.size(F.filter("samples", lambda v: v.isNotNull() & ~F.isnan(v))))
