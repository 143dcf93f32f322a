"""Grids in long form (row, col, value, valid): neighbourhoods as joins on integer offsets.

A grid is dealt by (row, col); a neighbourhood is one explode to the cells that need a value and one
aggregate, so no tile is gathered and any number of sources can stand side by side (``by``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _around(grid: DataFrame, by: list[str], offsets: list[tuple[int, int]]) -> DataFrame:
    """Each valid value sent to the cells for which it is a neighbour, with its offset."""
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in offsets])
    sent = grid.filter("valid").select(*by, "row", "col", "value", F.explode(steps).alias("o"))
    return sent.select(*by, (F.col("row") - F.col("o.dr")).alias("row"), (F.col("col") - F.col("o.dc")).alias("col"), "o", "value")


def horn_slope(grid: DataFrame, resolution: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Slope in degrees by Horn's 3 by 3 weights; a cell without nine valid values has none (no padding)."""
    by = by or []
    near = _around(grid, by, [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)])
    weight = lambda a, b: F.when(F.col(f"o.{b}") == 0, 2).otherwise(1) * F.col(f"o.{a}")
    sums = near.groupBy(*by, "row", "col").agg(F.count("*").alias("_n"), F.sum(F.col("value") * weight("dc", "dr")).alias("_x"), F.sum(F.col("value") * weight("dr", "dc")).alias("_y"))
    scale = 8.0 * resolution
    return sums.filter("_n = 9").select(*by, "row", "col", F.degrees(F.atan(F.hypot(F.col("_x") / scale, F.col("_y") / scale))).alias("slope"))


def bilinear(grid: DataFrame, targets: DataFrame, row: str = "y", col: str = "x") -> DataFrame:
    """Add ``sample`` to ``targets``: the bilinear value at fractional positions; all four cells must be valid."""
    r0, c0 = F.floor(row).cast("int"), F.floor(col).cast("int")
    corners = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in (0, 1) for dc in (0, 1)])
    fr, fc = F.col(row) - F.floor(row), F.col(col) - F.floor(col)
    part = lambda f, d: F.when(F.col(f"o.{d}") == 1, f).otherwise(1 - f)
    keyed = targets.withColumn("_t", F.struct(row, col)).withColumn("o", F.explode(corners))
    keyed = keyed.select("_t", (r0 + F.col("o.dr")).alias("row"), (c0 + F.col("o.dc")).alias("col"), (part(fr, "dr") * part(fc, "dc")).alias("_w"))
    sums = keyed.distinct().join(grid.filter("valid").select("row", "col", "value"), ["row", "col"]).groupBy("_t").agg(F.count("*").alias("_n"), F.sum(F.col("_w") * F.col("value")).alias("_v"))
    sums = sums.select(F.col(f"_t.{row}").alias(row), F.col(f"_t.{col}").alias(col), F.when(F.col("_n") == 4, F.col("_v")).alias("sample"))
    return targets.join(sums, [row, col], "left")


def nearest(grid: DataFrame, targets: DataFrame, row: str = "y", col: str = "x") -> DataFrame:
    """Add ``sample``: the value of the nearest valid cell centre (halves go up)."""
    at = targets.withColumns({"_r": F.floor(F.col(row) + 0.5).cast("int"), "_c": F.floor(F.col(col) + 0.5).cast("int")})
    own = grid.filter("valid").select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value").alias("sample"))
    return at.join(own, ["_r", "_c"], "left").drop("_r", "_c")


def seam_edges(grid: DataFrame) -> DataFrame:
    """Edges between a valid and an invalid four-neighbour: row, col, direction, valid_here."""
    right, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    next_to = grid.select(
        "row", "col", "valid",
        F.lead("valid").over(right).alias("_rv"), F.lead("col").over(right).alias("_rc"),
        F.lead("valid").over(down).alias("_dv"), F.lead("row").over(down).alias("_dr"),
    )
    across = F.when((F.col("_rc") == F.col("col") + 1) & (F.col("_rv") != F.col("valid")), F.lit("right"))
    below = F.when((F.col("_dr") == F.col("row") + 1) & (F.col("_dv") != F.col("valid")), F.lit("down"))
    return next_to.select("row", "col", F.explode(F.array_compact(F.array(across, below))).alias("direction"), F.col("valid").alias("valid_here"))


def boundary_cells(grid: DataFrame, label: str = "label") -> DataFrame:
    """Cells whose nine labelled neighbours do not all agree."""
    sent = grid.select("row", "col", F.col(label).cast("string").alias("value"), F.lit(True).alias("valid"))
    near = _around(sent, [], [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)])
    return near.groupBy("row", "col").agg(F.count("*").alias("_n"), F.min("value").alias("_a"), F.max("value").alias("_b")).filter("_n = 9 and _a <> _b").select("row", "col")


def validity(grid: DataFrame, by: list[str], nodata: float) -> DataFrame:
    """Cells that are NoData, not finite, or valid."""
    v = F.col("value")
    none = v.isNull() | (v == nodata)
    odd = ~none & (F.isnan(v) | (F.abs(v) == float("inf")))
    return grid.groupBy(*by).agg(F.count("*").alias("n_cells"), F.count_if(none).alias("n_nodata"), F.count_if(odd).alias("n_nonfinite"), F.count_if(~none & ~F.isnan(v) & (F.abs(v) < float("inf"))).alias("n_valid"))


def plane_fit(patch: DataFrame, by: list[str]) -> DataFrame:
    """Least-squares plane z = a x + b y + c per patch from its sums (no gathering), with the residual RMS.

    Coordinates are taken from each patch's mean, so the normal equations are two by two.
    """
    mean = patch.groupBy(*by).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"), F.avg("z").alias("_mz"))
    d = patch.join(mean, by)
    x, y, z = F.col("x") - F.col("_mx"), F.col("y") - F.col("_my"), F.col("z") - F.col("_mz")
    s = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.first("_mx").alias("_mx"), F.first("_my").alias("_my"), F.first("_mz").alias("_mz"),
        F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"), F.sum(y * y).alias("yy"), F.sum(x * z).alias("xz"), F.sum(y * z).alias("yz"), F.sum(z * z).alias("zz"),
    )
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    s = s.filter(det != 0).withColumns({"a": (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det, "b": (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det})
    rest = F.greatest(F.col("zz") - F.col("a") * F.col("xz") - F.col("b") * F.col("yz"), F.lit(0.0))
    return s.select(*by, "n", "a", "b", (F.col("_mz") - F.col("a") * F.col("_mx") - F.col("b") * F.col("_my")).alias("c"), F.sqrt(rest / F.col("n")).alias("rms"))


def pair_differences(grids: DataFrame, source: str = "source") -> DataFrame:
    """Differences of each pair of sources (first name first) on the cells that both hold."""
    a = grids.filter("valid").select(F.col(source).alias("a"), "row", "col", F.col("value").alias("_va"))
    b = grids.filter("valid").select(F.col(source).alias("b"), "row", "col", F.col("value").alias("_vb"))
    return a.join(b, ["row", "col"]).filter("a < b").select("a", "b", "row", "col", (F.col("_va") - F.col("_vb")).alias("difference"))


def to_map(col: Column, row: Column, affine: tuple[float, ...]) -> Column:
    """Map coordinates (x, y) of pixel coordinates under (a, b, c, d, e, f): x = a col + b row + c, y = d col + e row + f."""
    a, b, c, d, e, f = affine
    return F.struct((a * col + b * row + c).alias("x"), (d * col + e * row + f).alias("y"))


def to_pixel(x: Column, y: Column, affine: tuple[float, ...]) -> Column:
    """Pixel coordinates (col, row) of map coordinates: the inverse of ``to_map``."""
    a, b, c, d, e, f = affine
    det = a * e - b * d
    if not det:
        raise ValueError("the transform has no inverse")
    dx, dy = x - c, y - f
    return F.struct(((e * dx - b * dy) / det).alias("col"), ((a * dy - d * dx) / det).alias("row"))


def footprint(width: Column, height: Column, affine: tuple[float, ...]) -> Column:
    """Bounds (xmin, ymin, xmax, ymax) of a north-up raster; another orientation is an error."""
    a, b, c, d, e, f = affine
    if b or d or a <= 0 or e >= 0:
        raise ValueError("the raster is not north-up")
    return F.struct(F.lit(c).alias("xmin"), (f + e * height).alias("ymin"), (c + a * width).alias("xmax"), F.lit(f).alias("ymax"))


def window_of(box: dict[str, Column], width: Column, height: Column, affine: tuple[float, ...]) -> Column:
    """Cells (row0, row1, col0, col1; ends exclusive) of a north-up raster that a box meets; null if it meets none."""
    a, b, c, d, e, f = affine
    if b or d or a <= 0 or e >= 0:
        raise ValueError("the raster is not north-up")
    inside = lambda v, most: F.greatest(F.lit(0), F.least(v.cast("long"), most.cast("long")))
    col0, col1 = inside(F.floor((box["xmin"] - c) / a), width), inside(F.ceil((box["xmax"] - c) / a), width)
    row0, row1 = inside(F.floor((box["ymax"] - f) / e), height), inside(F.ceil((box["ymin"] - f) / e), height)
    return F.when((col0 < col1) & (row0 < row1), F.struct(row0.alias("row0"), row1.alias("row1"), col0.alias("col0"), col1.alias("col1")))
