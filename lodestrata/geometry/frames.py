"""Geometry columns: kernels over Arrow batches, behind joins that already bound the pairs.

Rings travel as array<array<array<double>>> (one polygon's rings, or a service feature's rings). Kernels
run on rows or on groups of one subject; subjects and sources meet through grid cells, never crossed.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.stages import Stages
from lodestrata.geometry import crs, planar
from lodestrata.operators.boxes import box_pairs, expanded

RINGS = "array<array<array<double>>>"
REGION = f"array<{RINGS}>"
#: The same as types: a function is declared before any session is there to read a type string.
RINGS_TYPE = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))
REGION_TYPE = T.ArrayType(RINGS_TYPE)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _plain(value):
    """Nested arrays as lists of tuples."""
    return [[tuple(float(v) for v in p) for p in ring] for ring in value]


def _region(value):
    return [_plain(polygon) for polygon in value]


@F.pandas_udf(_struct(region=REGION_TYPE, hold=T.StringType()))
def _decoded_rings(rings: pd.Series) -> pd.DataFrame:
    """Region of service rings, or the reason why they are held."""
    rows = []
    for r in rings:
        region, hold = planar.decode_rings(None if r is None else _plain(r))
        rows.append((None if region is None else [[[list(p) for p in ring] for ring in polygon] for polygon in region], hold))
    return pd.DataFrame(rows, columns=["region", "hold"])


@F.pandas_udf(T.StringType())
def _ring_reason(ring: pd.Series) -> pd.Series:
    """Why a ring is not simple; null if it is."""
    return ring.map(lambda r: "missing" if r is None else planar.ring_fault([tuple(p) for p in r]))


@F.pandas_udf(T.StringType())
def _region_reason(region: pd.Series) -> pd.Series:
    """Why a region is not valid; null if it is."""
    return pd.Series([planar.region_fault(_region(r)) for r in region], dtype=object)


@F.pandas_udf(_struct(loops=RINGS_TYPE, hold=T.StringType()))
def _split_touches(ring: pd.Series) -> pd.DataFrame:
    """Loops of a ring cut at twice-visited vertices."""
    rows = []
    for r in ring:
        loops, hold = (None, "missing") if r is None else planar.split_at_touches([tuple(p) for p in r])
        rows.append((None if loops is None else [[list(p) for p in loop] for loop in loops], hold))
    return pd.DataFrame(rows, columns=["loops", "hold"])


@F.pandas_udf(_struct(pattern=T.StringType(), loops=RINGS_TYPE, area=T.DoubleType(), hold=T.StringType()))
def _ring_contacts(ring: pd.Series) -> pd.DataFrame:
    """Pattern and loops of a ring with contacts, and its signed area; or the reason why it is held."""
    rows = []
    for r in ring:
        points = [tuple(p) for p in r]
        pattern, loops, hold = planar.contact_pattern(points)
        rows.append((pattern, loops and [[list(p) for p in loop] for loop in loops], None if hold else planar.signed_area(points), hold))
    return pd.DataFrame(rows, columns=["pattern", "loops", "area", "hold"])


@F.pandas_udf(_struct(**dict.fromkeys(("left", "right", "both", "either", "left_only", "right_only"), T.DoubleType())))
def _overlay_areas(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Boolean areas of pairs of regions; null where one is missing."""
    there = left.notna() & right.notna()
    areas = planar.areas_of_pairs([(_region(a), _region(b)) for a, b in zip(left[there], right[there], strict=True)])
    return pd.DataFrame(areas, index=left.index[there], columns=list(planar.AREAS), dtype=float).reindex(left.index)


@F.pandas_udf(T.StringType())
def _region_relation(left: pd.Series, study: pd.Series) -> pd.Series:
    """interior, touch or outside; held where a region is missing."""
    return pd.Series(["held" if a is None or b is None else planar.relation(_region(a), _region(b)) for a, b in zip(left, study, strict=True)])


@F.pandas_udf(T.DoubleType())
def _hausdorff(left: pd.Series, right: pd.Series) -> pd.Series:
    """Discrete Hausdorff distance of two polygons' rings; null where one is missing."""
    return pd.Series([None if a is None or b is None else planar.hausdorff(_plain(a), _plain(b)) for a, b in zip(left, right, strict=True)], dtype=float)


_CORNERS = [[0.0, 0.0], [0.0, 1.0], [1.0, 1.0], [1.0, 0.0], [0.0, 0.0]]


def stand_in() -> Column:
    """A unit box as a region: what travels into Python where there is no region."""
    return F.array(F.array(F.array(*[F.array(*map(F.lit, p)) for p in _CORNERS])))


def _whole(run, depth: int, *columns, null=None):
    """``run`` on nested arrays, ``null`` where one is missing.

    A batch in which all arrays of arrays are null does not survive the way into pandas, so a box stands in.
    """
    columns = [F.col(c) if isinstance(c, str) else c for c in columns]
    box = F.array(*[F.array(*map(F.lit, p)) for p in _CORNERS])
    for _ in range(depth):
        box = F.array(box)
    there = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns])
    found = run(*[F.coalesce(c, box) for c in columns])
    return F.when(there, found) if null is None else F.when(there, found).otherwise(null)


def _hold(reason: str, **fields) -> Column:
    """The struct of a geometry that is not there."""
    return F.struct(*[F.lit(None).cast(t).alias(n) for n, t in fields.items()], F.lit(reason).alias("hold"))


def decoded_rings(rings) -> Column:
    """Region of service rings, or the reason why they are held."""
    return _whole(_decoded_rings, 1, rings, null=_hold("missing rings", region=REGION))


def ring_reason(ring) -> Column:
    """Why a ring is not simple; null if it is."""
    return _whole(_ring_reason, 0, ring, null=F.lit("missing"))


def region_reason(region) -> Column:
    """Why a region is not valid; null if it is."""
    return _whole(_region_reason, 2, region, null=F.lit("missing"))


def split_touches(ring) -> Column:
    """Loops of a ring cut at twice-visited vertices."""
    return _whole(_split_touches, 0, ring, null=_hold("missing", loops=RINGS))


def ring_contacts(ring) -> Column:
    """Pattern, loops and signed area of a ring cut at twice-visited vertices, or the reason why it is held."""
    return _whole(_ring_contacts, 0, ring, null=_hold("missing", pattern="string", loops=RINGS, area="double"))


def overlay_areas(left, right) -> Column:
    """Boolean areas of pairs of regions; null where one is missing."""
    return _whole(_overlay_areas, 2, left, right)


def region_relation(left, study) -> Column:
    """interior, touch or outside; held where a region is missing."""
    return _whole(_region_relation, 2, left, study, null=F.lit("held"))


def hausdorff(left, right) -> Column:
    """Discrete Hausdorff distance of two polygons' rings; null where one is missing."""
    return _whole(_hausdorff, 1, left, right)


def transformed(rings, operation: str):
    """Rings through a named operation; one vectorised call for each batch."""

    @F.pandas_udf(RINGS_TYPE)
    def run(column: pd.Series) -> pd.Series:
        points = [p for r in column if r is not None for ring in r for p in ring]
        if not points:
            return column
        x, y = crs.transform([p[0] for p in points], [p[1] for p in points], operation)
        flat = iter(zip(x.tolist(), y.tolist(), strict=True))
        return column.map(lambda r: None if r is None else [[list(next(flat)) for _ in ring] for ring in r])

    return _whole(run, 1, rings)


def box_region(xmin, ymin, xmax, ymax):
    """A box as a region (JVM functions)."""
    p = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    return F.array(F.array(F.array(p(xmin, ymin), p(xmin, ymax), p(xmax, ymax), p(xmax, ymin), p(xmin, ymin))))


def with_bounds(df: DataFrame, region: str = "region") -> DataFrame:
    """Add xmin, ymin, xmax, ymax of a region column (JVM functions)."""
    points = F.flatten(F.flatten(region))
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return df.withColumns({"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)})


def shape_id(region: str = "region") -> Column:
    """Identity of a region: equal ones (a null one too) have the same."""
    return F.sha2(F.to_json(F.struct(F.col(region).alias("r"))), 256)


def shapes(df: DataFrame, *more: str) -> DataFrame:
    """(shape, region, *more, n): the different regions of ``df`` (shape, region, *more) and how many rows each has."""
    return df.groupBy("shape", *more).agg(F.first("region").alias("region"), F.count("*").alias("n"))


def overlaid(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a_id, b_id, both): the area that each two regions of ``a`` and ``b`` (id, region) share, where there is one.

    Regions that are equal are laid over others once.
    """
    a, b = a.withColumn("shape", shape_id()), b.withColumn("shape", shape_id())
    left, right = shapes(a), shapes(b)
    pairs = box_pairs(with_bounds(left), with_bounds(right), "shape", "shape", size).select(F.col("a_id").alias("a_class"), F.col("b_id").alias("b_class"))
    met = pairs.join(left.select(F.col("shape").alias("a_class"), F.col("region").alias("_a")), "a_class").join(right.select(F.col("shape").alias("b_class"), F.col("region").alias("_b")), "b_class")
    found = met.select("a_class", "b_class", overlay_areas("_a", "_b")["both"].alias("both")).filter("both > 0")
    members = lambda df: df.select("id", F.col("shape").alias("class"))
    return expanded(found, members(a), members(b))


def held_bounds(rings):
    """Bounds (xmin, ymin, xmax, ymax) of every vertex of held rings, null where any vertex is missing or not finite."""
    points = F.flatten(rings)
    finite = lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    full = (F.size(rings) > 0) & F.forall(rings, lambda r: F.coalesce(F.size(r), F.lit(0)) > 0)
    sound = full & F.forall(points, lambda p: F.coalesce(F.size(p) >= 2, F.lit(False)) & finite(F.get(p, F.lit(0))) & finite(F.get(p, F.lit(1))))
    along = lambda k: F.transform(points, lambda p: F.get(p, F.lit(k)))
    box = F.struct(F.array_min(along(0)).alias("xmin"), F.array_min(along(1)).alias("ymin"), F.array_max(along(0)).alias("xmax"), F.array_max(along(1)).alias("ymax"))
    return F.when(F.coalesce(sound, F.lit(False)), box)


def screen(subjects: DataFrame, zones: DataFrame, size: float) -> DataFrame:
    """Overlay each subject (id, region) with zones (id, zone, region): one row a subject.

    covered_fraction counts overlapping zones once, area_sum as often as they overlap; no overlap leaves the
    fraction null, because absence is not zero. Zones that only touch are listed apart. Subjects with equal regions share
    their answer, and zones with equal regions and names meet a subject once.
    """
    own = subjects.select("id", shape_id().alias("shape"), "region")
    named = zones.select("id", "zone", "region", shape_id().alias("shape")).withColumn("shape", F.concat("shape", F.coalesce(F.concat(F.lit("="), "zone"), F.lit("~"))))
    s, z = shapes(own), shapes(named, "zone")
    pairs = box_pairs(with_bounds(s), with_bounds(z), "shape", "shape", size).select("a_id", "b_id")
    met = pairs.join(s.select(F.col("shape").alias("a_id"), F.col("region").alias("s")), "a_id").join(z.select(F.col("shape").alias("b_id"), "zone", "n", F.col("region").alias("z")), "b_id")
    schema = "shape string, n_overlaps int, area_sum double, covered_fraction double, n_touch int, touched array<string>, zones array<string>"

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        subject = _region(frame["s"].iloc[0])
        over, touch, total, names, n_over, n_touch = [], [], 0.0, set(), 0, 0
        found = sorted(zip(frame["b_id"], frame["zone"], frame["n"], map(_region, frame["z"]), strict=True), key=lambda r: r[0])
        areas = planar.areas_of_pairs([(subject, region) for *_, region in found])
        whole = areas["left"][0]
        for (b_id, zone, n, region), area in zip(found, areas["both"].tolist(), strict=True):
            if area > 0:
                over += region
                n_over += int(n) * len(region)
                total += area * int(n)
                names.add(zone)
            elif planar.touches_or_crosses(subject, region):
                touch.append(b_id)
                n_touch += int(n)
        fraction = min(1.0, planar.boolean_areas(subject, over)["both"] / whole) if over else None
        return pd.DataFrame({"shape": [frame["a_id"].iloc[0]], "n_overlaps": [n_over], "area_sum": [total if over else None], "covered_fraction": [fraction], "n_touch": [n_touch], "touched": [touch], "zones": [sorted(names)]})

    found = Stages(subjects.sparkSession, "screen").keep(met.groupBy("a_id").applyInPandas(one, schema), "found")
    touched = found.select("shape", F.explode("touched").alias("_zone")).join(named.select(F.col("shape").alias("_zone"), F.col("id").cast("long").alias("_id")), "_zone")
    ids = touched.groupBy(F.col("shape").alias("_shape")).agg(F.array_sort(F.collect_list("_id")).alias("_ids"))
    met = found.join(ids, F.col("shape") == F.col("_shape"), "left").withColumn("touches", F.coalesce("_ids", F.expr("cast(array() as array<long>)")))
    rows = own.select("id", "shape").join(met, "shape", "left").select("id", "n_overlaps", "area_sum", "covered_fraction", "n_touch", "touches", "zones")
    return rows.withColumn("status", F.when(F.coalesce("n_overlaps", F.lit(0)) > 0, "overlap").when(F.col("n_touch") > 0, "touch_only").otherwise("no_evidence"))


def zone_areas(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Area per group of regions clipped to a subject, overlaps once: (group, area). Rows have s and z."""

    def one(key, frame: pd.DataFrame) -> pd.DataFrame:
        subject = _region(frame["s"].iloc[0])
        area = planar.boolean_areas(subject, [p for z in frame["z"] for p in _region(z)])["both"]
        return pd.DataFrame([(*key, area)], columns=[*group, "area"])

    types = dict(pairs.dtypes)
    return pairs.groupBy(*group).applyInPandas(one, ", ".join(f"{g} {types[g]}" for g in group) + ", area double")
