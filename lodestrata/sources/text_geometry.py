"""Geometry in texts, by JVM expressions: WKT and GeoJSON polygons to regions, and areas of regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrata.functions import variants

RINGS = "array<array<array<double>>>"
REGION = f"array<{RINGS}>"
NUMBER = r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_POINT = rf"\s*{NUMBER}\s+{NUMBER}\s*"
_RING = rf"\s*\({_POINT}(?:,{_POINT})*\)\s*"
_POLYGON = rf"\s*\({_RING}(?:,{_RING})*\)\s*"


def wkt_region(text: Column) -> Column:
    """Region of a two-dimensional POLYGON or MULTIPOLYGON in WKT; null for everything else, EMPTY included."""
    single = F.regexp_like(text, F.lit(rf"^(?i)\s*POLYGON{_POLYGON}\z"))
    many = F.regexp_like(text, F.lit(rf"^(?i)\s*MULTIPOLYGON\s*\({_POLYGON}(?:,{_POLYGON})*\)\s*\z"))
    point = lambda p: F.transform(F.regexp_extract_all(p, F.lit(f"({NUMBER})"), F.lit(1)), lambda v: v.cast("double"))
    ring = lambda r: F.transform(F.split(r, ","), point)
    polygon = lambda p: F.transform(F.split(p, r"\)\s*,\s*\("), ring)
    polygons = F.when(single, F.array(text)).when(many, F.split(text, r"\)\s*\)\s*,\s*\(\s*\("))
    return F.transform(polygons, polygon)


def geojson_region(text: Column) -> Column:
    """Region of a GeoJSON Polygon or MultiPolygon geometry (a text); null for other types and for coordinates that are not numbers in pairs."""
    v = variants.parsed(text)
    shape = variants.at(v, "$.type", "string")
    region = F.when(shape == "Polygon", F.array(variants.at(v, "$.coordinates", RINGS))).when(shape == "MultiPolygon", variants.at(v, "$.coordinates", REGION))
    pairs = F.forall(F.flatten(F.flatten(region)), lambda p: F.size(p) == 2) & ~F.schema_of_variant(variants.at(v, "$.coordinates")).rlike("STRING|BOOLEAN|VARIANT")
    return F.when(F.coalesce(pairs, F.lit(False)), region)


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring, positive if it turns left; measured from its first point."""
    x = lambda p: F.get(p, F.lit(0)) - F.get(F.get(ring, F.lit(0)), F.lit(0))
    y = lambda p: F.get(p, F.lit(1)) - F.get(F.get(ring, F.lit(0)), F.lit(1))
    pairs = F.zip_with(F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: x(a) * y(b) - x(b) * y(a))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v) / 2


def region_area(region: Column) -> Column:
    """Area of valid polygons: shells less holes, whichever way rings turn."""
    polygon = lambda rings: F.aggregate(F.transform(rings, lambda r, k: F.when(k == 0, F.abs(ring_area(r))).otherwise(-F.abs(ring_area(r)))), F.lit(0.0), lambda s, v: s + v)
    return F.aggregate(F.transform(region, polygon), F.lit(0.0), lambda s, v: s + v)
