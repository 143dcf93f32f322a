"""Unions and faces of polygons over a grid: cut to cells, swept cell by cell, stitched across cells.

``pieces`` cuts regions at grid lines, each edge once, so both neighbours get the same points; what covers a cell from
its left border on stands there as vertical edges. A cell is then a problem of its own: areas are sums over cells, and
``dissolved`` takes the boundaries of faces from each cell, cancels what neighbours share along their borders and
follows the rest from cell to cell. No subject is one task; a crowded cell is united in parts first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.stages import Stages
from lodestrata.geometry import arrangement
from lodestrata.geometry.arrangement import Edges

FIELDS = 5  # numbers of an edge: x and y below, x and y above, weight
CROWD = 4000  # edges of a cell that are swept together; more are united in parts first
BATCH = 200_000  # edges of cells that one sweep takes
CORNER = 1e-12  # of a cell: a place that is closer to a grid line is on it


def _on_line(v: np.ndarray, size: float) -> np.ndarray:
    near = np.round(v / size) * size
    return np.where(np.abs(v - near) <= CORNER * size * np.maximum(1.0, np.abs(v / size)), near, v)


def _split(e: Edges, size: float) -> tuple[Edges, np.ndarray, np.ndarray]:
    """The edges cut at all grid lines, with the column and row of each part."""
    n = np.arange(len(e))
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (e.xt - e.xb) / (e.yt - e.yb)
    where, xs, ys = [n, n], [e.xb, e.xt], [e.yb, e.yt]
    for low, high, row in ((e.yb, e.yt, True), (np.minimum(e.xb, e.xt), np.maximum(e.xb, e.xt), False)):
        first = np.floor(low / size).astype(np.int64) + 1
        many = np.maximum(np.ceil(high / size).astype(np.int64) - first, 0)
        of = np.repeat(n, many)
        line = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)) * size
        where.append(of)
        if row:
            ys.append(line)
            xs.append(_on_line(e.xb[of] + (line - e.yb[of]) * slope[of], size))
        else:
            xs.append(line)
            ys.append(np.clip(_on_line(e.yb[of] + (line - e.xb[of]) / slope[of], size), e.yb[of], e.yt[of]))
    of, x, y = (np.concatenate(v) for v in (where, xs, ys))
    order = np.lexsort((np.where(slope[of] < 0, -x, x), y, of))
    of, x, y = of[order], x[order], y[order]
    part = np.flatnonzero((of[1:] == of[:-1]) & (y[1:] > y[:-1]))
    own = of[part]
    cut = Edges(e.group[own], e.layer[own], x[part], y[part], x[part + 1], y[part + 1], e.weight[own])
    return cut, np.floor((cut.xb + cut.xt) / 2 / size).astype(np.int64), np.floor((cut.yb + cut.yt) / 2 / size).astype(np.int64)


def _borders(e: Edges, col: np.ndarray, row: np.ndarray, size: float) -> tuple[list, list, list]:
    """Vertical edges at the left borders of cells, for what lies left of them in their row: (numbers, columns, rows)."""
    order = np.lexsort((col, row, e.group))
    group, col, row = e.group[order], col[order], row[order]
    heads = np.flatnonzero(np.r_[True, (np.diff(group) != 0) | (np.diff(row) != 0)]) if len(group) else []
    made, cols, rows = [], [], []
    for lo, hi in zip(heads, [*heads[1:], len(group)], strict=True):
        if col[lo] == col[hi - 1]:
            continue
        change: dict[float, int] = {}
        at = lo
        while at < hi:
            now, to = col[at], lo + int(np.searchsorted(col[lo:hi], col[at], "right"))
            for k in order[at:to]:
                w = int(e.weight[k])
                for y, d in ((float(e.yb[k]), w), (float(e.yt[k]), -w)):
                    left = change.get(y, 0) + d
                    if left:
                        change[y] = left
                    else:
                        change.pop(y, None)
            ys, total, walls = sorted(change), 0, []
            for y, nxt in zip(ys, ys[1:], strict=False):
                total += change[y]
                if total:
                    walls.append((y, nxt, total))
            for c in range(now + 1, (col[to] if to < hi else now) + 1):
                made += [(int(group[lo]), c * size, y, c * size, nxt, w) for y, nxt, w in walls]
                cols += [c] * len(walls)
                rows += [int(row[lo])] * len(walls)
            at = to
    return made, cols, rows


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Which row each item of a list column belongs to, and the items; null lists have none."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def _region_edges(column: pa.Array, as_given: bool) -> Edges:
    """Edges of a column of regions; ``as_given`` keeps the turn of rings, else shells count one and holes take one away."""
    row_of_polygon, polygons = _lists(column)
    polygon_of_ring, rings = _lists(polygons)
    ring_of_point, points = _lists(rings)
    _, values = _lists(points)
    xy = np.asarray(values, float).reshape(-1, 2)
    inner = np.flatnonzero(ring_of_point[1:] == ring_of_point[:-1])
    a, b, ring = xy[inner], xy[inner + 1], ring_of_point[inner]
    turn = np.ones(len(rings), np.int64)
    if not as_given and len(inner):
        head = np.zeros(len(rings), np.int64)
        head[ring[::-1]] = inner[::-1]
        p, q = a - xy[head[ring]], b - xy[head[ring]]
        left = np.bincount(ring, p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1], len(rings)) > 0
        hole = np.r_[False, polygon_of_ring[1:] == polygon_of_ring[:-1]] if len(rings) else np.zeros(0, bool)
        turn = np.where(left != hole, 1, -1)
    row = row_of_polygon[polygon_of_ring[ring]]
    return Edges.of(row, np.zeros(len(row), np.int64), a[:, 0], a[:, 1], b[:, 0], b[:, 1], turn[ring])


def pieces(df: DataFrame, keys: list[str], region: str, size: float, as_given: bool = False) -> DataFrame:
    """(*keys, cx, cy, edges): the edges of each row's region in each grid cell that it covers or crosses.

    ``edges`` are runs of five numbers. A null or empty region has no pieces; rows that repeat have pieces each.
    """
    kinds = [df.schema[k] for k in keys]
    schema = T.StructType([*kinds, T.StructField("cx", T.LongType()), T.StructField("cy", T.LongType()), T.StructField("edges", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            e, col, row = _split(_region_edges(batch.column(len(keys)), as_given), size)
            made, cols, rows = _borders(e, col, row, size)
            extra = np.array(made, float).reshape(-1, FIELDS + 1)
            own = np.r_[e.group, extra[:, 0].astype(np.int64)]
            numbers = np.concatenate([np.stack([e.xb, e.yb, e.xt, e.yt, e.weight.astype(float)], 1), extra[:, 1:]])
            col, row = np.r_[col, np.array(cols, np.int64)], np.r_[row, np.array(rows, np.int64)]
            order = np.lexsort((row, col, own))
            own, col, row, numbers = own[order], col[order], row[order], numbers[order]
            heads = np.flatnonzero(np.r_[True, (np.diff(own) != 0) | (np.diff(col) != 0) | (np.diff(row) != 0)]) if len(own) else np.zeros(0, np.int64)
            offsets = pa.array(np.r_[heads, len(own)] * FIELDS, pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(numbers.reshape(-1)))
            at = pa.array(own[heads])
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(len(keys))], pa.array(col[heads]), pa.array(row[heads]), lists], names=[*keys, "cx", "cy", "edges"])

    return df.select(*keys, F.col(region).alias("_region")).mapInArrow(run, schema)


def _edges_of(columns: list[pa.Array]) -> Edges:
    """The edges of rows of cells; column k is layer k."""
    groups, layers, numbers = [], [], []
    for k, column in enumerate(columns):
        row, values = _lists(column)
        row = row[::FIELDS]
        groups.append(row)
        layers.append(np.full(len(row), k))
        numbers.append(np.asarray(values, float).reshape(-1, FIELDS))
    x = np.concatenate(numbers)
    return Edges(np.concatenate(groups), np.concatenate(layers), x[:, 0], x[:, 1], x[:, 2], x[:, 3], x[:, 4].astype(np.int64))


def _in_batches(batch: pa.RecordBatch, columns: list[str]):
    """Slices of a batch with a bounded number of edges, or of one row."""
    sizes = sum(np.asarray(pc.fill_null(pc.list_value_length(batch[c]), 0)) for c in columns) // FIELDS
    total, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BATCH, "right")))
        yield batch.slice(at, to - at)
        at = to


def cell_areas(cells: DataFrame, keys: list[str], layers: list[str], kinds: dict, size: float) -> DataFrame:
    """(*keys, *kinds): areas of cells (*keys, cx, and a column of edges for each layer), by the counters of the layers."""
    schema = T.StructType([*[cells.schema[k] for k in keys], *[T.StructField(k, T.DoubleType()) for k in kinds]])

    def run(batches):
        for whole in batches:
            for batch in _in_batches(whole, layers):
                e = _edges_of([batch[c] for c in layers])
                right = (np.asarray(batch["cx"], float) + 1) * size
                found = arrangement.strip_areas(e, batch.num_rows, len(layers), kinds, right)
                yield pa.RecordBatch.from_arrays([*[batch[k] for k in keys], *[pa.array(found[k]) for k in kinds]], names=[*keys, *kinds])

    return cells.select(*keys, *[c for c in ("cx",) if c not in keys], *layers).mapInArrow(run, schema)


def _covered(counts: np.ndarray) -> np.ndarray:
    return (counts[0] > 0).astype(np.int64)


def _winding(counts: np.ndarray) -> np.ndarray:
    return counts[0]


def gathered(parts: DataFrame, keys: list[str], name: str = "edges") -> DataFrame:
    """The pieces of each cell in one row."""
    return parts.groupBy(*keys, "cx", "cy").agg(F.flatten(F.collect_list("edges")).alias(name))


def thinned(parts: DataFrame, keys: list[str], size: float, stages: Stages) -> DataFrame:
    """Pieces of which no cell has many more than ``CROWD`` edges, if their union allows it.

    Crowded cells are dealt to parts of bounded size, each is united, and the boundaries of the unions take the place of
    the pieces; this goes on while it makes cells smaller. Counts come first, so other cells are left alone.
    """
    turn = 0
    parts = stages.keep(parts, "pieces-0")
    while True:
        load = parts.groupBy(*keys, "cx", "cy").agg(F.sum(F.size("edges") / FIELDS).alias("n"), F.count("*").alias("many"))
        crowded = load.filter((F.col("n") > CROWD) & (F.col("many") > 1)).select(*keys, "cx", "cy", F.least(F.col("many") / 2, F.ceil(F.col("n") / CROWD)).cast("int").alias("salts"))
        crowded = stages.keep(crowded, f"crowded-{turn}")
        before = crowded.count()
        if not before or turn > 20:
            return parts
        at = [*keys, "cx", "cy"]
        met = parts.alias("p").join(crowded.alias("c"), _same("p", "c", at), "left")
        calm = met.filter("salts is null").select("p.*")
        salted = met.filter("salts is not null").select("p.*", F.pmod(F.xxhash64("edges"), F.col("salts")).alias("_salt"))
        united = _united(salted.groupBy(*at, "_salt").agg(F.flatten(F.collect_list("edges")).alias("edges")), at, size).select(*at, "edges")
        turn += 1
        following = stages.keep(calm.unionByName(united), f"pieces-{turn}")
        stages.drop(f"pieces-{turn - 1}")
        parts = following
        if crowded.agg(F.sum("salts")).first()[0] <= before:
            return parts


def _united(cells: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Cells with the edges of the union of their pieces instead of all edges."""
    schema = cells.schema

    def run(batches):
        for whole in batches:
            for batch in _in_batches(whole, ["edges"]):
                e = _edges_of([batch["edges"]])
                n = batch.num_rows
                x = np.asarray(batch["cx"], float) * size
                own, numbers = arrangement.outline(e, np.stack([x, x + size], 1))
                offsets = pa.array(np.searchsorted(own, np.arange(n + 1)) * FIELDS, pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(numbers.reshape(-1)))
                yield pa.RecordBatch.from_arrays([lists if f.name == "edges" else batch[f.name] for f in schema], names=[f.name for f in schema])

    return cells.mapInArrow(run, schema)


_LINE = "label long, sx double, sy double, ex double, ey double, out double, back double, points array<double>, axis string, line long, cell long, low double, high double, sign int"


def _cell_lines(cells: DataFrame, keys: list[str], size: float, label) -> DataFrame:
    """The boundaries of faces in each cell: polylines inside (closed or from border to border), and stretches of borders.

    A stretch has its axis (v: up a column's left border, h: along a row's lower border), the number of that line and the cell
    along it; sign 1 runs up or to the right.
    """
    schema = T.StructType([*[cells.schema[k] for k in keys], *T._parse_datatype_string(_LINE).fields])
    names = [f.name for f in schema][len(keys) :]

    def run(batches):
        for whole in batches:
            for batch in _in_batches(whole, ["edges"]):
                cx, cy = np.asarray(batch["cx"]), np.asarray(batch["cy"])
                box = np.stack([cx * size, cy * size, (cx + 1) * size, (cy + 1) * size], 1).astype(float)
                s = arrangement.boundaries(_edges_of([batch["edges"]]), 1, label, box)
                b = box[s.group]
                up, along = s.x0 == s.x1, s.y0 == s.y1
                border = (up & ((s.x0 == b[:, 0]) | (s.x0 == b[:, 2]))) | (along & ((s.y0 == b[:, 1]) | (s.y0 == b[:, 3])))
                rows, at = [], []
                for k in np.flatnonzero(border):
                    g, v = s.group[k], bool(up[k])
                    lo, hi = (s.y0[k], s.y1[k]) if v else (s.x0[k], s.x1[k])
                    line = cx[g] + int(s.x0[k] == b[k, 2]) if v else cy[g] + int(s.y0[k] == b[k, 3])
                    at.append(g)
                    rows.append((int(s.label[k]), *[None] * 7, "v" if v else "h", int(line), int(cy[g] if v else cx[g]), float(min(lo, hi)), float(max(lo, hi)), 1 if hi > lo else -1))
                inner = np.flatnonzero(~border)
                inner = inner[np.lexsort((s.label[inner], s.group[inner]))]
                heads = np.flatnonzero(np.r_[True, (np.diff(s.group[inner]) != 0) | (np.diff(s.label[inner]) != 0)]) if len(inner) else []
                for lo, hi in zip(heads, [*heads[1:], len(inner)], strict=True):
                    own = inner[lo:hi]
                    for points, _ in arrangement.chains(*[v[own].tolist() for v in (s.x0, s.y0, s.x1, s.y1, s.source)]):
                        at.append(s.group[own[0]])
                        (ax, ay), (bx, by), (yx, yy), (zx, zy) = points[0], points[1], points[-2], points[-1]
                        rows.append((int(s.label[own[0]]), ax, ay, zx, zy, float(np.arctan2(by - ay, bx - ax)), float(np.arctan2(yy - zy, yx - zx)), [v for p in points for v in p], *[None] * 6))
                kinds = {"label": pa.int64(), "line": pa.int64(), "cell": pa.int64(), "axis": pa.string(), "sign": pa.int32(), "points": pa.list_(pa.float64())}
                made = [pa.array(v, kinds.get(n, pa.float64())) for n, v in zip(names, zip(*rows, strict=True) if rows else [[]] * len(names), strict=True)]
                index = pa.array(np.array(at, np.int64))
                yield pa.RecordBatch.from_arrays([*[batch[k].take(index) for k in keys], *made], names=[*keys, *names])

    return cells.mapInArrow(run, schema)


def _left_on_borders(lines: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Stretches of cell borders that the two sides do not cancel, as polylines of two points."""
    on = [*keys, "label", "axis", "line", "cell"]
    rows = lines.filter(F.col("axis").isNotNull())
    ends = rows.select(*on, F.explode(F.array(F.struct(F.col("low").alias("at"), F.col("sign").alias("d")), F.struct(F.col("high").alias("at"), (-F.col("sign")).alias("d")))).alias("e"))
    sums = ends.groupBy(*on, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    along = Window.partitionBy(*on).orderBy("at")
    net = sums.withColumn("net", F.sum("d").over(along)).withColumn("to", F.lead("at").over(along)).filter("net <> 0 and `to` is not null")
    place, fore = F.col("line") * F.lit(float(size)), F.col("net") > 0
    low, high = F.when(fore, F.col("at")).otherwise(F.col("to")), F.when(fore, F.col("to")).otherwise(F.col("at"))
    v = F.col("axis") == "v"
    xy = {"sx": F.when(v, place).otherwise(low), "sy": F.when(v, low).otherwise(place), "ex": F.when(v, place).otherwise(high), "ey": F.when(v, high).otherwise(place)}
    turned = net.select(*keys, "label", *[e.alias(n) for n, e in xy.items()])
    angle = F.atan2(F.col("ey") - F.col("sy"), F.col("ex") - F.col("sx"))
    back = F.atan2(F.col("sy") - F.col("ey"), F.col("sx") - F.col("ex"))
    return turned.select(*keys, "label", "sx", "sy", "ex", "ey", angle.alias("out"), back.alias("back"), F.array("sx", "sy", "ex", "ey").alias("points"))


def _same(a: str, b: str, columns: list[str]) -> list[Column]:
    return [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns]


_RING = "ring array<array<double>>, area double, length double"


def _ring_of(size: float, keys: list[str], schema: T.StructType):
    """The polylines of one ring in order, without points in the middle of straight runs over grid lines."""

    def run(table: pa.Table) -> pa.Table:
        rows = {n: table[n].to_pylist() for n in ("id", "next", "points")}
        by_id = {i: k for k, i in enumerate(rows["id"])}
        k, xy = by_id[min(rows["id"])], []
        for _ in rows["id"]:
            xy += rows["points"][k][:-2]
            k = by_id.get(rows["next"][k], k)
        p = np.array(xy).reshape(-1, 2)
        while len(p) > 3:
            before, after = p - np.roll(p, 1, 0), np.roll(p, -1, 0) - p
            cross, dot = before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0], (before * after).sum(1)
            on_grid = ((p == np.round(p / size) * size)).any(1)
            straight = on_grid & (np.abs(cross) <= 1e-9 * dot)
            straight &= ~np.roll(straight, 1)  # one of two neighbours at a time
            if not straight.any():
                break
            p = p[~straight]
        q = np.roll(p, -1, 0)
        o = p - p[0]
        area = float((o[:, 0] * (q - p[0])[:, 1] - (q - p[0])[:, 0] * o[:, 1]).sum() / 2)
        length = float(np.sqrt(((q - p) ** 2).sum(1)).sum())
        ring = [*p.tolist(), p[0].tolist()]
        head = table.slice(0, 1)
        values = [*[head[k] for k in [*keys, "label"]], pa.array([ring], pa.list_(pa.list_(pa.float64()))), pa.array([area]), pa.array([length])]
        return pa.table(dict(zip([f.name for f in schema], values, strict=True)))

    return run


def _stitched(lines: DataFrame, keys: list[str], size: float, stages: Stages) -> DataFrame:
    """Rings of polylines: each finds what begins where it ends, and the least number on a ring is its name."""
    schema = T.StructType([*[lines.schema[k] for k in keys], lines.schema["label"], *T._parse_datatype_string(_RING).fields])
    shown = lines.select(*keys, "label", "sx", "sy", "ex", "ey", "out", "back", "points").filter("sx is not null")
    nodes = shown.unionByName(_left_on_borders(lines, keys, size)).withColumn("id", F.monotonically_increasing_id())
    nodes = stages.keep(nodes, "nodes")
    open_ends = nodes.filter("sx <> ex or sy <> ey")
    a, b = open_ends.alias("a"), open_ends.alias("b")
    meets = [*_same("a", "b", [*keys, "label"]), F.col("a.ex") == F.col("b.sx"), F.col("a.ey") == F.col("b.sy")]
    full = 2 * np.pi
    turn = F.pmod(F.col("a.back") - F.col("b.out"), F.lit(full))
    turn = F.when(turn == 0, F.lit(full)).otherwise(turn)
    follow = a.join(b, meets).groupBy(F.col("a.id").alias("id")).agg(F.min_by(F.col("b.id"), turn).alias("next"))
    follow = stages.keep(follow, "follow")
    jumps, turns = stages.keep(follow.select("id", F.col("next").alias("jump"), F.least("id", "next").alias("low")), "jumps-0"), 0
    while turns < 64:  # twice as far each time
        j, k = jumps.alias("j"), jumps.alias("k")
        grown = j.join(k, F.col("j.jump") == F.col("k.id")).select("j.id", F.col("k.jump").alias("jump"), F.least("j.low", "k.low").alias("low"), (F.col("k.low") < F.col("j.low")).alias("moved"))
        turns += 1
        grown = stages.keep(grown, f"jumps-{turns}")
        stages.drop(f"jumps-{turns - 1}")
        jumps = grown.drop("moved")
        if not grown.filter("moved").take(1):
            break
    closed = nodes.filter("sx = ex and sy = ey").withColumns({"next": F.col("id"), "low": F.col("id")})
    named = nodes.join(follow, "id").join(jumps.select("id", "low"), "id").unionByName(closed.select(*nodes.columns, "next", "low"))
    return named.groupBy("low").applyInArrow(_ring_of(size, keys, schema), schema)


def _private(df: DataFrame, keys: list[str], region: str) -> tuple[DataFrame, list[str]]:
    """The subjects' columns under names that nothing here uses, and the names."""
    names = [f"_key{k}" for k in range(len(keys))]
    return df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], F.col(f"`{region}`").alias("_shape")), names


def _public(rings: DataFrame, keys: list[str]) -> DataFrame:
    return rings.select(*[F.col(f"_key{k}").alias(name) for k, name in enumerate(keys)], "label", "ring", "area", "length")


def dissolved(df: DataFrame, keys: list[str], region: str, size: float, stages: Stages) -> DataFrame:
    """(*keys, label, ring, area, length): the boundary of the union of the regions of each subject (``keys``).

    A ring has the union on its left: shells have positive areas, holes negative ones; label is 1. Rings that
    touch themselves in a point are one ring. A null region adds nothing, and a subject without any has no row; null
    keys are a subject. ``size`` is the grid: it changes the work, not the result (points on straight lines over grid
    lines are left out).
    """
    own, names = _private(df, keys, region)
    parts = thinned(pieces(own, names, "_shape", size), names, size, stages)
    return _public(_stitched(stages.keep(_cell_lines(gathered(parts, names), names, size, _covered), "lines"), names, size, stages), keys)


def faces(df: DataFrame, keys: list[str], region: str, size: float, stages: Stages) -> DataFrame:
    """(*keys, label, ring, area, length) of the faces into which the rings of each subject cut the plane, as they turn.

    label is the winding number of a face (never 0): rings that turn left count one, rings that turn right take one away,
    so the lobes of a figure of eight differ in sign and nested rings add up. A positive area is the outer
    boundary of a face, a negative one a hole in it. Winding numbers add up, so crowded cells cannot be united in parts
    first: ``size`` should leave few rings of a subject in one cell.
    """
    own, names = _private(df, keys, region)
    cells = gathered(pieces(own, names, "_shape", size, as_given=True), names)
    return _public(_stitched(stages.keep(_cell_lines(cells, names, size, _winding), "lines"), names, size, stages), keys)


def roles(rings: DataFrame, thin: float) -> DataFrame:
    """Add ``role``: hole, or of a face shell, reversed (winding below 0), overlap (above 1) or sliver (4 pi area / length^2 below ``thin``)."""
    round_ = 4 * np.pi * F.abs("area") / (F.col("length") * F.col("length"))
    role = F.when(F.col("area") < 0, "hole").when(round_ < thin, "sliver").when(F.col("label") < 0, "reversed").when(F.col("label") > 1, "overlap").otherwise("shell")
    return rings.withColumn("role", role)
