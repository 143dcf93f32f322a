"""Arrangements of edges by a sweep: coverage counts of strips, their areas, and the boundaries of faces.

Edges of many groups are swept together. They are cut into levels (every end and every crossing), and between two
levels no edge crosses another; from left to right a counter for each layer says how many polygons of that layer
cover a strip, so the work follows the edges that are active at a level, not polygons times edges. What a strip is
to be decides its label; faces are regions of one label, and their boundaries are the half edges at which labels
change, with the face on the left.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

ACTIVE = 1 << 20  # edges of levels that are looked at together
SAME = 1e-9  # of a group's extent: places on one level that are closer are one


@dataclass
class Edges:
    """Edges from bottom to top: (group, layer, xb, yb, xt, yt, weight). The counter grows by weight to the right of an edge.

    A polygon with its interior on the left has weight 1 where it goes down and -1 where it goes up.
    """

    group: np.ndarray
    layer: np.ndarray
    xb: np.ndarray
    yb: np.ndarray
    xt: np.ndarray
    yt: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, group, layer, x0, y0, x1, y1, turn) -> Edges:
        """Directed edges as they come; horizontal ones bound no strip and are left out."""
        up, keep = y1 > y0, y1 != y0
        low, high = np.where(up, x0, x1), np.where(up, x1, x0)
        parts = (group, layer, low, np.minimum(y0, y1), high, np.maximum(y0, y1), np.where(up, -turn, turn))
        return cls(*[np.asarray(p)[keep] for p in parts])

    def __len__(self) -> int:
        return len(self.xb)

    def take(self, at) -> Edges:
        return Edges(self.group[at], self.layer[at], self.xb[at], self.yb[at], self.xt[at], self.yt[at], self.weight[at])


@dataclass
class Active:
    """Edges between neighbouring levels, from left to right: level below, edge, x below and above."""

    slab: np.ndarray
    edge: np.ndarray
    low: np.ndarray
    high: np.ndarray


def region_edges(regions: list[tuple[int, int, list]]) -> Edges:
    """Edges of (group, layer, region): shells count one and holes take one away, whichever way rings turn."""
    rings = [(g, k, np.asarray(ring, float), n > 0) for g, k, region in regions for polygon in region for n, ring in enumerate(polygon) if len(ring) > 1]
    if not rings:
        none = np.zeros(0)
        return Edges(none.astype(int), none.astype(int), none, none, none, none, none.astype(int))
    sizes = [len(r) - 1 for _, _, r, _ in rings]
    a, b = np.concatenate([r[:-1] for _, _, r, _ in rings]), np.concatenate([r[1:] for _, _, r, _ in rings])
    which = np.repeat(np.arange(len(rings)), sizes)
    origin = np.array([r[0] for _, _, r, _ in rings])[which]
    p, q = a - origin, b - origin
    turns = np.bincount(which, p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1], len(rings)) > 0
    hole = np.array([h for _, _, _, h in rings])
    own = lambda k: np.array([r[k] for r in rings])[which]
    return Edges.of(own(0), own(1), a[:, 0], a[:, 1], b[:, 0], b[:, 1], np.where(turns != hole, 1, -1)[which])


def _levels(e: Edges, more: tuple[np.ndarray, np.ndarray]):
    """(group, y) of all levels in order, and the levels of the edges' ends."""
    groups, ys = np.concatenate([e.group, e.group, more[0]]), np.concatenate([e.yb, e.yt, more[1]])
    order = np.lexsort((ys, groups))
    g, y = groups[order], ys[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (y[1:] != y[:-1])] if len(g) else np.zeros(0, bool)
    place = np.empty(len(g), np.int64)
    place[order] = np.cumsum(new) - 1
    return g[new], y[new], place[: len(e)], place[len(e) : 2 * len(e)]


def _active(e: Edges, y: np.ndarray, first: np.ndarray, last: np.ndarray, begin: int, end: int, tolerance: np.ndarray) -> Active:
    """The edges between the levels begin .. end, sorted by slab and from left to right; near places on a level are made one."""
    lo, hi = np.maximum(first, begin), np.minimum(last, end)
    used = np.flatnonzero(hi > lo)
    many = (hi - lo)[used]
    edge = np.repeat(used, many)
    slab = np.arange(len(edge)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[used], many)
    slope = (e.xt - e.xb) / (e.yt - e.yb)
    ends = []
    for level, exact_at, exact_x in ((slab, first, e.xb), (slab + 1, last, e.xt)):
        exact = level == exact_at[edge]
        ends.append((level, np.where(exact, exact_x[edge], e.xb[edge] + (y[level] - e.yb[edge]) * slope[edge]), exact))
    level, x, exact = (np.concatenate(v) for v in zip(*ends, strict=True))
    order = np.lexsort((~exact, x, level))
    near = np.r_[True, (np.diff(level[order]) != 0) | (np.diff(x[order]) > tolerance[e.group[np.r_[edge, edge][order[1:]]]])] if len(x) else np.zeros(0, bool)
    cluster = np.empty(len(x), np.int64)
    cluster[order] = np.cumsum(near) - 1
    ranked = np.lexsort((x, ~exact, cluster))
    heads = ranked[np.r_[True, np.diff(cluster[ranked]) != 0]] if len(x) else ranked
    x = np.where(exact, x, x[heads][cluster])  # ends stay where they are; places between ends give way
    low, high = x[: len(edge)], x[len(edge) :]
    order = np.lexsort((high, low, slab))
    return Active(slab[order], edge[order], low[order], high[order])


def _crossings(e: Edges, y: np.ndarray, a: Active) -> tuple[np.ndarray, np.ndarray]:
    """(group, y) where edges that are in order below change places within their slab."""
    falls = (a.slab[1:] == a.slab[:-1]) & (a.high[1:] < a.high[:-1])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for s in np.unique(a.slab[1:][falls]):
        lo, hi = np.searchsorted(a.slab, [s, s + 1])
        high = a.high[lo:hi]
        later = np.minimum.accumulate(high[::-1])[::-1]
        involved = np.flatnonzero((high > np.r_[later[1:], np.inf]) | (high < np.r_[-np.inf, np.maximum.accumulate(high)[:-1]]))
        i, j = np.triu_indices(len(involved), 1)
        i, j = involved[i], involved[j]
        cross = (high[i] > high[j]) & (a.low[lo:hi][i] < a.low[lo:hi][j])
        i, j = i[cross] + lo, j[cross] + lo
        gap, back = a.low[j] - a.low[i], a.high[i] - a.high[j]
        at = y[s] + (y[s + 1] - y[s]) * (gap / (gap + back))
        inside = (at > y[s]) & (at < y[s + 1])
        found.append((e.group[a.edge[i]][inside], at[inside]))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, e.group.dtype), np.zeros(0))


def _bands(first: np.ndarray, last: np.ndarray, levels: int) -> Iterator[tuple[int, int]]:
    """Ranges of levels with a bounded number of active edges each, or of one level."""
    active = np.cumsum(np.bincount(first, minlength=levels + 1) - np.bincount(last, minlength=levels + 1))
    total, at = np.cumsum(active), 0
    while at < levels:
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + ACTIVE, "right")))
        yield at, min(to, levels)
        at = to


def sweep(e: Edges, tolerance: np.ndarray, extra: tuple[np.ndarray, np.ndarray] | None = None, whole: bool = False):
    """Level groups, level heights and the active edges of all slabs, in bands (one band if ``whole``).

    ``tolerance`` by group; ``extra``: further levels (group, y).
    """
    more = extra or (np.zeros(0, np.int64), np.zeros(0))
    for _ in range(8):  # new levels may show crossings that were hidden by rounding
        g, y, first, last = _levels(e, more)
        bands = [(0, len(y))] if whole else list(_bands(first, last, len(y)))
        found = [_crossings(e, y, _active(e, y, first, last, *band, tolerance)) for band in bands if band[1] > band[0]]
        if not any(len(f[0]) for f in found):
            break
        more = tuple(np.concatenate([more[k], *[f[k] for f in found]]) for k in (0, 1))
        g2, y2, first, last = _levels(e, more)
        if len(y2) == len(y):
            break
    g, y, first, last = _levels(e, more)
    bands = [(0, len(y))] if whole else list(_bands(first, last, len(y)))
    return g, y, (_active(e, y, first, last, *band, tolerance) for band in bands if band[1] > band[0])


def _counts(e: Edges, a: Active, layers: int) -> np.ndarray:
    """The counter of each layer right of each active edge."""
    starts = np.r_[0, np.flatnonzero(np.diff(a.slab)) + 1]
    out = np.zeros((layers, len(a.slab)), np.int64)
    for k in range(layers):
        sums = np.cumsum(np.where(e.layer[a.edge] == k, e.weight[a.edge], 0))
        out[k] = sums - np.repeat(np.r_[0, sums[starts[1:] - 1]], np.diff(np.r_[starts, len(sums)]))
    return out


def spans(e: Edges, groups: int) -> np.ndarray:
    """Tolerances of groups, from their extents."""
    wide = np.zeros(groups)
    np.maximum.at(wide, e.group, np.maximum(np.abs(e.xb), np.abs(e.xt)))
    return np.maximum(wide, 1e-300) * SAME * 1e-3


def strip_areas(e: Edges, groups: int, layers: int, kinds: dict[str, Callable], right: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """For each group the areas of the strips whose counters satisfy each of ``kinds``.

    ``right``: where strips end that no edge closes, by group (cells of a grid).
    """
    sums = {k: np.zeros(groups) for k in kinds}
    if not len(e):
        return sums
    g, y, bands = sweep(e, spans(e, groups))
    for a in bands:
        if not len(a.slab):
            continue
        counts = _counts(e, a, layers)
        last = np.r_[a.slab[1:] != a.slab[:-1], True]
        owner = g[a.slab]
        end = np.zeros(len(a.slab)) if right is None else right[owner]
        nxt = lambda v: np.where(last, end if right is not None else v, np.r_[v[1:], 0.0])  # noqa: B023, E731
        area = ((nxt(a.low) - a.low) + (nxt(a.high) - a.high)) / 2 * (y[a.slab + 1] - y[a.slab])
        for name, kind in kinds.items():
            sums[name] += np.bincount(owner, np.where(kind(counts), area, 0.0), groups)
    return sums


def outline(e: Edges, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges at which cover begins or ends: (group, numbers), in the order of groups; ``sides``: x of the left and right side by group.

    What is covered up to the right side stays open there, as it came. Pieces of one edge in neighbouring slabs are one again.
    """
    g, y, bands = sweep(e, (sides[:, 1] - sides[:, 0]) * SAME, whole=True)
    a = next(bands, None)
    if a is None or not len(a.slab):
        return np.zeros(0, np.int64), np.zeros((0, 5))
    covered = (_counts(e, a, 1)[0] > 0).astype(np.int64)
    begins = np.r_[True, a.slab[1:] != a.slab[:-1]]
    change = covered - np.where(begins, 0, np.r_[0, covered[:-1]])
    at = np.flatnonzero(change)
    at = at[np.lexsort((a.slab[at], a.edge[at]))]
    slab, edge, low, high, change = a.slab[at], a.edge[at], a.low[at], a.high[at], change[at]
    head = np.r_[True, (np.diff(edge) != 0) | (np.diff(slab) != 1) | (np.diff(change) != 0)]
    first = np.flatnonzero(head)
    last = np.r_[first[1:], len(at)] - 1
    own = e.group[edge[first]]
    numbers = np.stack([low[first], y[slab[first]], high[last], y[slab[last] + 1], change[first].astype(float)], 1)
    order = np.argsort(own, kind="stable")
    return own[order], numbers[order]


@dataclass
class Segments:
    """Directed segments with the face of ``label`` on their left; ``source`` tells pieces of one edge (-1: level)."""

    group: np.ndarray
    label: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray
    source: np.ndarray


def boundaries(e: Edges, layers: int, label: Callable[[np.ndarray], np.ndarray], cells: np.ndarray) -> Segments:
    """Boundaries of the faces of groups that fill the boxes ``cells`` (x0, y0, x1, y1 by group); 0 is no face."""
    n = len(cells)
    ids = np.arange(n)
    tolerance = (cells[:, 2] - cells[:, 0]) * SAME
    g, y, bands = sweep(e, tolerance, (np.r_[ids, ids], np.r_[cells[:, 1], cells[:, 3]]), whole=True)
    a = next(bands)
    face = label(_counts(e, a, layers)) if len(a.slab) else np.zeros(0, np.int64)
    # Edges in the same place are one: the last of them has the label to its right.
    same = (a.slab[1:] == a.slab[:-1]) & (a.low[1:] == a.low[:-1]) & (a.high[1:] == a.high[:-1])
    keep = np.r_[~same, True] if len(a.slab) else np.zeros(0, bool)
    slab, edge, low, high, face = a.slab[keep], a.edge[keep], a.low[keep], a.high[keep], face[keep]
    begins = np.r_[True, slab[1:] != slab[:-1]] if len(slab) else np.zeros(0, bool)
    before = np.where(begins, 0, np.r_[0, face[:-1]]) if len(slab) else face
    closes = np.r_[slab[1:] != slab[:-1], True] if len(slab) else begins
    out = []

    def put(level_group, lab, x0, y0, x1, y1, source):
        out.append((level_group, lab, x0, y0, x1, y1, source))

    y0, y1, owner = y[slab], y[slab + 1] if len(slab) else y[:0], g[slab]
    for which, lab in ((before != face) & (before != 0), before), ((before != face) & (face != 0), face):
        up = lab is before
        x, at = (low, y0), (high, y1)
        (sx, sy), (tx, ty) = (x, at) if up else (at, x)
        put(owner[which], lab[which], sx[which], sy[which], tx[which], ty[which], edge[which])
    right = closes & (face != 0)
    edge_x = cells[owner[right], 2]
    put(owner[right], face[right], edge_x, y0[right], edge_x, y1[right], np.full(right.sum(), -2))
    # Levels: labels below and above change where the strips of either slab begin.
    change = before != face
    level = np.concatenate([np.arange(len(y)), np.arange(len(y)), slab[change], slab[change] + 1])
    xs = np.concatenate([cells[g, 0], cells[g, 0], low[change], high[change]])
    above = np.concatenate([np.ones(len(y), bool), np.zeros(len(y), bool), np.ones(change.sum(), bool), np.zeros(change.sum(), bool)])
    lab = np.concatenate([np.zeros(2 * len(y), np.int64), face[change], face[change]])
    rank = np.concatenate([np.full(2 * len(y), -1), np.arange(change.sum()), np.arange(change.sum())])
    order = np.lexsort((rank, xs, level))
    level, xs, above, lab = level[order], xs[order], above[order], lab[order]
    at = np.arange(len(level))
    up_at, down_at = np.maximum.accumulate(np.where(above, at, -1)), np.maximum.accumulate(np.where(above, -1, at))
    ends = np.r_[(level[1:] != level[:-1]) | (xs[1:] != xs[:-1]), True]
    level, xs, top, bottom = level[ends], xs[ends], lab[up_at[ends]], lab[down_at[ends]]
    to = np.r_[xs[1:], 0.0]
    last = np.r_[level[1:] != level[:-1], True]
    to = np.where(last, cells[g[level], 2], to)
    wide = (top != bottom) & (to > xs)
    for which, face_of, forward in ((wide & (top != 0), top, True), (wide & (bottom != 0), bottom, False)):
        a0, a1 = (xs, to) if forward else (to, xs)
        put(g[level[which]], face_of[which], a0[which], y[level[which]], a1[which], y[level[which]], np.full(which.sum(), -1))
    return Segments(*[np.concatenate(v) for v in zip(*out, strict=True)])


def chains(x0, y0, x1, y1, source) -> list[tuple[list[tuple[float, float]], bool]]:
    """Directed segments of one face label to polylines (points, closed), the face on the left.

    Where several go on, the sharpest turn to the left is taken, so that faces which touch in a point stay apart.
    Points between pieces of one edge are left out.
    """
    starts: dict[tuple[float, float], list[int]] = {}
    for k, p in enumerate(zip(x0, y0, strict=True)):
        starts.setdefault(p, []).append(k)
    ends = set(zip(x1, y1, strict=True))
    angle = lambda k: math.atan2(y1[k] - y0[k], x1[k] - x0[k])

    def onward(k: int) -> int | None:
        options = starts.get((x1[k], y1[k]))
        if not options:
            return None
        if len(options) > 1:
            back = math.atan2(y0[k] - y1[k], x0[k] - x1[k])
            options.sort(key=lambda j: (back - angle(j)) % (2 * math.pi) or 2 * math.pi, reverse=True)
        return options.pop()

    out = []
    loose = [k for p, own in starts.items() if p not in ends for k in own]
    for begin in [*loose, *range(len(x0))]:
        own = starts.get((x0[begin], y0[begin]), ())
        if begin not in own:
            continue
        own.remove(begin)
        path, k = [begin], onward(begin)
        while k is not None:
            path.append(k)
            k = onward(k)
        closed = (x1[path[-1]], y1[path[-1]]) == (x0[begin], y0[begin])
        joined = lambda i, j: source[i] == source[j] and (source[i] >= 0 or x0[i] == x1[j] or y0[i] == y1[j])
        points = [(x0[begin], y0[begin])] + [(x0[j], y0[j]) for i, j in zip(path, path[1:], strict=False) if not joined(i, j)]
        if closed and len(path) > 1 and joined(path[-1], begin):
            points = points[1:]
        out.append((points + ([points[0]] if closed else [(x1[path[-1]], y1[path[-1]])]), closed))
    return out
