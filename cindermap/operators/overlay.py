"""Overlay of general polygons: intersections, unions, clips and their outlines.

A polygon is the column ``rings``, an array of rings (arrays of (x, y) structs that may repeat their first vertex); what an odd
number of rings surrounds is inside, so holes and parts need no flags. Bounds give candidate pairs by an equi-join on grid
cells. One sweep decides every overlay: between two neighbouring heights of vertices and crossings no edges cross, so the edges'
order at the middle tells where the result lies, exactly, whatever touches or coincides.

Pairs are swept one by one. Unions (of a group's polygons, or of a clip's regions) are swept grid cell by grid cell, after
identical polygons are made one, so a large union is many tasks: areas are summed, and pieces of outline meet again in blocks of cells, after those on borders between covered
cells have cancelled in an aggregation. Rings inside a block are put together there; only pieces that hang together over blocks' borders meet across them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindermap.operators.graph import components, joined
from cindermap.sources.shared import spread, staged, tasks

POINT = "struct<x:double,y:double>"
RINGS = f"array<array<{POINT}>>"
SEGMENTS = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
#: Cells of the matrix of slabs and edges that a sweep works on at once.
AT_ONCE = 1 << 20
#: Vertices nearer than this are one, and pieces of less area are none.
EPS = 1e-9
#: Cells on a side of the blocks in which rings are put together.
BLOCK = 16
Op = Callable[[list[np.ndarray]], np.ndarray]


def as_rings(*rings: Column) -> Column:
    """``rings`` of a polygon whose rings are columns (arrays of x, y structs)."""
    return F.array(*[F.transform(r, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))) for r in rings])


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A rectangle as a ring."""
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


def bounds(layer: DataFrame) -> DataFrame:
    """x0, y0, x1, y1 of ``rings``; rows without a vertex go."""
    at = lambda f, k: f(F.transform(F.flatten("rings"), lambda p: p[k]))
    made = layer.withColumns({"x0": at(F.array_min, "x"), "y0": at(F.array_min, "y"), "x1": at(F.array_max, "x"), "y1": at(F.array_max, "y")})
    return made.where(F.col("x0").isNotNull())


def rings_of(column: pa.Array) -> list[list[np.ndarray]]:
    """The rings of every row, as arrays of vertices."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ring = column.values
    xy = np.stack([ring.values.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y")], 1) if len(ring.values) else np.zeros((0, 2))
    edges, rows = ring.offsets.to_numpy(), column.offsets.to_numpy()
    return [[xy[edges[i] : edges[i + 1]] for i in range(a, b)] for a, b in zip(rows, rows[1:], strict=False)]


def rings_column(rows: list[list[np.ndarray]]) -> pa.Array:
    flat = [ring for rings in rows for ring in rings]
    xy = np.concatenate(flat) if flat else np.zeros((0, 2))
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])
    inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in flat])]).astype(np.int32)), points)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)), inner)


class Edges:
    """Edges that are not level, lower end first; ``shape`` numbers their polygon, ``role`` its part in the overlay."""

    def __init__(self, polygons: list[tuple[int, list[np.ndarray]]]):
        lines, shape, role = [np.zeros((0, 4))], [], []
        for i, (r, rings) in enumerate(polygons):
            for ring in rings:
                own = np.hstack([ring, np.roll(ring, -1, 0)])
                own = own[own[:, 1] != own[:, 3]]
                lines.append(np.where((own[:, 1] < own[:, 3])[:, None], own, own[:, [2, 3, 0, 1]]))
                shape += [i] * len(own)
                role += [r] * len(own)
        self.x0, self.y0, self.x1, self.y1 = np.concatenate(lines).T
        self.shape, self.role = np.array(shape, np.int64), np.array(role, np.int64)
        self.slope = (self.x1 - self.x0) / (self.y1 - self.y0)

    def at(self, y: np.ndarray, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        x = self.x0[which] + self.slope[which] * (y - self.y0[which])
        return np.where(y == self.y1[which], self.x1[which], x)

    def heights(self) -> np.ndarray:
        """All heights at which an edge starts, ends or crosses another."""
        found = [self.y0, self.y1]
        n = len(self.x0)
        at_once = max(1, AT_ONCE // max(n, 1))
        for a in range(0, n, at_once):
            own = slice(a, min(n, a + at_once))
            with np.errstate(divide="ignore", invalid="ignore"):
                # From each edge's lower end, so that large coordinates cost no digits.
                gap = self.x0[None] + self.slope[None] * (self.y0[own, None] - self.y0[None]) - self.x0[own, None]
                y = self.y0[own, None] + gap / (self.slope[own, None] - self.slope[None])
            low, high = np.maximum(self.y0[own, None], self.y0[None]), np.minimum(self.y1[own, None], self.y1[None])
            found.append(y[(y > low) & (y < high)])
        return np.unique(np.concatenate(found))


def slabs(edges: Edges, op: Op, roles: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bottom and top of slabs, each slab's edges from left to right, their places at half height, and whether the result lies right of each."""
    ys = edges.heights()
    n = len(edges.x0)
    at_once = max(1, AT_ONCE // max(n, 1))
    for a in range(0, len(ys) - 1, at_once):
        low, high = ys[a : a + at_once + 1][:-1], ys[a : a + at_once + 1][1:]
        active = (edges.y0[None] <= low[:, None]) & (edges.y1[None] >= high[:, None])
        own = np.flatnonzero(active.any(0))
        if not len(own):
            continue
        middle = np.where(active[:, own], edges.at(((low + high) / 2)[:, None], own[None]), np.inf)
        order = np.argsort(middle, axis=1, kind="stable")
        x, which = np.take_along_axis(middle, order, 1), own[order]
        # Every second edge of a polygon leaves it.
        shape = np.where(np.isfinite(x), edges.shape[which], -1)
        by_shape = np.argsort(shape, axis=1, kind="stable")
        grouped = np.take_along_axis(shape, by_shape, 1)
        place = np.arange(shape.shape[1])[None] + np.zeros((len(shape), 1), np.int64)
        first = np.maximum.accumulate(np.where(np.diff(grouped, axis=1, prepend=-2) != 0, place, 0), axis=1)
        turn = np.empty_like(place)
        np.put_along_axis(turn, by_shape, (place - first) % 2, 1)
        step = np.where(np.isfinite(x), 1 - 2 * turn, 0)
        role = edges.role[which]
        inside = op([np.cumsum(step * (role == r), axis=1) > 0 for r in range(roles)])
        inside[:, -1] = False
        yield low, high, which, x, inside


def swept_area(edges: Edges, op: Op, roles: int = 2) -> float:
    total = 0.0
    for low, high, _, x, inside in slabs(edges, op, roles):
        with np.errstate(invalid="ignore"):
            width = np.diff(x, axis=1)
        total += float((np.where(inside[:, :-1], width, 0).sum(1) * (high - low)).sum())
    return total


def level(below: list[tuple[float, float]], above: list[tuple[float, float]], y: float) -> list[tuple[float, float, float, float]]:
    """Level pieces of outline where only one side is inside, the inside on their left."""
    marks = sorted([(x, 0, s) for a, b in below for x, s in ((a, 1), (b, -1))] + [(x, 1, s) for a, b in above for x, s in ((a, 1), (b, -1))])
    out, count, start = [], [0, 0], None
    for i, (x, side, s) in enumerate(marks):
        state = (count[0] > 0, count[1] > 0)
        if start is not None and x > start + EPS and state[0] != state[1]:
            out.append((start, y, x, y) if state[1] else (x, y, start, y))
        count[side] += s
        start = x
    return out


def outline(edges: Edges, op: Op, roles: int = 2) -> list[tuple[float, float, float, float]]:
    """Pieces of the result's outline, directed so that the inside is on their left."""
    out: list[tuple[float, float, float, float]] = []
    before, top = [], None
    for low, high, which, x, inside in slabs(edges, op, roles):
        for i in range(len(low)):
            y0, y1 = float(low[i]), float(high[i])
            spans, edge_of = [], which[i]
            hits = np.flatnonzero(inside[i])
            for k in hits.tolist():
                if x[i, k + 1] - x[i, k] <= EPS * 1e-3:
                    continue
                if spans and x[i, k] - x[i, spans[-1][1]] <= EPS * 1e-3:
                    spans[-1][1] = k + 1
                else:
                    spans.append([k, k + 1])
            ends = [[float(v) for v in edges.at(np.array(y), edge_of[k])[None]][0] for y in (y0, y1) for s in spans for k in s]
            half = len(ends) // 2
            bottom = [(ends[j], ends[j + 1]) for j in range(0, half, 2)]
            tops = [(ends[half + j], ends[half + j + 1]) for j in range(0, half, 2)]
            out += level(before if top == y0 else [], bottom, y0)
            if top is not None and top != y0:
                out += level(before, [], top)
            for (a, b), (c, d) in zip(bottom, tops, strict=True):
                out += [(c, y1, a, y0), (b, y0, d, y1)]
            before, top = tops, y1
    return out + (level(before, [], top) if top is not None else [])


def _ends(values: np.ndarray) -> np.ndarray:
    """Where a run of equal values starts, for each value."""
    first = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    return np.maximum.accumulate(np.where(first, np.arange(len(values)), 0)) if len(values) else np.zeros(0, np.int64)


def _meetings(x0: np.ndarray, y0: np.ndarray, y1: np.ndarray, slope: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlay and height of the places at which two edges of an overlay cross; edges lie overlay by overlay."""
    starts = np.concatenate([[0], np.cumsum(counts)])
    whose, heights = [], []
    for n in np.unique(counts):
        own = np.flatnonzero(counts == n)
        if n < 2:
            continue
        i, j = np.triu_indices(n, 1)
        at_once = max(1, AT_ONCE // len(i))
        for part in (own[a : a + at_once] for a in range(0, len(own), at_once)):
            p, q = starts[part][:, None] + i, starts[part][:, None] + j
            low, high = np.maximum(y0[p], y0[q]), np.minimum(y1[p], y1[q])
            k, m = np.nonzero(low < high)
            p, q, low, high = p[k, m], q[k, m], low[k, m], high[k, m]
            with np.errstate(divide="ignore", invalid="ignore"):
                # From an edge's lower end, so that large coordinates cost no digits.
                y = y0[q] + (x0[p] + slope[p] * (y0[q] - y0[p]) - x0[q]) / (slope[q] - slope[p])
            met = (y > low) & (y < high)
            whose.append(part[k[met]])
            heights.append(y[met])
    return (np.concatenate(whose), np.concatenate(heights)) if whose else (np.zeros(0, np.int64), np.zeros(0))


def swept(overlays: list[list[tuple[int, list[np.ndarray]]]], ops: list[Op], roles: int = 2, outlined: bool = False) -> tuple[np.ndarray, list[list[tuple[float, float, float, float]]]]:
    """Areas (a row for each of the ``ops``) of overlays, each a list of (role, rings), and the pieces of the first one's outlines, if wanted. Small
    overlays are swept together, about ``AT_ONCE`` pairs of edges at once; large ones one by one, slab by slab."""
    areas, pieces, at = [np.zeros((len(ops), 0))], [], 0
    pairs = [sum(len(ring) for _, rings in polygons for ring in rings) ** 2 for polygons in overlays]
    while at < len(overlays):
        end, cost = at + 1, pairs[at]
        while end < len(overlays) and cost + pairs[end] <= AT_ONCE:
            cost += pairs[end]
            end += 1
        some = (_together if cost <= AT_ONCE else _one_by_one)(overlays[at:end], ops, roles, outlined)
        areas.append(some[0])
        pieces += some[1]
        at = end
    return np.concatenate(areas, 1), pieces


def _one_by_one(overlays: list, ops: list[Op], roles: int, outlined: bool) -> tuple[np.ndarray, list]:
    made = [Edges(polygons) for polygons in overlays]
    areas = np.array([[swept_area(edges, op, roles) for edges in made] for op in ops])
    return areas, [outline(edges, ops[0], roles) if outlined and area > EPS else [] for edges, area in zip(made, areas[0], strict=True)]


def _together(overlays: list, ops: list[Op], roles: int, outlined: bool) -> tuple[np.ndarray, list]:
    total, none = len(overlays), [[] for _ in overlays]
    flat = [(k, s, r, ring) for k, polygons in enumerate(overlays) for s, (r, rings) in enumerate(polygons) for ring in rings if len(ring)]
    if not flat:
        return np.zeros((len(ops), total)), none
    sizes = np.array([len(ring) for *_, ring in flat])
    own, shape, role = (np.repeat(np.array([f[i] for f in flat], np.int64), sizes) for i in range(3))
    xy = np.concatenate([ring for *_, ring in flat])
    after = np.arange(1, len(xy) + 1)
    last = np.cumsum(sizes)
    after[last - 1] = last - sizes
    sloping = xy[:, 1] != xy[after, 1]
    a, b, own, shape, role = xy[sloping], xy[after][sloping], own[sloping], shape[sloping], role[sloping]
    up = (a[:, 1] < b[:, 1])[:, None]
    (x0, y0), (x1, y1) = np.where(up, a, b).T, np.where(up, b, a).T
    if not len(x0):
        return np.zeros((len(ops), total)), none
    slope = (x1 - x0) / (y1 - y0)
    counts = np.bincount(own, minlength=total)
    first_edge = np.concatenate([[0], np.cumsum(counts)])

    def place(edge: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(y == y1[edge], x1[edge], x0[edge] + slope[edge] * (y - y0[edge]))

    met, heights = _meetings(x0, y0, y1, slope, counts)
    whose, heights = np.concatenate([own, own, met]), np.concatenate([y0, y1, heights])
    order = np.lexsort((heights, whose))
    whose, heights = whose[order], heights[order]
    fresh = np.concatenate([[True], (whose[1:] != whose[:-1]) | (heights[1:] != heights[:-1])])
    whose, heights = whose[fresh], heights[fresh]
    below = np.flatnonzero(whose[1:] == whose[:-1])  # a slab lies between heights i and i + 1
    # Every slab with its overlay's edges, of which those that cross it stay.
    near = counts[whose[below]]
    if near.sum() > 16 * AT_ONCE:
        if total == 1:
            return _one_by_one(overlays, ops, roles, outlined)
        halves = [_together(part, ops, roles, outlined) for part in (overlays[: total // 2], overlays[total // 2 :])]
        return np.concatenate([h[0] for h in halves], 1), halves[0][1] + halves[1][1]
    slab = np.repeat(below, near)
    edge = np.arange(len(slab)) - np.repeat(np.cumsum(near) - near, near) + first_edge[whose[slab]]
    crossing = (y0[edge] <= heights[slab]) & (y1[edge] >= heights[slab + 1])
    slab, edge = slab[crossing], edge[crossing]
    x = place(edge, (heights[slab] + heights[slab + 1]) / 2)
    order = np.lexsort((x, slab))
    slab, edge, x = slab[order], edge[order], x[order]
    # Every second edge of a polygon leaves it.
    by_shape = np.lexsort((shape[edge], slab))
    key = slab[by_shape] * (int(shape.max()) + 1) + shape[edge[by_shape]]
    turn = np.empty(len(slab), np.int64)
    turn[by_shape] = (np.arange(len(key)) - _ends(key)) % 2
    start = _ends(slab)

    def within(steps: np.ndarray) -> np.ndarray:
        count = np.cumsum(steps)
        return count - (count - steps)[start] > 0

    states = [within((1 - 2 * turn) * (role[edge] == r)) for r in range(roles)]
    goes_on = np.concatenate([slab[1:] == slab[:-1], [False]])
    width = np.concatenate([np.diff(x), [0.0]]) * (heights[slab + 1] - heights[slab])
    insides = [op(states) & goes_on for op in ops]
    areas = np.stack([np.bincount(whose[slab], np.where(i, width, 0.0), total) for i in insides])
    if not outlined:
        return areas, none
    hits = np.flatnonzero(insides[0] & (np.concatenate([np.diff(x), [0.0]]) > EPS * 1e-3))
    if not len(hits):
        return areas, none
    apart = np.concatenate([[True], (slab[hits[1:]] != slab[hits[:-1]]) | (x[hits[1:]] - x[hits[:-1] + 1] > EPS * 1e-3)])
    left, right = hits[apart], hits[np.concatenate([apart[1:], [True]])] + 1
    own_slab = slab[left]
    low, high = heights[own_slab], heights[own_slab + 1]
    a, b, c, d = place(edge[left], low), place(edge[right], low), place(edge[left], high), place(edge[right], high)
    sides = [np.stack([c, high, a, low], 1), np.stack([b, low, d, high], 1)]
    # Level pieces of outline where only one side of a height is inside, the inside on their left.
    one = np.ones(len(a), np.int64)
    height = np.concatenate([own_slab + 1, own_slab + 1, own_slab, own_slab])
    mark, above, step = np.concatenate([c, d, a, b]), np.concatenate([0 * one, 0 * one, one, one]), np.concatenate([one, -one, one, -one])
    order = np.lexsort((step, above, mark, height))
    height, mark, above, step = height[order], mark[order], above[order], step[order]
    under, over = np.cumsum(step * (above == 0)) > 0, np.cumsum(step * above) > 0
    i = np.flatnonzero((height[1:] == height[:-1]) & (mark[1:] > mark[:-1] + EPS) & (under[:-1] != over[:-1]))
    y, p, q = heights[height[i]], mark[i], mark[i + 1]
    sides.append(np.where(over[i][:, None], np.stack([p, y, q, y], 1), np.stack([q, y, p, y], 1)))
    rows, item = np.concatenate(sides), np.concatenate([whose[own_slab], whose[own_slab], whose[height[i]]])
    order = np.argsort(item, kind="stable")
    cuts = np.searchsorted(item[order], np.arange(1, total))
    return areas, [list(map(tuple, part.tolist())) for part in np.split(rows[order], cuts)]


def linked(pieces: list[tuple[float, float, float, float]]) -> list[np.ndarray]:
    """Rings of directed pieces; where rings touch they part; vertices on straight lines go."""
    key = lambda x, y: (round(x / EPS), round(y / EPS))
    after = defaultdict(list)
    for x0, y0, x1, y1 in pieces:
        a, b = key(x0, y0), key(x1, y1)
        if a != b:
            after[a].append((b, (x0, y0), (x1, y1)))
    rings = []
    for start in list(after):
        while after[start]:
            ring, at, came = [], start, None
            while True:
                ways = after.get(at) or next((after[k] for i in (-1, 0, 1) for j in (-1, 0, 1) if after.get(k := (at[0] + i, at[1] + j))), None)
                if not ways:
                    break
                if came is not None and len(ways) > 1:
                    arrived = math.atan2(came[1], came[0])
                    turn = lambda w: (math.atan2(w[2][1] - w[1][1], w[2][0] - w[1][0]) - arrived) % (2 * math.pi)  # noqa: E731,B023
                    ways.sort(key=lambda w: (turn(w) + math.pi) % (2 * math.pi))  # the sharpest left turn comes last
                to, p, q = ways.pop()
                ring.append(p)
                came = q[0] - p[0], q[1] - p[1]
                at = to
                if at == start:
                    break
            xy = np.array(ring)
            while len(xy) > 2:
                u, v = xy - np.roll(xy, 1, 0), np.roll(xy, -1, 0) - xy
                straight = np.abs(u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]) <= EPS * (1 + np.hypot(*u.T) * np.hypot(*v.T))
                straight[1:] &= ~straight[:-1]  # of two neighbours one at a time
                if not straight.any():
                    break
                xy = xy[~straight]
            if len(xy) > 2:
                rings.append(xy)
    return rings


BOTH: Op = lambda inside: inside[0] & inside[1]
EITHER: Op = lambda inside: inside[0] | inside[1]


def candidates(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """Pairs of polygons whose bounds share more than a border, each once; columns prefixed a_ and b_."""

    def dealt(layer: DataFrame, prefix: str) -> DataFrame:
        named = bounds(layer).select(F.col("id").alias(f"{prefix}id"), F.col("rings").alias(f"{prefix}rings"), *[F.col(c).alias(prefix + c) for c in ("x0", "y0", "x1", "y1")])
        span = lambda k: F.explode(F.sequence(F.floor(F.col(f"{prefix}{k}0") / size), F.floor(F.col(f"{prefix}{k}1") / size)))
        return named.select("*", span("x").alias("bx")).select("*", span("y").alias("by"))

    # Both sides grow with their layers: neither is sent to every task, whatever their files' size promises.
    both = dealt(a, "a_").join(dealt(b, "b_").hint("merge"), ["bx", "by"])
    x0, y0 = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    shared = (x0 < F.least("a_x1", "b_x1")) & (y0 < F.least("a_y1", "b_y1"))
    return both.where(shared & (F.col("bx") == F.floor(x0 / size)) & (F.col("by") == F.floor(y0 / size))).select("a_id", "a_rings", "b_id", "b_rings")


def _pieces(with_rings: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            overlays = [[(0, a), (1, b)] for a, b in zip(rings_of(rows.column("a_rings")), rings_of(rows.column("b_rings")), strict=True)]
            found, outlines = swept(overlays, [BOTH], outlined=with_rings)
            kept = np.flatnonzero(found[0] > EPS)
            areas, rings = found[0][kept], [linked(outlines[i]) for i in kept] if with_rings else []
            own = rows.take(pa.array(kept, pa.int64()))
            columns = [own.column("a_id"), own.column("b_id"), pa.array(areas, pa.float64())]
            yield pa.RecordBatch.from_arrays([*columns, rings_column(rings)] if with_rings else columns, ["a_id", "b_id", "area", "rings"][: 4 if with_rings else 3])

    return run


def pieces(a: DataFrame, b: DataFrame, size: int = 16, with_rings: bool = True) -> DataFrame:
    """a_id, b_id, area and outline of what each two polygons (id, rings) of the layers share, where that has an area."""
    pairs = candidates(a, b, size)
    ids = f"a_id {a.schema['id'].dataType.simpleString()}, b_id {b.schema['id'].dataType.simpleString()}, area double"
    return spread(pairs).mapInArrow(_pieces(with_rings), ids + (f", rings {RINGS}" if with_rings else ""))


def measured(pairs: DataFrame) -> DataFrame:
    """``pairs`` (id, a_rings, b_rings) with the areas of the intersection and the union and their ratio (1 if both are empty): id, shared, together, iou."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            overlays = [[(0, a), (1, b)] for a, b in zip(rings_of(rows.column("a_rings")), rings_of(rows.column("b_rings")), strict=True)]
            (shared, together), _ = swept(overlays, [BOTH, EITHER])
            ratio = np.divide(shared, together, out=np.ones(len(shared)), where=together > EPS)
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(shared), pa.array(together), pa.array(ratio)], ["id", "shared", "together", "iou"])

    empty = F.array().cast(RINGS)
    named = pairs.select("id", *[F.coalesce(c, empty).alias(c) for c in ("a_rings", "b_rings")])
    return spread(named, "id").mapInArrow(run, f"id {pairs.schema['id'].dataType.simpleString()}, shared double, together double, iou double")


def _cells(size: float, with_outline: bool, clip: bool):
    """Sweeps the polygons of each result and grid cell, whose rows follow each other: role 0 is united (or, for ``clip``, cut by the union of role 1); role 2 is the cell."""
    op: Op = (lambda i: i[0] & i[1] & i[2]) if clip else (lambda i: i[0] & i[2])
    struct = pa.list_(pa.struct([(k, pa.float64()) for k in ("x0", "y0", "x1", "y1")]))

    def told(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        role, rings, ends = rows.column("role").to_pylist(), rings_of(rows.column("rings")), [*starts[1:].tolist(), rows.num_rows]
        overlays, frames = [], []
        for i, j, bx, by in zip(starts.tolist(), ends, rows.column("bx").take(starts).to_pylist(), rows.column("by").take(starts).to_pylist(), strict=True):
            x0, y0, x1, y1 = bx * size, by * size, (bx + 1) * size, (by + 1) * size
            overlays.append([*zip(role[i:j], rings[i:j], strict=True), (2, [np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)])])
            frames.append((x0, y0, x1, y1))
        areas, found = swept(overlays, [op], 3, with_outline)
        lines = [_joined(pieces, *frame) if area > EPS else [] for pieces, frame, area in zip(found, frames, areas[0], strict=True)] if with_outline else [[] for _ in frames]
        xy = np.array([s for own in lines for s in own], float).reshape(-1, 4).T
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(own) for own in lines])]).astype(np.int32))
        segments = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([*map(pa.array, xy)], ["x0", "y0", "x1", "y1"])).cast(struct)
        return pa.RecordBatch.from_arrays([rows.column("result").take(starts).combine_chunks(), pa.array(areas[0]), segments], ["result", "area", "segments"])

    return _by_cell(told)


def _by_cell(told: Callable[[pa.Table, np.ndarray], pa.RecordBatch]):
    """``told`` (rows of whole cells, and the rows at which a cell starts) on rows whose cells (``cell``) follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            starts = _starts(batch)
            if len(starts) < 2 and (len(held) < 2 or _same(held[-2], batch)):
                continue  # all of one cell, which may go on
            rows = pa.Table.from_batches(held)
            whole = rows.num_rows - batch.num_rows + int(starts[-1])
            if whole:
                done = rows.slice(0, whole)
                yield told(done, _starts(done))
            held = [batch.slice(int(starts[-1]))]
        if held:
            rows = pa.Table.from_batches(held)
            yield told(rows, _starts(rows))

    return run


def _starts(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """The rows at which another number of the group starts."""
    group = rows.column("cell").to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column("cell").to_numpy()
    return np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))


def _same(before: pa.RecordBatch, after: pa.RecordBatch) -> bool:
    return before.column("cell")[-1] == after.column("cell")[0]


def _joined(found: list, x0: float, y0: float, x1: float, y1: float) -> list:
    """Pieces of outline, of which those on the cell's border that continue each other are one, so that neighbours cancel."""
    inner, border = [], defaultdict(list)
    for x, y, u, v in found:
        if x == u and x in (x0, x1) or y == v and y in (y0, y1):
            border[(x == u, x if x == u else y)].append((x, y, u, v))
        else:
            inner.append((x, y, u, v))
    for (upright, _), own in border.items():
        own.sort(key=lambda s: min(s[1], s[3]) if upright else min(s[0], s[2]))
        joined = [list(own[0])]
        for s in own[1:]:
            a = joined[-1]
            if a[2:] == list(s[:2]):
                a[2:] = s[2:]
            elif a[:2] == list(s[2:]):
                a[:2] = s[:2]
            else:
                joined.append(list(s))
        inner += map(tuple, joined)
    return inner


def _cancelled(lines: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Pieces of outline without what lies on each other in opposite directions."""
    pieces, axes = [], defaultdict(lambda: ([], []))
    for x0, y0, x1, y1 in lines.tolist():
        if x0 == x1:
            axes[True, x0][y1 < y0].append((min(y0, y1), max(y0, y1)))
        elif y0 == y1:
            axes[False, y0][x1 < x0].append((min(x0, x1), max(x0, x1)))
        else:
            pieces.append((x0, y0, x1, y1))
    for (upright, at), (forward, backward) in axes.items():
        for a, _, b, _ in level(backward, forward, 0.0):
            pieces.append((at, a, at, b) if upright else (a, at, b, at))
    return pieces


def _hanging(lines: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """For each piece the first one it hangs together with, over vertices of its cell that ``linked`` takes for one."""
    n, near = len(lines), []
    ends = np.concatenate([lines[:, :2], lines[:, 2:]])
    at = np.rint(ends / EPS)
    whose = np.concatenate([cell, cell])
    for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)):  # places that differ by one at most share one of these
        near.append(np.stack([whose, at[:, 0] + i, at[:, 1] + j]))
    key = np.concatenate(near, 1)
    order = np.lexsort(key)
    fresh = (np.diff(key[:, order], axis=1, prepend=np.nan) != 0).any(0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(fresh) - 1
    return joined(n + int(fresh.sum()), np.tile(np.arange(n), 8), n + number)[:n]


def _blocks(size: float):
    """Of the pieces of each result and block, whose rows follow each other, a row with the rings that lie within it, and one for all pieces that hang
    together and reach its border (``lines``), with the places where they do (``ends``)."""
    side = BLOCK * size
    segment = pa.list_(pa.struct([(k, pa.float64()) for k in ("x0", "y0", "x1", "y1")]))
    place = pa.list_(pa.struct([(k, pa.float64()) for k in ("x", "y")]))

    def told(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        xy = np.stack([rows.column(k).to_numpy() for k in ("x0", "y0", "x1", "y1")], 1)
        found = [np.array(_cancelled(part), float).reshape(-1, 4) for part in np.split(xy, starts[1:])]
        cell, lines = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found)
        group = _hanging(lines, cell)
        left, low = (rows.column(k).to_numpy()[starts][cell] * side for k in ("bx", "by"))
        border = np.zeros((len(lines), 2), bool)  # of a piece's start and end
        for k, at in ((0, left), (1, low)):
            for end in (0, 1):
                here = lines[:, 2 * end + k]
                slack = 8 * EPS + 1e-12 * np.abs(here)
                border[:, end] |= (np.abs(here - at) <= slack) | (np.abs(here - at - side) <= slack)
        open_ = np.zeros(len(lines), bool)
        open_[group[border.any(1)]] = True
        open_ = open_[group]
        results, rings, parts, ends = [], [], [], []
        inner = np.split(lines[~open_], np.searchsorted(cell[~open_], np.arange(1, len(found))))
        for i, pieces in zip(starts.tolist(), inner, strict=True):
            if len(pieces):
                results.append(i)
                rings.append(linked(pieces.tolist()))
                parts.append(np.zeros((0, 4)))
                ends.append(np.zeros((0, 2)))
        rest = np.flatnonzero(open_)
        rest = rest[np.argsort(group[rest], kind="stable")]
        for own in np.split(rest, np.flatnonzero(np.diff(group[rest])) + 1) if len(rest) else []:
            results.append(int(starts[cell[own[0]]]))
            rings.append([])
            parts.append(lines[own])
            ends.append(np.concatenate([lines[own, :2][border[own, 0]], lines[own, 2:][border[own, 1]]]))

        def listed(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
            flat = np.concatenate(arrays) if arrays else np.zeros((0, kind.value_type.num_fields))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32))
            return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(k) for k in flat.T], [f.name for f in kind.value_type])).cast(kind)

        taken = rows.column("result").combine_chunks().take(pa.array(results, pa.int64()))
        return pa.RecordBatch.from_arrays([taken, rings_column(rings), listed(parts, segment), listed(ends, place)], ["result", "rings", "lines", "ends"])

    return _by_cell(told)


def _linked(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """Rings of the pieces of each cell."""
    xy = np.stack([rows.column(k).to_numpy() for k in ("x0", "y0", "x1", "y1")], 1)
    rings = [linked(part.tolist()) for part in np.split(xy, starts[1:])]
    return pa.RecordBatch.from_arrays([rows.column("result").combine_chunks().take(pa.array(starts)), rings_column(rings)], ["result", "rings"])


def _ring_rows(cells: DataFrame, size: float) -> DataFrame:
    """Rings of what was swept cell by cell (result, segments): result and rings, many rows a result, each of what one block holds or of what hangs together."""
    kind = cells.schema["result"].dataType.simpleString()
    s = cells.select("result", F.explode("segments").alias("s")).select("result", "s.*")
    swap = (F.col("x1") < F.col("x0")) | ((F.col("x1") == F.col("x0")) & (F.col("y1") < F.col("y0")))
    ends = [F.when(swap, F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("x1", "x0", "a"), ("y1", "y0", "b"), ("x0", "x1", "c"), ("y0", "y1", "d"))]
    left = s.select("result", *ends, F.when(swap, -1).otherwise(1).alias("way")).groupBy("result", "a", "b", "c", "d").agg(F.sum("way").alias("way")).where("way <> 0")
    back = F.col("way") < 0
    turned = [F.when(back, F.col(q)).otherwise(F.col(p)).alias(k) for p, q, k in (("a", "c", "x0"), ("b", "d", "y0"), ("c", "a", "x1"), ("d", "b", "y1"))]
    pieces = left.select("result", *turned)
    block = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / (BLOCK * size))
    dealt = pieces.withColumns({"bx": block("x0", "x1"), "by": block("y0", "y1")})
    dealt = dealt.withColumn("cell", F.to_json(F.struct("result", "bx", "by"))).repartition(tasks(cells), "cell").sortWithinPartitions("cell")
    blocks = dealt.mapInArrow(_blocks(size), f"result {kind}, rings {RINGS}, lines {SEGMENTS}, ends array<{POINT}>")
    blocks = staged(blocks.withColumn("part", F.monotonically_increasing_id()), "blocks")
    # Pieces of several blocks hang together where they reach a border at one place.
    steps = F.array(*[F.struct(F.lit(float(i)).alias("i"), F.lit(float(j)).alias("j")) for i in (0, 1) for j in (0, 1)])
    at = blocks.select("part", "result", F.explode("ends").alias("p")).select("part", "result", F.explode(steps).alias("d"), "p")
    at = at.select("part", "result", (F.rint(F.col("p.x") / EPS) + F.col("d.i")).alias("x"), (F.rint(F.col("p.y") / EPS) + F.col("d.j")).alias("y"))
    met = at.groupBy("result", "x", "y").agg(F.collect_set("part").alias("parts")).where("size(parts) > 1")
    roots = components(met.select(F.array_min("parts").alias("a"), F.explode("parts").alias("b")), "outlines")
    rest = blocks.where("size(lines) > 0").select("part", "result", "lines").join(roots.hint("merge"), F.col("part") == F.col("node"), "left")
    rest = rest.select("result", F.coalesce("root", "part").alias("cell"), F.explode("lines").alias("s")).select("result", "cell", "s.*")
    rest = rest.repartition(tasks(cells), "cell").sortWithinPartitions("cell").mapInArrow(_by_cell(_linked), f"result {kind}, rings {RINGS}")
    return blocks.where("size(rings) > 0").select("result", "rings").unionByName(rest.where("size(rings) > 0"))


def _swept_cells(parts: DataFrame, size: float, with_outline: bool, clip: bool) -> tuple[DataFrame, DataFrame]:
    """``parts`` (result, role, rings) swept cell by cell: the cells (result, area, segments), and result and area; results without area have no row there."""
    kind = parts.schema["result"].dataType.simpleString()
    spans = lambda k: F.explode(F.sequence(F.floor(F.col(f"{k}0") / size), F.floor(F.col(f"{k}1") / size)))
    dealt = bounds(parts).select("*", spans("x").alias("bx")).select("*", spans("y").alias("by")).select("result", "role", "rings", "bx", "by")
    # A cell's rows follow each other; a task sweeps many small cells together.
    dealt = dealt.withColumn("cell", F.to_json(F.struct("result", "bx", "by"))).repartition(tasks(parts), "cell").sortWithinPartitions("cell")
    cells = staged(dealt.mapInArrow(_cells(size, with_outline, clip), f"result {kind}, area double, segments {SEGMENTS}"), "cells")
    return cells, cells.groupBy("result").agg(F.sum("area").alias("area")).where(F.col("area") > EPS)


def _gathered(parts: DataFrame, size: float, with_rings: bool, clip: bool) -> DataFrame:
    """``parts`` (result, role, rings) swept cell by cell: result, area and, if wanted, rings; results without area have no row."""
    cells, areas = _swept_cells(parts, size, with_rings, clip)
    if not with_rings:
        return areas
    rings = _ring_rows(cells, size).groupBy("result").agg(F.flatten(F.collect_list("rings")).alias("rings"))
    return areas.join(rings.hint("merge"), "result")


def union(layer: DataFrame, by: str, size: float = 16, with_rings: bool = True) -> DataFrame:
    """The union of each group's polygons: ``by``, area and rings. A null group is a group; identical polygons are swept once."""
    made = _gathered(_united(layer, by), size, with_rings, clip=False)
    return made.select(F.col(f"result.{by}").alias(by), *made.columns[1:])


def union_lengths(layer: DataFrame, by: str, size: float = 16) -> DataFrame:
    """The union of each group's polygons, measured: ``by``, area and the outline's length. Rings are measured where they are made, so no row holds a group's outline."""
    cells, areas = _swept_cells(_united(layer, by), size, True, clip=False)
    lengths = _ring_rows(cells, size).groupBy("result").agg(F.sum(length_of(F.col("rings"))).alias("length"))
    return areas.join(lengths.hint("merge"), "result").select(F.col(f"result.{by}").alias(by), "area", "length")


def _united(layer: DataFrame, by: str) -> DataFrame:
    return layer.select(F.struct(F.col(by)).alias("result"), F.lit(0).alias("role"), "rings").dropDuplicates(["result", "rings"])


def clip(layer: DataFrame, regions: DataFrame, size: float = 16, with_rings: bool = True) -> DataFrame:
    """What of each polygon (id, rings) lies in the union of the regions' rings: id, area and rings; polygons outside have no row."""
    own = bounds(layer.select("id", "rings"))
    spans = lambda k: F.explode(F.sequence(F.floor(F.col(f"{k}0") / size), F.floor(F.col(f"{k}1") / size)))
    cells = lambda t: t.select("*", spans("x").alias("cx")).select("*", spans("y").alias("cy"))
    cut = cells(bounds(regions.select("rings").distinct())).select("rings", "cx", "cy")
    # A region meets a polygon through each of their common cells; one row of it is enough.
    near = cells(own).select("id", "cx", "cy").join(cut.hint("merge"), ["cx", "cy"]).select("id", "rings").distinct()
    near = staged(near, "near")
    parts = own.join(near.select("id").distinct().hint("merge"), "id", "left_semi").select(F.col("id").alias("result"), F.lit(0).alias("role"), "rings")
    made = _gathered(parts.unionByName(near.select(F.col("id").alias("result"), F.lit(1).alias("role"), "rings")), size, with_rings, clip=True)
    return made.withColumnRenamed("result", "id")


def merged(layer: DataFrame, size: float = 16, with_rings: bool = True) -> DataFrame:
    """Polygons (id: long, rings) connected by positive-area overlaps made one: root (the smallest id), members, largest_id (the
    member of largest area, the smallest id on ties), area and rings. Polygons that only touch stay apart."""
    own = staged(layer.select("id", "rings"), "layer")
    links = pieces(own, own.select("id", "rings"), int(size), with_rings=False).where("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    named = own.join(components(links).withColumnRenamed("node", "id").hint("merge"), "id", "left").select("id", "rings", F.coalesce("root", "id").alias("root"))
    named = staged(named.withColumn("own_area", area_of(F.col("rings"))), "groups")
    told = named.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.max_by("id", F.struct("own_area", -F.col("id"))).alias("largest_id"))
    lone = told.where("members = 1").join(named.select("root", F.col("own_area").alias("area"), "rings").hint("merge"), "root")
    many = told.where("members > 1").join(union(named.join(told.where("members > 1").select("root").hint("merge"), "root", "left_semi"), "root", size, with_rings).hint("merge"), "root")
    return (lone if with_rings else lone.drop("rings")).unionByName(many)


def intersect(a: DataFrame, b: DataFrame, size: float = 16, with_rings: bool = True) -> DataFrame:
    """What two layers share after each side's overlapping polygons are merged, so that nothing counts twice: pieces (a_id and b_id
    are the merged groups' smallest ids), area and rings."""
    sides = [merged(x, size).select(F.col("root").alias("id"), "rings") for x in (a, b)]
    return pieces(*sides, int(size), with_rings)


def totals(found: DataFrame, pixel_m: float) -> DataFrame:
    """Of pieces: their number, the features of each side that take part, and the area, in one row."""
    return found.agg(F.count(F.lit(1)).alias("intersection_count"), F.count_distinct("a_id").alias("intersecting_a_count"), F.count_distinct("b_id").alias("intersecting_b_count"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("area_px2"), (F.coalesce(F.sum("area"), F.lit(0.0)) * pixel_m * pixel_m).alias("area_m2"))


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive for a counter-clockwise ring."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.lit(0), F.size(ring) - 1)), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, after, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda t, x: t + x) / 2


def area_of(rings: Column) -> Column:
    """Area of a polygon whose first ring surrounds the others, which are holes; a lone ring's orientation does not matter."""
    from cindermap.operators.vector import ring_area

    whole = F.aggregate(rings, F.lit(0.0), lambda t, r: t + ring_area(r))
    return F.when(F.size(rings) == 0, 0.0).otherwise(2 * ring_area(rings[0]) - whole)


def length_of(rings: Column) -> Column:
    """Length of all rings."""
    from cindermap.operators.vector import ring_perimeter

    return F.aggregate(rings, F.lit(0.0), lambda t, r: t + ring_perimeter(r))
