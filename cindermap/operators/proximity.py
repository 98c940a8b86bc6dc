"""Distances between geometries, buffers as outlines, and Voronoi cells.

A geometry is ``parts`` (arrays of x, y vertices) and ``filled``: polygons are filled (all parts together, as in ``overlay``), lines are not,
a point is a part of one vertex. Searches start on a small grid and go on, for what is not settled, on one twice or four times as
wide; each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindermap.operators.overlay import EPS, RINGS, linked, rings_column, rings_of, swept
from cindermap.sources.shared import spread, staged

#: Segments of a quarter of a circle.
QUARTER = 16
#: Neighbours that a Voronoi cell is first cut by.
NEIGHBOURS = 32
FAR = "distance double, ax double, ay double, bx double, by double"


# --- nearest ---------------------------------------------------------------------------------------------------------


def segments(parts: list[np.ndarray], filled: bool) -> np.ndarray:
    """The edges (x0, y0, x1, y1) of a geometry; a lone vertex is an edge to itself."""
    out = []
    for p in parts:
        if filled and len(p) > 2:
            out.append(np.hstack([p, np.roll(p, -1, 0)]))
        elif len(p):
            out.append(np.hstack([p[:-1], p[1:]]) if len(p) > 1 else np.hstack([p, p]))
    return np.concatenate(out) if out else np.zeros((0, 4))


def holds(parts: list[np.ndarray], x: float, y: float) -> bool:
    s = segments(parts, True)
    up = (s[:, 1] > y) != (s[:, 3] > y)
    s = s[up]
    return bool((x < s[:, 0] + (s[:, 2] - s[:, 0]) * (y - s[:, 1]) / (s[:, 3] - s[:, 1])).sum() % 2)


def foot(points: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest places on each segment to each point, and their squared distances: (points, segments)."""
    d = s[:, 2:] - s[:, :2]
    square = (d**2).sum(1)
    t = np.clip(np.einsum("psk,sk->ps", points[:, None] - s[None, :, :2], d) / np.where(square > 0, square, 1), 0, 1)
    at = s[None, :, :2] + t[..., None] * d[None]
    return at, ((at - points[:, None]) ** 2).sum(2)


def crossing(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """A place where two sets of segments cross or touch."""
    r, s = a[:, None, 2:] - a[:, None, :2], b[None, :, 2:] - b[None, :, :2]
    w = b[None, :, :2] - a[:, None, :2]
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = cross(w, s) / cross(r, s), cross(w, r) / cross(r, s)
    hit = np.argwhere((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1))
    return a[hit[0][0], :2] + t[tuple(hit[0])] * (a[hit[0][0], 2:] - a[hit[0][0], :2]) if len(hit) else None


def apart(a: list[np.ndarray], a_filled: bool, b: list[np.ndarray], b_filled: bool) -> tuple[float, float, float, float, float]:
    """Distance of two geometries and the places where they are nearest; 0 if they meet or one is within the other."""
    s, t = segments(a, a_filled), segments(b, b_filled)
    if a_filled and holds(a, *t[0, :2]):
        return (0.0, *t[0, :2], *t[0, :2])
    if b_filled and holds(b, *s[0, :2]):
        return (0.0, *s[0, :2], *s[0, :2])
    best: tuple = (np.inf,)
    at_once = max(1, (1 << 18) // len(t))
    for own in (s[i : i + at_once] for i in range(0, len(s), at_once)):
        met = crossing(own, t)
        if met is not None:
            return (0.0, *met, *met)
        for points, lines, turned in ((own[:, :2], t, False), (own[:, 2:], t, False), (t[:, :2], own, True), (t[:, 2:], own, True)):
            at, d2 = foot(points, lines)
            i, j = np.unravel_index(np.argmin(d2), d2.shape)
            if d2[i, j] < best[0]:
                pair = (points[i], at[i, j])
                best = (float(d2[i, j]), *(pair[1] if turned else pair[0]), *(pair[0] if turned else pair[1]))
    return (float(np.sqrt(best[0])), *map(float, best[1:]))


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        sides = [(rings_of(rows.column(f"{s}_parts")), rows.column(f"{s}_filled").to_pylist()) for s in ("a", "b")]
        found = np.array([apart(a, af, b, bf) for a, af, b, bf in zip(*sides[0], *sides[1], strict=True)]).reshape(-1, 5).T
        yield pa.RecordBatch.from_arrays([rows.column("a_id"), rows.column("b_id"), *map(pa.array, found)], ["a_id", "b_id", "distance", "ax", "ay", "bx", "by"])


def _boxed(layer: DataFrame, prefix: str) -> DataFrame:
    at = lambda f, k: f(F.transform(F.flatten("parts"), lambda p: p[k]))
    made = layer.select(F.col("id").alias(f"{prefix}id"), F.col("parts").alias(f"{prefix}parts"), F.col("filled").alias(f"{prefix}filled"), *[at(f, k).alias(f"{prefix}{k}{n}") for k in ("x", "y") for f, n in ((F.array_min, 0), (F.array_max, 1))])
    return made.where(F.col(f"{prefix}x0").isNotNull())


def nearest_geometries(a: DataFrame, b: DataFrame, k: int = 1, size: float = 16) -> DataFrame:
    """a_id, rank, b_id, distance, ax, ay, bx, by: the k nearest geometries of ``b`` (id, parts, filled) for each one of ``a`` and the connector's
    ends; ties go to the smaller b_id. Geometries without a vertex take no part; fewer than k give all.

    Bounds are compared first: of the geometries whose bounds lie within reach, only those whose least possible distance is at most the k-th smallest largest
    possible one are measured. Who has k within the reach is done; the others look four times as far.
    """
    a, b = staged(_boxed(a, "a_"), "layer-a"), staged(_boxed(b, "b_"), "layer-b")
    extent = b.agg(F.avg(F.greatest(F.col("b_x1") - F.col("b_x0"), F.col("b_y1") - F.col("b_y0"))), *[f(c) for f, c in ((F.min, "b_x0"), (F.max, "b_x1"), (F.min, "b_y0"), (F.max, "b_y1"))]).first()
    reach = a.agg(F.min("a_x0"), F.max("a_x1"), F.min("a_y0"), F.max("a_y1")).first()
    size = max(float(size), float(extent[0] or 0))
    ends = [float(v) for v in (*extent[1:], *reach) if v is not None]
    widest = 4 * (max(ends, default=0) - min(ends, default=0)) + size
    left, done = a, None
    while True:
        span = lambda p, ax, more, s=size: F.explode(F.sequence(F.floor((F.col(f"{p}{ax}0") - more) / s), F.floor((F.col(f"{p}{ax}1") + more) / s)))
        asked = left.select("a_id", "a_x0", "a_x1", "a_y0", "a_y1", span("a_", "x", size).alias("cx")).select("*", span("a_", "y", size).alias("cy"))
        there = b.select("b_id", "b_x0", "b_x1", "b_y0", "b_y1", span("b_", "x", 0).alias("cx")).select("*", span("b_", "y", 0).alias("cy"))
        gap = lambda ax: F.greatest(F.lit(0.0), F.col(f"a_{ax}0") - F.col(f"b_{ax}1"), F.col(f"b_{ax}0") - F.col(f"a_{ax}1"))
        most = lambda ax: F.greatest(F.col(f"a_{ax}1"), F.col(f"b_{ax}1")) - F.least(F.col(f"a_{ax}0"), F.col(f"b_{ax}0"))
        corner = lambda ax, s=size: F.floor(F.greatest(F.col(f"a_{ax}0") - s, F.col(f"b_{ax}0")) / s)
        # Only the cell of the lower corner of what the widened bounds share reports a pair.
        pairs = asked.join(there.hint("merge"), ["cx", "cy"]).where((F.col("cx") == corner("x")) & (F.col("cy") == corner("y")))
        pairs = pairs.select("a_id", "b_id", F.hypot(gap("x"), gap("y")).alias("low"), F.hypot(most("x"), most("y")).alias("high"))
        kth = F.row_number().over(Window.partitionBy("a_id").orderBy("high", "b_id"))
        cut = pairs.withColumn("nth", kth).where(F.col("nth") == k).select("a_id", F.col("high").alias("cut"))
        close = pairs.join(cut.hint("merge"), "a_id", "left").where(F.col("cut").isNull() | (F.col("low") <= F.col("cut"))).select("a_id", "b_id")
        full = spread(close.join(left.select("a_id", "a_parts", "a_filled").hint("merge"), "a_id").join(b.select("b_id", "b_parts", "b_filled").hint("merge"), "b_id"), "a_id")
        kinds = f"a_id {a.schema['a_id'].dataType.simpleString()}, b_id {b.schema['b_id'].dataType.simpleString()}, {FAR}"
        rank = F.row_number().over(Window.partitionBy("a_id").orderBy("distance", "b_id"))
        ranked = staged(full.mapInArrow(_distances, kinds).withColumn("rank", rank).where(F.col("rank") <= k), "near")
        if size >= widest:
            part = ranked
        else:
            settled = ranked.groupBy("a_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far")).where((F.col("n") >= k) & (F.col("far") <= size)).select("a_id")
            part = ranked.join(settled.hint("merge"), "a_id", "left_semi")
            left = staged(left.join(settled.hint("merge"), "a_id", "left_anti"), "unsettled")
        part = part.select("a_id", "rank", "b_id", "distance", "ax", "ay", "bx", "by")
        done = part if done is None else done.unionByName(part)
        if size >= widest or left.isEmpty():
            return done
        size *= 4


def closest_pair(found: DataFrame) -> DataFrame:
    """The nearest pair of all; of equal ones that of the smallest a_id."""
    return found.orderBy("distance", "a_id", "rank").limit(1)


# --- buffers ---------------------------------------------------------------------------------------------------------


def _arc(centre: np.ndarray, start: float, turn: float, radius: float) -> np.ndarray:
    n = max(1, int(np.ceil(abs(turn) / (np.pi / 2) * QUARTER - 1e-9)))
    angle = start + turn * np.arange(n + 1) / n
    return centre + radius * np.stack([np.cos(angle), np.sin(angle)], 1)


def _strips(ring: np.ndarray, radius: float) -> list[np.ndarray]:
    """What lies right of a closed ring within the radius: a strip an edge, and a sector where the ring turns left."""
    ring = ring[(ring != np.roll(ring, -1, 0)).any(1)]
    if len(ring) < 2:
        return []
    step = np.roll(ring, -1, 0) - ring
    length = np.hypot(*step.T)
    side = np.stack([step[:, 1], -step[:, 0]], 1) / length[:, None] * radius
    out = [np.array([p, p + s, p + d + s, p + d]) for p, d, s in zip(ring, step, side, strict=True)]
    angle = np.arctan2(step[:, 1], step[:, 0])
    turn = (angle - np.roll(angle, 1) + np.pi) % (2 * np.pi) - np.pi
    turn[np.isclose(turn, -np.pi)] = np.pi  # a line's end
    for p, at, t in zip(ring, np.roll(angle, 1), turn, strict=True):
        if t > 1e-12:
            out.append(np.concatenate([p[None], _arc(p, at - np.pi / 2, t, radius)]))
    return out


def _signed(ring: np.ndarray) -> float:
    x, y = ring.T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())


def _around(parts: list[np.ndarray], filled: bool, distance: float) -> list[tuple[int, list[np.ndarray]]]:
    """The polygons whose overlay is a buffer: role 0 the geometry, 1 what is added to it, 2 what is taken away from it."""
    radius, pieces = abs(distance), []
    if distance <= 0 and not filled:
        return []
    for i, p in enumerate(parts):
        if filled:
            outer = i == 0 or not holds(parts[:1], *p[0])  # as in a list of rings of which the first, or one outside it, surrounds
            ring = p if (_signed(p) > 0) == outer else p[::-1]
            pieces += _strips(ring if distance > 0 else ring[::-1], radius)
        elif len(p) == 1:
            pieces.append(_arc(p[0], 0.0, 2 * np.pi, radius)[:-1])
        else:
            pieces += _strips(np.concatenate([p, p[-2:0:-1]]), radius)
    return [(0, parts if filled else []), *((1 if distance > 0 else 2, [x]) for x in pieces)]


def all_buffered(geometries: list[tuple[list[np.ndarray], bool, float]], outlined: bool = True) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Area and rings of what lies within ``distance`` of each geometry (parts, filled, distance); for a negative one, of what is left of a polygon that far
    from its border. A polygon's rings must not cross themselves."""
    (areas,), found = swept([_around(*g) for g in geometries], [lambda i: (i[0] | i[1]) & ~i[2]], 3, outlined)
    some = areas > EPS
    return np.where(some, areas, 0.0), [linked(pieces) if own else [] for pieces, own in zip(found, some, strict=True)]


def buffered(parts: list[np.ndarray], filled: bool, distance: float) -> tuple[float, list[np.ndarray]]:
    """``all_buffered`` of one geometry."""
    areas, rings = all_buffered([(parts, filled, distance)])
    return float(areas[0]), rings[0]


def buffers(layer: DataFrame, distances: list[float], with_rings: bool = True) -> DataFrame:
    """id, distance, area and, if wanted, rings of the buffers of every geometry (id, parts, filled), round at corners and ends (``QUARTER`` segments a quarter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            areas, rings = all_buffered([*zip(rings_of(rows.column("parts")), rows.column("filled").to_pylist(), rows.column("distance").to_pylist(), strict=True)], with_rings)
            told = [rows.column("id"), rows.column("distance"), pa.array(areas)]
            yield pa.RecordBatch.from_arrays([*told, rings_column(rings)] if with_rings else told, ["id", "distance", "area", "rings"][: 4 if with_rings else 3])

    each = layer.where(F.size(F.flatten("parts")) > 0).select("id", "parts", "filled", F.explode(F.array(*[F.lit(float(d)) for d in distances])).alias("distance"))
    return spread(each, "id").mapInArrow(run, f"id {layer.schema['id'].dataType.simpleString()}, distance double, area double" + (f", rings {RINGS}" if with_rings else ""))


# --- Voronoi cells ---------------------------------------------------------------------------------------------------


def voronoi_cell(point: np.ndarray, others: np.ndarray, box: np.ndarray) -> tuple[np.ndarray, float]:
    """The box cut by the middle lines to the other points (nearest first), and its farthest corner's distance from the point."""
    cell = box
    far = np.hypot(*(cell - point).T).max()
    for q in others:
        d = q - point
        if np.hypot(*d) > 2 * far:
            break
        over = (cell - (point + q) / 2) @ d  # above 0: nearer to q
        if (over <= 0).all():
            continue
        out = []
        for i in range(len(cell)):
            a, b, u, v = cell[i - 1], cell[i], over[i - 1], over[i]
            if (u > 0) != (v > 0):
                out.append(a + (b - a) * (u / (u - v)))
            if v <= 0:
                out.append(b)
        cell = np.array(out)
        far = np.hypot(*(cell - point).T).max()
    return cell, float(far)


def voronoi(points: DataFrame, box: tuple[float, float, float, float] | None = None, size: float = 16) -> DataFrame:
    """id, area and ring of every point's cell within the box (x0, y0, x1, y1; by default the points' bounds, widened by their perimeter).

    Points (id, px, py) in one place have one cell, the smallest id's. A cell is cut by its nearest neighbours; it is done once no other point lies within
    twice the distance of its farthest corner, else the point comes again with twice as many neighbours from twice as far.
    """
    own = staged(points.where("px IS NOT NULL AND py IS NOT NULL").groupBy(F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py")).agg(F.min("id").alias("id")), "sites")
    n, x0, x1, y0, y1 = own.agg(F.count(F.lit(1)), F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    if n < 2:
        raise ValueError("a Voronoi diagram needs at least two points")
    edge = max(2 * (x1 - x0 + y1 - y0), 1.0)
    x0, y0, x1, y1 = box or (x0 - edge, y0 - edge, x1 + edge, y1 + edge)
    corners = np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float)
    kind = own.schema["id"].dataType.simpleString()
    widest, most = 4 * edge, NEIGHBOURS
    left, done = own, None
    while True:

        def run(batches: Iterator[pa.RecordBatch], size=size, most=most) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                cells, seen = [], []
                for x, y, near in zip(rows.column("px").to_pylist(), rows.column("py").to_pylist(), rows.column("near").to_pylist(), strict=True):
                    p, others = np.array([x, y]), np.array([[q["x"], q["y"]] for q in near]).reshape(-1, 2)
                    cell, far = voronoi_cell(p, others, corners)
                    known = np.hypot(*(others[-1] - p)) if len(others) >= most else size
                    cells.append([cell])
                    seen.append(2 * far <= min(known, size) or (len(others) < most and size >= widest))
                areas = [abs(_signed(c)) / 2 for (c,) in cells]
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(areas, pa.float64()), rings_column(cells), pa.array(seen, pa.bool_())], ["id", "area", "rings", "settled"])

        cell = lambda c, s=size: F.floor(F.col(c) / s)
        step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
        asked = left.select("id", "px", "py", F.explode(step).alias("i")).select("*", F.explode(step).alias("j")).withColumns({"bx": cell("px") + F.col("i"), "by": cell("py") + F.col("j")})
        there = own.select(F.col("id").alias("q"), F.col("px").alias("x"), F.col("py").alias("y"), cell("px").alias("bx"), cell("py").alias("by"))
        d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
        near = asked.join(there, ["bx", "by"]).where(F.col("id") != F.col("q")).withColumn("d2", d2)
        near = near.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("d2", "q"))).where(F.col("nth") <= most)
        packed = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("nth", "x", "y"))).alias("near"))
        rows = left.join(packed, "id", "left").select("id", "px", "py", F.coalesce("near", F.array().cast("array<struct<nth:int,x:double,y:double>>")).alias("near"))
        made = staged(rows.mapInArrow(run, f"id {kind}, area double, rings {RINGS}, settled boolean"), "cells")
        part = made.where("settled").select("id", "area", F.col("rings")[0].alias("ring"))
        done = part if done is None else done.unionByName(part)
        left = staged(left.join(made.where("NOT settled").select("id"), "id", "left_semi"), "unsettled")
        if left.isEmpty():
            return done
        size, most = min(2 * size, max(widest, size)), 2 * most
