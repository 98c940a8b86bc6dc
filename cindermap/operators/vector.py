"""Layers of rectangles (id, x0, y0, x1, y1, ...), points (id, px, py, ...) and polylines.

Spatial joins are equi-joins on grid cells, followed by the exact predicate, so that Spark hashes and splits them like any
other join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindermap.functions.scalar import haversine_m
from cindermap.operators.raster import valid
from cindermap.sources.shared import staged


def rect_area(pixel_m: float = 1.0) -> Column:
    return (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * pixel_m * pixel_m


def _edges(ring: Column, of) -> Column:
    """Sum of ``of(a, b)`` over the edges of a ring, an array of (x, y) structs that may repeat its first vertex at the end."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.lit(0), F.size(ring) - 1)), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, after, of), F.lit(0.0), lambda total, x: total + x)


def _cross(a: Column, b: Column) -> Column:
    return (a["x"] * b["y"] - b["x"] * a["y"]).cast("double")


def ring_area(ring: Column) -> Column:
    """Shoelace area; 0 for fewer than three vertices."""
    return F.abs(_edges(ring, _cross)) / 2


def ring_perimeter(ring: Column) -> Column:
    return _edges(ring, lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2)))


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Row (y) and column (x) of a ring's centre of area; of its vertices' mean if it has no area."""
    twice = _edges(ring, _cross)
    axis = lambda k: F.when(twice != 0, _edges(ring, lambda a, b: (a[k] + b[k]) * _cross(a, b)) / (3 * twice)).otherwise(F.aggregate(ring, F.lit(0.0), lambda t, p: t + p[k]) / F.size(ring))
    return axis("y"), axis("x")


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting: whether an odd number of edges lies right of the point."""

    def crosses(a: Column, b: Column) -> Column:
        straddles = (a["y"] > y) != (b["y"] > y)
        return F.when(straddles & (x < (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"]), 1.0).otherwise(0.0)

    return _edges(ring, crosses) % 2 == 1


def on_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether the point lies on an edge."""

    def on(a: Column, b: Column) -> Column:
        straight = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        between = (x >= F.least(a["x"], b["x"])) & (x <= F.greatest(a["x"], b["x"])) & (y >= F.least(a["y"], b["y"])) & (y <= F.greatest(a["y"], b["y"]))
        return (straight & between).cast("double")

    return _edges(ring, on) > 0


def with_bounds(layer: DataFrame) -> DataFrame:
    """x0, y0, x1, y1 of the column ``ring``."""
    at = lambda f, k: f(F.transform("ring", lambda p: p[k]))
    return layer.withColumns({"x0": at(F.array_min, "x"), "y0": at(F.array_min, "y"), "x1": at(F.array_max, "x"), "y1": at(F.array_max, "y")})


def point_in_ring(points: DataFrame, layer: DataFrame, size: int = 16) -> DataFrame:
    """Pairs of points and polygons (column ``ring``) strictly around them, so not on their edges: candidates by grid cell, then ray casting."""
    both = binned(points, size, "p_").join(binned(with_bounds(layer), size, "a_"), ["bx", "by"])
    inside = (F.col("p_px") >= F.col("a_x0")) & (F.col("p_px") <= F.col("a_x1")) & (F.col("p_py") >= F.col("a_y0")) & (F.col("p_py") <= F.col("a_y1"))
    at = F.col("a_ring"), F.col("p_px"), F.col("p_py")
    return both.where(inside).where(ring_contains(*at) & ~on_ring(*at))


def filter_by_area(layer: DataFrame, min_m2: float, pixel_m: float) -> DataFrame:
    return layer.withColumn("area_m2", rect_area(pixel_m)).where(F.col("area_m2") >= min_m2)


def filter_by_attribute(layer: DataFrame, name: str, allowed: list[str]) -> DataFrame:
    """Any comma-separated token of the attribute, trimmed and lower-cased, is allowed."""
    tokens = F.transform(F.split(F.col(name).cast("string"), ","), lambda t: F.lower(F.trim(t)))
    return layer.where(F.arrays_overlap(tokens, F.array(*[F.lit(a.strip().lower()) for a in allowed])))


def filter_by_distance(points: DataFrame, lat: float, lon: float, most_m: float) -> DataFrame:
    near = points.withColumn("distance_m", haversine_m(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)))
    return near.where(F.col("distance_m") <= most_m)


def max_polygon(layer: DataFrame, pixel_m: float, topk: int) -> DataFrame:
    return layer.withColumn("area_m2", rect_area(pixel_m)).orderBy(F.desc("area_m2"), "id").limit(topk)


def centroid(layer: DataFrame) -> DataFrame:
    """Pixel frame: row is y, column is x."""
    return layer.withColumn("row", (F.col("y0") + F.col("y1")) / 2).withColumn("col", (F.col("x0") + F.col("x1")) / 2)


def perimeter(layer: DataFrame, pixel_m: float) -> DataFrame:
    return layer.withColumn("perimeter_m", 2 * (F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0")) * pixel_m)


def polyline_length(vertices: DataFrame, by: str, order: list[str], pixel_m: float) -> DataFrame:
    """Length of each line whose vertices (px, py) stand in rows."""
    w = Window.partitionBy(by).orderBy(*order)
    dx, dy = F.col("px") - F.lag("px").over(w), F.col("py") - F.lag("py").over(w)
    return vertices.withColumn("step", F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))).groupBy(by).agg((F.sum("step") * pixel_m).alias("length_m"))


def binned(layer: DataFrame, size: int, prefix: str, reach: float = 0) -> DataFrame:
    """A row for each grid cell that the rectangle, widened by ``reach``, touches; columns renamed with ``prefix``."""
    named = layer.select(*[F.col(c).alias(prefix + c) for c in layer.columns])
    span = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(prefix + lo) - reach) / size), F.floor((F.col(prefix + hi) + reach) / size)))
    lo_x, hi_x, lo_y, hi_y = ("x0", "x1", "y0", "y1") if "x0" in layer.columns else ("px", "px", "py", "py")
    return named.select("*", span(lo_x, hi_x).alias("bx")).select("*", span(lo_y, hi_y).alias("by"))


def overlaps(a: DataFrame, b: DataFrame, size: int = 16) -> DataFrame:
    """Pairs of rectangles that share a positive area, with the shared rectangle; each pair once."""
    both = binned(a, size, "a_").join(binned(b, size, "b_"), ["bx", "by"])
    x0, x1 = F.greatest("a_x0", "b_x0"), F.least("a_x1", "b_x1")
    y0, y1 = F.greatest("a_y0", "b_y0"), F.least("a_y1", "b_y1")
    # Only the cell that holds the shared corner reports the pair.
    return both.withColumn("x0", x0).withColumn("x1", x1).withColumn("y0", y0).withColumn("y1", y1).where((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")) & (F.col("bx") == F.floor(F.col("x0") / size)) & (F.col("by") == F.floor(F.col("y0") / size)))


def point_in_polygon(points: DataFrame, layer: DataFrame, size: int = 16) -> DataFrame:
    """Pairs of points and rectangles strictly around them."""
    both = binned(points, size, "p_").join(binned(layer, size, "a_"), ["bx", "by"])
    return both.where((F.col("p_px") > F.col("a_x0")) & (F.col("p_px") < F.col("a_x1")) & (F.col("p_py") > F.col("a_y0")) & (F.col("p_py") < F.col("a_y1")))


def within(points: DataFrame, layer: DataFrame, reach: float, size: int = 16) -> DataFrame:
    """Pairs of points and rectangles at most ``reach`` apart (the predicate form of a buffer)."""
    both = binned(points, size, "p_").join(binned(layer, size, "a_", reach), ["bx", "by"])
    dx = F.greatest(F.col("a_x0") - F.col("p_px"), F.lit(0), F.col("p_px") - F.col("a_x1"))
    dy = F.greatest(F.col("a_y0") - F.col("p_py"), F.lit(0), F.col("p_py") - F.col("a_y1"))
    return both.withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= reach * reach)


def nearest(a: DataFrame, b: DataFrame, k: int = 1, size: int = 16) -> DataFrame:
    """The k nearest points of b for each point of a (a_id, rank, b_id, d2), ties to the smaller id.

    Each point looks at the 3 x 3 grid cells around it; one whose k-th neighbour lies no farther than a cell's width is
    done, the others go on with cells of four times the width. The rounds are logarithmic in the extent; each is written to the shared folder.
    """
    left, done = a.select("id", "px", "py"), None
    extent = b.agg(F.max("px") - F.min("px"), F.max("py") - F.min("py")).first()
    reach = a.agg(F.max(F.abs("px")), F.max(F.abs("py"))).first()
    widest = 2 * (sum(float(x or 0) for x in extent) + sum(float(x or 0) for x in reach)) + size
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    while True:
        cell = lambda c, s=size: F.floor(F.col(c) / s)
        asked = left.select(F.col("id").alias("a_id"), F.col("px").alias("ax"), F.col("py").alias("ay"), cell("px").alias("cx"), cell("py").alias("cy"))
        asked = asked.select("*", F.explode(step).alias("i")).select("*", F.explode(step).alias("j")).withColumn("bx", F.col("cx") + F.col("i")).withColumn("by", F.col("cy") + F.col("j"))
        there = b.select(F.col("id").alias("b_id"), F.col("px").alias("qx"), F.col("py").alias("qy"), cell("px").alias("bx"), cell("py").alias("by"))
        dx, dy = F.col("ax") - F.col("qx"), F.col("ay") - F.col("qy")
        found = asked.join(there.hint("merge"), ["bx", "by"]).withColumn("d2", dx * dx + dy * dy)
        ranked = staged(found.withColumn("rank", F.row_number().over(Window.partitionBy("a_id").orderBy("d2", "b_id"))).where(F.col("rank") <= k).select("a_id", "rank", "b_id", "d2"), "nearest")
        if size >= widest:
            return ranked if done is None else done.unionByName(ranked)
        settled = ranked.groupBy("a_id").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("far")).where((F.col("n") >= k) & (F.col("far") <= size * size)).select("a_id")
        part = ranked.join(settled, "a_id", "left_semi")
        done = part if done is None else done.unionByName(part)
        left = staged(left.join(settled, left["id"] == settled["a_id"], "left_anti"), "unsettled")
        if left.isEmpty():
            return done
        size = size * 4 if size * 4 < widest else int(widest) + 1


def zonal(layer: DataFrame, cells: DataFrame, nodata: float | None) -> DataFrame:
    """Statistics of the valid cells whose centre lies in a rectangle; one raster, cells and layer in one pixel frame."""
    ok = cells.where(valid(F.col("value"), nodata))
    points = ok.select((F.col("c") + 0.5).alias("px"), (F.col("r") + 0.5).alias("py"), "value")
    hits = point_in_polygon(points, layer)
    return hits.groupBy(F.col("a_id").alias("id")).agg(F.count(F.lit(1)).alias("pixel_count"), F.avg("p_value").alias("mean"), F.min("p_value").alias("min"), F.max("p_value").alias("max"), F.stddev_pop("p_value").alias("std"))


def _ring_edges(ring: Column) -> Column:
    after = F.concat(F.slice(ring, 2, F.greatest(F.lit(0), F.size(ring) - 1)), F.slice(ring, 1, 1))
    number = lambda p, k: p[k].cast("double")
    return F.zip_with(ring, after, lambda a, b: F.struct(number(a, "x").alias("ax"), number(a, "y").alias("ay"), number(b, "x").alias("bx"), number(b, "y").alias("by")))


def burnt(layer: DataFrame, by: list[str], all_touched: bool = False) -> DataFrame:
    """The cells of shapes (column ``ring``) as runs: the columns ``by``, r, c0, c1, each cell of a shape in at least one of them.

    A ring of one vertex is a point and takes the cell around it; other rings take the cells whose centre they hold, by the
    crossings of their edges with each row's middle, or with ``all_touched`` also those that an edge meets. Null and empty rings take none.
    """
    shapes = with_bounds(layer.where(F.size("ring") > 0).select(*by, "ring"))
    rows = lambda lo, hi: F.explode(F.filter(F.sequence(lo.cast("long"), F.greatest(lo, hi).cast("long")), lambda r: r <= hi))
    run = lambda lo, hi: F.struct(lo.cast("long").alias("c0"), hi.cast("long").alias("c1"))
    points = shapes.where(F.size("ring") == 1).select(*by, F.floor("y0").alias("r"), run(F.floor("x0"), F.floor("x0")).alias("run"))
    lined = shapes.where(F.size("ring") > 1).withColumn("edges", _ring_edges(F.col("ring")))
    # A centre is inside from the first crossing to the one before the second.
    crossed = lined.select(*by, "edges", rows(F.ceil(F.col("y0") - 0.5), F.floor(F.col("y1") - 0.5)).alias("r"))
    y = F.col("r") + 0.5
    at = F.transform(F.filter("edges", lambda e: (e["ay"] > y) != (e["by"] > y)), lambda e: (e["bx"] - e["ax"]) * ((y - e["ay"]) / (e["by"] - e["ay"])) + e["ax"])
    crossed = crossed.select(*by, "r", F.array_sort(at).alias("x")).where(F.size("x") > 1)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("x") / 2).cast("int") - 1), lambda k: run(F.ceil(F.get("x", 2 * k) - 0.5), F.ceil(F.get("x", 2 * k + 1) - 0.5) - 1))
    runs = points.unionByName(crossed.select(*by, "r", F.explode(pairs).alias("run")))
    if all_touched:
        edges = lined.select(*by, F.explode("edges").alias("e")).select(*by, "e.*")
        low, high = F.least("ay", "by"), F.greatest("ay", "by")
        met = edges.select("*", rows(F.ceil(low - 1), F.floor(high)).alias("r"))
        # The part of the edge within the row, borders included.
        place = lambda v: F.when(F.col("ay") == F.col("by"), F.lit(None)).otherwise(F.col("ax") + (F.col("bx") - F.col("ax")) * F.try_divide(F.greatest(low, F.least(high, v)) - F.col("ay"), F.col("by") - F.col("ay")))
        a, b = F.coalesce(place(F.col("r")), F.col("ax")), F.coalesce(place(F.col("r") + 1), F.col("bx"))
        runs = runs.unionByName(met.select(*by, "r", run(F.ceil(F.least(a, b) - 1), F.floor(F.greatest(a, b))).alias("run")))
    return runs.select(*by, "r", "run.c0", "run.c1").where("c0 <= c1")


def raster_stats(layer: DataFrame, cells: DataFrame, nodata: float | None, min_pixels: int = 1, all_touched: bool = False, width: int = 64) -> tuple[DataFrame, DataFrame]:
    """Statistics of the valid cells under each feature (raster_id, id, ring) of its raster, and of all features' cells together.

    Features are burnt into runs of cells once (``burnt``), which meet the raster's cells by row and stretch of ``width`` columns. Null, NaN
    and infinite values are not valid. Features of fewer than ``min_pixels`` valid cells are left out of both results. A cell under several
    features counts once in the second result, which has one row a raster.
    """
    px = cells.where(valid(F.col("value"), nodata)).select("raster_id", "r", "c", "value", F.floor(F.col("c") / width).alias("stretch"))
    runs = burnt(layer, ["raster_id", "id"], all_touched).where("r >= 0 AND c1 >= 0")
    runs = runs.select("*", F.explode(F.sequence(F.floor(F.greatest(F.lit(0), F.col("c0")) / width), F.floor(F.col("c1") / width))).alias("stretch"))
    hits = px.join(runs, ["raster_id", "r", "stretch"]).where("c BETWEEN c0 AND c1").select("raster_id", "id", "r", "c", "value")
    hits = hits.dropDuplicates(["raster_id", "id", "r", "c"]) if all_touched else hits
    measures = [F.count(F.lit(1)).alias("pixel_count"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_pop("value").alias("std")]
    features = hits.groupBy("raster_id", "id").agg(*measures).where(F.col("pixel_count") >= min_pixels)
    kept = hits if min_pixels <= 1 else hits.join(features.select("raster_id", "id"), ["raster_id", "id"], "left_semi")
    together = kept.groupBy("raster_id", "r", "c").agg(F.first("value").alias("value")).groupBy("raster_id").agg(*measures)
    return features, together


def dissolve(layer: DataFrame, by: str, pixel_m: float) -> DataFrame:
    """Members, summed area and bounds of each group."""
    return layer.groupBy(by).agg(F.count(F.lit(1)).alias("members"), F.sum(rect_area(pixel_m)).alias("area_m2"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def merge_overlapping(layer: DataFrame, components) -> DataFrame:
    """Groups of rectangles connected by positive-area overlaps: group id (smallest member), members, and the largest member."""
    links = overlaps(layer, layer).where("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    named = layer.withColumn("area", rect_area()).join(components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    return named.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.max_by("id", F.struct("area", -F.col("id"))).alias("largest_id"))


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the leftmost; points on its edges are no corners."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(rows: np.ndarray) -> list:
        out: list = []
        for p in rows.tolist():
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def convex_hulls(points: DataFrame, by: str, block: int = 4096) -> DataFrame:
    """Vertices (closing one included) and area of the hull of each group's points.

    Points are dealt out without a shuffle and every Arrow batch leaves the corners of its groups' hulls, of which no hull corner is missing; they are thinned
    to the extreme ones of each column and again, by blocks of columns, to hull corners, so that the last step sees few points whatever the group's size.
    """
    kind = points.schema[by].dataType.simpleString()

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            codes = rows.column("g").dictionary_encode()
            which = codes.indices.to_numpy(zero_copy_only=False)
            xy = np.stack([rows.column(k).to_numpy(zero_copy_only=False) for k in ("px", "py")], 1)
            order = np.argsort(which, kind="stable")
            own = [(int(which[part[0]]), _hull(xy[part])) for part in np.split(order, np.flatnonzero(np.diff(which[order])) + 1) if len(part)]
            names = codes.dictionary.take(pa.array(np.repeat([i for i, _ in own], [len(h) for _, h in own]).astype(np.int32)))
            flat = np.concatenate([h for _, h in own]) if own else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays([names, pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["g", "px", "py"])

    named = points.where(F.col(by).isNotNull() & F.col("px").isNotNull() & F.col("py").isNotNull()).select(F.col(by).alias("g"), F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"))
    first = named.mapInArrow(corners, f"g {kind}, px double, py double")
    thin = first.groupBy("g", "px").agg(F.min("py").alias("lo"), F.max("py").alias("hi")).select("g", "px", F.explode(F.array("lo", "hi")).alias("py"))
    # Neighbouring columns together, then the corners of all blocks.
    again = thin.repartition("g", F.floor(F.col("px") / block)).mapInArrow(corners, f"g {kind}, px double, py double")

    def closed(rows: pa.Table) -> pa.Table:
        ring = _hull(np.stack([rows.column(k).to_numpy() for k in ("px", "py")], 1))
        x, y = ring.T
        area = abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2
        return pa.table({"g": rows.column("g").slice(0, 1), "vertices": pa.array([len(ring) + (len(ring) > 2)], pa.int32()), "area": pa.array([area])})

    return again.groupBy("g").applyInArrow(closed, f"g {kind}, vertices int, area double").withColumnRenamed("g", by)


def _kept(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices Douglas-Peucker keeps: of each stretch the farthest from its chord, while that is farther than the tolerance."""
    keep = np.zeros(len(line), bool)
    keep[[0, -1]] = True
    stretches = [(0, len(line) - 1)]
    while stretches:
        i, j = stretches.pop()
        if j - i < 2:
            continue
        a, d, p = line[i], line[j] - line[i], line[i + 1 : j]
        square = float(d @ d)
        t = np.clip((p - a) @ d / square, 0, 1) if square else np.zeros(len(p))
        far = np.hypot(*(p - a - t[:, None] * d).T)
        m = int(far.argmax())
        if far[m] > tolerance:
            keep[i + 1 + m] = True
            stretches += [(i, i + 1 + m), (i + 1 + m, j)]
    return keep


def simplified_lines(vertices: DataFrame, by: str, order: str, tolerance: float) -> DataFrame:
    """Douglas-Peucker: g (the value of ``by``), vertices of each line before and after, and the vertices that are left (an array of x, y). A line is one
    row of the result, and one group; many lines are worked on in a batch."""
    kind = vertices.schema[by].dataType.simpleString()
    at = F.struct(F.col(order).alias("o"), F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"))
    bare = F.transform(F.array_sort(F.collect_list("at")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    packed = vertices.select(F.col(by).alias("g"), at.alias("at")).groupBy("g").agg(bare.alias("vertices"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            column = rows.column("vertices")
            ends, xy = column.offsets.to_numpy(), np.stack([column.values.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y")], 1)
            keep = np.concatenate([np.zeros(0, bool), *(_kept(xy[a:b], tolerance) for a, b in zip(ends, ends[1:], strict=False))])
            xy = xy[ends[0] : ends[-1]][keep]
            after = np.diff(np.concatenate([[0], np.cumsum(keep)])[ends - ends[0]])
            points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])
            left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(after)]).astype(np.int32)), points)
            yield pa.RecordBatch.from_arrays([rows.column("g"), pa.array(np.diff(ends).astype(np.int32)), pa.array(after.astype(np.int32)), left], ["g", "before", "after", "vertices"])

    return packed.mapInArrow(run, f"g {kind}, before int, after int, vertices array<struct<x:double,y:double>>")


def simplified(vertices: DataFrame, by: str, order: str, tolerance: float) -> DataFrame:
    """Numbers of vertices of each line before and after Douglas-Peucker."""
    return simplified_lines(vertices, by, order, tolerance).select(F.col("g").alias(by), "before", "after")
