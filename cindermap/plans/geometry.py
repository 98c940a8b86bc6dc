"""Registered queries over general polygons, lines, road networks, nested arguments, warps and summaries, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cindermap.operators import arguments, overlay, proximity, roads, summary, vector, warp
from cindermap.plans.registry import query
from cindermap.sources import tables as T
from cindermap.sources.shared import spread

C = F.col


def six(c) -> object:
    return F.round(c, 6)


# --- overlay ---------------------------------------------------------------------------------------------------------
# Shapes in the rectangles: id % 3 = 0 a ring with a hole, 1 an L without its upper right quarter, 2 a triangle or, in the
# layers whose SQL counts quarter cells, the whole rectangle.


def shapes(spark, d, triangles: bool) -> DataFrame:
    x, y = (lambda k, c=c: C(f"{c}0") + (C(f"{c}1") - C(f"{c}0")) * k for c in ("x", "y"))
    ring = lambda *at: F.array(*[F.struct(x(F.lit(i)).cast("double").alias("x"), y(F.lit(j)).cast("double").alias("y")) for i, j in at])
    outer, hole = ring((0, 0), (1, 0), (1, 1), (0, 1)), ring((0.25, 0.25), (0.25, 0.75), (0.75, 0.75), (0.75, 0.25), (0.25, 0.25))
    ell, triangle = ring((0, 0), (1, 0), (1, 0.5), (0.5, 0.5), (0.5, 1), (0, 1)), ring((0, 0), (1, 0), (1, 1))
    rings = F.when(C("id") % 3 == 0, F.array(outer, hole)).when(C("id") % 3 == 1, F.array(ell)).otherwise(F.array(triangle if triangles else outer))
    return T.rects(spark, d).select("id", "class", "brand", rings.alias("rings"))


#: The quarter cells (a side of 0.25) that shapes without triangles cover.
QUARTERS = """quarters AS (
  SELECT id, class, brand, cx, cy FROM (SELECT *, unnest(range(4 * x0, 4 * x1)) AS cx FROM rects), LATERAL (SELECT unnest(range(4 * y0, 4 * y1)) AS cy)
  WHERE CASE id % 3 WHEN 0 THEN NOT (cx >= 4 * x0 + (x1 - x0) AND cx < 4 * x1 - (x1 - x0) AND cy >= 4 * y0 + (y1 - y0) AND cy < 4 * y1 - (y1 - y0))
    WHEN 1 THEN NOT (cx >= 2 * (x0 + x1) AND cy >= 2 * (y0 + y1)) ELSE true END)"""
#: Of a set of cells by key k: area, and length of the outline, which a cell adds to where it has no neighbour.
OUTLINE = """SELECT a.k, count(DISTINCT (a.cx, a.cy)) / 16.0 AS area, sum(CASE WHEN b.cx IS NULL THEN 0.25 ELSE 0 END) AS length
  FROM {cells} a CROSS JOIN (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy) LEFT JOIN {cells} b ON a.k = b.k AND b.cx = a.cx + o.dx AND b.cy = a.cy + o.dy GROUP BY a.k"""
#: Which smallest id a shape of a class reaches by shared cells.
ROOTS = """near{n} AS (SELECT DISTINCT a.id AS a, b.id AS b FROM quarters a JOIN quarters b USING (cx, cy) WHERE a.class = {n} AND b.class = {n}),
  reach{n}(a, b) AS (SELECT a, a FROM near{n} UNION SELECT r.a, n.b FROM reach{n} r JOIN near{n} n ON r.b = n.a),
  root{n} AS (SELECT a AS id, min(b) AS root FROM reach{n} GROUP BY a)"""

PIECES = """WITH parts AS (
  SELECT id, class, 1 AS sign, id % 3 = 2 AS tri, x0, y0, x1, y1, x0 AS tx, y0 AS ty, CAST(y1 - y0 AS DOUBLE) / (x1 - x0) AS m FROM rects
  UNION ALL SELECT id, class, -1, false, x0 + (x1 - x0) / 4.0, y0 + (y1 - y0) / 4.0, x1 - (x1 - x0) / 4.0, y1 - (y1 - y0) / 4.0, 0, 0, 1 FROM rects WHERE id % 3 = 0
  UNION ALL SELECT id, class, -1, false, (x0 + x1) / 2.0, (y0 + y1) / 2.0, x1, y1, 0, 0, 1 FROM rects WHERE id % 3 = 1
), cut AS (
  SELECT a.id AS a_id, b.id AS b_id, a.sign * b.sign AS sign, b.tri, b.tx, b.ty, b.m, greatest(a.x0, b.x0) AS x0, least(a.x1, b.x1) AS x1, greatest(a.y0, b.y0) AS y0, least(a.y1, b.y1) AS y1
  FROM parts a JOIN parts b ON a.class = 0 AND a.id % 3 < 2 AND b.class = 1 AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
), measured AS (
  SELECT a_id, b_id, sum(sign * CASE WHEN tri THEN (power(greatest(ty + (x1 - tx) * m - y0, 0), 2) - power(greatest(ty + (x0 - tx) * m - y0, 0), 2)
    - power(greatest(ty + (x1 - tx) * m - y1, 0), 2) + power(greatest(ty + (x0 - tx) * m - y1, 0), 2)) / (2 * m) ELSE (x1 - x0) * (y1 - y0) END) AS area FROM cut GROUP BY ALL
)
SELECT a_id, b_id, round(area, 6) AS area FROM measured WHERE area > 0.000001"""


@query(PIECES, "rects")
def overlay_pieces(spark, d):
    layer = shapes(spark, d, triangles=True)
    found = overlay.pieces(layer.where("class = 0 AND id % 3 < 2"), layer.where("class = 1"))
    # The outlines' own area, so that the rings are held against the SQL too.
    signed = F.abs(F.aggregate("rings", F.lit(0.0), lambda t, r: t + overlay.signed_area(r)))
    return found.select("a_id", "b_id", six(signed).alias("area"))


@query(f"WITH RECURSIVE {QUARTERS}, {ROOTS.format(n=0)}, {ROOTS.format(n=1)}, sides AS (SELECT DISTINCT root, cx, cy FROM quarters JOIN root0 USING (id)), others AS (SELECT DISTINCT root, cx, cy FROM quarters JOIN root1 USING (id)), shared AS (SELECT s.root AS a, o.root AS b, count(*) AS n FROM sides s JOIN others o USING (cx, cy) GROUP BY ALL) SELECT count(*) AS intersection_count, count(DISTINCT a) AS intersecting_a_count, count(DISTINCT b) AS intersecting_b_count, round(sum(n) / 16.0, 4) AS area_px2, round(sum(n) / 64.0, 4) AS area_m2 FROM shared", "rects")
def intersect_merged(spark, d):
    layer = shapes(spark, d, triangles=False)
    found = overlay.totals(overlay.intersect(layer.where("class = 0"), layer.where("class = 1"), with_rings=False), 0.5)
    return found.withColumns({c: F.round(c, 4) for c in ("area_px2", "area_m2")})


@query(f"WITH {QUARTERS}, cells AS (SELECT DISTINCT brand AS k, cx, cy FROM quarters), told AS ({OUTLINE.format(cells='cells')}) SELECT k AS brand, round(area, 4) AS area, round(length, 4) AS length FROM told", "rects")
def dissolve_union(spark, d):
    made = overlay.union_lengths(shapes(spark, d, triangles=False), "brand")
    return made.select("brand", F.round("area", 4).alias("area"), F.round("length", 4).alias("length"))


@query(f"WITH {QUARTERS}, roi AS (SELECT DISTINCT cx, cy FROM quarters WHERE class = 2), cells AS (SELECT id AS k, cx, cy FROM quarters JOIN roi USING (cx, cy) WHERE class <> 2), told AS ({OUTLINE.format(cells='cells')}) SELECT k AS id, round(area, 4) AS area, round(length, 4) AS length FROM told", "rects")
def clip_union(spark, d):
    layer = shapes(spark, d, triangles=False)
    made = overlay.clip(layer.where("class <> 2"), layer.where("class = 2"))
    return made.select("id", F.round("area", 4).alias("area"), F.round(overlay.length_of(C("rings")), 4).alias("length"))


@query(f"WITH RECURSIVE {QUARTERS}, {ROOTS.format(n=2)}, sized AS (SELECT root, id, count(*) AS n FROM quarters JOIN root2 USING (id) GROUP BY ALL), groups AS (SELECT root, count(*) AS members, arg_max(id, n * 1000000000 - id) AS largest_id FROM sized GROUP BY root), cells AS (SELECT DISTINCT root AS k, cx, cy FROM quarters JOIN root2 USING (id)), told AS ({OUTLINE.format(cells='cells')}) SELECT root, members, largest_id, round(area, 4) AS area, round(length, 4) AS length FROM groups JOIN told ON root = k", "rects")
def merge_polygons(spark, d):
    made = overlay.merged(shapes(spark, d, triangles=False).where("class = 2"))
    return made.select("root", "members", "largest_id", F.round("area", 4).alias("area"), F.round(overlay.length_of(C("rings")), 4).alias("length"))


@query(f"WITH {QUARTERS}, moved AS (SELECT id, cx + 4 AS cx, cy + 2 * class AS cy FROM quarters), shared AS (SELECT id, count(*) AS n FROM quarters JOIN moved USING (id, cx, cy) GROUP BY id), sized AS (SELECT id, count(*) AS n FROM quarters GROUP BY id) SELECT id, round(coalesce(s.n, 0) / 16.0, 4) AS shared, round((2 * z.n - coalesce(s.n, 0)) / 16.0, 4) AS together, round(coalesce(s.n, 0) / CAST(2 * z.n - coalesce(s.n, 0) AS DOUBLE), 6) AS iou FROM sized z LEFT JOIN shared s USING (id)", "rects")
def iou_polygons(spark, d):
    moved = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct((p["x"] + 1).alias("x"), (p["y"] + C("class") / 2).alias("y"))))
    pairs = shapes(spark, d, triangles=False).select("id", C("rings").alias("a_rings"), moved.alias("b_rings"))
    return overlay.measured(pairs).select("id", F.round("shared", 4).alias("shared"), F.round("together", 4).alias("together"), six(C("iou")).alias("iou"))


# --- road networks ---------------------------------------------------------------------------------------------------
# A crossing a supplier: four straight roads of one pixel's width, damaged towards their tips. Its centre, the four pixels around
# it and the tips are nodes.

ARM = "SELECT s_suppkey AS raster_id, d, dr, dc, 24 + s_suppkey % 5 AS r, 24 + s_suppkey % 7 AS c, 8 + s_suppkey * (d + 3) % 9 AS n, s_suppkey * (d + 1) % (8 + s_suppkey * (d + 3) % 9) AS k FROM supplier, (VALUES (0, -1, 0), (1, 0, 1), (2, 1, 0), (3, 0, -1)) a(d, dr, dc)"
ARMS = f"""arms AS (SELECT *, (r + dr) * 65536 + c + dc AS near, (r + n * dr) * 65536 + c + n * dc AS tip, least(k, n - 3) >= 0.5 * (n - 3) AND k > 0 AS damaged FROM ({ARM})),
  lines AS (
    SELECT raster_id, least(near, tip) AS u, greatest(near, tip) AS v, n - 1.0 AS length, damaged FROM arms
    UNION ALL SELECT raster_id, least(near, r * 65536 + c), greatest(near, r * 65536 + c), 1.0, false FROM arms
    UNION ALL SELECT a.raster_id, least(a.near, b.near), greatest(a.near, b.near), 1.41421356237, false FROM arms a JOIN arms b ON a.raster_id = b.raster_id AND b.d = (a.d + 1) % 4)"""


def crossings(spark, d) -> DataFrame:
    """Mask cells: 1 intact, 2 flooded, 3 blocked."""
    s = C("s_suppkey")
    arm = F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.lit(r).alias("dr"), F.lit(c).alias("dc")) for i, (r, c) in enumerate(((-1, 0), (0, 1), (1, 0), (0, -1)))]))
    arms = spread(T.table(spark, d, "supplier").select(s), "s_suppkey").select(s.alias("raster_id"), arm.alias("a")).select("raster_id", "a.*")
    n = 8 + C("raster_id") * (C("d") + 3) % 9
    arms = arms.withColumns({"n": n, "k": C("raster_id") * (C("d") + 1) % n}).select("*", F.explode(F.sequence(F.lit(0).cast("long"), C("n").cast("long"))).alias("i"))
    value = F.when(C("i") <= C("n") - C("k"), 1).otherwise(2 + C("d") % 2)
    cells = arms.select("raster_id", (24 + C("raster_id") % 5 + C("i") * C("dr")).cast("int").alias("r"), (24 + C("raster_id") % 7 + C("i") * C("dc")).cast("int").alias("c"), value.alias("value"))
    return cells.groupBy("raster_id", "r", "c").agg(F.min("value").alias("value"))


@query(f"WITH {ARMS} SELECT raster_id, u, v, round(CAST(length AS DOUBLE), 6) AS length, damaged FROM lines")
def centerline_edges(spark, d):
    return roads.centerlines(crossings(spark, d), 64, 64).select("raster_id", "u", "v", six(C("length")).alias("length"), "damaged")


@query(f"WITH {ARMS} SELECT raster_id AS graph, node, CAST(node // 65536 AS INT) AS r, CAST(node % 65536 AS INT) AS c, count(*) AS degree FROM (SELECT raster_id, u AS node FROM lines UNION ALL SELECT raster_id, v FROM lines) GROUP BY ALL")
def centerline_graph(spark, d):
    return roads.road_graph(roads.centerlines(crossings(spark, d), 64, 64))[0]


#: kind 0: from beside the upper road to beside the right one; 1: along the upper road; 2: from its tip to the centre; 3: from a far corner; 4: in a graph without roads.
ROUTES = f"""WITH {ARMS}, up AS (SELECT * FROM arms WHERE d = 0), x AS (
  SELECT up.raster_id, up.r, up.c, up.n, up.damaged AS u_hurt, b.damaged AS r_hurt, 2 + up.raster_id % 5 AS i, 2 + up.raster_id % 4 AS j FROM up JOIN arms b ON b.raster_id = up.raster_id AND b.d = 1)
SELECT raster_id * 10 AS id, 'ok' AS status, round(CAST(CASE WHEN u_hurt THEN 0 ELSE i - 1 END + 1.41421356237 + CASE WHEN r_hurt THEN 0 ELSE j - 1 END AS DOUBLE), 6) AS distance_px,
  r - CASE WHEN u_hurt THEN 1 ELSE i END AS start_r, c AS start_c, r AS end_r, c + CASE WHEN r_hurt THEN 1 ELSE j END AS end_c, CAST(CASE WHEN u_hurt THEN 0 ELSE i - 1 END + 2 + CASE WHEN r_hurt THEN 0 ELSE j - 1 END AS INT) AS pixels FROM x
UNION ALL SELECT raster_id * 10 + 1, 'ok', CASE WHEN u_hurt THEN 0 ELSE 3 END, r - CASE WHEN u_hurt THEN 1 ELSE 2 END, c, r - CASE WHEN u_hurt THEN 1 ELSE 5 END, c, CASE WHEN u_hurt THEN 1 ELSE 4 END FROM x
UNION ALL SELECT raster_id * 10 + 2, CASE WHEN u_hurt AND n > 11 THEN 'snapped_on_damaged' ELSE 'ok' END, CASE WHEN NOT u_hurt THEN n WHEN n <= 11 THEN 1 END, r - CASE WHEN u_hurt AND n <= 11 THEN 1 ELSE n END, c, r, c, CASE WHEN NOT u_hurt THEN n + 1 WHEN n <= 11 THEN 2 ELSE 0 END FROM x
UNION ALL SELECT raster_id * 10 + 3, 'snap_failed', NULL, 0, 0, r, c, 0 FROM x
UNION ALL SELECT raster_id * 10 + 4, 'no_roads', NULL, r, c, r, c, 0 FROM x"""


@query(ROUTES)
def snapped_routes(spark, d):
    _, edges = roads.road_graph(roads.centerlines(crossings(spark, d), 64, 64))
    s = C("s_suppkey")
    r, c, i, j, n = 24 + s % 5, 24 + s % 7, 2 + s % 5, 2 + s % 4, 8 + s * 3 % 9
    zero = F.lit(0).cast("long")
    asked = [(0, s, r - i, c - 1, r + 1, c + j), (1, s, r - 2, c, r - 5, c), (2, s, r - n, c, r, c), (3, s, zero, zero, r, c), (4, -1 - s, r, c, r, c)]
    names = ("graph", "sr", "sc", "er", "ec")
    each = F.explode(F.array(*[F.struct((s * 10 + k).alias("id"), *[x.cast("long").alias(a) for x, a in zip(rest, names)]) for k, *rest in asked]))
    requests = T.table(spark, d, "supplier").select(each.alias("q")).select("q.*")
    found = roads.snapped_routes(edges, requests)
    ends = [C(e).cast("long").alias(e) for e in ("start_r", "start_c", "end_r", "end_c")]
    return found.select("id", "status", six(C("distance_px")).alias("distance_px"), *ends, F.when(C("path").isNotNull(), F.size("path")).otherwise(0).alias("pixels"))


# --- distances, buffers, cells ---------------------------------------------------------------------------------------


def geometries(spark, d, lines: bool) -> DataFrame:
    """Shapes without triangles as filled geometries; with ``lines``, of the rectangles: lower edges (even ids) and whole rectangles."""
    if not lines:
        return shapes(spark, d, triangles=False).select("id", "class", C("rings").alias("parts"), F.lit(True).alias("filled"))
    at = lambda x, y: F.struct(C(x).cast("double").alias("x"), C(y).cast("double").alias("y"))
    even = C("id") % 2 == 0
    part = F.when(even, F.array(at("x0", "y0"), at("x1", "y0"))).otherwise(F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1")))
    return T.rects(spark, d).select("id", "class", F.array(part).alias("parts"), (~even).alias("filled"))


#: Distances by rectangles that make up the shapes; an even id of the other layer is its lower edge.
DISTANCES = """pieces AS (
  SELECT id, class, x0, y0, x1, y1 FROM rects WHERE id % 3 = 2
  UNION ALL SELECT id, class, x0, y0, x1, (y0 + y1) / 2.0 FROM rects WHERE id % 3 = 1 UNION ALL SELECT id, class, x0, y0, (x0 + x1) / 2.0, y1 FROM rects WHERE id % 3 = 1
  UNION ALL SELECT id, class, x0, y0, x1, y0 + (y1 - y0) / 4.0 FROM rects WHERE id % 3 = 0 UNION ALL SELECT id, class, x0, y1 - (y1 - y0) / 4.0, x1, y1 FROM rects WHERE id % 3 = 0
  UNION ALL SELECT id, class, x0, y0, x0 + (x1 - x0) / 4.0, y1 FROM rects WHERE id % 3 = 0 UNION ALL SELECT id, class, x1 - (x1 - x0) / 4.0, y0, x1, y1 FROM rects WHERE id % 3 = 0
), gaps AS (
  SELECT a.id AS a_id, b.id AS b_id, greatest(0.0, a.x0 - b.x1, b.x0 - a.x1) AS dx, greatest(0.0, a.y0 - b.y1, b.y0 - CASE WHEN a.id % 2 = 0 THEN a.y0 ELSE a.y1 END) AS dy
  FROM rects a JOIN pieces b ON a.class = 0 AND b.class = 1
), far AS (SELECT a_id, b_id, min(sqrt(CAST(dx AS DOUBLE) * dx + CAST(dy AS DOUBLE) * dy)) AS distance FROM gaps GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY distance, b_id) AS rank FROM far)"""


def nearest_of(spark, d, k: int) -> DataFrame:
    return proximity.nearest_geometries(geometries(spark, d, True).where("class = 0"), geometries(spark, d, False).where("class = 1"), k)


def told_pairs(found: DataFrame) -> DataFrame:
    """The connector's own length beside the distance."""
    return found.select("a_id", C("rank").cast("int").alias("rank"), "b_id", six(C("distance")).alias("distance"), six(F.hypot(C("ax") - C("bx"), C("ay") - C("by"))).alias("link"))


@query(f"WITH {DISTANCES} SELECT a_id, CAST(rank AS INT) AS rank, b_id, round(distance, 6) AS distance, round(distance, 6) AS link FROM ranked WHERE rank = 1", "rects")
def nearest_geometry_k1(spark, d):
    return told_pairs(nearest_of(spark, d, 1))


@query(f"WITH {DISTANCES} SELECT a_id, CAST(rank AS INT) AS rank, b_id, round(distance, 6) AS distance, round(distance, 6) AS link FROM ranked WHERE rank <= 3", "rects")
def nearest_geometry_k3(spark, d):
    return told_pairs(nearest_of(spark, d, 3))


@query(f"WITH {DISTANCES} SELECT a_id, CAST(rank AS INT) AS rank, b_id, round(distance, 6) AS distance, round(distance, 6) AS link FROM ranked ORDER BY distance, a_id, rank LIMIT 1", "rects")
def closest_pair(spark, d):
    return told_pairs(proximity.closest_pair(nearest_of(spark, d, 1)))


#: A round corner of n quarters, with 16 segments a quarter, has n / 4 * 32 sin(2 pi / 64) r^2.
ROUND = "32 * sin(pi() / 32)"


@query(f"SELECT id, r AS distance, round(CASE id % 3 WHEN 2 THEN w * h + 2 * r * (w + h) + {ROUND} * r * r WHEN 1 THEN 0.75 * w * h + 2 * r * (w + h) - r * r + 1.25 * {ROUND} * r * r ELSE w * h + 2 * r * (w + h) + {ROUND} * r * r - greatest(0, w / 2 - 2 * r) * greatest(0, h / 2 - 2 * r) END, 6) AS area FROM (SELECT id, CAST(x1 - x0 AS DOUBLE) AS w, CAST(y1 - y0 AS DOUBLE) AS h FROM rects), (VALUES (CAST(0.125 AS DOUBLE)), (0.25)) k(r)", "rects")
def buffer_outlines(spark, d):
    """The area is that of the outline."""
    made = proximity.buffers(geometries(spark, d, False), [0.125, 0.25])
    return made.select("id", "distance", six(F.abs(F.aggregate("rings", F.lit(0.0), lambda t, r: t + overlay.signed_area(r)))).alias("area"))


@query(f"SELECT id, r AS distance, round(CASE WHEN id % 2 = 0 THEN CASE WHEN r > 0 THEN 2 * r * w + {ROUND} * r * r ELSE 0 END WHEN r > 0 THEN w * h + 2 * r * (w + h) + {ROUND} * r * r ELSE (w + 2 * r) * (h + 2 * r) END, 6) AS area FROM (SELECT id, CAST(x1 - x0 AS DOUBLE) AS w, CAST(y1 - y0 AS DOUBLE) AS h FROM rects), (VALUES (CAST(2.5 AS DOUBLE)), (-0.25)) k(r)", "rects")
def buffer_lines(spark, d):
    """Lines, and rectangles that also shrink."""
    return proximity.buffers(geometries(spark, d, True), [2.5, -0.25], with_rings=False).select("id", "distance", six(C("area")).alias("area"))


@query("WITH s AS (SELECT DISTINCT px, py FROM sites) SELECT count(*) AS cells, count(*) AS own, round(CAST((max(px) - min(px) + 20) * (max(py) - min(py) + 20) AS DOUBLE), 4) AS area FROM s", "sites")
def voronoi_cells(spark, d):
    """Cells over the sites' bounds, widened by ten: how many, how many hold their own site, and their areas' sum."""
    sites = T.sites(spark, d)
    ends = sites.agg(F.min("px") - 10, F.min("py") - 10, F.max("px") + 10, F.max("py") + 10).first()
    cells = proximity.voronoi(sites, tuple(map(float, ends))).join(sites.select("id", "px", "py"), "id")
    return cells.agg(F.count(F.lit(1)).alias("cells"), F.count_if(vector.ring_contains(C("ring"), C("px"), C("py"))).alias("own"), F.round(F.sum("area"), 4).alias("area"))


# --- nested arguments ------------------------------------------------------------------------------------------------


def nested(k, path: str, *, extra: bool = False) -> object:
    """An argument object with a map, a list in it, a file and a list written as text."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return text('{"k": ', k, ', "m": {"a": [', k, ', "x"', ', 9' if extra else "", '], "p": "', path, k, '.png"}, "on": true, "s": "[', k, ', {\\"t\\": null}]"}')


LEAVES = [("/k", "'number'", "k"), ("/m/a/0", "'number'", "k"), ("/m/a/1", "'string'", "'x'"), ("/m/p", "'string'", "'/data/in_' || k || '.png'"), ("/on", "'boolean'", "'true'"), ("/s/0", "'number'", "k"), ("/s/1/t", "'null'", "NULL")]


@query(" UNION ALL ".join(f"SELECT event_id, '{path}' AS path, {kind} AS kind, {leaf} AS leaf FROM (SELECT event_id, CAST(event_id % 50 AS VARCHAR) AS k FROM events)" for path, kind, leaf in LEAVES))
def argument_leaves(spark, d):
    rows = T.table(spark, d, "events").select("event_id", nested(C("event_id") % 50, "/data/in_").alias("args"))
    nodes = arguments.walked(rows, ["event_id"], "args", coerce=True)
    return nodes.where("kind NOT IN ('object', 'array')").select("event_id", "path", "kind", "leaf")


@query("SELECT event_id AS task, CASE event_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.75 WHEN 3 THEN 1.0 ELSE 0.0 END AS score FROM events")
def argument_accuracy(spark, d):
    """One step a task: the same arguments, another number, a longer list, another input file, another tool."""
    e, n = T.table(spark, d, "events"), C("event_id") % 5
    k = C("event_id") % 50
    told = lambda call, args: e.select(C("event_id").alias("task"), F.lit(1).alias("step"), call.alias("call"), args.alias("args"), F.lit(None).cast("string").alias("obs"))
    other = F.when(n == 1, F.regexp_replace(nested(k, "/g/in_"), r'^\{"k": \d+', '{"k": 500')).when(n == 2, nested(k, "/g/in_", extra=True)).when(n == 3, nested(k, "/p/raw_")).otherwise(nested(k, "/g/in_"))
    gold, pred = told(F.lit("ras.area"), nested(k, "/g/in_")), told(F.when(n == 4, "ras.stats").otherwise("ras_area(x)"), other)
    return arguments.parameter_accuracy(gold, pred, "task")


# --- warps and densities ---------------------------------------------------------------------------------------------

CUBIC = "CASE WHEN abs({t}) <= 1 THEN (1.5 * abs({t}) - 2.5) * {t} * {t} + 1 WHEN abs({t}) < 2 THEN ((2.5 - 0.5 * abs({t})) * abs({t}) - 4) * abs({t}) + 2 ELSE 0 END"


@query(f"WITH t AS (SELECT i.i AS r, j.j AS c, CAST((i.i + 0.5) * 16 / 20 - 0.5 AS DOUBLE) AS y, CAST((j.j + 0.5) * 16 / 20 - 0.5 AS DOUBLE) AS x FROM range(20) i(i), range(20) j(j)), taps AS (SELECT r, c, {CUBIC.format(t='(y - (floor(y) + k.k))')} * {CUBIC.format(t='(x - (floor(x) + l.l))')} AS w, greatest(0, least(15, floor(y) + k.k)) AS sr, greatest(0, least(15, floor(x) + l.l)) AS sc FROM t, range(-1, 3) k(k), range(-1, 3) l(l)) SELECT raster_id, CAST(t.r AS INT) AS r, CAST(t.c AS INT) AS c, round(sum(w * value), 8) AS value FROM taps t JOIN dem d ON d.r = t.sr AND d.c = t.sc GROUP BY ALL", "dem")
def resample_cubic(spark, d):
    return warp.resample(T.dem(spark, d), T.SIDE, T.SIDE, 0.5, 0.4, "cubic").withColumn("value", F.round("value", 8))


#: A frame in UTM zone 33.
UTM_FRAME = (30.0, 0.0, 500_000.0, 0.0, -30.0, 5_000_000.0)


@query("SELECT raster_id, count(*) AS cells, count(*) AS same FROM dem GROUP BY raster_id", "dem")
def reproject_round_trip(spark, d):
    """Elevations to degrees, finely, and back to their own frame by the nearest cell: all come back."""
    cells = T.dem(spark, d)
    fine = (0.00005, 0.0, 14.999, 0.0, -0.00005, 45.155)
    there = warp.reproject(cells, T.SIDE, T.SIDE, UTM_FRAME, "EPSG:32633", "EPSG:4326", "nearest", (fine, 160, 180))
    back = warp.reproject(there, 160, 180, fine, "EPSG:4326", "EPSG:32633", "nearest", (UTM_FRAME, T.SIDE, T.SIDE))
    both = back.withColumnRenamed("value", "own").join(cells.hint("merge"), ["raster_id", "r", "c"])
    return both.groupBy("raster_id").agg(F.count(F.lit(1)).alias("cells"), F.count_if(C("own") == C("value")).alias("same"))


@query("WITH f AS (SELECT count(*) AS n, min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1, var_samp(px) * power(count(*), -1.0 / 3) AS xx, var_samp(py) * power(count(*), -1.0 / 3) AS yy, covar_samp(px, py) * power(count(*), -1.0 / 3) AS xy FROM pois), g AS (SELECT i, j, x0 + (x1 - x0) * i / 199.0 AS gx, y0 + (y1 - y0) * j / 199.0 AS gy FROM f, range(200) a(i), range(200) b(j)), p AS (SELECT CAST(px AS DOUBLE) AS px, CAST(py AS DOUBLE) AS py, count(*) AS w FROM pois GROUP BY ALL), k AS (SELECT i, j, sum(w * exp(-0.5 / (xx * yy - xy * xy) * (yy * (gx - px) * (gx - px) + xx * (gy - py) * (gy - py) - 2 * xy * (gx - px) * (gy - py)))) / any_value(2 * pi() * sqrt(xx * yy - xy * xy) * n) AS density FROM g, p, f GROUP BY i, j) SELECT round(max(density) * 1000000, 4) AS kde_max, round(avg(density) * 1000000, 4) AS kde_mean, count(*) AS cells FROM k", "pois")
def heatmap_density(spark, d):
    """The largest and the mean density, in millionths."""
    density, _ = warp.heatmap(T.pois(spark, d))
    return density.agg(F.round(F.max("density") * 1_000_000, 4).alias("kde_max"), F.round(F.avg("density") * 1_000_000, 4).alias("kde_mean"), F.count(F.lit(1)).alias("cells"))


# --- summaries -------------------------------------------------------------------------------------------------------

NAMES = ["Before_After_{n}.png", "damage_board{n}.png", "pie_{n}.png", "report{n}.tif", "road_map_{n}.png", "pre_{n}.tif", "pre_post_{n}.tif", "scene{n}.tif"]


@query("SELECT p_partkey, ['before_after_panel', 'situation_board', 'chart', 'report_page', 'damage_or_hazard_map', 'pre_disaster_image', 'post_disaster_image', 'context_image'][1 + p_partkey % 8] AS role FROM part")
def image_roles(spark, d):
    key = C("p_partkey")
    name = F.get(F.array(*[F.concat(F.lit("/in/map/" + n.split("{n}")[0]), key.cast("string"), F.lit(n.split("{n}")[1])) for n in NAMES]), (key % 8).cast("int"))
    return T.table(spark, d, "part").select("p_partkey", summary.image_role(name).alias("role"))


@query("WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k) AS place FROM (SELECT user_id, event_type AS k, count(*) AS n FROM events GROUP BY ALL)), t AS (SELECT user_id, string_agg(k || '=' || n, ', ' ORDER BY place) AS shown FROM s WHERE place <= 4 GROUP BY user_id) SELECT c_custkey AS task, CASE WHEN c_custkey % 2 = 0 THEN 'Image-aware LLM summary unavailable' ELSE 'LLM summary unavailable' END || '; using trajectory statistics only. Key outputs include ' || coalesce(shown, 'no prominent quantitative statistics were extracted') || '.' || CASE WHEN c_custkey % 3 = 0 THEN ' Recovery should prioritize critical infrastructure, housing, and environmental stabilization in that order where feasible.' ELSE '' END AS summary, c_custkey % 3 = 0 AS recommendations, 'low' AS confidence FROM customer LEFT JOIN t ON user_id = c_custkey")
def summary_fallback(spark, d):
    e = T.table(spark, d, "events").groupBy(C("user_id").alias("task"), C("event_type").alias("key")).agg(F.count(F.lit(1)).alias("value"))
    place = F.row_number().over(Window.partitionBy("task").orderBy("key"))
    key = C("c_custkey")
    tasks = T.table(spark, d, "customer").select(key.alias("task"), F.when(key % 3 == 0, "Plan the REPAIR of roads").otherwise("Count the roads").alias("question"), ((key + 1) % 2).alias("images"))
    return summary.fallback(tasks, e.withColumn("place", place), "task")


@query("SELECT o_orderkey, o_custkey % 5 AS place, CAST(o_custkey % 5 // 3 AS INT) AS row, CAST(o_custkey % 5 % 3 AS INT) AS col, CAST(20 + o_custkey % 5 % 3 * 440 AS INT) AS x, CAST(70 + o_custkey % 5 // 3 * 360 AS INT) AS y, 't' || (o_custkey % 5 + 1) AS label FROM orders")
def panel_places(spark, d):
    images = T.table(spark, d, "orders").select("o_orderkey", (C("o_custkey") % 5).alias("place"))
    return summary.panels(images, "o_orderkey", "place", 3)
