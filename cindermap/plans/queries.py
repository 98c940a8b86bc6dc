"""Registered queries of the geospatial, record, graph and scoring operators, each with its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cindermap.functions import answers as A
from cindermap.functions import crs
from cindermap.functions import scalar as S
from cindermap.operators import evaluation, evidence, graph, perceive, raster, records, scoring, vector
from cindermap.plans import geometry, trajectory  # noqa: F401  geometry registers its own
from cindermap.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from cindermap.sources import files
from cindermap.sources import tables as T
from cindermap.sources.shared import shared_dir, spread

C = F.col


def six(c) -> object:
    return F.round(c, 6)


# --- scalars ---------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice + l_quantity, 6) AS added, round(l_extendedprice - l_quantity, 6) AS subtracted, round(abs(l_quantity - l_extendedprice), 6) AS apart, round(l_extendedprice * l_quantity, 4) AS product, CAST(l_extendedprice > l_quantity * 1000 AS INT) AS greater, round(l_extendedprice * l_discount, 6) AS volume FROM lineitem")
def calc_arith(spark, d):
    p, q = C("l_extendedprice"), C("l_quantity")
    return T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", six(p + q).alias("added"), six(p - q).alias("subtracted"), six(F.abs(q - p)).alias("apart"), F.round(p * q, 4).alias("product"), (p > q * 1000).cast("int").alias("greater"), six(p * C("l_discount")).alias("volume"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 0.0 ELSE round(l_extendedprice / (l_linenumber - 1), 6) END AS ratio FROM lineitem")
def calc_div_zero(spark, d):
    return T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", six(S.safe_div(C("l_extendedprice"), C("l_linenumber") - 1)).alias("ratio"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 2 THEN 0 ELSE CAST(ceil(l_quantity / (l_linenumber - 2)) AS BIGINT) END AS trips FROM lineitem")
def truck_trips(spark, d):
    return T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.truck_trips(C("l_quantity"), C("l_linenumber") - 2).alias("trips"))


@query("SELECT id, round(sqrt((px - 40) * (px - 40) + (py - 30) * (py - 30)) * 0.5, 6) AS metres FROM pois", "pois")
def point_distance(spark, d):
    return T.pois(spark, d).select("id", six(S.pixel_distance(C("py"), C("px"), F.lit(30), F.lit(40), 0.5)).alias("metres"))


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) * 0.5 + CAST(embedding[2] AS DOUBLE) * 0.25 + CAST(embedding[3] AS DOUBLE) * 0.25, 6) AS plain, round((CAST(embedding[1] AS DOUBLE) * 2 + CAST(embedding[2] AS DOUBLE)) / 3, 6) AS normalized FROM embeddings")
def weighted_sum(spark, d):
    v = C("embedding").cast("array<double>")
    w = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    return T.table(spark, d, "embeddings").select("vec_id", six(S.weighted_sum(F.slice(v, 1, 3), w(0.5, 0.25, 0.25))).alias("plain"), six(S.weighted_sum(F.slice(v, 1, 2), w(2, 1), True)).alias("normalized"))


HAVERSINE = "2 * 6371000 * atan2(sqrt(a), sqrt(1 - a))"
NEAR_POIS = "(SELECT id, lat, pow(sin(radians(lat - 10.0) / 2), 2) + cos(radians(10.0)) * cos(radians(lat)) * pow(sin(radians(lon - 20.0) / 2), 2) AS a FROM pois)"


@query(f"SELECT id, round({HAVERSINE}, 2) AS metres FROM {NEAR_POIS}", "pois")
def haversine(spark, d):
    return T.pois(spark, d).select("id", F.round(S.haversine_m(C("lat"), C("lon"), F.lit(10.0), F.lit(20.0)), 2).alias("metres"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.a.b') AS missing FROM events")
def nested_get(spark, d):
    return T.table(spark, d, "events").select("event_id", S.nested_get(C("props"), "k").cast("long").alias("k"), S.nested_get(C("props"), "a.b").alias("missing"))


@query("SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(trim(c_name || '  (' || c_mktsegment || ')!')), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS name, regexp_replace(lower(c_mktsegment) || '_tool_a', '^([^_]+)_', '\\1.') AS tool, CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE CAST(c_custkey AS VARCHAR) END AS answer FROM customer")
def normalize_names(spark, d):
    name = F.concat("c_name", F.lit("  ("), "c_mktsegment", F.lit(")!"))
    tool = F.concat(F.lower("c_mktsegment"), F.lit("_tool_a(x=1)"))
    answer = F.when(C("c_custkey") % 2 == 0, " Yes ").otherwise(F.concat(C("c_custkey").cast("string"), F.lit(".0")))
    return T.table(spark, d, "customer").select("c_custkey", S.normalize_text(name).alias("name"), S.normalize_tool(tool).alias("tool"), S.canonical(answer).alias("answer"))


@query("SELECT o_orderkey, 'r' || CAST(o_orderkey % 7 AS VARCHAR) || 'c' || CAST(o_custkey % 5 AS VARCHAR) || '-' || o_orderstatus AS label FROM orders")
def label_template(spark, d):
    return T.table(spark, d, "orders").select("o_orderkey", S.label("r{row}c{col}-{status}", row=(C("o_orderkey") % 7).cast("double"), col=C("o_custkey") % 5, status=C("o_orderstatus")).alias("label"))


@query("SELECT id, round(500000 + 0.5 * px, 6) AS x, round(4000000 - 0.5 * py, 6) AS y FROM pois", "pois")
def pixel_to_world(spark, d):
    x, y = S.pixel_to_world(C("py"), C("px"), (0.5, 0, 500_000, 0, -0.5, 4_000_000))
    return T.pois(spark, d).select("id", six(x).alias("x"), six(y).alias("y"))


@query("SELECT id, CAST(trunc((20 - lat) / 0.25) AS INT) AS r, CAST(trunc((lon + 30) / 0.25) AS INT) AS c FROM pois WHERE trunc((20 - lat) / 0.25) BETWEEN 0 AND 199 AND trunc((lon + 30) / 0.25) BETWEEN 0 AND 399", "pois")
def poi_world_to_pixel(spark, d):
    r, c = S.world_to_pixel(C("lon"), C("lat"), (0.25, 0, -30.0, 0, -0.25, 20.0))
    return T.pois(spark, d).select("id", r.alias("r"), c.alias("c")).where("r >= 0 AND r < 200 AND c >= 0 AND c < 400")


# --- rasters ---------------------------------------------------------------------------------------------------------


@query("SELECT m.raster_id, k.c AS class, count(x.value) AS pixel_count FROM (SELECT DISTINCT raster_id FROM mask) m CROSS JOIN (VALUES (1), (3), (9)) k(c) LEFT JOIN mask x ON x.raster_id = m.raster_id AND x.value = k.c GROUP BY ALL", "mask")
def count_pixels(spark, d):
    return raster.count_pixels(T.mask(spark, d), [1, 3, 9])


@query("SELECT raster_id, count(*) FILTER (value = 3) AS pixel_count, round(count(*) FILTER (value = 3) * 0.09, 6) AS area_m2 FROM mask GROUP BY raster_id", "mask")
def area(spark, d):
    return raster.area(T.mask(spark, d), 0.3, [3]).withColumn("area_m2", six("area_m2"))


@query("SELECT raster_id, band, min(value) FILTER (value <> 1) AS min, max(value) FILTER (value <> 1) AS max, round(avg(value) FILTER (value <> 1), 6) AS mean, round(stddev_pop(value) FILTER (value <> 1), 6) AS std, count(*) FILTER (value <> 1) AS valid_pixels FROM cells GROUP BY ALL", "cells")
def stats(spark, d):
    return raster.stats(T.cells(spark, d), T.NODATA).withColumns({"mean": six("mean"), "std": six("std")})


@query("SELECT raster_id, band, r, c, CASE WHEN value <> 1 AND value >= 30 THEN 255 ELSE 0 END AS value FROM cells", "cells")
def threshold(spark, d):
    return raster.threshold(T.cells(spark, d), 30, nodata=T.NODATA)


@query("SELECT a.raster_id, a.r, a.c, CASE WHEN a.value <> 1 AND b.value <> 1 THEN a.value - b.value ELSE -9999 END AS value FROM cells a JOIN cells b ON a.raster_id = b.raster_id AND a.r = b.r AND a.c = b.c AND a.band = 1 AND b.band = 2", "cells")
def diff(spark, d):
    x = T.cells(spark, d)
    return raster.diff(x.where("band = 1"), x.where("band = 2"), T.NODATA)


@query("SELECT raster_id, band, r - 4 AS r, c - 2 AS c, value FROM cells WHERE r >= 4 AND r < 12 AND c >= 2 AND c < 10", "cells")
def clip(spark, d):
    return raster.clip(T.cells(spark, d), 12, 4, 2, 10)


@query("SELECT raster_id, band, r, c, value FROM cells UNION ALL SELECT raster_id, 4, r, c, value FROM mask", "mask")
def concat(spark, d):
    return raster.concat([(T.cells(spark, d), 3), (T.mask(spark, d).withColumn("band", F.lit(1)).withColumn("value", C("value").cast("double")), 1)])


@query("SELECT raster_id, r, c, CASE WHEN max(CASE WHEN band = 3 AND value > 25 THEN 1 ELSE 0 END) = 1 THEN 7 WHEN max(CASE WHEN band = 1 AND value > 10 THEN 1 ELSE 0 END) = 1 THEN 5 ELSE 0 END AS value FROM cells WHERE band IN (1, 3) GROUP BY ALL", "cells")
def compose_multiclass(spark, d):
    x = T.cells(spark, d)
    on = lambda band, over: x.where(C("band") == band).withColumn("value", (C("value") > over).cast("int"))
    return raster.compose([(on(1, 10), 5), (on(3, 25), 7)])


@query("SELECT s_suppkey AS raster_id, CAST(i AS INT) AS row_idx, CAST(j AS INT) AS col_idx, CAST(i * (h // 3) AS INT) AS x1, CAST(CASE WHEN i = 2 THEN h ELSE (i + 1) * (h // 3) END AS INT) AS x2, CAST(j * (w // 3) AS INT) AS y1, CAST(CASE WHEN j = 2 THEN w ELSE (j + 1) * (w // 3) END AS INT) AS y2 FROM (SELECT s_suppkey, CAST(10 + s_suppkey % 7 AS INT) AS h, CAST(12 + s_suppkey % 5 AS INT) AS w FROM supplier), range(3) a(i), range(3) b(j)")
def grid_windows(spark, d):
    sizes = T.table(spark, d, "supplier").select(C("s_suppkey").alias("raster_id"), (10 + C("s_suppkey") % 7).cast("int").alias("height"), (12 + C("s_suppkey") % 5).cast("int").alias("width"))
    return raster.grid_windows(sizes, 3)


@query("SELECT p.raster_id, p.id, p.r, p.c, x.value, p.r BETWEEN 0 AND 15 AND p.c BETWEEN 0 AND 15 AS is_inside FROM (SELECT p_partkey AS id, 1 + p_partkey % 10 AS raster_id, CAST(p_partkey % 19 AS INT) AS r, CAST(p_partkey % 17 AS INT) AS c FROM part) p LEFT JOIN cells x ON x.raster_id = p.raster_id AND x.r = p.r AND x.c = p.c AND x.band = 1", "cells")
def sample_points(spark, d):
    key = C("p_partkey")
    at = T.table(spark, d, "part").select(key.alias("id"), (1 + key % 10).alias("raster_id"), (key % 19).alias("r"), (key % 17).alias("c"))
    return raster.sample_points(T.cells(spark, d), at, T.SIDE, T.SIDE)


GRADIENT = """WITH g AS (SELECT raster_id, r, c, value,
  CASE WHEN r = 0 THEN lead(value) OVER rr - value WHEN r = 15 THEN value - lag(value) OVER rr ELSE (lead(value) OVER rr - lag(value) OVER rr) / 2 END AS gy,
  CASE WHEN c = 0 THEN lead(value) OVER cc - value WHEN c = 15 THEN value - lag(value) OVER cc ELSE (lead(value) OVER cc - lag(value) OVER cc) / 2 END AS gx
  FROM dem WINDOW rr AS (PARTITION BY raster_id, c ORDER BY r), cc AS (PARTITION BY raster_id, r ORDER BY c)) """


@query(GRADIENT + "SELECT raster_id, r, c, round(degrees(atan(sqrt(gx * gx + gy * gy))), 4) AS value FROM g", "dem")
def slope(spark, d):
    return raster.slope(T.dem(spark, d)).withColumn("value", F.round("value", 4))


@query(GRADIENT + "SELECT raster_id, r, c, CAST(trunc(greatest(0, least(255, 255 * (sin(radians(45)) * cos(atan(sqrt(gx * gx + gy * gy))) + cos(radians(45)) * sin(atan(sqrt(gx * gx + gy * gy))) * cos(radians(135) - atan2(-gx, gy))) + 0.001))) AS INT) AS value FROM g", "dem")
def hillshade(spark, d):
    gx, gy = C("gx"), C("gy")
    import math

    # A thousandth is added on both sides before truncation, for the two engines' last bits.
    steep = F.atan(F.sqrt(gx * gx + gy * gy))
    shade = math.sin(math.radians(45)) * F.cos(steep) + math.cos(math.radians(45)) * F.sin(steep) * F.cos(F.lit(math.radians(135)) - F.atan2(-gx, gy))
    return raster.gradient(T.dem(spark, d)).select("raster_id", "r", "c", F.greatest(F.lit(0.0), F.least(F.lit(255.0), 255 * shade + 0.001)).cast("int").alias("value"))


@query(None)
def hillshade_operator(spark, d):
    return raster.hillshade(T.dem(spark, d))


def focal_sql(expr: str) -> str:
    return f"SELECT a.raster_id, a.r, a.c, CASE WHEN any_value(a.value) = 5 THEN 5 ELSE round({expr}, 6) END AS value FROM dem a, range(-1, 2) i(i), range(-1, 2) j(j), dem b WHERE b.raster_id = a.raster_id AND b.r = greatest(0, least(15, a.r + i)) AND b.c = greatest(0, least(15, a.c + j)) GROUP BY a.raster_id, a.r, a.c"


def focal_query(name: str, stat: str, expr: str) -> None:
    def run(spark, d):
        return raster.focal(T.dem(spark, d), stat, 3, 5.0, T.SIDE, T.SIDE).withColumn("value", six("value"))

    QUERIES[name], ORACLES[name] = run, T.with_views(focal_sql(expr), "dem")


Z = "CASE WHEN b.value = 5 THEN 0 ELSE b.value END"
focal_query("focal_mean", "mean", "avg(b.value) FILTER (b.value <> 5)")
focal_query("focal_sum", "sum", f"sum({Z})")
focal_query("focal_min", "min", f"min({Z})")
focal_query("focal_max", "max", f"max({Z})")
focal_query("focal_std", "std", f"stddev_pop({Z})")


@query("SELECT x.raster_id, CAST(t.r AS INT) AS r, CAST(t.c AS INT) AS c, x.value FROM (SELECT i.i AS r, j.j AS c FROM range(6) i(i), range(6) j(j)) t JOIN dem x ON x.r = CAST(floor((t.r + 0.5) * 16 / 6) AS INT) AND x.c = CAST(floor((t.c + 0.5) * 16 / 6) AS INT)", "dem")
def resample_nearest(spark, d):
    return raster.resample_nearest(T.dem(spark, d), T.SIDE, T.SIDE, 0.4)


@query("WITH s AS (SELECT vec_id // 4 AS pixel, i AS class, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS score FROM embeddings, range(1, 9) k(i) GROUP BY ALL) SELECT pixel, arg_max(class, score) AS class, max(score) AS score FROM s GROUP BY pixel")
def overlap_argmax(spark, d):
    rows = T.table(spark, d, "embeddings").select(F.floor(C("vec_id") / 4).alias("pixel"), F.posexplode(F.slice("embedding", 1, 8)).alias("class", "score"))
    mean = raster.argmax_of_patches(rows.select("pixel", (C("class") + 1).cast("long").alias("class"), C("score").cast("double").alias("score")))
    return mean.withColumn("score", six("score"))


@query("SELECT a.raster_id, a.r, a.c, CASE WHEN b.value * 5 - a.value * 5 > 128 THEN 255 ELSE 0 END AS value FROM cells a JOIN cells b ON a.raster_id = b.raster_id AND a.r = b.r AND a.c = b.c AND a.band = 1 AND b.band = 3", "cells")
def flood_fusion(spark, d):
    x = T.cells(spark, d).withColumn("value", C("value") * 5)
    return raster.flood(x.where("band = 1"), x.where("band = 3"))


@query("SELECT raster_id, band, r, c, CASE WHEN hi > lo THEN CAST(trunc((value - lo) / (hi - lo) * 255) AS INT) ELSE 0 END AS value FROM (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM cells WINDOW w AS (PARTITION BY raster_id, band))", "cells")
def stretch_uint8(spark, d):
    return raster.stretch_uint8(T.cells(spark, d))


REGIONS = """WITH RECURSIVE ids AS (SELECT *, (raster_id * 1048576 + r) * 1048576 + c AS cell FROM mask WHERE value > 0),
near AS (SELECT a.cell AS a, b.cell AS b FROM ids a JOIN ids b ON a.raster_id = b.raster_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 AND {same}),
reach(a, b) AS (SELECT cell, cell FROM ids UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
region AS (SELECT a AS cell, min(b) AS region FROM reach GROUP BY a)
"""


@query(REGIONS.format(same="true") + "SELECT raster_id, count(DISTINCT region) AS components FROM ids JOIN region USING (cell) GROUP BY raster_id", "mask")
def components(spark, d):
    return graph.raster_components(T.mask(spark, d), False).groupBy("raster_id").agg(F.count_distinct("region").alias("components"))


@query(REGIONS.format(same="a.value = b.value") + "SELECT raster_id, region, any_value(value) AS class, count(*) AS pixel_count, round(count(*) * 0.09, 6) AS area_m2, min(r) AS min_r, min(c) AS min_c, max(r) AS max_r, max(c) AS max_c FROM ids JOIN region USING (cell) WHERE value IN (2, 3) GROUP BY raster_id, region", "mask")
def vectorize_counts(spark, d):
    found = graph.raster_components(T.mask(spark, d).where("value IN (2, 3)"), True)
    return found.groupBy("raster_id", "region").agg(F.first("value").alias("class"), F.count(F.lit(1)).alias("pixel_count"), six(F.count(F.lit(1)) * 0.09).alias("area_m2"), F.min("r").alias("min_r"), F.min("c").alias("min_c"), F.max("r").alias("max_r"), F.max("c").alias("max_c"))


# --- vectors ---------------------------------------------------------------------------------------------------------

AREA = "(x1 - x0) * (y1 - y0) * 0.25"


@query(f"SELECT id, round({AREA}, 6) AS area_m2 FROM rects WHERE {AREA} >= 5", "rects")
def filter_by_area(spark, d):
    return vector.filter_by_area(T.rects(spark, d), 5, 0.5).select("id", six("area_m2").alias("area_m2"))


@query("SELECT id, types FROM pois WHERE lower(types) LIKE '%shelter%' OR lower(types) LIKE 'building%'", "pois")
def filter_by_attribute(spark, d):
    return vector.filter_by_attribute(T.pois(spark, d), "types", [" SHELTER", "building"]).select("id", "types")


@query(f"SELECT id, round({HAVERSINE}, 2) AS distance_m FROM {NEAR_POIS} WHERE {HAVERSINE} <= 5000000", "pois")
def filter_by_distance(spark, d):
    return vector.filter_by_distance(T.pois(spark, d), 10.0, 20.0, 5_000_000).select("id", F.round("distance_m", 2).alias("distance_m"))


@query(f"SELECT id, round({AREA}, 6) AS area_m2 FROM rects ORDER BY {AREA} DESC, id LIMIT 10", "rects")
def max_polygon_topk(spark, d):
    return vector.max_polygon(T.rects(spark, d), 0.5, 10).select("id", six("area_m2").alias("area_m2"))


@query("SELECT id, (y0 + y1) / 2 AS row, (x0 + x1) / 2 AS col, (x1 - x0 + y1 - y0) * 2 * 0.5 AS perimeter_m FROM rects", "rects")
def centroid(spark, d):
    return vector.perimeter(vector.centroid(T.rects(spark, d)), 0.5).select("id", "row", "col", "perimeter_m")


@query("SELECT id, 2 * (x1 - x0 + y1 - y0) * 0.5 AS perimeter_m FROM rects WHERE class = 1", "rects")
def perimeter(spark, d):
    return vector.perimeter(T.rects(spark, d).where("class = 1"), 0.5).select("id", "perimeter_m")


@query("SELECT line, round(sum(coalesce(sqrt((px - bx) * (px - bx) + (py - b_y) * (py - b_y)), 0)) * 0.5, 4) AS length_m FROM (SELECT id // 10 AS line, px, py, lag(px) OVER w AS bx, lag(py) OVER w AS b_y FROM pois WINDOW w AS (PARTITION BY id // 10 ORDER BY id)) GROUP BY line", "pois")
def length(spark, d):
    lines = T.pois(spark, d).select(F.floor(C("id") / 10).alias("line"), "id", "px", "py")
    return vector.polyline_length(lines, "line", ["id"], 0.5).withColumn("length_m", F.round("length_m", 4))


OVERLAP = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"


@query(f"SELECT a.id AS a_id, b.id AS b_id, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area_px FROM rects a JOIN rects b ON {OVERLAP} WHERE a.class = 0 AND b.class = 1", "rects")
def intersect_rects(spark, d):
    x = T.rects(spark, d)
    return vector.overlaps(x.where("class = 0"), x.where("class = 1")).select("a_id", "b_id", ((C("x1") - C("x0")) * (C("y1") - C("y0"))).alias("area_px"))


@query("SELECT id, greatest(x0, 20) AS x0, greatest(y0, 10) AS y0, least(x1, 260) AS x1, least(y1, 60) AS y1 FROM rects WHERE x0 < 260 AND x1 > 20 AND y0 < 60 AND y1 > 10", "rects")
def clip_rects(spark, d):
    roi = spark.createDataFrame([(0, 20, 10, 260, 60)], "id long, x0 long, y0 long, x1 long, y1 long")
    return vector.overlaps(T.rects(spark, d), roi, 64).select(C("a_id").alias("id"), "x0", "y0", "x1", "y1")


@query("SELECT p.id AS point_id, count(*) AS polygons, min(a.id) AS first_polygon FROM pois p JOIN rects a ON p.px > a.x0 AND p.px < a.x1 AND p.py > a.y0 AND p.py < a.y1 GROUP BY p.id", "pois", "rects")
def point_in_polygon(spark, d):
    hits = vector.point_in_polygon(T.pois(spark, d).select("id", "px", "py"), T.rects(spark, d))
    return hits.groupBy(C("p_id").alias("point_id")).agg(F.count(F.lit(1)).alias("polygons"), F.min("a_id").alias("first_polygon"))


def nearest_sql(k: int) -> str:
    return f"SELECT * FROM (SELECT p.id AS a_id, row_number() OVER (PARTITION BY p.id ORDER BY (p.px - s.px) * (p.px - s.px) + (p.py - s.py) * (p.py - s.py), s.id) AS rank, s.id AS b_id, (p.px - s.px) * (p.px - s.px) + (p.py - s.py) * (p.py - s.py) AS d2 FROM pois p CROSS JOIN sites s) WHERE rank <= {k}"


@query(nearest_sql(1), "pois", "sites")
def nearest_k1(spark, d):
    return vector.nearest(T.pois(spark, d), T.sites(spark, d)).withColumn("rank", C("rank").cast("long"))


@query(nearest_sql(3), "pois", "sites")
def nearest_k3(spark, d):
    return vector.nearest(T.pois(spark, d), T.sites(spark, d), 3).withColumn("rank", C("rank").cast("long"))


@query("SELECT s.b_id AS site, count(*) AS cells FROM (" + nearest_sql(1) + ") s GROUP BY 1", "pois", "sites")
def voronoi_assignment(spark, d):
    return vector.nearest(T.pois(spark, d), T.sites(spark, d)).groupBy(C("b_id").alias("site")).agg(F.count(F.lit(1)).alias("cells"))


@query("SELECT a.id, count(*) AS pixel_count, round(avg(x.value), 6) AS mean, min(x.value) AS min, max(x.value) AS max, round(stddev_pop(x.value), 6) AS std FROM rects a JOIN (SELECT c + 16 * raster_id AS c, r, value FROM cells WHERE band = 1 AND value <> 1) x ON x.c + 0.5 > a.x0 AND x.c + 0.5 < a.x1 AND x.r + 0.5 > a.y0 AND x.r + 0.5 < a.y1 GROUP BY a.id", "rects", "cells")
def zonal_rects(spark, d):
    mosaic = T.cells(spark, d).where("band = 1").select((C("c") + 16 * C("raster_id")).alias("c"), "r", "value")
    return vector.zonal(T.rects(spark, d), mosaic, T.NODATA).withColumns({"mean": six("mean"), "std": six("std")})


BUFFER = "SELECT {what} FROM sites p JOIN rects a ON pow(greatest(a.x0 - p.px, 0, p.px - a.x1), 2) + pow(greatest(a.y0 - p.py, 0, p.py - a.y1), 2) <= "


@query(BUFFER.format(what="p.id AS site, count(*) AS near") + "25 GROUP BY p.id", "sites", "rects")
def buffer_predicate(spark, d):
    hits = vector.within(T.sites(spark, d).select("id", "px", "py"), T.rects(spark, d), 5)
    return hits.groupBy(C("p_id").alias("site")).agg(F.count(F.lit(1)).alias("near"))


@query(" UNION ALL ".join(BUFFER.format(what=f"{k} AS metres, count(*) AS pairs, count(DISTINCT a.id) AS features") + str(k * k) for k in (2, 5, 9)), "sites", "rects")
def kbuffer(spark, d):
    hits = vector.within(T.sites(spark, d).select("id", "px", "py"), T.rects(spark, d), 9)
    rings = hits.select("a_id", "d2", F.explode(F.array(F.lit(2), F.lit(5), F.lit(9))).alias("metres")).where("d2 <= metres * metres")
    return rings.groupBy("metres").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("a_id").alias("features"))


@query("SELECT brand, count(*) AS members, sum((x1 - x0) * (y1 - y0)) * 0.25 AS area_m2, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM rects GROUP BY brand", "rects")
def dissolve_counts(spark, d):
    return vector.dissolve(T.rects(spark, d), "brand", 0.5)


@query(f"WITH RECURSIVE own AS (SELECT * FROM rects WHERE class = 2), near AS (SELECT a.id AS a, b.id AS b FROM own a JOIN own b ON a.id <> b.id AND {OVERLAP}), reach(a, b) AS (SELECT id, id FROM own UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a), root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a) SELECT root, count(*) AS members, arg_max(id, (x1 - x0) * (y1 - y0) * 1000000000 - id) AS largest_id FROM root JOIN own USING (id) GROUP BY root", "rects")
def merge_overlapping(spark, d):
    return vector.merge_overlapping(T.rects(spark, d).where("class = 2"), graph.components)


@query(None)
def convex_hull(spark, d):
    return vector.convex_hulls(T.rects(spark, d).select("brand", F.explode(F.array(*[F.struct(C(x).alias("px"), C(y).alias("py")) for x in ("x0", "x1") for y in ("y0", "y1")])).alias("p")).select("brand", "p.px", "p.py"), "brand")


@query(None)
def simplify(spark, d):
    return vector.simplified(T.pois(spark, d).select(F.floor(C("id") / 20).alias("line"), "id", "px", "py"), "line", "id", 8.0)


@query("SELECT a.id, round(CAST(greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS DOUBLE) / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))), 6) AS iou FROM rects a JOIN (SELECT id, x0 + 1 AS x0, y0 AS y0, x1 + 1 AS x1, y1 + class AS y1 FROM rects) b USING (id)", "rects")
def polygon_iou(spark, d):
    x = T.rects(spark, d)
    a = x.select("id", *[C(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")], "class")
    both = a.select("*", (C("a_x0") + 1).alias("b_x0"), C("a_y0").alias("b_y0"), (C("a_x1") + 1).alias("b_x1"), (C("a_y1") + C("class")).alias("b_y1"))
    return both.select("id", six(scoring.rect_iou("a_", "b_")).alias("iou"))


def polygons(spark, d):
    """A triangle (even ids) or an L-shape (odd ids) in each rectangle, as a ring; the L lacks its upper right quarter."""
    xy = lambda x, y: F.struct((C("x0") + (C("x1") - C("x0")) * x).cast("double").alias("x"), (C("y0") + (C("y1") - C("y0")) * y).cast("double").alias("y"))
    triangle, ell = F.array(xy(0, 0), xy(1, 0), xy(1, 1)), F.array(xy(0, 0), xy(1, 0), xy(1, 0.5), xy(0.5, 0.5), xy(0.5, 1), xy(0, 1), xy(0, 0))
    return T.rects(spark, d).select("id", F.when(C("id") % 2 == 0, triangle).otherwise(ell).alias("ring"))


@query("SELECT id, round(w * h * CASE WHEN id % 2 = 0 THEN 0.5 ELSE 0.75 END, 6) AS area, round(w + h + CASE WHEN id % 2 = 0 THEN sqrt(w * w + h * h) ELSE w + h END, 6) AS perimeter, round(y0 + h * CASE WHEN id % 2 = 0 THEN 1 / 3.0 ELSE 5 / 12.0 END, 6) AS row, round(x0 + w * CASE WHEN id % 2 = 0 THEN 2 / 3.0 ELSE 5 / 12.0 END, 6) AS col FROM (SELECT *, CAST(x1 - x0 AS DOUBLE) AS w, CAST(y1 - y0 AS DOUBLE) AS h FROM rects)", "rects")
def polygon_measures(spark, d):
    row, col = vector.ring_centroid(C("ring"))
    return polygons(spark, d).select("id", six(vector.ring_area(C("ring"))).alias("area"), six(vector.ring_perimeter(C("ring"))).alias("perimeter"), six(row).alias("row"), six(col).alias("col"))


@query("SELECT p.id AS point_id, count(*) AS polygons, min(a.id) AS first_polygon FROM (SELECT id, px + 0.26 AS px, py + 0.17 AS py FROM pois) p JOIN (SELECT *, CAST(x1 - x0 AS DOUBLE) AS w, CAST(y1 - y0 AS DOUBLE) AS h FROM rects) a ON p.px > a.x0 AND p.px < a.x1 AND p.py > a.y0 AND p.py < a.y1 AND CASE WHEN a.id % 2 = 0 THEN (p.py - a.y0) * w < (p.px - a.x0) * h ELSE p.px < a.x0 + w / 2 OR p.py < a.y0 + h / 2 END GROUP BY p.id", "pois", "rects")
def point_in_polygon_rings(spark, d):
    points = T.pois(spark, d).select("id", (C("px") + 0.26).alias("px"), (C("py") + 0.17).alias("py"))
    hits = vector.point_in_ring(points, polygons(spark, d))
    return hits.groupBy(C("p_id").alias("point_id")).agg(F.count(F.lit(1)).alias("polygons"), F.min("a_id").alias("first_polygon"))


# --- points of interest and records ----------------------------------------------------------------------------------


@query("SELECT id, name FROM pois WHERE lower(name) LIKE '%00012%'", "pois")
def poi_search(spark, d):
    return records.search_by_name(T.pois(spark, d), "00012").select("id", "name")


@query("SELECT id, name FROM pois WHERE regexp_matches(name, '[0-9]*7$')", "pois")
def poi_to_vector(spark, d):
    return records.matching(T.pois(spark, d), "[0-9]*7$").select("id", "name")


@query('SELECT trim(split_part(types, \',\', 1)) AS "group", count(*) AS count, round(sum(CAST(px AS DOUBLE)), 2) AS sum FROM pois GROUP BY 1', "pois")
def poi_group_by(spark, d):
    return records.group_by(T.pois(spark, d), C("types"), C("px").cast("double"))


DAMAGE = "SELECT raster_id, CAST(arg_max(value, n * 100 - value) AS INT) AS damage_class FROM (SELECT raster_id, value, count(*) AS n FROM mask GROUP BY ALL) GROUP BY raster_id"


def damage_classes(spark, d):
    counts = T.mask(spark, d).groupBy("raster_id", C("value").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return records.dominant_class(counts, "raster_id")


@query(f"SELECT * FROM ({DAMAGE}) WHERE damage_class >= 2", "mask")
def poi_filter_damage(spark, d):
    return damage_classes(spark, d).where("damage_class >= 2")


@query(f"SELECT * FROM ({DAMAGE}) WHERE damage_class = 1", "mask")
def poi_filter_intact(spark, d):
    return damage_classes(spark, d).where("damage_class = 1")


@query("SELECT id, types FROM pois WHERE types LIKE '%, Shelter'", "pois")
def poi_filter_attribute(spark, d):
    return records.attribute_in(T.pois(spark, d), "types", ["Shelter", "building"]).select("id", "types")


@query("SELECT d.name, d.damage, p.population FROM (SELECT c_name AS name, CAST(c_custkey % 4 AS INT) AS damage FROM customer) d JOIN (SELECT c_name AS name, c_acctbal AS population FROM customer) p USING (name) WHERE damage >= 2 ORDER BY population DESC, damage DESC, name LIMIT 20")
def population_exposure(spark, d):
    c = T.table(spark, d, "customer")
    damage = c.select(C("c_name").alias("name"), (C("c_custkey") % 4).cast("int").alias("damage"))
    return records.exposure(damage, c.select(C("c_name").alias("name"), C("c_acctbal").alias("population"), C("c_custkey").alias("pos")), 2).limit(20)


def reduced(mode: str):
    return lambda spark, d: records.reduce_by(T.steps(spark, d), "user_id", "value", "step", mode)


QUERIES |= {"reduce_max": reduced("max"), "reduce_min": reduced("min"), "reduce_mean": lambda spark, d: reduced("mean")(spark, d).withColumn("best_value", six("best_value"))}
FIRST = "SELECT user_id, value AS best_value, step AS best_index FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value {order}, step) AS n FROM steps) WHERE n = 1"
ORACLES |= {"reduce_max": T.with_views(FIRST.format(order="DESC"), "steps"), "reduce_min": T.with_views(FIRST.format(order="ASC"), "steps"), "reduce_mean": T.with_views("SELECT user_id, round(avg(value), 6) AS best_value FROM steps GROUP BY user_id", "steps")}


@query("SELECT id, CASE WHEN n > 1 THEN label || ' (' || n || ')' ELSE label END AS label, value FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY value DESC, id) AS n FROM (SELECT id, types AS label, round(population, 1) AS value FROM pois ORDER BY population DESC, id LIMIT 25))", "pois")
def chart_data(spark, d):
    return records.chart_data(T.pois(spark, d), C("types"), C("name"), F.round("population", 1), 25, 1, by=C("population"))


@query("SELECT id, round(0.7 * need + 3 * region, 4) AS score FROM sites ORDER BY 0.7 * need + 3 * region DESC, id LIMIT 15", "sites")
def priority_score(spark, d):
    return records.priority_score(T.sites(spark, d), {"need": 0.7, "region": 3.0}, 15).select("id", F.round("score", 4).alias("score"))


@query("WITH b AS (SELECT *, need % 700 + 100 AS cap, greatest(0, least(200.0, 900 - 200 * (row_number() OVER (PARTITION BY region ORDER BY id) - 1))) AS base, greatest(need - 200, 0) AS above FROM sites), s AS (SELECT *, CAST(900 - sum(base) OVER w AS DOUBLE) AS rest, sum(above) OVER w AS total FROM b WINDOW w AS (PARTITION BY region)) SELECT region, id, need, round(CAST(base AS DOUBLE) + CASE WHEN total > 0 AND rest > 0 THEN greatest(0, least(CAST(above AS DOUBLE) / total * rest, CAST(cap - base AS DOUBLE))) ELSE 0 END, 4) AS allocated FROM s", "sites")
def resource_allocation(spark, d):
    demands = T.sites(spark, d).select("region", "id", "need", (C("need") % 700 + 100).alias("cap"))
    return records.allocate(demands, "region", 900.0, 200.0).withColumn("allocated", F.round("allocated", 4))


@query("SELECT raster_id, CAST(least(2, r // 5) AS INT) AS row_idx, CAST(least(2, c // 5) AS INT) AS col_idx, count(*) FILTER (value = 3) AS value FROM mask GROUP BY ALL", "mask")
def loop_grid_stats(spark, d):
    return records.loop_windows(T.mask(spark, d), T.SIDE, T.SIDE, 3, F.count_if(C("value") == 3))


@query("WITH w AS (SELECT raster_id, least(2, r // 5) AS i, least(2, c // 5) AS j, count(*) FILTER (value = 3) AS n FROM mask GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY raster_id ORDER BY n DESC, i * 3 + j) AS k FROM w) SELECT raster_id, CAST(i * 3 + j AS INT) AS best_index, n AS best_value FROM best WHERE k = 1", "mask")
def trajectory_loop_reduce(spark, d):
    """Three chained steps of a trajectory: the mask, a loop over its windows, and the best window."""
    plan = [
        {"call": "source.mask", "args": {}},
        {"call": "loop.count_class", "args": {"cells": "<0>", "side": T.SIDE, "n": 3, "class": 3}},
        {"call": "reduce.best", "args": {"rows": "<1>", "by": "raster_id", "value": "value", "index": "index", "mode": "max"}},
    ]
    return trajectory.compiled(spark, d, plan).select("raster_id", C("best_index").cast("int").alias("best_index"), "best_value")


@query("SELECT id, CAST(floor(id / 4) AS INT) AS row_idx, CAST(id % 4 AS INT) AS col_idx, round(CAST(need AS DOUBLE) / (region + 1), 6) AS per_region, round(greatest(0, ceil(need / 40.0)), 6) AS trips, round(need / (SELECT CAST(max(need) AS DOUBLE) FROM sites), 6) AS share, round(need / (SELECT CAST(max(need) AS DOUBLE) FROM sites) * 0.5 + CAST(need AS DOUBLE) / (region + 1) * 0.25, 6) AS score FROM sites", "sites")
def trajectory_loop_nested(spark, d):
    """A loop of four calls that name the item's nested fields, each other's results and an earlier step of one row."""
    items = T.sites(spark, d).select("id", F.struct(F.struct("need", (C("region") + 1).alias("regions")).alias("facts")).alias("properties"))
    most = T.sites(spark, d).agg(F.max("need").alias("most"))
    calls = [
        {"call": "functions.calc_div", "args": {"a": "<item.properties.facts.need>", "b": "<item.properties.facts.regions>"}},
        {"tool": "logi.truck_trips", "args": {"volume": "<item.properties.facts.need>", "capacity": 40}},
        {"call": "calc.div", "args": {"a": "<item.properties.facts.need>", "b": "<most> from trajectory[0].obs"}},
        {"call": "calc.weighted_sum", "args": {"values": ["<value> from step[2].obs", "<value> from step[0].obs"], "weights": [0.5, 0.25]}},
    ]
    out = trajectory.loop(items, calls, grid_n=4, index="id", trajectory=[most])
    step = lambda n: six(C(f"steps.step_{n}.value").cast("double"))
    return out.select("id", "row_idx", "col_idx", step(0).alias("per_region"), step(1).alias("trips"), step(2).alias("share"), six("last_obs.value").alias("score"))


@query("WITH w AS (SELECT raster_id, row_idx, col_idx, col_idx * 5 AS x1, row_idx * 5 AS y1, value FROM (SELECT raster_id, CAST(least(2, r // 5) AS INT) AS row_idx, CAST(least(2, c // 5) AS INT) AS col_idx, count(*) FILTER (value = 3) AS value FROM mask GROUP BY ALL)) SELECT raster_id, row_idx, col_idx, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, round(value / 25.0, 6) AS share FROM w", "mask")
def trajectory_loop_windows(spark, d):
    """A compiled plan in which a loop takes an earlier step's windows, binds an argument and divides by a literal."""
    plan = [
        {"call": "source.mask", "args": {}},
        {"call": "loop.count_class", "args": {"cells": "<0>", "side": T.SIDE, "n": 3, "class": 3}},
        {"call": "tool.loop", "args": {"items": "<1>", "bind": {"a": "value"}, "calls": [{"call": "ras.window", "args": {"row_idx": "<item.row_idx>", "col_idx": "<item.col_idx>", "size": 5}}, {"call": "calc.div", "args": {"a": 0, "b": 25}}]}},
    ]
    window = lambda c: C(f"steps.step_0.{c}").cast("int").alias(c)
    return trajectory.compiled(spark, d, plan).select("raster_id", "row_idx", "col_idx", window("x1"), window("y1"), six("last_obs.value").alias("share"))


# --- graphs ----------------------------------------------------------------------------------------------------------


@query("SELECT graph, node, count(*) AS degree FROM (SELECT graph, u AS node FROM edges UNION ALL SELECT graph, v FROM edges) GROUP BY ALL", "edges")
def build_graph(spark, d):
    return graph.build_graph(T.edges(spark, d))


#: Bellman-Ford over a round for each node but one; both come as one whole number, repairs above lengths.
PATHS = """WITH RECURSIVE both_ways AS (SELECT graph, u, v, w FROM (SELECT graph, u, v, {w} AS w FROM edges {where}) UNION ALL SELECT graph, v, u, w FROM (SELECT graph, u, v, {w} AS w FROM edges {where})),
walk(graph, node, d, n) AS (SELECT DISTINCT graph, CAST(3 AS BIGINT), CAST(0 AS HUGEINT), 0 FROM both_ways UNION ALL SELECT graph, node, min(d), min(n) FROM (
  SELECT b.graph, b.v AS node, walk.d + b.w AS d, walk.n + 1 AS n FROM walk JOIN both_ways b ON walk.graph = b.graph AND walk.node = b.u WHERE walk.n < 14) GROUP BY graph, node)
"""


@query(PATHS.format(w="length", where="WHERE NOT damaged") + "SELECT graph, node, CAST(min(d) AS BIGINT) AS length FROM walk GROUP BY ALL", "edges")
def shortest_path(spark, d):
    return graph.shortest_path(T.edges(spark, d), 3)


@query(PATHS.format(w="CAST(damaged AS BIGINT) * 1000000000000 + length", where="") + "SELECT graph, node, CAST(min(d) // 1000000000000 AS BIGINT) AS repairs, CAST(min(d) % 1000000000000 AS BIGINT) AS length FROM walk GROUP BY ALL", "edges")
def repair_min_edges(spark, d):
    return graph.repair_min_edges(T.edges(spark, d), 3)


# --- evidence and scores ---------------------------------------------------------------------------------------------


@query("SELECT raster_id, count(*) AS nonzero, round(count(*) * 0.25, 6) AS area_m2, min(r) AS min_r, max(r) AS max_r, min(c) AS min_c, max(c) AS max_c, round(avg(r), 6) AS row, round(avg(c), 6) AS col, count(DISTINCT value) AS classes, CASE WHEN avg(r) < 8 THEN 'north' ELSE 'south' END || CASE WHEN avg(c) < 8 THEN 'west' ELSE 'east' END AS quadrant FROM mask WHERE value > 0 GROUP BY raster_id", "mask")
def evidence_rollup(spark, d):
    return evidence.rollup(T.mask(spark, d), 0.5, T.SIDE).withColumns({"row": six("row"), "col": six("col"), "area_m2": six("area_m2")})


SERIES = "SELECT user_id // 3 AS series, user_id % 3 AS t, count(*) AS value FROM events GROUP BY ALL"


@query(f"WITH s AS ({SERIES}), x AS (SELECT *, value - lag(value) OVER w AS step, row_number() OVER w AS pos FROM s WINDOW w AS (PARTITION BY series ORDER BY t)), g AS (SELECT series, count(*) AS n, bool_and(coalesce(step >= 0, true)) AS up, bool_and(coalesce(step <= 0, true)) AS down, arg_max(t, value * 1000 - pos) AS peak_t, arg_max(pos, value * 1000 - pos) AS pp, max(value) AS peak FROM x GROUP BY series) SELECT series, n, peak_t, peak, CASE WHEN n = 1 THEN 'single' WHEN up THEN 'expanding' WHEN down THEN 'shrinking' WHEN pp > 1 AND pp < n THEN 'expand_then_recede' ELSE 'mixed' END AS trend FROM g")
def timeline_trend(spark, d):
    series = T.table(spark, d, "events").groupBy(F.floor(C("user_id") / 3).alias("series"), (C("user_id") % 3).alias("t")).agg(F.count(F.lit(1)).alias("value"))
    return evidence.trend(series, "series", "t", "value")


ANSWERS = "SELECT doc_id, lang, source, CAST(n_chars AS DOUBLE) AS gold, n_chars * (85 + doc_id % 40) / 100.0 AS pred FROM documents"


def answers(spark, d):
    return T.table(spark, d, "documents").select("doc_id", "lang", "source", C("n_chars").cast("double").alias("gold"), (C("n_chars") * (85 + C("doc_id") % 40) / 100).cast("double").alias("pred"))


@query(f"SELECT doc_id, CASE WHEN abs(pred - gold) <= 1 + 0.2 * abs(gold) THEN 1.0 ELSE 0.0 END AS score FROM ({ANSWERS})")
def score_scalar(spark, d):
    return answers(spark, d).select("doc_id", scoring.close(C("gold"), C("pred")).alias("score"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN CAST(l_tax = 0 AS DOUBLE) WHEN abs(l_tax - l_discount) <= 0.2 * l_discount OR (l_tax * 100 > 1.5 AND abs(l_tax * 100 / 100 - l_discount) <= 0.2 * l_discount) THEN 1.0 ELSE 0.0 END AS score FROM (SELECT l_orderkey, l_linenumber, CAST(round(l_discount * 100) AS DOUBLE) AS l_discount, CAST(round(l_tax * 100) AS DOUBLE) AS l_tax FROM lineitem)")
def score_scalar_whole(spark, d):
    pct = lambda c: F.round(C(c) * 100).cast("double")
    return T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scoring.close(pct("l_discount"), pct("l_tax"), 0.0).alias("score"))


@query("SELECT l_orderkey, l_linenumber, greatest(CASE WHEN abs(p - g) <= 0.2 * abs(g) THEN 1.0 ELSE 0.0 END, CASE WHEN abs(g) <= 1.5 AND abs(p) > 1.5 AND abs(p / 100 - g) <= 0.2 * abs(g) THEN 1.0 WHEN abs(p) <= 1.5 AND abs(g) > 1.5 AND abs(p * 100 - g) <= 0.2 * abs(g) THEN 1.0 ELSE 0.0 END) AS score FROM (SELECT l_orderkey, l_linenumber, l_quantity / 64 AS g, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 2 ELSE l_quantity / 32 END AS p FROM lineitem)")
def score_ratio(spark, d):
    q = C("l_quantity")
    return T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scoring.ratio_close(q / 64, F.when(C("l_linenumber") % 2 == 0, q * 2).otherwise(q / 32)).alias("score"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE 1.0 END AS score FROM documents")
def score_exact(spark, d):
    doc = C("doc_id")
    gold = F.concat(C("lang"), doc.cast("string"))
    pred = F.when(doc % 3 == 0, F.concat(gold, F.lit("x"))).when(doc % 3 == 1, F.concat(F.lit(" "), F.upper(gold))).otherwise(gold)
    return T.table(spark, d, "documents").select("doc_id", scoring.exact(gold, pred).alias("score"))


@query("WITH g AS (SELECT DISTINCT user_id, event_type AS x FROM events WHERE value >= 40), p AS (SELECT DISTINCT user_id, event_type AS x FROM events WHERE value < 60), n AS (SELECT u.user_id, (SELECT count(*) FROM g WHERE g.user_id = u.user_id) AS a, (SELECT count(*) FROM p WHERE p.user_id = u.user_id) AS b, (SELECT count(*) FROM g JOIN p USING (user_id, x) WHERE user_id = u.user_id) AS both_ FROM (SELECT DISTINCT user_id FROM events) u) SELECT user_id, CASE WHEN a = 0 AND b = 0 THEN 1.0 WHEN a = 0 OR b = 0 THEN 0.0 ELSE round(2.0 * both_ / (a + b), 6) END AS score FROM n")
def score_set_f1(spark, d):
    sets = T.table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(C("value") >= 40, C("event_type"))).alias("g"), F.collect_set(F.when(C("value") < 60, C("event_type"))).alias("p"))
    return sets.select("user_id", six(scoring.set_f1(C("g"), C("p"))).alias("score"))


COUNTS = "SELECT user_id, event_type AS k, count(*) AS n FROM events WHERE {w} GROUP BY ALL"


@query(f"SELECT g.user_id, round(avg(CASE WHEN abs(p.n - g.n) <= 1 + 0.2 * g.n THEN 1.0 ELSE 0.0 END), 6) AS score FROM ({COUNTS.format(w='value < 70')}) g LEFT JOIN ({COUNTS.format(w='value < 60')}) p USING (user_id, k) GROUP BY g.user_id")
def score_dict(spark, d):
    e = T.table(spark, d, "events")
    n = lambda w: e.where(w).groupBy("user_id", C("event_type").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return scoring.dict_score(n("value < 70"), n("value < 60"), ["user_id"], "k", "n").withColumn("score", six("score"))


RANKS = "SELECT user_id, event_type AS k, row_number() OVER (PARTITION BY user_id ORDER BY sum({v}) DESC, event_type) AS n FROM events GROUP BY user_id, event_type"


@query(f"WITH g AS ({RANKS.format(v='1')}), p AS ({RANKS.format(v='event_id % 7')}), x AS (SELECT g.user_id, g.n AS g, p.n AS p FROM g JOIN p USING (user_id, k)), pairs AS (SELECT a.user_id, avg(CASE WHEN a.p < b.p THEN 1.0 ELSE 0.0 END) AS score FROM x a JOIN x b ON a.user_id = b.user_id AND a.g < b.g GROUP BY a.user_id), n AS (SELECT user_id, count(*) AS ng, (SELECT count(*) FROM p WHERE p.user_id = g.user_id) AS np, (SELECT count(*) FROM x WHERE x.user_id = g.user_id) AS k FROM g GROUP BY user_id) SELECT user_id, round(CASE WHEN k < 2 THEN CASE WHEN k = ng AND k = np THEN 1.0 ELSE 0.0 END ELSE score END, 6) AS score FROM n LEFT JOIN pairs USING (user_id)")
def score_ranking(spark, d):
    e = T.table(spark, d, "events")

    def ranks(v):
        totals = e.groupBy("user_id", C("event_type").alias("k")).agg(F.sum(v).alias("s"))
        return totals.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("s"), "k"))).drop("s")

    return scoring.ranking_score(ranks(F.lit(1)), ranks(C("event_id") % 7), "user_id", "k", "n").withColumn("score", six("score"))


@query("SELECT id, CASE WHEN sqrt(pow(px - (id % 90), 2) + pow(py - (id % 70), 2)) <= 20 THEN 1.0 ELSE 0.0 END AS score FROM pois", "pois")
def score_points(spark, d):
    return T.pois(spark, d).select("id", scoring.point_score(C("py"), C("px"), C("id") % 70, C("id") % 90).alias("score"))


FIELDS = f"SELECT source AS dimension, doc_id // 5 AS task, CASE WHEN abs(pred - gold) <= 1 + 0.2 * abs(gold) THEN 1.0 ELSE 0.0 END AS s FROM ({ANSWERS})"


def averaged(spark, d):
    rows = answers(spark, d).select(C("source").alias("dimension"), F.floor(C("doc_id") / 5).alias("task"), scoring.close(C("gold"), C("pred")).alias("s"))
    return scoring.averages(rows, "dimension", "task", "s")


@query(f"SELECT dimension, task, round(avg(s), 6) AS score FROM ({FIELDS}) GROUP BY ALL")
def task_score(spark, d):
    return averaged(spark, d)[0].withColumn("score", six("score"))


@query(f"SELECT dimension, round(avg(s), 6) AS score, count(*) AS tasks FROM (SELECT dimension, task, avg(s) AS s FROM ({FIELDS}) GROUP BY ALL) GROUP BY dimension")
def dimension_score(spark, d):
    return averaged(spark, d)[1].withColumn("score", six("score"))


@query(f"SELECT round(avg(s), 6) AS score FROM (SELECT dimension, avg(s) AS s FROM (SELECT dimension, task, avg(s) AS s FROM ({FIELDS}) GROUP BY ALL) GROUP BY dimension)")
def overall_score(spark, d):
    return averaged(spark, d)[2].withColumn("score", six("score"))


def trajectories(spark, d):
    """Pairs of gold (even users) and predicted (the next user) call sequences, all steps."""
    calls = scoring.sequences(T.steps(spark, d), "user_id")
    gold = calls.where("user_id % 2 = 0").select((C("user_id") / 2).cast("long").alias("task"), C("calls").alias("g"))
    pred = calls.where("user_id % 2 = 1").select(((C("user_id") - 1) / 2).cast("long").alias("task"), C("calls").alias("p"))
    return gold.join(pred, "task")


PAIRS = "WITH x AS (SELECT user_id // 2 AS task, user_id % 2 AS side, step, call FROM steps), t AS (SELECT task, count(*) FILTER (side = 0) AS ng, count(*) FILTER (side = 1) AS np FROM x GROUP BY task HAVING count(DISTINCT side) = 2) "


@query(PAIRS + "SELECT t.task, round(CAST((SELECT count(DISTINCT a.call) FROM x a JOIN x b ON a.task = b.task AND a.call = b.call AND a.side = 0 AND b.side = 1 WHERE a.task = t.task) AS DOUBLE) / (SELECT count(DISTINCT call) FROM x WHERE x.task = t.task AND side = 0), 6) AS score FROM t", "steps")
def traj_any(spark, d):
    return trajectories(spark, d).select("task", six(scoring.recall(C("g"), C("p"))).alias("score"))


@query(PAIRS + "SELECT t.task, round(CAST(least(ng, coalesce((SELECT min(coalesce(a.step, b.step)) FROM (SELECT * FROM x WHERE side = 0) a FULL JOIN (SELECT * FROM x WHERE side = 1) b ON a.task = b.task AND a.step = b.step WHERE coalesce(a.task, b.task) = t.task AND a.call IS DISTINCT FROM b.call) - 1, ng)) AS DOUBLE) / ng, 6) AS score FROM t", "steps")
def traj_prefix(spark, d):
    return trajectories(spark, d).select("task", six(scoring.prefix(C("g"), C("p"))).alias("score"))


@query(PAIRS + "SELECT task, round(CAST(ng AS DOUBLE) / greatest(ng, np), 6) AS score FROM t", "steps")
def traj_eff(spark, d):
    return trajectories(spark, d).select("task", six(scoring.efficiency(C("g"), C("p"))).alias("score"))


@query(None)
def traj_lcs(spark, d):
    return trajectories(spark, d).select("task", six(scoring.lcs(C("g"), C("p"))).alias("score"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def resume_anti(spark, d):
    done = T.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(C("l_orderkey").alias("o_orderkey"))
    return T.table(spark, d, "orders").join(done, "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT event_id FROM events WHERE event_type IN (SELECT event_type FROM events WHERE value > 90 GROUP BY 1 HAVING count(*) > 10)")
def tool_filter_semi(spark, d):
    e = T.table(spark, d, "events")
    wanted = e.where("value > 90").groupBy("event_type").count().where("count > 10")
    return e.join(wanted, "event_type", "left_semi").select("event_id")


@query("WITH w AS (SELECT event_type FROM events WHERE value > 99.5 GROUP BY 1 HAVING count(*) > 3) SELECT event_id, event_type FROM events WHERE event_type IN (SELECT event_type FROM w) OR NOT EXISTS (SELECT 1 FROM w)")
def tool_filter_or_all(spark, d):
    """Steps of the tools with more than three high values; all steps where no tool has."""
    e = T.table(spark, d, "events")
    wanted = e.where("value > 99.5").groupBy("event_type").count().where("count > 3")
    return records.only_named(e, "event_type", wanted).select("event_id", "event_type")


@query("SELECT user_id, event_type, event_id AS last_event FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def predictions_last(spark, d):
    return scoring.merged_predictions(T.table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", C("event_id").alias("last_event"))


@query("WITH n AS (SELECT raster_id, value AS class, count(*) AS k FROM mask GROUP BY ALL) SELECT raster_id, class, round(CAST(k AS DOUBLE) / sum(k) OVER w, 6) AS share, round(CAST(k AS DOUBLE) / max(k) OVER w, 6) AS height FROM n WINDOW w AS (PARTITION BY raster_id)", "mask")
def pie_shares(spark, d):
    counts = T.mask(spark, d).groupBy("raster_id", C("value").alias("class")).agg(F.count(F.lit(1)).alias("k"))
    return evidence.shares(counts, "raster_id", "class", "k").withColumns({"share": six("share"), "height": six("height")})


@query("SELECT px // 10 AS gx, py // 10 AS gy, count(*) AS points FROM pois GROUP BY ALL", "pois")
def heatmap_counts(spark, d):
    return T.pois(spark, d).groupBy(F.floor(C("px") / 10).alias("gx"), F.floor(C("py") / 10).alias("gy")).agg(F.count(F.lit(1)).alias("points"))


@query("WITH n AS (SELECT px // 10 AS gx, py // 10 AS gy, count(*) AS k FROM pois GROUP BY ALL) SELECT n.gx + i AS gx, n.gy + j AS gy, round(sum(k * exp(-(i * i + j * j) / 2.0)), 6) AS density FROM n, range(-3, 4) a(i), range(-3, 4) b(j) GROUP BY ALL", "pois")
def heatmap_kde(spark, d):
    """Gaussian kernel on a grid of 10 pixels, cut off at three cells."""
    n = heatmap_counts(spark, d)
    off = F.explode(F.sequence(F.lit(-3), F.lit(3)))
    spread = n.select("gx", "gy", "points", off.alias("i")).select("*", off.alias("j"))
    return spread.groupBy((C("gx") + C("i")).alias("gx"), (C("gy") + C("j")).alias("gy")).agg(six(F.sum(C("points") * F.exp(-(C("i") * C("i") + C("j") * C("j")) / 2.0))).alias("density"))


@query("SELECT id, round(radians(lon) * 6378137, 2) + 0.0 AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 2) + 0.0 AS y FROM pois WHERE abs(lat) < 85", "pois")
def web_mercator(spark, d):
    x, y = crs.mercator(C("lat"), C("lon"))
    return T.pois(spark, d).where("abs(lat) < 85").select("id", (F.round(x, 2) + 0.0).alias("x"), (F.round(y, 2) + 0.0).alias("y"))


@query("SELECT id, CAST(floor((lon + 180) / 6) AS BIGINT) % 60 + 1 AS zone, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon FROM pois WHERE abs(lat) < 80", "pois")
def utm_round_trip(spark, d):
    """To UTM and back."""
    rows = T.pois(spark, d).where("abs(lat) < 80").withColumn("zone", crs.utm_zone(C("lon")))
    east, north = crs.utm(C("lat"), C("lon"), C("zone"))
    lat, lon = crs.from_utm(C("east"), C("north"), C("zone"))
    return rows.select("id", "zone", east.alias("east"), north.alias("north")).select("id", "zone", (six(lat) + 0.0).alias("lat"), (six(lon) + 0.0).alias("lon"))


@query("SELECT s_suppkey AS raster_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(greatest(0, least(i * 4, h - 6)) AS INT) AS r0, CAST(greatest(0, least(j * 4, w - 6)) AS INT) AS c0 FROM (SELECT s_suppkey, 10 + s_suppkey % 7 AS h, 12 + s_suppkey % 5 AS w FROM supplier), range(9) a(i), range(9) b(j) WHERE i <= ceil((h - 6) / 4) AND j <= ceil((w - 6) / 4)")
def sliding_windows(spark, d):
    sizes = T.table(spark, d, "supplier").select(C("s_suppkey").alias("raster_id"), (10 + C("s_suppkey") % 7).cast("int").alias("height"), (12 + C("s_suppkey") % 5).cast("int").alias("width"))
    return perceive.sliding_windows(sizes, 6, 4)


@query("SELECT raster_id, r, c, CASE WHEN value IN (1, 3) THEN 255 ELSE 0 END AS value FROM mask", "mask")
def class_mask(spark, d):
    return perceive.class_mask(T.mask(spark, d), [1, 3])


@query(None)
def road_centerline(spark, d):
    return perceive.centerlines(T.mask(spark, d), T.SIDE, T.SIDE)


@query("SELECT raster_id, r // 4 AS r, c // 4 AS c, round(avg(value), 6) AS value FROM dem GROUP BY ALL", "dem")
def decimated_read(spark, d):
    return raster.decimate(T.dem(spark, d), 4).withColumn("value", six("value"))


@query("SELECT id, CAST(px AS DOUBLE) AS px, CAST(py AS DOUBLE) AS py, name FROM pois", "pois")
def geojson_round_trip(spark, d):
    """Points of interest written as GeoJSON lines to the shared folder and read back."""
    path = shared_dir(spark, "geojson")
    files.write_geojson_lines(T.pois(spark, d), path, "px", "py", ["id", "name"])
    return files.points(files.read_geojson_lines(spark, path)).select(C("props")["id"].cast("long").alias("id"), "px", "py", C("props")["name"].alias("name"))


@query("SELECT count(*) AS total, count(*) FILTER (value < 80) AS success, count(*) FILTER (value >= 80) AS failed, round(avg(value), 6) AS avg_time FROM events")
def run_stats(spark, d):
    runs = T.table(spark, d, "events").select(C("event_type").alias("predicted_answer"), F.when(C("value") >= 80, "late").alias("error"), C("value").alias("elapsed_time"))
    return files.run_stats(runs).withColumn("avg_time", six("avg_time"))


@query(PAIRS.replace("step, call FROM", "step, call, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM") + "SELECT t.task, round(coalesce((SELECT sum(CASE WHEN a.call = b.call AND abs(b.k - a.k) <= 1 + 0.2 * abs(a.k) THEN 1.0 ELSE 0.0 END) FROM x a JOIN x b ON a.task = b.task AND a.step = b.step AND a.side = 0 AND b.side = 1 WHERE a.task = t.task), 0) / ng, 6) AS score FROM t", "steps")
def traj_params(spark, d):
    """Matching arguments of steps at the same place with the same call, over the gold steps."""
    rows = T.steps(spark, d).select(F.floor(C("user_id") / 2).alias("task"), (C("user_id") % 2).alias("side"), "step", "call", F.from_json("props", "map<string,double>").alias("args"))
    return scoring.parameter_accuracy(rows.where("side = 0"), rows.where("side = 1"), "task").withColumn("score", six("score"))


AXIS = "greatest(0.0, least(15.0, ({t} + 0.5) * 16 / 6 - 0.5))"


@query(f"WITH t AS (SELECT i.i AS r, j.j AS c, {AXIS.format(t='i.i')} AS y, {AXIS.format(t='j.j')} AS x FROM range(6) i(i), range(6) j(j)) SELECT d.raster_id, CAST(t.r AS INT) AS r, CAST(t.c AS INT) AS c, round(sum(CAST(d.value AS DOUBLE) * (1 - abs(CAST(y AS DOUBLE) - d.r)) * (1 - abs(CAST(x AS DOUBLE) - d.c))), 4) AS value FROM t JOIN dem d ON abs(y - d.r) < 1 AND abs(x - d.c) < 1 GROUP BY ALL", "dem")
def resample_bilinear(spark, d):
    return raster.resample_bilinear(T.dem(spark, d), T.SIDE, T.SIDE, 0.4).withColumn("value", F.round("value", 4))


@query("SELECT user_id, CAST(place AS INT) AS place, k, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN lower(k) LIKE '%purchase%' THEN 0 WHEN lower(k) LIKE '%c%' THEN 1 ELSE 2 END, k) AS place FROM (SELECT user_id, event_type AS k, count(*) AS n FROM events GROUP BY ALL)) WHERE place <= 3")
def prominent_statistics(spark, d):
    counts = T.table(spark, d, "events").groupBy("user_id", C("event_type").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return evidence.prominent(counts, "user_id", "k", "n", ["purchase", "c"], 3)


# --- answers as text -------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id % 6 < 4 THEN json_extract_string(props, '$.k') END AS k, event_id % 6 < 4 AS found FROM events")
def parsed_answers(spark, d):
    """Objects that answers wrap in nothing, tags, a fence or prose; the rest hold none or a broken one."""
    e, p, n = T.table(spark, d, "events"), C("props"), C("event_id") % 6
    text = F.when(n == 0, p).when(n == 1, F.concat(F.lit("Sure. <Answer> "), p, F.lit(" </answer> {}"))).when(n == 2, F.concat(F.lit("```json\n"), p, F.lit("\n```")))
    text = text.when(n == 3, F.concat(F.lit("I {think} it is "), p, F.lit(" {or so}"))).when(n == 4, C("event_type")).otherwise(F.expr("substring(props, 1, length(props) - 1)"))
    got = A.parsed_answer(text)
    return e.select("event_id", F.get_json_object(got, "$.k").alias("k"), got.isNotNull().alias("found"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '[' || event_id || ']' WHEN 1 THEN '\"[' || event_id || '\"' ELSE '\"' || event_type || '\"' END AS arg FROM events")
def coerced_arguments(spark, d):
    n, own = C("event_id") % 3, C("event_id").cast("string")
    value = F.when(n == 0, F.concat(F.lit(" ["), own, F.lit("] "))).when(n == 1, F.concat(F.lit("["), own)).otherwise(C("event_type"))
    return T.table(spark, d, "events").select("event_id", A.coerced(value).alias("arg"))


@query("SELECT p_partkey, '{\"pre_image\": {\"file\": \"/data/t/' || p_partkey || '.TIF\"}, \"a.png\": \"' || CASE WHEN p_partkey % 2 = 0 THEN '/abs/b.png' ELSE 'note.txt' END || '\", \"post_image\": {\"pixel_size_m\": ' || p_size || '}}' AS manifest, CAST(p_size AS DOUBLE) AS pixel_m, CAST(p_partkey AS VARCHAR) AS stem FROM part")
def resolved_paths(spark, d):
    key = C("p_partkey").cast("string")
    other = F.when(C("p_partkey") % 2 == 0, "/abs/b.png").otherwise("note.txt")
    manifest = F.concat(F.lit('{"pre_image": {"file": "t/'), key, F.lit('.TIF"}, "a.png": "'), other, F.lit('", "post_image": {"pixel_size_m": '), C("p_size").cast("string"), F.lit("}}"))
    out = A.resolved_paths(manifest, "/data")
    return T.table(spark, d, "part").select("p_partkey", out.alias("manifest"), A.pixel_size(manifest).alias("pixel_m"), A.path_stem(F.get_json_object(out, "$.pre_image.file")).alias("stem"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'p' || c_custkey WHEN 1 THEN 't' || c_custkey WHEN 2 THEN CAST(c_custkey AS VARCHAR) WHEN 3 THEN lower(c_mktsegment) || '_building' ELSE 'glass_' || c_custkey END AS k, c_custkey % 5 = 3 AS is_ratio FROM customer")
def same_keys(spark, d):
    n, own, segment = C("c_custkey") % 5, C("c_custkey").cast("string"), C("c_mktsegment")
    key = F.when(n == 0, F.concat(F.lit("Phase "), own)).when(n == 1, F.concat(F.lit("phase_T"), own)).when(n == 2, F.concat(F.lit("Rank_"), own)).when(n == 3, F.concat(segment, F.lit(" -Buildings"))).otherwise(F.concat(F.lit(" glass-"), own))
    name = F.when(n == 3, F.concat(segment, F.lit("_Share"))).otherwise(segment)
    return T.table(spark, d, "customer").select("c_custkey", A.same_key(key).alias("k"), A.is_ratio_name(name).alias("is_ratio"))


#: Fields of every order: counts, shares, exact names, maps, sets, rankings, pixels, places, and ignored ones.
EVAL_KINDS = ["scalar_count", "scalar_continuous", "exact_match", "scalar_dict", "set_f1", "ranking_kendall", "point_pixel", "point_pixel", "point_haversine", "point_haversine", "ignore"]
EVAL_FIELDS = ["n", "burnt_share", "phase", "areas", "names", "order", "at_row", "at_col", "seen_lat", "seen_lon", "note"]
EVAL_SQL = """SELECT o_orderkey AS task, unnest([
  {'field': 'n', 'score': CASE WHEN k % 25 <= 1 + 0.2 * k THEN 1.0 ELSE 0.0 END},
  {'field': 'burnt_share', 'score': CASE WHEN k % 3 = 0 THEN 0.0 ELSE 1.0 END},
  {'field': 'phase', 'score': CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.0 END},
  {'field': 'areas', 'score': CASE WHEN k % 4 = 0 THEN 2.0 / 3 ELSE 1.0 / 3 END},
  {'field': 'names', 'score': CASE WHEN k % 5 = 0 THEN 1.0 ELSE 0.8 END},
  {'field': 'order', 'score': CASE WHEN k % 2 = 0 THEN 2.0 / 3 ELSE 0.0 END},
  {'field': 'at__point_px', 'score': CASE WHEN k % 30 <= 20 THEN 1.0 ELSE 0.0 END},
  {'field': 'seen__point_geo', 'score': CASE WHEN k % 7 < 4 THEN 1.0 ELSE 0.0 END}], recursive := true) FROM (SELECT o_orderkey, CAST(o_orderkey % 97 + 1 AS BIGINT) AS k FROM orders)"""


def evaluated(spark, d):
    k = C("o_orderkey") % 97 + 1
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    own = text(k)
    gold = [own, F.lit("0.4"), text("Phase ", k), text('{"Phase 1": 200, "way_id": ', k, ', "Roads": 0.25}'), F.when(k % 5 == 0, '["Road"]').otherwise('["Road", "school", "Park"]'), F.lit('["a", "b", "c"]'), F.lit("10"), own, F.lit("12.5"), F.lit("45"), own]
    pred = [
        text(k + k % 25), F.when(k % 3 == 0, "0.9").when(k % 3 == 1, "42%").otherwise("0.38"), F.when(k % 2 == 0, text("p", k)).otherwise(own),
        F.when(k % 4 == 0, text('{"p1": 210, "way_id": ', k, "}")).otherwise(text('{"p1": 400, "way_id": ', k + 1, ', "road": "26"}')),
        F.when(k % 5 == 0, '["road"]').otherwise('["ROAD", "park"]'), F.when(k % 2 == 0, '["a", "c", "b"]').otherwise('["c", "b", "a", "d"]'),
        text(k % 30 + 10), own, text(F.lit(12.5) + (k % 7) / 100000.0), F.lit("45"), F.lit("other"),
    ]
    made = [F.struct(F.lit(f).alias("field"), F.lit(t).alias("kind"), g.cast("string").alias("gold"), p.cast("string").alias("pred")) for f, t, g, p in zip(EVAL_FIELDS, EVAL_KINDS, gold, pred)]
    orders = spread(T.table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    fields = orders.select(C("o_orderkey").alias("task"), F.lit(0.2).alias("pixel_m"), F.explode(F.array(*made)).alias("f")).select("task", "pixel_m", "f.*")
    return evaluation.field_scores(fields)


@query(f"SELECT task, field, round(score, 6) AS score FROM ({EVAL_SQL})")
def field_scores(spark, d):
    return evaluated(spark, d).withColumn("score", six("score"))


@query(f"WITH t AS (SELECT task, round(avg(score), 9) AS score FROM ({EVAL_SQL}) GROUP BY task), x AS (SELECT 'D' || task % 5 AS dimension, CASE WHEN task % 11 = 0 THEN NULL ELSE score END AS score, CAST(task % 2 AS DOUBLE) AS eff FROM t), g AS (SELECT dimension, count(*) AS n_tasks, count(score) AS n_scored, avg(score) AS score, avg(eff) AS eff FROM x GROUP BY dimension) SELECT dimension, n_tasks, n_scored, round(score, 6) AS score, round(eff, 6) AS eff FROM g UNION ALL SELECT 'overall', sum(n_tasks), sum(n_scored), round(avg(score), 6), round(avg(eff), 6) FROM g")
def results_table(spark, d):
    """Tasks of five dimensions, of which every eleventh holds ignored fields alone."""
    task = C("task")
    tasks = evaluated(spark, d).groupBy("task").agg(F.avg("score").alias("score"))
    tasks = tasks.select(F.concat(F.lit("D"), (task % 5).cast("string")).alias("dimension"), F.when(task % 11 != 0, C("score")).alias("score"), (task % 2).cast("double").alias("eff"))
    return evaluation.results_table(tasks, "dimension", "score", ["eff"])


@query("SELECT c_custkey AS sample, CASE WHEN c_custkey % 3 = 0 THEN 'by id ' || c_custkey WHEN c_custkey % 7 = 0 THEN NULL ELSE 'by id ' || CASE WHEN c_custkey % 3 = 1 THEN c_custkey + 2 ELSE c_custkey - 2 END END AS pred FROM customer")
def matched_predictions(spark, d):
    """Predictions by sample id; samples without one take what stands at their place, if anything does."""
    own, n = C("c_custkey"), C("c_custkey") % 3
    c = T.table(spark, d, "customer").select("c_custkey")
    gold = c.select(F.concat(F.when(n == 0, "s").otherwise("g"), own.cast("string")).alias("sample_id"), own.alias("pos"), own.alias("gold"))
    place = F.when(n == 0, own).when(n == 1, own + 2).otherwise(own - 2)
    pred = c.where((n == 0) | (own % 7 != 0)).select(F.concat(F.lit("s"), F.when(n == 0, own).otherwise(-own).cast("string")).alias("sample_id"), own.alias("pos"), F.concat(F.lit("by id "), place.cast("string")).alias("pred"))
    return evaluation.matched(gold, pred).select(C("gold").alias("sample"), "pred")


# --- more of rasters, layers, graphs and evidence --------------------------------------------------------------------


@query("SELECT a.raster_id, a.r, a.c, count(b.raster_id) AS neighbours FROM mask a LEFT JOIN mask b ON a.raster_id = b.raster_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND (a.r <> b.r OR a.c <> b.c) AND b.value <> 0 WHERE a.value <> 0 GROUP BY ALL", "mask")
def neighbours8(spark, d):
    return raster.neighbours8(T.mask(spark, d))


@query("SELECT raster_id, r, c, CASE WHEN CAST(trunc(value) AS INT) % 5 = 4 THEN 0 ELSE CAST(trunc(value) AS INT) % 5 END AS label FROM cells WHERE band = 1", "cells")
def colour_labels(spark, d):
    """Labels of colours made from values: four of the palette and one that is not."""
    n = C("value").cast("int") % 5
    channel = lambda i: F.element_at(F.array(*[F.lit(c[i]) for c in (*raster.LABEL_COLOURS, (10, 20, 30))]), n + 1)
    return T.cells(spark, d).where("band = 1").select("raster_id", "r", "c", raster.colour_label(channel(0), channel(1), channel(2)).alias("label"))


@query("WITH n AS (SELECT raster_id, r, c FROM mask WHERE value <> 0 UNION SELECT raster_id, r, c FROM cells WHERE band = 2 AND value > 30), every AS (SELECT raster_id, r, c FROM mask UNION SELECT raster_id, r, c FROM cells WHERE band = 2) SELECT e.raster_id, e.r, e.c, CASE WHEN n.r IS NULL THEN 0 ELSE 255 END AS value FROM every e LEFT JOIN n ON e.raster_id = n.raster_id AND e.r = n.r AND e.c = n.c", "cells", "mask")
def mask_union(spark, d):
    second = raster.threshold(T.cells(spark, d).where("band = 2"), 30.0, ">")
    return raster.mask_union([T.mask(spark, d), second])


@query("WITH RECURSIVE m AS (SELECT raster_id, r, c, r * 16 + c AS cell FROM mask WHERE value > 0), walk(raster_id, a, b) AS (SELECT raster_id, cell, cell FROM m UNION SELECT w.raster_id, w.a, y.cell FROM walk w JOIN m x ON w.raster_id = x.raster_id AND w.b = x.cell JOIN m y ON y.raster_id = x.raster_id AND abs(y.r - x.r) + abs(y.c - x.c) = 1), roots AS (SELECT raster_id, a AS cell, min(b) AS root FROM walk GROUP BY ALL), ids AS (SELECT raster_id, root, count(*) AS pixels, row_number() OVER (PARTITION BY raster_id ORDER BY root) AS id FROM roots GROUP BY raster_id, root) SELECT raster_id, r, c, id, pixels FROM m JOIN roots USING (raster_id, cell) JOIN ids USING (raster_id, root)", "mask")
def vectorize_ids(spark, d):
    return raster.region_ids(graph.raster_components(T.mask(spark, d), same_class=False)).select("raster_id", "r", "c", "id", "pixels")


SHAPES = "SELECT *, slot * 7 % 13 + 0.37 AS x, slot * 5 % 11 + 0.21 AS y, 3 + slot % 4 AS w, 4 + slot % 3 AS h FROM (SELECT DISTINCT l_suppkey AS raster_id, l_partkey % 50 AS slot FROM lineitem)"
UNDER = f"SELECT s.raster_id, s.slot AS id, k.r, k.c, CAST(k.value AS DOUBLE) AS value FROM ({SHAPES}) s JOIN cells k ON k.raster_id = s.raster_id AND k.band = 1 AND k.value <> 1 WHERE CASE slot % 3 WHEN 0 THEN k.c = floor(x) AND k.r = floor(y) WHEN 1 THEN k.c + 0.5 BETWEEN x AND x + w AND k.r + 0.5 BETWEEN y AND y + h ELSE k.c + 0.5 > x AND k.r + 0.5 > y AND (k.c + 0.5 - x) / w + (k.r + 0.5 - y) / h < 1 END"
MEASURES = "count(*) AS pixel_count, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_pop(value), 6) AS std"


def shapes(spark, d):
    """Points, rectangles and triangles over every raster."""
    slot = C("slot")
    x, y, w, h = slot * 7 % 13 + 0.37, slot * 5 % 11 + 0.21, 3 + slot % 4, 4 + slot % 3
    at = lambda px, py: F.struct(px.cast("double").alias("x"), py.cast("double").alias("y"))
    corners = [at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h)]
    ring = F.when(slot % 3 == 0, F.array(corners[0])).when(slot % 3 == 1, F.array(*corners)).otherwise(F.array(corners[0], corners[1], corners[3]))
    # Rings are made of what is left of each name: beside the names they would be sorted, and tests of them would run on every row.
    names = T.table(spark, d, "lineitem").groupBy(C("l_suppkey").alias("raster_id"), (C("l_partkey") % 50).alias("id")).agg(F.max(C("l_partkey") % 50).alias("slot"))
    return names.select("raster_id", "id", ring.alias("ring"))


@query(f"SELECT raster_id, id, {MEASURES} FROM ({UNDER}) GROUP BY ALL HAVING count(*) >= 2", "cells")
def raster_stats(spark, d):
    got, _ = vector.raster_stats(shapes(spark, d), T.cells(spark, d).where("band = 1"), T.NODATA, 2)
    return got.withColumns({"mean": six("mean"), "std": six("std"), "min": C("min").cast("double"), "max": C("max").cast("double")})


@query(f"WITH u AS ({UNDER}), k AS (SELECT raster_id, id FROM u GROUP BY ALL HAVING count(*) >= 2), t AS (SELECT DISTINCT raster_id, r, c, value FROM u JOIN k USING (raster_id, id)) SELECT raster_id, {MEASURES} FROM t GROUP BY ALL", "cells")
def raster_stats_union(spark, d):
    _, got = vector.raster_stats(shapes(spark, d), T.cells(spark, d).where("band = 1"), T.NODATA, 2)
    return got.withColumns({"mean": six("mean"), "std": six("std"), "min": C("min").cast("double"), "max": C("max").cast("double")})


@query("SELECT raster_id, value AS class, CASE value WHEN 1 THEN 'intact' WHEN 3 THEN 'damaged' ELSE CAST(value AS VARCHAR) END AS label, count(*) AS pixel_count, round(count(*) * 0.25, 6) AS area_m2 FROM mask WHERE value <> 0 GROUP BY ALL", "mask")
def class_statistics(spark, d):
    return evidence.class_statistics(T.mask(spark, d), 0.5, {1: "intact", 3: "damaged"}).withColumn("area_m2", six("area_m2"))


@query("WITH e AS (SELECT raster_id, count(*) AS nonzero, CASE WHEN avg(r) < 8 THEN 'north' ELSE 'south' END || CASE WHEN avg(c) < 8 THEN 'west' ELSE 'east' END AS quadrant FROM mask WHERE value > 0 GROUP BY raster_id) SELECT 'tool' || raster_id % 4 AS tool, count(*) AS mask_count, sum(nonzero) AS nonzero, round(sum(nonzero) * 0.25, 6) AS area_m2, string_agg(quadrant, ',' ORDER BY raster_id) AS regions FROM e GROUP BY ALL", "mask")
def evidence_by_tool(spark, d):
    items = evidence.rollup(T.mask(spark, d), 0.5, T.SIDE).select(F.concat(F.lit("tool"), C("raster_id") % 4).alias("tool"), C("raster_id").alias("place"), "nonzero", "area_m2", "quadrant")
    return evidence.by_tool(items).withColumns({"area_m2": six("area_m2"), "regions": F.array_join("regions", ",")})


@query(f"SELECT series, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS ordinal, round(CAST(value AS DOUBLE) / max(value) OVER (PARTITION BY series), 6) AS height FROM ({SERIES})")
def line_chart(spark, d):
    series = T.table(spark, d, "events").groupBy(F.floor(C("user_id") / 3).alias("series"), (C("user_id") % 3).alias("t")).agg(F.count(F.lit(1)).alias("value"))
    return evidence.line_heights(series, "series", "t", "value").withColumn("height", six("height"))


@query("SELECT raster_id, coalesce(string_agg(value, ',' ORDER BY value), '') AS classes FROM (SELECT raster_id, CAST(value AS VARCHAR) AS value FROM mask WHERE value <> 0 GROUP BY ALL) GROUP BY raster_id", "mask")
def classes_present(spark, d):
    return evidence.classes_present(T.mask(spark, d)).where(F.size("classes") > 0).withColumn("classes", F.array_join("classes", ","))


#: Routes by carrying the best path of every node; costs are lengths, above them repairs, and below them edges.
ROUTES = """WITH RECURSIVE both_ways AS (SELECT graph, u, v, w FROM (SELECT graph, u, v, {w} AS w FROM edges {where}) UNION ALL SELECT graph, v, u, w FROM (SELECT graph, u, v, {w} AS w FROM edges {where})),
walk(graph, node, d, path, n) AS (SELECT DISTINCT graph, CAST(3 AS BIGINT), CAST(0 AS HUGEINT), [CAST(3 AS BIGINT)], 0 FROM both_ways UNION ALL SELECT graph, node, min(d), arg_min(path, d), min(n) FROM (
  SELECT b.graph, b.v AS node, walk.d + b.w AS d, list_append(walk.path, b.v) AS path, walk.n + 1 AS n FROM walk JOIN both_ways b ON walk.graph = b.graph AND walk.node = b.u WHERE walk.n < 14) GROUP BY graph, node),
best AS (SELECT graph, arg_min(path, d) AS path FROM walk WHERE node = 17 GROUP BY graph), hops AS (SELECT graph, path[i] AS u, path[i + 1] AS v, CAST(i AS INT) AS seq FROM (SELECT graph, path, unnest(range(1, len(path))) AS i FROM best))
SELECT h.graph, h.seq, h.u, h.v, e.length, e.damaged FROM hops h JOIN edges e ON e.graph = h.graph AND e.u = least(h.u, h.v) AND e.v = greatest(h.u, h.v)"""


@query(ROUTES.format(w="CAST(length AS HUGEINT) * 1048576 + 1", where="WHERE NOT damaged"), "edges")
def route(spark, d):
    return graph.routes(T.edges(spark, d), 3, 17)


@query(ROUTES.format(w="CAST(damaged AS HUGEINT) * 1000000000000000000 + CAST(length AS HUGEINT) * 1048576 + 1", where=""), "edges")
def repair_route(spark, d):
    return graph.routes(T.edges(spark, d), 3, 17, repair=True)


@query("WITH RECURSIVE b AS (SELECT graph, u, v FROM edges UNION SELECT graph, v, u FROM edges), walk(graph, s, node, n) AS (SELECT DISTINCT graph, u, u, 0 FROM b UNION SELECT w.graph, w.s, b.v, w.n + 1 FROM walk w JOIN b ON w.graph = b.graph AND w.node = b.u WHERE w.n < 8), h AS (SELECT graph, s, node, min(n) AS n FROM walk GROUP BY ALL), c AS (SELECT graph, s, count(*) AS size FROM h GROUP BY ALL), src AS (SELECT graph, arg_max(s, size * 1000 - s) AS source FROM c GROUP BY graph), far AS (SELECT h.graph, source, node, n FROM h JOIN src ON h.graph = src.graph AND h.s = src.source) SELECT graph, source, arg_max(node, n * 1000 - node) AS target, max(n) AS hops FROM far GROUP BY ALL", "edges")
def farthest_pair(spark, d):
    return graph.farthest_pair(T.edges(spark, d).select("graph", "u", "v"))
