"""Answers scored field by field as an evaluation specification says; all tasks of all samples in one plan.

``fields`` rows: task, field, kind, gold, pred and pixel_m; gold and pred are texts (JSON for maps and lists), null if missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindermap.functions.answers import is_ratio_name, json_object, ratio_number, same_key
from cindermap.functions.scalar import haversine_m, normalize_text, once
from cindermap.operators import overlay, scoring
from cindermap.sources import files
from cindermap.sources.shared import staged

POINT_PIXELS, FALLBACK_M, METRES_A_DEGREE = 20.0, 20.0, 111_320.0
#: Endings of the two halves of a point.
LAT, LON, ROW, COL = r"_(latitude|lat)$", r"_(longitude|lon)$", r"_row$", r"_col$"
#: The names under which a map holds a point, in the order in which they are looked for.
PIXEL_KEYS = (("pixel_row", "pixel_col"), ("row", "col"), ("r", "c"), ("y", "x"))
PLACE_KEYS = (("latitude", "longitude"), ("lat", "lon"), ("lat", "lng"), ("y", "x"))
LEAST_IOU = 0.5
#: The member of a gold GeoJSON text that holds its image's pixel grid, where the caller names no other.
GRID_KEY = "pixel_grid"
#: Predictions that say there is no polygon.
NO_POLYGON = ("", "none", "null", "n/a", "na", "nan", "[]", "{}")


def _number(text: Column) -> Column:
    return text.try_cast("double")


def scalar(gold: Column, pred: Column, absolute: float = 1.0) -> Column:
    """Equal texts (two nulls too) score 1, else numbers that are close."""
    return F.when(gold.eqNullSafe(pred), 1.0).otherwise(F.coalesce(scoring.close(_number(gold), _number(pred), absolute), F.lit(0.0)))


def ratio(gold: Column, pred: Column) -> Column:
    """Shares as fractions or percentages; what is no number is compared as a scalar without absolute tolerance."""
    both = F.struct(ratio_number(gold).alias("g"), ratio_number(pred).alias("p"))
    close = once(both, lambda n: F.when(n["g"].isNotNull() & n["p"].isNotNull(), scoring.ratio_close(n["g"], n["p"])))
    return F.coalesce(close, scalar(gold, pred, 0.0))


def dictionary(gold: Column, pred: Column, pixel_m: Column) -> Column:
    """Mean over the gold keys, spelled alike: identifiers exactly, coordinates within 20 pixels, the rest as numbers (small ones relatively).

    An empty gold map scores 1; text that is no map scores 0; of keys that become equal the last counts.
    """
    as_map = lambda x: F.from_json(x, "map<string,string>")
    entries = lambda x: F.transform(F.map_entries(as_map(x)), lambda e: F.struct(same_key(e["key"]).alias("k"), e["value"].alias("v")))
    reach = F.coalesce(POINT_PIXELS * pixel_m, F.lit(FALLBACK_M)) / METRES_A_DEGREE

    def pairs(b: Column) -> Column:
        last = lambda x, key: F.try_element_at(F.filter(x, lambda e: e["k"] == key), F.lit(-1))
        found = F.transform(F.array_distinct(F.transform(b["g"], lambda e: e["k"])), lambda key: F.struct(key.alias("k"), last(b["g"], key).alias("g"), last(b["p"], key).alias("p")))
        return F.transform(found, lambda e: F.struct(e["k"].alias("k"), e["p"].isNotNull().alias("there"), e["g"]["v"].alias("gv"), e["p"]["v"].alias("pv"), _number(e["g"]["v"]).alias("gn"), _number(e["p"]["v"]).alias("pn")))

    def one(e: Column) -> Column:
        gn, pn = e["gn"], e["pn"]
        numbers = F.when(F.abs(gn) <= 1.5, scoring.ratio_close(gn, pn)).otherwise(scoring.ratio_close(gn, pn, 1.0))
        near = F.when(e["k"].rlike(r"(^|_)(lat|latitude|lon|lng|longitude)$"), (F.abs(pn - gn) <= reach).cast("double")).otherwise(numbers)
        valued = F.when(e["k"].rlike(r"^id$|_id$|osmid$"), scoring.exact(e["gv"], e["pv"])).when(gn.isNotNull() & pn.isNotNull(), near).otherwise(scalar(e["gv"], e["pv"]))
        return F.when(e["there"], valued).otherwise(0.0)

    def mean(scores: Column) -> Column:
        return F.when(F.size(scores) == 0, 1.0).otherwise(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores))

    both = F.struct(entries(gold).alias("g"), entries(pred).alias("p"))
    return once(both, lambda b: F.when(b["g"].isNull() | b["p"].isNull(), 0.0).otherwise(once(F.transform(pairs(b), one), mean)))


def set_of(gold: Column, pred: Column) -> Column:
    """F1 of two sets of normalized texts: the items of a JSON list, or what stands between the commas of any other text. Nulls and JSON objects are empty sets."""

    def items(x: Column) -> Column:
        text = F.trim(x)
        listed = F.transform(F.when(text.startswith("["), F.from_json(text, "array<string>")), lambda v: F.coalesce(v, F.lit("None")))
        parts = F.filter(F.split(x, ","), lambda p: F.trim(p) != "")
        other = F.when(text.startswith("{") & json_object(text).isNotNull(), F.array().cast("array<string>")).otherwise(parts)
        return F.transform(F.coalesce(listed, other, F.array().cast("array<string>")), normalize_text)

    return once(F.struct(items(gold).alias("g"), items(pred).alias("p")), lambda b: scoring.set_f1(b["g"], b["p"]))


def ranking(gold: Column, pred: Column) -> Column:
    """(tau + 1) / 2 over the pairs of gold's items that the prediction ranks too; with fewer than two: 1 if both hold the same items.

    Of an item that is ranked twice its last place counts. Texts that are no lists score 0.
    """
    place = lambda x, v: -F.array_position(F.reverse(x), v)

    def share(ranks: Column) -> Column:
        n = F.size(ranks)
        ahead = F.transform(ranks, lambda a, i: F.size(F.filter(F.slice(ranks, i + 2, n), lambda b: (b["g"] - a["g"]) * (b["p"] - a["p"]) > 0)))
        return F.when(n >= 2, F.aggregate(ahead, F.lit(0), lambda a, x: a + x) / (n * (n - 1) / 2))

    def score(b: Column) -> Column:
        g, p = b["g"], b["p"]
        same = (F.size(F.array_except(g, p)) == 0) & (F.size(F.array_except(p, g)) == 0)
        ranks = F.transform(F.filter(g, lambda v: F.array_contains(p, v)), lambda v: F.struct(place(g, v).alias("g"), place(p, v).alias("p")))
        return F.when(g.isNull() | p.isNull(), 0.0).otherwise(F.coalesce(once(ranks, share), same.cast("double")))

    return once(F.struct(F.from_json(gold, "array<string>").alias("g"), F.from_json(pred, "array<string>").alias("p")), score)


def _points(fields: DataFrame, kind: str, first: str, second: str, hit) -> DataFrame:
    """One row for each (task, base) whose two halves are there; halves without a number score 0, missing ones count as 0."""
    ending = F.when(F.col("field").rlike(first), 1).when(F.col("field").rlike(second), 2)
    base = F.regexp_replace("field", f"{first}|{second}", "")
    halves = fields.where(F.col("kind") == kind).withColumn("half", ending).where("half IS NOT NULL")
    pick = lambda c, n: F.max(F.when(F.col("half") == n, F.coalesce(c, F.lit("0"))))
    pairs = halves.groupBy("task", base.alias("field")).agg(*[pick(c, n).try_cast("double").alias(f"{c}{n}") for c in ("gold", "pred") for n in (1, 2)], F.max("pixel_m").alias("pixel_m"), F.count_distinct("half").alias("halves"))
    return pairs.where("halves = 2").select("task", F.concat("field", F.lit("__point_geo" if kind == "point_haversine" else "__point_px")).alias("field"), F.coalesce(hit.cast("double"), F.lit(0.0)).alias("score"))


def _coordinates(text: Column, keys: tuple) -> Column:
    """(a, b) of a point given as a JSON list of two numbers or a map that holds both; null if it is neither."""
    t = F.trim(text)
    listed = F.transform(F.when(t.startswith("["), F.from_json(t, "array<string>")), _number)
    mapped = F.when(t.startswith("{"), F.from_json(t, "map<string,string>"))
    point = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("a"), b.alias("b")))
    from_list = F.when(F.size(listed) == 2, point(F.get(listed, F.lit(0)), F.get(listed, F.lit(1))))
    return F.coalesce(from_list, *[point(*[_number(F.try_element_at(mapped, F.lit(k))) for k in pair]) for pair in keys])


def lone_point(gold: Column, pred: Column, kind: Column, pixel_m: Column) -> Column:
    """A point in one value: within 20 pixels, or 20 pixel sizes in metres (20 m if unknown); what is no point is compared as a scalar."""

    def score(keys: tuple, near) -> Column:
        both = F.struct(_coordinates(gold, keys).alias("g"), _coordinates(pred, keys).alias("p"))
        return once(both, lambda b: F.when(b["g"].isNotNull() & b["p"].isNotNull(), F.coalesce(near(b["g"], b["p"]).cast("double"), F.lit(0.0))))

    reach = F.coalesce(POINT_PIXELS * pixel_m, F.lit(FALLBACK_M))
    pixel = score(PIXEL_KEYS, lambda g, p: F.hypot(p["a"] - g["a"], p["b"] - g["b"]) <= POINT_PIXELS)
    place = score(PLACE_KEYS, lambda g, p: haversine_m(p["a"], p["b"], g["a"], g["b"]) <= reach)
    return F.coalesce(F.when(kind == "point_pixel", pixel).otherwise(place), scalar(gold, pred))


def polygon_scores(fields: DataFrame, grid_key: str = GRID_KEY) -> DataFrame:
    """task, field, score of polygon_iou fields, whose gold and pred are GeoJSON texts: 1 if their largest polygons (the first, if two are) have an
    intersection of at least half of their union. Where the gold text has the member ``grid_key``, with a transform, predictions without a crs are pixels and
    are placed by its transform. Equal texts score 1; an empty prediction scores 1 if the gold text has no polygon; unreadable texts score 0."""
    gold, pred = (files.geojson_polygons(F.col(c)) for c in ("gold", "pred"))
    largest = lambda polygons: F.array_max(F.transform(polygons, lambda rings, i: F.struct(overlay.area_of(rings).alias("area"), (-i).alias("nth"), rings.alias("rings"))))["rings"]
    grid = F.from_json(F.get_json_object("gold", f"$.{grid_key}.transform"), "array<double>")
    t = lambda i: F.get(grid, F.lit(i))
    world = lambda rings: F.transform(rings, lambda r: F.transform(r, lambda p: F.struct((t(0) * p["x"] + t(1) * p["y"] + t(2)).alias("x"), (t(3) * p["x"] + t(4) * p["y"] + t(5)).alias("y"))))
    rows = fields.select("task", "field", "gold", "pred", largest(gold).alias("a_rings"), largest(pred).alias("b_rings"), gold.isNotNull().alias("readable"))
    pixels = grid.isNotNull() & F.get_json_object("pred", "$.crs").isNull()
    rows = rows.withColumn("b_rings", F.when(pixels, world(F.col("b_rings"))).otherwise(F.col("b_rings"))).withColumn("id", F.struct("task", "field"))
    both = overlay.measured(rows.where("a_rings IS NOT NULL AND b_rings IS NOT NULL").select("id", "a_rings", "b_rings"))
    none = F.lower(F.trim(F.coalesce("pred", F.lit("none")))).isin(*NO_POLYGON) | files.geojson_polygons(F.col("pred")).isNotNull()
    score = F.when(F.col("gold") == F.col("pred"), 1.0).when(F.col("iou").isNotNull(), ((F.col("iou") >= LEAST_IOU) & (F.col("together") > 0)).cast("double"))
    score = score.when(F.col("readable") & F.col("a_rings").isNull() & F.col("b_rings").isNull() & none, 1.0).otherwise(0.0)
    return rows.join(both, "id", "left").select("task", "field", score.alias("score"))


def field_scores(fields: DataFrame, grid_key: str = GRID_KEY) -> DataFrame:
    """task, field, score. Kinds: scalar_continuous, scalar_count, ratio_pct, exact_match, scalar_dict, set_f1, ranking_kendall, polygon_iou,
    point_haversine and point_pixel (two fields named as a point's halves make one row, a half without the other none, any other such field is a point
    of its own), ignore (no row); any other kind is compared exactly.

    The fields are written once; every group of kinds is a scan of its own, so that the simple ones run as compiled code.
    """
    fields = staged(fields.select("task", "field", "kind", "gold", "pred", "pixel_m"), "fields")
    gold, pred, kind, pixel_m = (F.col(c) for c in ("gold", "pred", "kind", "pixel_m"))
    share = (kind == "ratio_pct") | ((kind == "scalar_continuous") & is_ratio_name(F.col("field")))
    numbers = kind.isin("ratio_pct", "scalar_continuous", "scalar_count")
    nested = {"scalar_dict": dictionary(gold, pred, pixel_m), "set_f1": set_of(gold, pred), "ranking_kendall": ranking(gold, pred)}
    half = F.when(kind == "point_haversine", F.col("field").rlike(f"{LAT}|{LON}")).otherwise(F.col("field").rlike(f"{ROW}|{COL}"))
    points = kind.isin("point_haversine", "point_pixel")
    told = lambda rows, score: rows.select("task", "field", score.alias("score"))
    parts = [told(fields.where(numbers), F.when(share, ratio(gold, pred)).otherwise(scalar(gold, pred)))]
    parts += [told(fields.where(kind == k), score) for k, score in nested.items()]
    parts += [told(fields.where(points & ~half), lone_point(gold, pred, kind, pixel_m)), polygon_scores(fields.where(kind == "polygon_iou"), grid_key)]
    parts += [told(fields.where(~numbers & ~points & ~F.coalesce(kind, F.lit("")).isin("ignore", "polygon_iou", *nested) | kind.isNull()), scoring.exact(gold, pred))]
    metres = haversine_m(F.col("pred1"), F.col("pred2"), F.col("gold1"), F.col("gold2"))
    parts += [_points(fields, "point_haversine", LAT, LON, metres <= F.coalesce(POINT_PIXELS * F.col("pixel_m"), F.lit(FALLBACK_M)))]
    pixels = F.hypot(F.col("pred1") - F.col("gold1"), F.col("pred2") - F.col("gold2"))
    parts += [_points(fields, "point_pixel", ROW, COL, pixels <= POINT_PIXELS)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def matched(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Gold samples (sample_id, pos, gold) with their prediction (pred): the last of the same id, else the one at the same place, else null."""
    named = pred.where("sample_id <> ''").groupBy("sample_id").agg(F.max_by("pred", "pos").alias("by_id"))
    placed = pred.select("pos", F.col("pred").alias("by_place"))
    rows = gold.join(named.withColumn("found", F.lit(True)), "sample_id", "left").join(placed, "pos", "left")
    return rows.select("sample_id", "pos", "gold", F.when(F.col("found"), F.col("by_id")).otherwise(F.col("by_place")).alias("pred"))


def results_table(tasks: DataFrame, dimension: str, score: str, metrics: list[str]) -> DataFrame:
    """One row a dimension and one row ``overall``: tasks, scored tasks, mean score over scored tasks, means of the metrics, all to six places.

    ``overall`` is the mean of the dimensions; its counts are sums. A dimension without scored tasks has score 0.
    """
    means = [F.avg(m).alias(m) for m in metrics]
    dims = tasks.groupBy(F.col(dimension).cast("string").alias("dimension")).agg(F.count(F.lit(1)).alias("n_tasks"), F.count(score).alias("n_scored"), F.coalesce(F.avg(score), F.lit(0.0)).alias("score"), *means)
    total = dims.agg(F.lit("overall").alias("dimension"), F.sum("n_tasks").alias("n_tasks"), F.sum("n_scored").alias("n_scored"), F.avg("score").alias("score"), *means)
    return dims.unionByName(total).select("dimension", "n_tasks", "n_scored", *[F.round(c, 6).alias(c) for c in ("score", *metrics)])
