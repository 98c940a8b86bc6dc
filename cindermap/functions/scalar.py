"""Column functions: arithmetic with defined edge cases, distances, labels, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def safe_div(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0; null where either is null."""
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)))


def truck_trips(volume: Column, capacity: Column) -> Column:
    """Full loads rounded up; 0 without capacity."""
    return F.when(capacity <= 0, F.lit(0).cast("long")).otherwise(F.ceil(F.try_divide(volume.cast("double"), capacity.cast("double"))))


def pixel_distance(r1: Column, c1: Column, r2: Column, c2: Column, pixel_m: float = 1.0) -> Column:
    return F.sqrt((r1 - r2) * (r1 - r2) + (c1 - c2) * (c1 - c2)) * pixel_m


def weighted_sum(values: Column, weights: Column, normalize: bool = False) -> Column:
    """Dot product; null if the lengths differ; normalized by the weights' sum unless that is 0."""
    total = F.aggregate(F.zip_with(values, weights, lambda v, w: v * w), F.lit(0.0), lambda a, x: a + x)
    if normalize:
        over = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
        total = F.when(over != 0, total / over).otherwise(total)
    return F.when(F.size(values) == F.size(weights), total)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres on a sphere of radius ``EARTH_M``."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def nested_get(json: Column, path: str) -> Column:
    """Value at a dotted path of a JSON text; the whole text for an empty path; null if missing."""
    return F.get_json_object(json, f"$.{path}") if path else json


def label(template: str, **columns: Column) -> Column:
    """Fill ``{name}`` places; nulls are empty, whole floats are printed as integers."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), F.coalesce(F.regexp_replace(columns[name].cast("string"), r"\.0$", ""), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def once(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def normalize_text(x: Column) -> Column:
    """Lower case; punctuation becomes spaces; runs of spaces become one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), r"(?U)[^\w\s]", " "), r"\s+", " "))


def normalize_tool(x: Column) -> Column:
    """A call's name without arguments; the first underscore of a prefix becomes a dot (``seg_flood`` is ``seg.flood``)."""
    name = F.trim(F.regexp_replace(x, r"\(.*$", ""))
    return F.when(name.contains("."), name).otherwise(F.regexp_replace(name, r"^([^_]+)_", "$1."))


def canonical(x: Column) -> Column:
    """Form in which answers are compared: whole numbers without decimals, else ``normalize_text``, one spelling for booleans and for phases ("Phase 3" and "p_3" are "p3", "phase t1" is "t1")."""
    whole = F.regexp_extract(F.trim(x), r"^(-?\d+)(\.0+)?$", 1)

    def spelled(t: Column) -> Column:
        phase = lambda pattern: F.regexp_extract(t, pattern, 1)
        t1, p1 = phase(r"^(?:phase[\s_]*t|t[\s_]+)(\d+)$"), phase(r"^(?:phase[\s_]*|p[\s_]+)(\d+)$")
        out = F.when(t.isin("true", "yes"), "true").when(t.isin("false", "no"), "false")
        return out.when(t1 != "", F.concat(F.lit("t"), t1)).when(p1 != "", F.concat(F.lit("p"), p1)).otherwise(t)

    return F.when(whole != "", whole).otherwise(once(normalize_text(x), spelled))


def pixel_to_world(r: Column, c: Column, transform: tuple[float, ...]) -> tuple[Column, Column]:
    """x and y of a pixel's corner by the affine transform (a, b, c, d, e, f)."""
    a, b, x0, d, e, y0 = (F.lit(float(v)) for v in transform)
    return x0 + a * c + b * r, y0 + d * c + e * r


def world_to_pixel(x: Column, y: Column, transform: tuple[float, ...]) -> tuple[Column, Column]:
    """Row and column, truncated toward zero, so that -0.4 becomes pixel 0."""
    a, b, x0, d, e, y0 = transform
    det = a * e - b * d
    col = ((x - x0) * e - (y - y0) * b) / det
    row = ((y - y0) * a - (x - x0) * d) / det
    return row.cast("int"), col.cast("int")
