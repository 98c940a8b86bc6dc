"""Trajectories as plans: a list of {call, args} steps compiled to one lazy DataFrame.

``"<i>"`` as an argument names step i's result; other values are literals. Loops and reductions are grouped plans, not
driver loops. ``tool.loop`` runs row-wise calls for each row of its items: all items are one DataFrame, each call adds a column. Unknown calls and references raise; ``outcome`` turns a failure into a {status, error} row for callers that go on.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cindermap.functions import scalar
from cindermap.operators import raster, records, vector
from cindermap.sources import tables

REFERENCE = re.compile(r"<(\d+)>")
#: Inside a loop: a value of the item, of an earlier call of the same loop, or of an earlier one-row step of the trajectory.
ITEM, OBSERVED, OUTER = re.compile(r"<item\.([\w.]+)>", re.I), re.compile(r"<(\w+)>\s*from\s*step\[(\d+)\]\.obs", re.I), re.compile(r"<(\w+)>\s*from\s*trajectory\[(\d+)\]\.obs", re.I)


def _count_class(cells: DataFrame, side: int, n: int, **args) -> DataFrame:
    windows = records.loop_windows(cells, side, side, n, F.count_if(F.col("value") == args["class"]))
    return windows.withColumn("index", F.col("row_idx") * n + F.col("col_idx"))


#: Calls by name. Sources take the session and the folder, the others DataFrames and literals.
SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"source.{f.__name__}": f for f in (tables.cells, tables.mask, tables.dem, tables.rects, tables.pois, tables.sites, tables.edges, tables.steps)}
CALLS: dict[str, Callable[..., DataFrame]] = {
    "ras.area": raster.area, "ras.stats": raster.stats, "ras.threshold": raster.threshold, "ras.diff": raster.diff, "ras.clip": raster.clip, "ras.slope": raster.slope, "ras.hillshade": raster.hillshade, "ras.count_pixels": raster.count_pixels,
    "vec.filter_by_area": vector.filter_by_area, "vec.filter_by_attribute": vector.filter_by_attribute, "vec.max_polygon": vector.max_polygon, "vec.nearest": vector.nearest, "vec.intersect": vector.overlaps, "vec.point_in_polygon": vector.point_in_polygon, "vec.raster_stats": vector.zonal,
    "poi.search_by_name": records.search_by_name, "loop.count_class": _count_class, "reduce.best": records.reduce_by,
}


#: Calls for one row: columns and literals to named columns.
ROW_CALLS: dict[str, Callable[..., dict[str, Column]]] = {
    "calc.add": lambda a, b: {"value": a + b}, "calc.sub": lambda a, b: {"value": a - b}, "calc.diff": lambda a, b: {"value": F.abs(b - a)}, "calc.mul": lambda a, b: {"value": a * b},
    "calc.div": lambda a, b: {"value": scalar.safe_div(a, b)}, "calc.greater_than": lambda a, b: {"value": a > b}, "calc.volume": lambda area, depth: {"value": area * depth},
    "calc.point_distance": lambda r1, c1, r2, c2: {"value": scalar.pixel_distance(r1, c1, r2, c2)}, "calc.weighted_sum": lambda values, weights: {"value": scalar.weighted_sum(values, weights)},
    "logi.truck_trips": lambda volume, capacity: {"value": scalar.truck_trips(volume, capacity)}, "vec.haversine": lambda lat1, lon1, lat2, lon2: {"value": scalar.haversine_m(lat1, lon1, lat2, lon2)},
    "ras.window": lambda row_idx, col_idx, size: {"x1": col_idx * size, "x2": col_idx * size + size, "y1": row_idx * size, "y2": row_idx * size + size},
}


def plain_name(call: str) -> str:
    """A call's name without namespace; ``seg_flood`` is ``seg.flood``."""
    name = call.removeprefix("functions.")
    return name if "." in name else name.replace("_", ".", 1)


def _has(rows: DataFrame, path: str) -> bool:
    """Whether a dotted path names a column or a field inside one."""
    kind = rows.schema
    for part in path.split("."):
        names = kind.fieldNames() if hasattr(kind, "fieldNames") else []
        if part not in names:
            return False
        kind = kind[part].dataType
    return True


def loop(items: DataFrame, calls: list[dict], bind: dict[str, str] | None = None, grid_n: int | None = None, index: str = "index", trajectory: list[DataFrame] | None = None) -> DataFrame:
    """Every item through ``calls`` in order: the items' columns, ``last_obs`` (the last call's struct) and ``steps`` (all structs).

    Arguments may be ``<item.a.b>``, ``<k> from step[i].obs`` (an earlier call of this loop), ``<k> from trajectory[i].obs`` (a step
    of one row), lists of these, or literals. ``bind`` takes an argument that a call has from the item's column instead. What
    cannot be resolved stays as it is written, as a literal. With ``grid_n`` items without row_idx and col_idx get them from
    ``index``. A failed computation (a null) stays null in its row; the other rows go on. Extra columns stay; columns of the items
    that are called steps or last_obs are replaced.
    """
    rows = items.drop("steps", "last_obs")
    if grid_n and not {"row_idx", "col_idx"} <= set(rows.columns):
        rows = rows.withColumns({"row_idx": F.floor(F.col(index) / grid_n).cast("int"), "col_idx": (F.col(index) % grid_n).cast("int")})
    outer: dict[tuple[int, str], str] = {}

    def at_outer(key: str, i: int) -> bool:
        return trajectory is not None and i < len(trajectory) and key in trajectory[i].columns

    texts = [v for call in calls for v in (*call.get("args", {}).values(), *(bind or {}).values()) if isinstance(v, str)]
    for found in filter(None, map(OUTER.fullmatch, map(str.strip, texts))):
        key, i = found[1], int(found[2])
        if at_outer(key, i) and (i, key) not in outer:
            outer[i, key] = f"_outer_{i}_{key}"
            rows = rows.withColumn(outer[i, key], trajectory[i].agg(F.first(key)).scalar())
    seen: list[dict[str, Column]] = []

    def value(v):
        if isinstance(v, list):
            return F.array(*[value(x) for x in v])
        if isinstance(v, str):
            text = v.strip()
            if (m := ITEM.fullmatch(text)) and _has(rows, m[1]):
                return F.col(m[1])
            if (m := OBSERVED.fullmatch(text)) and int(m[2]) < len(seen) and m[1] in seen[int(m[2])]:
                return seen[int(m[2])][m[1]]
            if (m := OUTER.fullmatch(text)) and (int(m[2]), m[1]) in outer:
                return F.col(outer[int(m[2]), m[1]])
        return v if isinstance(v, Column) else F.lit(v)

    for n, call in enumerate(calls):
        name = plain_name(call.get("call") or call.get("tool") or "")
        if name not in ROW_CALLS:
            raise ValueError(f"tool.loop: unknown call {name}")
        args = dict(call.get("args") or {})
        for arg, key in (bind or {}).items():
            if arg in args:
                args[arg] = key if OUTER.fullmatch(key.strip()) else F.col(key) if key in rows.columns else args[arg]
        out = ROW_CALLS[name](**{k: value(v) for k, v in args.items()})
        rows = rows.withColumn(f"_step_{n}", F.struct(*[c.alias(k) for k, c in out.items()]))
        seen.append({k: F.col(f"_step_{n}.{k}") for k in out})
    own = [c for c in rows.columns if not re.match(r"_(step|outer)_\d", c)]
    every = [F.col(f"_step_{n}").alias(f"step_{n}") for n in range(len(seen))]
    last = F.col(f"_step_{len(seen) - 1}") if seen else F.lit(None).cast("struct<value:double>")
    return rows.select(*own, last.alias("last_obs"), *([F.struct(*every).alias("steps")] if every else []))


def compiled(spark: SparkSession, sf_dir: str, steps: list[dict]) -> DataFrame:
    """The last step's result; nothing runs until it is read."""
    results: list[DataFrame] = []
    for step in steps:
        name = plain_name(step["call"])
        args = {}
        for key, value in step.get("args", {}).items():
            found = REFERENCE.fullmatch(value) if isinstance(value, str) else None
            if found and int(found[1]) >= len(results):
                raise ValueError(f"{name}: {value} is not an earlier step")
            args[key] = results[int(found[1])] if found else value
        if name in SOURCES:
            results.append(SOURCES[name](spark, sf_dir, **args))
        elif name == "tool.loop":
            results.append(loop(trajectory=results, **args))
        elif name in CALLS:
            results.append(CALLS[name](**args))
        else:
            raise ValueError(f"unknown call {name}")
    return results[-1]


def outcome(spark: SparkSession, sf_dir: str, steps: list[dict]) -> DataFrame:
    """``compiled``, or one row with status and error where the plan cannot be built."""
    try:
        return compiled(spark, sf_dir, steps)
    except (ValueError, TypeError, KeyError) as e:
        return spark.createDataFrame([("stub", str(e))], "status string, error string")
