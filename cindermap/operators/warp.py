"""Rasters resampled at any place: other pixel sizes and other projections, by nearest, bilinear or cubic kernels; and densities of points.

A target cell asks for the source cells under its kernel, a join on (row, column); rasters of one frame ask for the same cells, so places are worked
out once, whatever the number of rasters. Projections are column arithmetic, so a whole warp is one lazy plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindermap.functions import crs
from cindermap.operators.raster import FEW, asked_of_all, frame_cells
from cindermap.sources.shared import staged

#: Source cells on each side of the place, and the kernel's weight at a distance.
TAPS = {"nearest": (0, 0), "bilinear": (0, 1), "cubic": (-1, 2)}
#: A heat map's cells an axis, and the bins an axis that points are first counted in.
GRID, BINS = 200, 1024


def kernel(method: str, t: Column) -> Column:
    """Weight at the distance t: linear, or Keys' cubic with a = -1/2."""
    a = F.abs(t)
    if method == "bilinear":
        return F.greatest(F.lit(0.0), 1 - a)
    return F.when(a <= 1, (1.5 * a - 2.5) * a * a + 1).when(a < 2, ((2.5 - 0.5 * a) * a - 4) * a + 2).otherwise(0.0)


def sampled(cells: DataFrame, places: DataFrame, height: int, width: int, method: str, edges: str = "repeat", rows: int | None = None) -> DataFrame:
    """raster_id, r, c, value: the cells' (raster_id, r, c, value) values at the places (raster_id, r, c, y, x in source cells, 0 at the first one's centre).

    Places without a raster_id, about ``rows`` of them, are asked of every raster. ``edges``: beyond the border the border's cells repeat, or (``none``)
    places outside have no row. Missing, null and NaN cells are left out and the other weights shared anew; a place without any has no row. Unknown
    methods are bilinear.
    """
    method = method if method in TAPS else "bilinear"
    own = cells.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).select("raster_id", F.col("r").alias("sr"), F.col("c").alias("sc"), F.col("value").cast("double").alias("value"))
    if edges == "none":
        places = places.where((F.col("y") >= -0.5) & (F.col("y") < height - 0.5) & (F.col("x") >= -0.5) & (F.col("x") < width - 0.5))
    inside = lambda k, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), k)).cast("int")
    own_places = ["raster_id"] if "raster_id" in places.columns else []
    low, high = TAPS[method]

    def met(asked: DataFrame) -> DataFrame:
        if own_places:
            return own.join(asked.hint("merge"), ["raster_id", "sr", "sc"])
        return asked_of_all(own, asked, ["sr", "sc"], (high - low + 1) ** 2 * (rows or FEW + 1))

    if method == "nearest":
        at = places.withColumns({"sr": inside(F.floor(F.col("y") + 0.5), height), "sc": inside(F.floor(F.col("x") + 0.5), width)})
        return met(at.select(*own_places, "r", "c", "sr", "sc")).select("raster_id", "r", "c", "value")
    step = F.array(*[F.lit(i) for i in range(low, high + 1)])
    tapped = places.select("*", F.explode(step).alias("i")).select("*", F.explode(step).alias("j"))
    y, x = F.floor("y") + F.col("i"), F.floor("x") + F.col("j")
    asked = tapped.select(*own_places, "r", "c", inside(y, height).alias("sr"), inside(x, width).alias("sc"), (kernel(method, F.col("y") - y) * kernel(method, F.col("x") - x)).alias("w")).where("w <> 0")
    took = met(asked).groupBy("raster_id", "r", "c").agg(F.sum(F.col("w") * F.col("value")).alias("total"), F.sum("w").alias("w"))
    return took.where(F.abs("w") > 1e-12).select("raster_id", "r", "c", (F.col("total") / F.col("w")).alias("value"))


def _grid(cells: DataFrame, height: int, width: int) -> DataFrame:
    return frame_cells(cells, height, width).withColumnsRenamed({"tr": "r", "tc": "c"})


def resample(cells: DataFrame, height: int, width: int, pixel_m: float, target_m: float, method: str = "bilinear") -> DataFrame:
    """Rasters of height x width cells of ``pixel_m`` at cells of ``target_m`` (at least one cell; a size that is not positive is an error)."""
    if not target_m or target_m <= 0:
        raise ValueError("the target pixel size must be positive")
    scale = (abs(pixel_m) or 1.0) / target_m
    h, w = max(1, int(height * scale)), max(1, int(width * scale))
    centre = lambda c, n, full: (F.col(c) + 0.5) * full / n - 0.5
    return sampled(cells, _grid(cells, h, w).withColumns({"y": centre("r", h, height), "x": centre("c", w, width)}), height, width, method, rows=h * w)


def to_degrees(name: str, x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude of coordinates in EPSG:4326, 3857, 326zz or 327zz."""
    if name == "EPSG:4326":
        return y, x
    if name == "EPSG:3857":
        return crs.from_mercator(x, y)
    zone = re.fullmatch(r"EPSG:32([67])(\d\d)", name)
    if not zone:
        raise ValueError(f"no projection for {name}")
    return crs.from_utm(x, y - (10_000_000 if zone[1] == "7" else 0), F.lit(int(zone[2])))


def from_degrees(name: str, lat: Column, lon: Column) -> tuple[Column, Column]:
    """x and y of a place in one of the projections of ``to_degrees``."""
    if name == "EPSG:4326":
        return lon, lat
    if name == "EPSG:3857":
        x, y = crs.mercator(lat, lon)
        return x, y
    zone = re.fullmatch(r"EPSG:32([67])(\d\d)", name)
    if not zone:
        raise ValueError(f"no projection for {name}")
    x, y = crs.utm(lat, lon, F.lit(int(zone[2])))
    return x, y + (10_000_000 if zone[1] == "7" else 0)


def projected(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    return (x, y) if source == target else from_degrees(target, *to_degrees(source, x, y))


def suggested_grid(spark, height: int, width: int, transform: tuple[float, ...], source: str, target: str) -> tuple[tuple[float, ...], int, int]:
    """Transform (a, b, c, d, e, f), height and width that hold a raster in another projection, north up, with as many cells along its diagonal."""
    a, b, c, d, e, f = transform
    t = F.col("id") / 20.0
    sides = [(t * width, F.lit(0.0)), (t * width, F.lit(float(height))), (F.lit(0.0), t * height), (F.lit(float(width)), t * height)]
    row = spark.range(21).select(F.explode(F.array(*[F.struct((a * x + b * y + c).alias("x"), (d * x + e * y + f).alias("y")) for x, y in sides])).alias("p"))
    x, y = projected(F.col("p.x"), F.col("p.y"), source, target)
    x0, x1, y0, y1 = row.select(x.alias("x"), y.alias("y")).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    size = float(np.hypot(x1 - x0, y1 - y0) / np.hypot(height, width))
    return (size, 0.0, x0, 0.0, -size, y1), max(1, round((y1 - y0) / size)), max(1, round((x1 - x0) / size))


def reproject(cells: DataFrame, height: int, width: int, transform: tuple[float, ...], source: str, target: str, method: str = "bilinear", grid: tuple | None = None) -> DataFrame:
    """Rasters (raster_id, r, c, value) of one frame in another projection, on ``grid`` (as ``suggested_grid`` gives it); cells outside the source have no row.

    Every target cell's centre is taken back to the source, and the source is sampled there.
    """
    out, h, w = grid or suggested_grid(cells.sparkSession, height, width, transform, source, target)
    centre = F.col("c") + 0.5, F.col("r") + 0.5
    x, y = projected(out[0] * centre[0] + out[1] * centre[1] + out[2], out[3] * centre[0] + out[4] * centre[1] + out[5], target, source)
    a, b, c, d, e, f = transform
    world = _grid(cells, h, w).withColumns({"wx": x - c, "wy": y - f})
    det = a * e - b * d
    places = world.select("r", "c", ((a * F.col("wy") - d * F.col("wx")) / det - 0.5).alias("y"), ((e * F.col("wx") - b * F.col("wy")) / det - 0.5).alias("x"))
    # Written once: the series of the projections would else be computed for each tap. They are the same for every raster.
    return sampled(cells, staged(places, "places"), height, width, method, "none", h * w)


def heatmap(points: DataFrame, bandwidth: float | None = None) -> tuple[DataFrame, dict]:
    """Density of points (px, py) on a grid of ``GRID`` x ``GRID`` places from the smallest to the largest coordinates (i, j, density), and its frame: point_count and extent.

    A Gaussian kernel with the points' covariance, scaled by ``bandwidth`` or n^(-1/6), and without any cut. Points are first
    counted in ``BINS`` x ``BINS`` bins, each standing at its points' mean place: with bins h wide and a kernel s wide that is off by about
    (h / s)^2 / 24 of the density, and by nothing where a bin's points are in one place. So work does not grow with the points beyond
    counting them. Null coordinates are left out; fewer than two points, or points on one line, are an error.
    """
    own = points.where("px IS NOT NULL AND py IS NOT NULL").select(F.col("px").cast("double").alias("px"), F.col("py").cast("double").alias("py"))
    f = own.agg(F.count(F.lit(1)).alias("n"), *[g(k).alias(f"{k}{n}") for k in ("px", "py") for n, g in ((0, F.min), (1, F.max))], F.var_samp("px").alias("xx"), F.var_samp("py").alias("yy"), F.covar_samp("px", "py").alias("xy")).first()
    if f["n"] < 2:
        raise ValueError("a heat map needs at least two points")
    x0, y0 = f["px0"], f["py0"]
    x1, y1 = (b if b - a >= 1e-6 else a + 1.0 for a, b in ((f["px0"], f["px1"]), (f["py0"], f["py1"])))
    scale = (bandwidth if bandwidth is not None else f["n"] ** (-1 / 6)) ** 2
    xx, yy, xy = f["xx"] * scale, f["yy"] * scale, f["xy"] * scale
    det = xx * yy - xy * xy
    if det <= 1e-12 * max(xx, yy, 1e-300) ** 2:
        raise ValueError("the points lie on one line")
    bin_of = lambda k, a, b: F.least(F.lit(BINS - 1), F.floor((F.col(k) - a) / (b - a) * BINS))
    bins = own.groupBy(bin_of("px", x0, x1).alias("i"), bin_of("py", y0, y1).alias("j")).agg(F.avg("px").alias("x"), F.avg("py").alias("y"), F.count(F.lit(1)).alias("n"))
    gx, gy = np.linspace(x0, x1, GRID)[:, None], np.linspace(y0, y1, GRID)[None]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((GRID, GRID))
        for rows in batches:
            for x, y, n in zip(*(rows.column(k).to_pylist() for k in ("x", "y", "n")), strict=True):
                dx, dy = gx - x, gy - y
                total += n * np.exp((-0.5 / det) * (yy * dx * dx + xx * dy * dy - 2 * xy * (dx * dy)))
        i, j = np.divmod(np.arange(GRID * GRID, dtype=np.int32), GRID)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "part"])

    parts = bins.repartition(points.sparkSession.sparkContext.defaultParallelism).mapInArrow(spread, "i int, j int, part double")
    density = parts.groupBy("i", "j").agg((F.sum("part") / (2 * np.pi * det**0.5 * f["n"])).alias("density"))
    return density, {"point_count": f["n"], "extent": (x0, y0, x1, y1)}
