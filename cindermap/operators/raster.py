"""Rasters as cells: raster_id, [band], r, c, value. Everything is per raster and runs over all rasters at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows asked of every raster that are still sent to every task.
FEW = 1 << 18


def valid(value: Column, nodata: float | None) -> Column:
    ok = value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value) < float("inf"))
    return ok if nodata is None else ok & (value != nodata)


def count_pixels(mask: DataFrame, classes: list[int]) -> DataFrame:
    """Cells of each class and raster, zeros included."""
    asked = F.array(*[F.lit(c) for c in dict.fromkeys(classes)])
    wanted = mask.select("raster_id").distinct().select("raster_id", F.explode(asked).alias("value"))
    counts = mask.where(F.col("value").isin(classes)).groupBy("raster_id", "value").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, ["raster_id", "value"], "left").select("raster_id", F.col("value").alias("class"), F.coalesce("n", F.lit(0)).alias("pixel_count"))


def area(mask: DataFrame, pixel_m: float, classes: list[int] | None = None) -> DataFrame:
    """Square metres of the given classes, else of all cells above 0."""
    chosen = F.col("value").isin(classes) if classes else F.col("value") > 0
    return mask.groupBy("raster_id").agg(F.count_if(chosen).alias("pixel_count"), (F.count_if(chosen) * pixel_m * pixel_m).alias("area_m2"))


def stats(cells: DataFrame, nodata: float | None) -> DataFrame:
    """Minimum, maximum, mean and population deviation of valid cells; a raster without any has nulls and 0."""
    v = F.when(valid(F.col("value"), nodata), F.col("value"))
    return cells.groupBy("raster_id", "band").agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("valid_pixels"))


def threshold(cells: DataFrame, limit: float, op: str = ">=", true: int = 255, false: int = 0, nodata: float | None = None) -> DataFrame:
    """``true`` where the comparison holds on a valid cell."""
    v = F.col("value")
    holds = {">=": v >= limit, ">": v > limit, "<=": v <= limit, "<": v < limit, "==": v == limit}[op]
    return cells.withColumn("value", F.when(valid(v, nodata) & holds, true).otherwise(false))


def diff(a: DataFrame, b: DataFrame, nodata: float, empty: float = -9999.0) -> DataFrame:
    """a - b cell by cell, ``empty`` where either has no data."""
    both = a.select("raster_id", "r", "c", F.col("value").alias("a")).join(b.select("raster_id", "r", "c", F.col("value").alias("b")), ["raster_id", "r", "c"])
    ok = valid(F.col("a"), nodata) & valid(F.col("b"), nodata)
    return both.select("raster_id", "r", "c", F.when(ok, F.col("a") - F.col("b")).otherwise(empty).alias("value"))


def clip(cells: DataFrame, x1: int, x2: int, y1: int, y2: int) -> DataFrame:
    """Rows x1 to x2 and columns y1 to y2 (half-open, in any order), counted from the window's corner."""
    (x1, x2), (y1, y2) = sorted((x1, x2)), sorted((y1, y2))
    inside = cells.where((F.col("r") >= x1) & (F.col("r") < x2) & (F.col("c") >= y1) & (F.col("c") < y2))
    return inside.withColumn("r", F.col("r") - max(x1, 0)).withColumn("c", F.col("c") - max(y1, 0))


def concat(rasters: list[tuple[DataFrame, int]]) -> DataFrame:
    """Bands of several rasters (each with its number of bands) stacked; later ones count on."""
    out, base = None, 0
    for cells, bands in rasters:
        part = cells.withColumn("band", F.col("band") + base)
        out, base = part if out is None else out.unionByName(part), base + bands
    return out


def compose(masks: list[tuple[DataFrame, int]]) -> DataFrame:
    """One mask of several: where a mask is above 0, its class; later masks overwrite; 0 where none is."""
    rows = None
    for i, (mask, klass) in enumerate(masks):
        part = mask.select("raster_id", "r", "c", F.when(F.col("value") > 0, F.struct(F.lit(i).alias("i"), F.lit(klass).alias("class"))).alias("top"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("raster_id", "r", "c").agg(F.coalesce(F.max("top")["class"], F.lit(0)).alias("value"))


def grid_windows(rasters: DataFrame, n: int) -> DataFrame:
    """n x n windows of rasters (raster_id, height, width), row by row; the last take the remainder."""
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = rasters.where((F.col("height") >= n) & (F.col("width") >= n)).select("*", i.alias("row_idx")).select("*", i.alias("col_idx"))
    h, w = F.floor(F.col("height") / n).cast("int"), F.floor(F.col("width") / n).cast("int")
    end = lambda k, step, full: F.when(F.col(k) == n - 1, F.col(full)).otherwise((F.col(k) + 1) * step)
    return grid.select("raster_id", "row_idx", "col_idx", (F.col("row_idx") * h).alias("x1"), end("row_idx", h, "height").alias("x2"), (F.col("col_idx") * w).alias("y1"), end("col_idx", w, "width").alias("y2"))


def sample_points(cells: DataFrame, points: DataFrame, height: int, width: int) -> DataFrame:
    """Band 1's value at (raster_id, r, c) of each point, and whether the point is inside."""
    inside = (F.col("r") >= 0) & (F.col("r") < height) & (F.col("c") >= 0) & (F.col("c") < width)
    at = points.withColumn("r", F.col("r").cast("int")).withColumn("c", F.col("c").cast("int"))
    return at.join(cells.where("band = 1").select("raster_id", "r", "c", "value"), ["raster_id", "r", "c"], "left").withColumn("is_inside", inside)


def gradient(cells: DataFrame) -> DataFrame:
    """gy and gx: central differences inside, one-sided at the edges, of a dense raster."""
    def along(partition: str, order: str) -> Column:
        w = Window.partitionBy("raster_id", partition).orderBy(order)
        after, before = F.lead("value").over(w), F.lag("value").over(w)
        return F.when(before.isNull(), after - F.col("value")).when(after.isNull(), F.col("value") - before).otherwise((after - before) / 2)

    return cells.withColumn("gy", along("c", "r")).withColumn("gx", along("r", "c"))


def slope(dem: DataFrame, cell_m: float = 1.0, units: str = "degrees") -> DataFrame:
    rise = F.sqrt(F.pow(F.col("gx") / cell_m, 2) + F.pow(F.col("gy") / cell_m, 2))
    return gradient(dem).select("raster_id", "r", "c", (F.degrees(F.atan(rise)) if units == "degrees" else rise * 100).alias("value"))


def hillshade(dem: DataFrame, azimuth: float = 315.0, altitude: float = 45.0, z: float = 1.0, cell_m: float = 1.0) -> DataFrame:
    """0 to 255, truncated. The gradient is the plain one, not a 3 x 3 kernel."""
    gx, gy = F.col("gx") * z / cell_m, F.col("gy") * z / cell_m
    steep, aspect = F.atan(F.sqrt(gx * gx + gy * gy)), F.atan2(-gx, gy)
    az, alt = math.radians(360.0 - azimuth + 90.0), math.radians(altitude)
    shade = math.sin(alt) * F.cos(steep) + math.cos(alt) * F.sin(steep) * F.cos(F.lit(az) - aspect)
    return gradient(dem).select("raster_id", "r", "c", F.greatest(F.lit(0.0), F.least(F.lit(255.0), shade * 255)).cast("int").alias("value"))


def focal(cells: DataFrame, stat: str, size: int, nodata: float | None, height: int, width: int) -> DataFrame:
    """Statistics over a square window of a dense raster, edge cells repeated outward.

    The mean leaves nodata out, the others read it as 0; a nodata centre stays nodata; an even size grows by one.
    """
    k = size // 2
    ok = valid(F.col("value"), nodata)
    v = F.when(ok, F.col("value")).otherwise(0.0)
    base = cells.select("raster_id", "r", "c", "value", v.alias("total"), ok.cast("int").alias("n"), (v * v).alias("squares"), v.alias("lo"), v.alias("hi"))
    for axis, other, last in (("r", "c", height - 1), ("c", "r", width - 1)):
        line = Window.partitionBy("raster_id", other).orderBy(axis)
        near, whole = line.rowsBetween(-k, k), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        # Places of the window beyond either end repeat the end's cell; extremes have it already.
        before, behind = (F.greatest(F.lit(0), x) for x in (k - F.col(axis), k - last + F.col(axis)))
        summed = [(F.sum(c).over(near) + F.first(c).over(whole) * before + F.last(c).over(whole) * behind).alias(c) for c in ("total", "n", "squares")]
        base = base.select("raster_id", "r", "c", "value", *summed, F.min("lo").over(near).alias("lo"), F.max("hi").over(near).alias("hi"))
    every = (2 * k + 1) ** 2
    mean = F.col("total") / every
    out = {"sum": F.col("total"), "min": F.col("lo"), "max": F.col("hi"), "mean": F.try_divide(F.col("total"), F.col("n")), "std": F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / every - mean * mean))}[stat]
    return base.select("raster_id", "r", "c", F.when(valid(F.col("value"), nodata), out).otherwise(F.col("value")).alias("value"))


def decimate(cells: DataFrame, factor: int) -> DataFrame:
    """Means of blocks of factor x factor cells; blocks at the far edges may be smaller, blocks without cells have no row. Nulls are left out of the mean."""
    block = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return cells.groupBy("raster_id", block("r"), block("c")).agg(F.avg("value").alias("value"))


def frame_cells(cells: DataFrame, height: int, width: int) -> DataFrame:
    """tr, tc of the target cells, which are the same for every raster."""
    at = cells.sparkSession.range(height * width)
    return at.select(F.floor(F.col("id") / width).cast("int").alias("tr"), (F.col("id") % width).cast("int").alias("tc"))


def asked_of_all(cells: DataFrame, asked: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``cells`` of all rasters joined with what is asked of each of them (about ``rows`` rows): sent to every task if that is little, else shuffled. The cells are never sent."""
    return cells.join(F.broadcast(asked) if rows <= FEW else asked.hint("merge"), keys)


def resample_nearest(cells: DataFrame, height: int, width: int, factor: float) -> DataFrame:
    """Each target cell takes the source cell under its centre."""
    h, w = max(1, int(height * factor)), max(1, int(width * factor))
    at = frame_cells(cells, h, w).withColumn("r", F.floor((F.col("tr") + 0.5) * height / h).cast("int")).withColumn("c", F.floor((F.col("tc") + 0.5) * width / w).cast("int"))
    return asked_of_all(cells.select("raster_id", "r", "c", "value"), at, ["r", "c"], h * w).select("raster_id", F.col("tr").alias("r"), F.col("tc").alias("c"), "value")


def resample_bilinear(cells: DataFrame, height: int, width: int, factor: float) -> DataFrame:
    """Each target cell takes the weighted mean of the four source cells around its centre; edge cells repeat outward."""
    h, w = max(1, int(height * factor)), max(1, int(width * factor))
    centre = lambda c, n, full: F.greatest(F.lit(0.0), F.least(F.lit(full - 1.0), (F.col(c) + 0.5) * full / n - 0.5))
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    at = frame_cells(cells, h, w).withColumn("y", centre("tr", h, height)).withColumn("x", centre("tc", w, width)).select("*", near.alias("n"))
    r, c = F.floor("y") + F.col("n.i"), F.floor("x") + F.col("n.j")
    weight = F.greatest(F.lit(0.0), 1 - F.abs(F.col("y") - r)) * F.greatest(F.lit(0.0), 1 - F.abs(F.col("x") - c))
    asked = at.select("tr", "tc", r.cast("int").alias("r"), c.cast("int").alias("c"), weight.alias("weight")).where("weight > 0")
    took = asked_of_all(cells.select("raster_id", "r", "c", "value"), asked, ["r", "c"], 4 * h * w)
    return took.groupBy("raster_id", F.col("tr").alias("r"), F.col("tc").alias("c")).agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def argmax_of_patches(scores: DataFrame) -> DataFrame:
    """Average the overlapping patches' scores of each pixel and class; the best class, the smaller on ties."""
    mean = scores.groupBy("pixel", "class").agg(F.avg("score").alias("score"))
    return mean.groupBy("pixel").agg(F.max_by("class", F.struct("score", -F.col("class"))).alias("class"), F.max("score").alias("score"))


def flood(pre: DataFrame, post: DataFrame) -> DataFrame:
    """255 where water appeared: post - pre over 128."""
    both = pre.select("raster_id", "r", "c", F.col("value").alias("pre")).join(post.select("raster_id", "r", "c", F.col("value").alias("post")), ["raster_id", "r", "c"])
    return both.select("raster_id", "r", "c", F.when(F.col("post") - F.col("pre") > 128, 255).otherwise(0).alias("value"))


def stretch_uint8(cells: DataFrame) -> DataFrame:
    """Minimum to maximum of each raster and band onto 0 to 255; constant ones become 0."""
    ends = cells.groupBy("raster_id", "band").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = cells.join(ends, ["raster_id", "band"])
    return rows.select("raster_id", "band", "r", "c", F.when(F.col("hi") > F.col("lo"), ((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255)).otherwise(0.0).cast("int").alias("value"))


def neighbours8(mask: DataFrame) -> DataFrame:
    """Of each non-zero cell, how many of the eight around it are non-zero: raster_id, r, c, neighbours. One shuffle, no join."""
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o")
    votes = mask.where("value <> 0").select("raster_id", "r", "c", near).select("raster_id", (F.col("r") + F.col("o.i")).alias("r"), (F.col("c") + F.col("o.j")).alias("c"), ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("own"))
    return votes.groupBy("raster_id", "r", "c").agg(F.bool_or("own").alias("own"), (F.count(F.lit(1)) - 1).alias("neighbours")).where("own").drop("own")


#: Colours of labels 0 to 3, and the weights by which colours are compared.
LABEL_COLOURS = ((0, 0, 0), (255, 255, 255), (248, 179, 101), (255, 0, 0))
COLOUR_WEIGHTS = (3, 4, 5)


def colour_label(red: Column, green: Column, blue: Column) -> Column:
    """Label of a colour; unknown colours, and missing channels, are 0. Colours of one weighted sum are one colour."""
    weigh = lambda c: sum(x * w for x, w in zip(c, COLOUR_WEIGHTS))
    own = weigh((red.cast("int"), green.cast("int"), blue.cast("int")))
    out = F.lit(0)
    for n, colour in enumerate(LABEL_COLOURS):
        out = F.when(own == weigh(colour), n).otherwise(out)
    return out


def region_ids(regions: DataFrame) -> DataFrame:
    """Regions of ``raster_components`` numbered from 1 within each raster, in reading order of their first cells."""
    first = regions.groupBy("raster_id", "region").agg(F.count(F.lit(1)).alias("pixels"))
    numbered = first.withColumn("id", F.row_number().over(Window.partitionBy("raster_id").orderBy("region")))
    return regions.join(numbered, ["raster_id", "region"]).select("raster_id", "r", "c", "value", "id", "pixels")


def mask_union(masks: list[DataFrame]) -> DataFrame:
    """255 where any of the masks is non-zero, else 0, for each cell that any of them has."""
    every = masks[0].select("raster_id", "r", "c", "value")
    for m in masks[1:]:
        every = every.unionByName(m.select("raster_id", "r", "c", "value"))
    return every.groupBy("raster_id", "r", "c").agg(F.when(F.bool_or(F.col("value") != 0), 255).otherwise(0).alias("value"))
