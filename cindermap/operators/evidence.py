"""Evidence of masks and its timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rollup(mask: DataFrame, pixel_m: float, side: int) -> DataFrame:
    """Of each mask: non-zero pixels and area, bounds, centroid, quadrant, number of classes."""
    on = mask.where("value > 0")
    got = on.groupBy("raster_id").agg(F.count(F.lit(1)).alias("nonzero"), (F.count(F.lit(1)) * pixel_m * pixel_m).alias("area_m2"), F.min("r").alias("min_r"), F.max("r").alias("max_r"), F.min("c").alias("min_c"), F.max("c").alias("max_c"), F.avg("r").alias("row"), F.avg("c").alias("col"), F.count_distinct("value").alias("classes"))
    return got.withColumn("quadrant", F.concat(F.when(F.col("row") < side / 2, "north").otherwise("south"), F.when(F.col("col") < side / 2, "west").otherwise("east")))


def trend(series: DataFrame, by: str, t: str, value: str) -> DataFrame:
    """Peak (first largest) and trend of each series: single, expanding, shrinking, expand_then_recede or mixed. One row a (by, t)."""
    w = Window.partitionBy(by).orderBy(t)
    rows = series.withColumn("step", F.col(value) - F.lag(value).over(w)).withColumn("pos", F.row_number().over(w))
    got = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(F.col("step") >= 0, F.lit(True))).alias("up"), F.bool_and(F.coalesce(F.col("step") <= 0, F.lit(True))).alias("down"), F.max_by(t, F.struct(value, -F.col("pos"))).alias("peak_t"), F.max_by("pos", F.struct(value, -F.col("pos"))).alias("peak_pos"), F.max(value).alias("peak"))
    label = F.when(F.col("n") == 1, "single").when(F.col("up"), "expanding").when(F.col("down"), "shrinking").when((F.col("peak_pos") > 1) & (F.col("peak_pos") < F.col("n")), "expand_then_recede").otherwise("mixed")
    return got.select(by, "n", "peak_t", "peak", label.alias("trend"))


def shares(rows: DataFrame, by: str, key: str, value: str) -> DataFrame:
    """Pie shares and bar heights: value over the sum, and over the largest (over 1 if that is not positive)."""
    totals = rows.groupBy(by).agg(F.sum(value).alias("total"), F.max(value).alias("top"))
    over = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(1.0)
    return rows.join(totals, by).select(by, key, (F.col(value) / over("total")).alias("share"), (F.col(value) / over("top")).alias("height"))


def prominent(rows: DataFrame, by: str, key: str, value: str, hints: list[str], most: int = 20) -> DataFrame:
    """The first ``most`` statistics of each ``by``: keys that contain an earlier hint first, then by name."""
    order = F.lit(len(hints))
    for i, hint in reversed(list(enumerate(hints))):
        order = F.when(F.lower(F.col(key)).contains(hint), i).otherwise(order)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order, key))
    return rows.withColumn("place", rank).where(F.col("place") <= most).select(by, "place", key, value)


def class_statistics(mask: DataFrame, pixel_m: float, labels: dict[int, str], targets: list[int] | None = None) -> DataFrame:
    """Pixels, area and label of each class of each mask; of ``targets`` if given (0 too, if it is one), else of the non-zero ones."""
    kept = mask.where(F.col("value").isin(targets) if targets is not None else F.col("value") != 0)
    counted = kept.groupBy("raster_id", F.col("value").alias("class")).agg(F.count(F.lit(1)).alias("pixel_count"))
    label = F.col("class").cast("string")
    for value, name in labels.items():
        label = F.when(F.col("class") == value, name).otherwise(label)
    return counted.select("raster_id", "class", label.alias("label"), "pixel_count", (F.col("pixel_count") * pixel_m * pixel_m).alias("area_m2"))


def by_tool(items: DataFrame) -> DataFrame:
    """Evidence items (tool, place, nonzero, area_m2, quadrant) rolled up by tool; ``regions`` lists the quadrants in the order of ``place``."""
    regions = F.transform(F.array_sort(F.collect_list(F.when(F.col("quadrant").isNotNull(), F.struct("place", "quadrant")))), lambda q: q["quadrant"])
    return items.groupBy("tool").agg(F.count(F.lit(1)).alias("mask_count"), F.sum("nonzero").alias("nonzero"), F.sum("area_m2").alias("area_m2"), regions.alias("regions"))


def line_heights(series: DataFrame, by: str, t: str, value: str) -> DataFrame:
    """Points of line charts: the ordinal of ``t`` within each ``by``, and value over the largest (over 1 if that is not positive)."""
    placed = series.withColumn("ordinal", F.row_number().over(Window.partitionBy(by).orderBy(t)) - 1)
    return shares(placed, by, "ordinal", value).select(by, "ordinal", "height")


def classes_present(mask: DataFrame) -> DataFrame:
    """The sorted non-zero classes of each mask; an empty list for masks of zeros."""
    return mask.groupBy("raster_id").agg(F.array_sort(F.collect_set(F.when(F.col("value") != 0, F.col("value")))).alias("classes"))
