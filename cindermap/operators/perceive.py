"""The Spark side of segmentation: windows over images, a pluggable scorer in batches, and masks of class sets.

Networks and weights are not part of this library; a scorer is any function from a pandas frame of tiles to one of
(raster_id, r, c, class, score).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sliding_windows(rasters: DataFrame, kernel: int, stride: int) -> DataFrame:
    """Windows of rasters (raster_id, height, width); the last row and column are moved back to the border."""
    steps = lambda full: F.greatest(F.lit(0), F.ceil((F.col(full) - kernel) / stride)).cast("int")
    at = rasters.select("*", F.explode(F.sequence(F.lit(0), steps("height"))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), steps("width"))).alias("j"))
    start = lambda k, full: F.greatest(F.lit(0), F.least(F.col(k) * stride, F.col(full) - kernel))
    return at.select("raster_id", "i", "j", start("i", "height").alias("r0"), start("j", "width").alias("c0"))


def predict(tiles: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Scores of tiles (raster_id, r0, c0, side, data), batch by batch; overlapping scores are averaged and the best class taken."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for tile in batches:
            yield scorer(tile)

    scores = tiles.mapInPandas(run, "raster_id long, r int, c int, class int, score double")
    mean = scores.groupBy("raster_id", "r", "c", "class").agg(F.avg("score").alias("score"))
    return mean.groupBy("raster_id", "r", "c").agg(F.max_by("class", F.struct("score", -F.col("class"))).alias("value"))


def class_mask(labels: DataFrame, classes: list[int]) -> DataFrame:
    """255 where the label is one of ``classes``, else 0."""
    return labels.withColumn("value", F.when(F.col("value").isin(classes), 255).otherwise(0))


def band_scaled(value: Column, mean: Column, std: Column) -> Column:
    return F.when(std != 0, (value - mean) / std).otherwise(0.0)


def thinning_pass(grid: np.ndarray) -> np.ndarray:
    """One pass of Zhang-Suen thinning, both halves; what lies beyond the grid is empty."""
    m = np.pad(grid, 1)
    for odd in (0, 1):
        p = [np.roll(m, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]  # north, then clockwise
        n = sum(x.astype(np.int8) for x in p)
        turns = sum((~p[i] & p[(i + 1) % 8]).astype(np.int8) for i in range(8))
        a, b = (p[0] & p[2] & p[4], p[2] & p[4] & p[6]) if odd == 0 else (p[0] & p[2] & p[6], p[0] & p[4] & p[6])
        m = m & ~((n >= 2) & (n <= 6) & (turns == 1) & ~a & ~b)
    return m[1:-1, 1:-1]


def thinned(mask: np.ndarray) -> np.ndarray:
    """One-pixel lines of a boolean mask."""
    m = mask.astype(bool)
    while True:
        after = thinning_pass(m)
        if (after == m).all():
            return m
        m = after


def centerlines(mask: DataFrame, height: int, width: int) -> DataFrame:
    """Centre pixels of each raster's non-zero cells, with the cell's class; one raster tile a group."""

    def thin(rows: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((height, width), int)
        grid[rows["r"], rows["c"]] = rows["value"]
        r, c = np.nonzero(thinned(grid > 0))
        return pd.DataFrame({"raster_id": rows["raster_id"].iloc[0], "r": r, "c": c, "value": grid[r, c]})

    return mask.where("value > 0").groupBy("raster_id").applyInPandas(thin, "raster_id long, r int, c int, value int")
