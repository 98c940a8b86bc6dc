"""Warps against plain arithmetic; densities against an exact sum."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cindermap.operators import warp


def raster(spark, grid):
    rows = [(1, r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(grid)]
    return spark.createDataFrame(rows, "raster_id long, r int, c int, value double").repartition(3)


def weight(method, t):
    t = abs(t)
    if method == "bilinear":
        return max(0.0, 1 - t)
    return 1.5 * t**3 - 2.5 * t**2 + 1 if t <= 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0


def plain(grid, y, x, method):
    total = weights = 0.0
    for i in range(-1, 3):
        for j in range(-1, 3):
            r, c = int(np.floor(y)) + i, int(np.floor(x)) + j
            w = weight(method, y - r) * weight(method, x - c)
            v = grid[min(max(r, 0), grid.shape[0] - 1), min(max(c, 0), grid.shape[1] - 1)]
            if not np.isnan(v):
                total, weights = total + w * v, weights + w
    return total / weights


@pytest.mark.parametrize("method", ["bilinear", "cubic"])
def test_resample(spark, method):
    grid = np.random.default_rng(1).uniform(0, 9, (5, 7))
    grid[1, 1] = np.nan
    got = {(r["r"], r["c"]): r["value"] for r in warp.resample(raster(spark, grid), 5, 7, 2.0, 1.25, method).collect()}
    h, w = int(5 * 1.6), int(7 * 1.6)
    assert len(got) == h * w
    for (r, c), v in got.items():
        assert v == pytest.approx(plain(grid, (r + 0.5) * 5 / h - 0.5, (c + 0.5) * 7 / w - 0.5, method))
    with pytest.raises(ValueError):
        warp.resample(raster(spark, grid), 5, 7, 2.0, 0.0)
    assert warp.resample(raster(spark, grid), 5, 7, 1.0, 100.0, "nearest").count() == 1


def test_reproject_a_plane(spark):
    """A plane over UTM coordinates keeps its values at the places of the new grid."""
    frame = (30.0, 0.0, 500_000.0, 0.0, -30.0, 5_000_000.0)
    r, c = np.mgrid[0:20, 0:24]
    grid = 0.01 * (500_000 + 30 * (c + 0.5) - 500_000) + 0.02 * (5_000_000 - (5_000_000 - 30 * (r + 0.5)))
    cells = raster(spark, grid)
    out, h, w = warp.suggested_grid(spark, 20, 24, frame, "EPSG:32633", "EPSG:4326")
    assert abs(np.hypot(h, w) - np.hypot(20, 24)) < 2 and out[0] == -out[4]
    made = warp.reproject(cells, 20, 24, frame, "EPSG:32633", "EPSG:4326", "bilinear", (out, h, w))
    x, y = warp.projected(out[0] * (F.col("c") + 0.5) + out[2], out[4] * (F.col("r") + 0.5) + out[5], "EPSG:4326", "EPSG:32633")
    told = made.select("value", x.alias("x"), y.alias("y")).collect()
    assert len(told) > 0.8 * h * w
    within = [t for t in told if 500_030 < t["x"] < 500_690 and 4_999_430 < t["y"] < 4_999_970]
    assert within and all(t["value"] == pytest.approx(0.01 * (t["x"] - 500_000) + 0.02 * (5_000_000 - t["y"]), abs=1e-6) for t in within)
    with pytest.raises(ValueError):
        warp.suggested_grid(spark, 20, 24, frame, "EPSG:32633", "EPSG:1")


def test_heatmap(spark):
    rng = np.random.default_rng(2)
    xy = rng.normal(size=(500, 2)) @ np.array([[3.0, 1.0], [0.0, 0.5]])
    points = spark.createDataFrame([(float(x), float(y)) for x, y in xy] + [(None, 1.0)], "px double, py double")
    density, frame = warp.heatmap(points)
    cov = np.cov(xy.T) * 500 ** (-1 / 3)
    gx, gy = np.meshgrid(np.linspace(*np.sort(xy[:, 0])[[0, -1]], 200), np.linspace(*np.sort(xy[:, 1])[[0, -1]], 200), indexing="ij")
    d = np.stack([gx.ravel(), gy.ravel()], 1)[:, None] - xy[None]
    exact = np.exp(-0.5 * np.einsum("gpk,kl,gpl->gp", d, np.linalg.inv(cov), d)).sum(1) / (2 * np.pi * np.sqrt(np.linalg.det(cov)) * 500)
    got = density.orderBy("i", "j").toPandas()["density"].to_numpy()
    assert frame["point_count"] == 500 and np.abs(got - exact).max() < 1e-4 * exact.max()
    with pytest.raises(ValueError):
        warp.heatmap(points.limit(1))
    with pytest.raises(ValueError):
        warp.heatmap(points.withColumn("py", F.col("px") * 2))


def test_rasters_of_a_frame_are_asked_the_same(spark):
    """No raster's cells are sent to every task, and places of all rasters give what places of each of them give."""
    from cindermap.operators import raster as R
    from cindermap.sources import tables as T

    dem = T.dem(spark, "/root/testdata/sf0.001")
    assert dem.rdd.getNumPartitions() >= 8
    made = warp.resample(dem, T.SIDE, T.SIDE, 0.5, 0.4, "cubic")
    for found in (made, R.resample_nearest(dem, T.SIDE, T.SIDE, 0.4), R.resample_bilinear(dem, T.SIDE, T.SIDE, 0.4)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1 and "rightHint=(strategy=broadcast)" in plan and "supplier" not in plan[plan.index("Join") :].split("Range")[-1]
    grid = np.random.default_rng(4).uniform(0, 9, (6, 6))
    two = raster(spark, grid).unionByName(raster(spark, grid * 2).withColumn("raster_id", F.lit(2).cast("long")))
    places = spark.createDataFrame([(r, c, r * 1.3 - 0.4, c * 1.1 - 0.2) for r in range(5) for c in range(5)], "r int, c int, y double, x double")
    each = places.crossJoin(spark.createDataFrame([(1,), (2,)], "raster_id long"))
    for method in ("nearest", "bilinear", "cubic"):
        for rows in (25, None):
            one, other = ({(r["raster_id"], r["r"], r["c"]): r["value"] for r in warp.sampled(two, p, 6, 6, method, "none", rows).collect()} for p in (places, each))
            assert one.keys() == other.keys() and all(one[k] == pytest.approx(other[k]) for k in one)
