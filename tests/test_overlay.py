"""Overlays, distances, buffers and Voronoi cells against counting, sampling and identities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cindermap.operators import overlay, proximity, vector
from cindermap.plans import queries
from cindermap.sources import files

LAYER = f"id long, g string, rings {overlay.RINGS}"


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def layer(spark, rows):
    return spark.createDataFrame([(i, g, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for i, g, rings in rows], LAYER)


def area(rings):
    return sum(0.5 * float(np.sum(r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1])) for r in rings)


def star(rng, n):
    """A polygon without crossings."""
    angle, radius, centre = (np.arange(n) + rng.uniform(0, 0.4, n)) * 2 * np.pi / n, rng.uniform(1, 4, n), rng.uniform(0, 4, 2)
    return centre + radius[:, None] * np.stack([np.cos(angle), np.sin(angle)], 1)


def inside(rings, p):
    odd = np.zeros(len(p), int)
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, np.roll(ring, -1, 0), strict=True):
            if y0 != y1:
                odd += ((y0 > p[:, 1]) != (y1 > p[:, 1])) & (p[:, 0] < x0 + (x1 - x0) * (p[:, 1] - y0) / (y1 - y0))
    return odd % 2 == 1


def test_sweep_on_random_polygons():
    rng = np.random.default_rng(0)
    points = rng.uniform(-4, 8, (4000, 2))
    for _ in range(60):
        a, b = star(rng, rng.integers(3, 9)), star(rng, rng.integers(3, 9))
        edges = overlay.Edges([(0, [a]), (1, [b])])
        both, either = overlay.swept_area(edges, overlay.BOTH), overlay.swept_area(edges, overlay.EITHER)
        assert abs(abs(area([a])) + abs(area([b])) - both - either) < 1e-7
        for op, whole in ((overlay.BOTH, both), (overlay.EITHER, either)):
            rings = overlay.linked(overlay.outline(edges, op))
            assert abs(area(rings) - whole) < 1e-7
            want = op([inside([a], points), inside([b], points)])
            assert (inside(rings, points) != want).sum() <= 2  # points on a border


def test_shared_borders_holes_and_empties(spark):
    a = layer(spark, [(1, "x", [square(0, 0, 4, 4), square(1, 1, 3, 3)]), (2, "x", [square(4, 0, 6, 4)]), (3, "y", []), (4, None, [square(9, 9, 10, 10)]), (5, None, [square(9, 9, 10, 10)]), (6, "y", [[(0, 0), (1, 1)]])])
    b = layer(spark, [(7, "z", [square(2, 2, 5, 5)]), (8, "z", [square(1, 1, 3, 3)])])
    got = {(r["a_id"], r["b_id"]): round(r["area"], 9) for r in overlay.pieces(a, b).collect()}
    assert got == {(1, 7): 3.0, (2, 7): 2.0}  # the hole's filling touches the ring only
    made = {r["g"]: r for r in overlay.union(a, "g").collect()}
    assert set(made) == {"x", None} and made["x"]["area"] == 20.0 and made[None]["area"] == 1.0
    assert sorted(len(r) for r in made["x"]["rings"]) == [4, 4]
    assert overlay.union(a.limit(0), "g").collect() == [] == overlay.clip(a, b.limit(0)).collect()
    merged = {r["root"]: (r["members"], r["largest_id"], round(r["area"], 9)) for r in overlay.merged(a.where("id <> 3")).collect()}
    assert merged[4] == (2, 4, 1.0) and merged[1][0] == 1 and merged[2][0] == 1
    totals = overlay.totals(overlay.intersect(a.where("size(rings) > 0 AND id < 6"), b), 0.5).first()
    assert (totals["intersection_count"], totals["intersecting_a_count"], totals["intersecting_b_count"], totals["area_px2"], totals["area_m2"]) == (2, 2, 1, 5.0, 1.25)


def test_unions_do_not_depend_on_the_cells(spark):
    rng = np.random.default_rng(3)
    shapes = layer(spark, [(i, "ab"[i % 2], [(star(rng, 7) * 3 + rng.uniform(0, 20, 2)).tolist()]) for i in range(24)])
    made = {size: {r["g"]: r for r in overlay.union(shapes, "g", size).collect()} for size in (3, 64)}
    rings = {g: [np.array([(p["x"], p["y"]) for p in x]) for r in shapes.where(F.col("g") == g).collect() for x in r["rings"]] for g in "ab"}
    points = rng.uniform(-10, 40, (3000, 2))
    for g in "ab":
        small, large = made[3][g], made[64][g]
        assert abs(small["area"] - large["area"]) < 1e-6
        for r in (small, large):
            outline = [np.array([(p["x"], p["y"]) for p in x]) for x in r["rings"]]
            assert abs(area(outline) - r["area"]) < 1e-6
            assert (inside(outline, points) != np.any([inside([x], points) for x in rings[g]], axis=0)).sum() <= 2


def test_distances_against_sampling():
    rng = np.random.default_rng(5)
    for k in range(60):
        a, b = star(rng, 5), star(rng, 4) + rng.uniform(-9, 9, 2)
        kinds = [(True, True), (True, False), (False, False)][k % 3]
        d, ax, ay, bx, by = proximity.apart([a], kinds[0], [b], kinds[1])
        assert abs(np.hypot(ax - bx, ay - by) - d) < 1e-9
        t = np.linspace(0, 1, 120)[:, None]
        dots = [np.concatenate([s[:2] + t * (s[2:] - s[:2]) for s in proximity.segments([x], f)]) for x, f in zip((a, b), kinds, strict=True)]
        near = np.sqrt(((dots[0][:, None] - dots[1][None]) ** 2).sum(2).min())
        within = kinds[0] and inside([a], b[:1])[0] or kinds[1] and inside([b], a[:1])[0]
        assert d <= near + 1e-9 and (d >= near - 0.2 or within and d == 0)


def test_nearest_rounds(spark):
    far = [(1, [(0, 0)]), (2, [(5000, 5000)]), (3, [])]
    near = [(10, [(3, 4)]), (11, [(0, 5)]), (12, [(5000, 4000), (5000, 6000)]), (13, [(-900, 0), (-900, 1)])]
    frame = lambda rows: spark.createDataFrame([(i, [[{"x": float(x), "y": float(y)} for x, y in p]] if p else [], False) for i, p in rows], "id long, parts array<array<struct<x:double,y:double>>>, filled boolean")
    got = [(r["a_id"], r["rank"], r["b_id"], round(r["distance"], 6)) for r in proximity.nearest_geometries(frame(far), frame(near), 3, size=1).orderBy("a_id", "rank").collect()]
    assert [g[:3] for g in got] == [(1, 1, 10), (1, 2, 11), (1, 3, 13), (2, 1, 12), (2, 2, 10), (2, 3, 11)]
    assert got[0][3] == got[1][3] == 5.0 and got[3][3] == 0.0
    assert proximity.nearest_geometries(frame(far).limit(0), frame(near)).collect() == []
    assert proximity.nearest_geometries(frame(far), frame(near).limit(0)).collect() == []


def test_buffers_nest():
    rng = np.random.default_rng(7)
    points = rng.uniform(-6, 10, (1500, 2))
    for k in range(12):
        shape, filled = star(rng, 6), k % 3 > 0
        before = None
        for d in (0.3, 1.1):
            whole, rings = proximity.buffered([shape], filled, d)
            assert abs(area(rings) - whole) < 1e-6
            near = np.array([proximity.apart([p[None]], False, [shape], filled)[0] for p in points])
            now = inside(rings, points)
            assert (now & (near > d + 1e-9)).sum() == 0 and (~now & (near < d * np.cos(np.pi / 64) - 1e-9)).sum() == 0
            assert before is None or (before <= now).all()
            before = now
    assert proximity.buffered([np.array([[0, 0], [4, 0], [4, 4], [0, 4.0]])], True, -2.5) == (0.0, [])


@pytest.mark.parametrize("n", [2, 60])
def test_voronoi(spark, n):
    rng = np.random.default_rng(n)
    at = rng.uniform(0, 30, (n, 2))
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(900, float(at[0, 0]), float(at[0, 1])), (901, None, 1.0)]
    cells = {r["id"]: r for r in proximity.voronoi(spark.createDataFrame(rows, "id long, px double, py double"), (-10.0, -10.0, 50.0, 50.0), size=2).collect()}
    assert set(cells) == set(range(n)) and abs(sum(r["area"] for r in cells.values()) - 3600) < 1e-6
    dots = rng.uniform(-10, 50, (2000, 2))
    owner = ((dots[:, None] - at[None]) ** 2).sum(2).argmin(1)
    held = np.stack([inside([np.array([(p["x"], p["y"]) for p in cells[i]["ring"]])], dots) for i in range(n)], 1)
    assert (held.sum(1) == 1).mean() > 0.999 and (held.argmax(1) == owner).mean() > 0.999
    with pytest.raises(ValueError):
        proximity.voronoi(spark.createDataFrame(rows[:1] * 2, "id long, px double, py double"))


def test_points_on_borders_and_infinite_cells(spark):
    ring = spark.createDataFrame([(1, [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 0.0, "y": 4.0}])], "id long, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 0.0), (3, 2.0, 2.0), (4, 1.0, 1.0), (5, 0.0, 0.0)], "id long, px double, py double")
    assert [r["p_id"] for r in vector.point_in_ring(points, ring).collect()] == [4]
    cells = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, float("inf")), (1, 1, 0, float("nan")), (1, 1, 1, 3.0), (1, 0, 2, None)], "raster_id long, r int, c int, value double")
    one, union = vector.raster_stats(ring.withColumn("raster_id", F.lit(1).cast("long")), cells, None)
    assert one.first()["pixel_count"] == 2 and one.first()["mean"] == union.first()["mean"] == 2.0


def test_shapes_are_told_apart_without_sorting_their_rings(spark, small):
    shapes = queries.shapes(spark, small)
    assert "SortAggregate" not in shapes._jdf.queryExecution().executedPlan().toString()
    assert shapes.count() == shapes.select("raster_id", "id").distinct().count() > 0
    assert {r["n"] for r in shapes.select(F.size("ring").alias("n")).distinct().collect()} == {1, 3, 4}


def test_files_of_polygons_and_graphs(spark, tmp_path):
    rows = layer(spark, [(1, "x", [square(0, 0, 4, 4), square(1, 1, 3, 3)]), (2, "y", [square(5, 5, 6, 6)]), (3, "z", [])])
    files.write_polygons(rows, str(tmp_path / "p"), ["id", "g"])
    back = files.polygons(files.read_geojson_lines(spark, str(tmp_path / "p")))
    assert sorted((r["props"]["g"], r["area"]) for r in back.withColumn("area", overlay.area_of(F.col("rings"))).collect()) == [("x", 12.0), ("y", 1.0)]
    assert files.layer_or_empty(spark, str(tmp_path / "none")).count() == 0
    edges = spark.createDataFrame([("a", "b<&\"", 1.5, True, [1, 2]), ("b", "c", 2.0, False, None)], "u string, v string, length double, damaged boolean, pixels array<int>")
    files.write_graphml(edges, str(tmp_path / "g"))
    assert sorted(map(tuple, files.read_graphml(spark, str(tmp_path / "g")).collect())) == [("a", 'b<&"', 1.5, True), ("b", "c", 2.0, False)]


def test_swept_together_and_one_by_one(monkeypatch):
    """Overlays swept together, each by itself, and in halves have the same areas and outlines."""
    rng = np.random.default_rng(11)
    overlays = [[(0, [star(rng, n)]), (1, [star(rng, 5)]), (1, [star(rng, 4)])] for n in (3, 6, 6, 9, 20)] + [[], [(0, [])]]
    ops = [overlay.EITHER, overlay.BOTH]
    areas, outlines = overlay.swept(overlays, ops, outlined=True)
    one, lines = overlay._one_by_one(overlays[:5], ops, 2, True)
    assert np.allclose(areas[:, :5], one) and (areas[:, 5:] == 0).all() and outlines[5:] == [[], []]
    area = lambda pieces: sum(proximity._signed(r) / 2 for r in overlay.linked(pieces))
    assert [area(p) for p in outlines[:5]] == pytest.approx(one[0].tolist()) == [area(p) for p in lines]
    monkeypatch.setattr(overlay, "AT_ONCE", 40)
    assert np.allclose(overlay.swept(overlays, ops)[0], areas)


def test_one_file_is_many_tasks(spark):
    """Shapes of one small file are buffered, measured and swept in many tasks."""
    layer = spark.range(40).coalesce(1).selectExpr("id", "array(array(named_struct('x', double(3 * id), 'y', 0D), named_struct('x', 3 * id + 2D, 'y', 0D), named_struct('x', 3 * id + 2D, 'y', 2D))) AS rings")
    made = proximity.buffers(layer.selectExpr("id", "rings AS parts", "true AS filled"), [0.5], with_rings=False)
    assert made.columns == ["id", "distance", "area"] and made.rdd.getNumPartitions() >= 4 and made.count() == 40
    pairs = overlay.measured(layer.selectExpr("id", "rings AS a_rings", "rings AS b_rings"))
    assert pairs.rdd.getNumPartitions() >= 4 and {r["iou"] for r in pairs.collect()} == {1.0}
    clipped = overlay.clip(layer, layer.where("id % 2 = 0"), 4, with_rings=False)
    assert {r["id"]: r["area"] for r in clipped.collect()} == {i: pytest.approx(2.0) for i in range(0, 40, 2)}


def test_rings_are_put_together_in_blocks(spark, monkeypatch):
    """What hangs together over blocks' borders is one ring, the rest stays in its block: no row or task holds a whole outline."""
    rng = np.random.default_rng(13)
    shapes = [(i, "ab"[i % 2], [(star(rng, 6) + rng.uniform(-20, 40, 2)).tolist()]) for i in range(40)]
    shapes += [(100, None, [square(-8, -8, 24, 24), square(0, 0, 16, 16)]), (101, None, [square(-8, 24, -4, 30)]), (102, None, [square(24, 24, 30, 30)]), (103, None, [square(2, 2, 3, 3)])]
    shapes += [(200 + i, "c", [square(8 * i, 0, 8 * i + 8, 8)]) for i in range(20)] + [(300 + i, "d", [square(20 * i, 0, 20 * i + 2, 3)]) for i in range(30)]
    shapes = layer(spark, shapes)
    monkeypatch.setattr(overlay, "BLOCK", 2)
    got = {r["g"]: r for r in overlay.union(shapes, "g", 4).collect()}
    monkeypatch.setattr(overlay, "BLOCK", 1 << 10)
    want = {r["g"]: r for r in overlay.union(shapes, "g", 4).collect()}
    size = lambda r: sorted(round(abs(area([np.array([(p["x"], p["y"]) for p in x])])), 6) for x in r["rings"])
    assert set(got) == set(want) == {"a", "b", "c", "d", None}
    assert all(size(got[g]) == size(want[g]) and abs(got[g]["area"] - want[g]["area"]) < 1e-6 for g in got)
    assert size(got["c"]) == [1280.0] and size(got["d"]) == [6.0] * 30 and len(got[None]["rings"]) >= 4
    monkeypatch.setattr(overlay, "BLOCK", 2)
    told = {r["g"]: (r["area"], r["length"]) for r in overlay.union_lengths(shapes, "g", 4).collect()}
    length = {r["g"]: r["n"] for r in overlay.union(shapes, "g", 4).select("g", overlay.length_of(F.col("rings")).alias("n")).collect()}
    assert all(told[g] == (pytest.approx(got[g]["area"]), pytest.approx(length[g])) for g in got) and told["c"][1] == 336.0
    cells, _ = overlay._swept_cells(overlay._united(shapes.where("g = 'd'"), "g"), 4, True, clip=False)
    assert overlay._ring_rows(cells, 4).select(F.size("rings").alias("n")).agg(F.count("n").alias("rows"), F.max("n").alias("most")).first() == (30, 1)
