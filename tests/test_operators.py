"""Closed-form fixtures of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from cindermap.functions import scalar as S
from cindermap.operators import evidence, graph, raster, records, scoring, vector
from cindermap.plans import trajectory

C = F.col


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(*xs):
    return F.array(*[F.lit(x) for x in xs])


def grid(spark, f, h=6, w=6):
    return spark.createDataFrame([(0, 1, r, c, float(f(r, c))) for r in range(h) for c in range(w)], "raster_id long, band int, r int, c int, value double")


def test_scalars(spark):
    assert one(spark, S.safe_div(F.lit(5), F.lit(0))) == 0.0
    assert one(spark, S.safe_div(F.lit(None).cast("double"), F.lit(0))) is None
    assert one(spark, S.truck_trips(F.lit(10.1), F.lit(5.0))) == 3
    assert one(spark, S.truck_trips(F.lit(10.1), F.lit(0.0))) == 0
    assert one(spark, S.weighted_sum(lit(1.0, 2.0), lit(1.0))) is None
    assert one(spark, S.weighted_sum(lit(1.0, 2.0), lit(0.0, 0.0), True)) == 0.0
    assert one(spark, S.label("r{row}c{col}", row=F.lit(3.0), col=F.lit(None).cast("int"))) == "r3c"
    assert one(spark, S.normalize_tool(F.lit("seg_flood(x)"))) == "seg.flood"
    assert one(spark, S.canonical(F.lit(" 5.0"))) == "5"
    row, _ = S.world_to_pixel(F.lit(-0.4), F.lit(-0.4), (1, 0, 0, 0, 1, 0))
    assert one(spark, row) == 0


def test_area_of_pixels(spark):
    mask = spark.range(89_116).select(F.lit(0).alias("raster_id"), C("id").alias("r"), F.lit(0).alias("c"), F.lit(3).alias("value"))
    assert raster.area(mask, 0.3, [3]).first()["area_m2"] == pytest.approx(8020.44)


def test_plane_has_45_degrees(spark):
    assert {round(r["value"], 9) for r in raster.slope(grid(spark, lambda r, c: c)).collect()} == {45.0}


def test_focal_nodata_counts_as_zero_and_stays(spark):
    x = grid(spark, lambda r, c: -1 if (r, c) == (2, 2) else 1)
    got = {(r["r"], r["c"]): r["value"] for r in raster.focal(x, "sum", 3, -1.0, 6, 6).collect()}
    assert got[2, 2] == -1 and got[2, 3] == 8 and got[0, 0] == 9


def test_stats_without_valid_cells(spark):
    got = raster.stats(grid(spark, lambda r, c: 1), 1.0).first()
    assert got["min"] is None and got["valid_pixels"] == 0


def test_grid_windows_take_the_remainder(spark):
    got = raster.grid_windows(spark.createDataFrame([(0, 10, 10)], "raster_id long, height int, width int"), 3).orderBy("row_idx", "col_idx").collect()
    assert len(got) == 9 and (got[-1]["x1"], got[-1]["x2"]) == (6, 10)


def test_clip_is_idempotent_and_threshold_complements(spark):
    x = grid(spark, lambda r, c: r * 6 + c)
    assert raster.clip(raster.clip(x, 1, 5, 1, 5), 0, 4, 0, 4).count() == 16
    over, under = (raster.threshold(x, 17, op).where("value = 255").count() for op in (">=", "<"))
    assert over + under == 36


def test_components_end_when_edges_are_stars(spark, monkeypatch):
    written, staged = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, purpose: written.append(purpose) or staged(df, purpose))
    found = lambda rows: dict(map(tuple, graph.components(spark.createDataFrame(rows, "a long, b long")).collect()))
    assert found([(5, 1), (1, 7), (7, 1), (9, 2), (3, 3), (None, 4)]) == {1: 1, 5: 1, 7: 1, 2: 2, 9: 2}
    assert found([]) == {}
    assert len(written) == 2  # stars need no round
    for rows in ([(3, 1), (3, 2)], [(3, 2), (2, 1)], [(1, 3), (2, 3), (2, 4)]):
        assert found(rows) == dict.fromkeys({x for row in rows for x in row}, 1)
    edges = [(i, i + 1) for i in range(-20, 20)] + [(100 + int(i * 997 * math.pi) % 211, 100 + int(i * 769 * math.pi) % 211) for i in range(150)]
    root = {x: x for row in edges for x in row}
    while any(root[a] != root[b] for a, b in edges):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert found(edges) == {x: r for x, r in root.items() if any(x in row for row in edges if row[0] != row[1])}


def test_diagonal_cells_are_two_components(spark):
    mask = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 1, 1), (0, 1, 2, 2)], "raster_id long, r int, c int, value int")
    assert graph.raster_components(mask, False).select("region").distinct().count() == 2
    assert graph.raster_components(mask, True).select("region").distinct().count() == 3


@pytest.mark.parametrize("same_class", [False, True])
def test_components_do_not_depend_on_tiles(spark, same_class):
    import numpy as np

    x = np.random.default_rng(4).integers(0, 3, (2, 14, 11))
    mask = spark.createDataFrame([(i, r, c, int(v)) for (i, r, c), v in np.ndenumerate(x)], "raster_id long, r int, c int, value int")
    regions = [sorted(map(tuple, graph.raster_components(mask, same_class, t).collect())) for t in (256, 4)]
    assert regions[0] == regions[1]


def test_thinning_gives_lines(spark):
    from cindermap.operators import perceive

    bar = spark.createDataFrame([(0, r, c, 1) for r in range(4, 9) for c in range(2, 18)], "raster_id long, r int, c int, value int")
    got = perceive.centerlines(bar, 20, 20).collect()
    assert 8 <= len(got) <= 20 and {r["r"] for r in got} <= {5, 6, 7}


def test_files(spark, tmp_path):
    import json

    from cindermap.sources import files

    (tmp_path / "layer.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2]}, "properties": {"name": "a"}}]}))
    got = files.points(files.read_geojson(spark, str(tmp_path / "layer.json"))).first()
    assert (got["px"], got["py"], got["props"]["name"]) == (1.5, 2.0, "a")
    (tmp_path / "graph.json").write_text(json.dumps({"nodes": [{"id": 1}], "edges": [{"source": 1, "target": 2, "weight": 3.0}, {"source": 2, "target": 3, "length_m": 4.0, "length": 9.0, "damaged": True}]}))
    assert sorted((r["length"], r["damaged"]) for r in files.read_graph(spark, str(tmp_path / "graph.json")).collect()) == [(3.0, False), (4.0, True)]
    (tmp_path / "tasks.json").write_text(json.dumps([{"sample_id": "s", "tasks": [{"question": "q0"}, {"question": "q1"}]}]))
    tasks = files.read_tasks(spark, str(tmp_path / "tasks.json"))
    assert [r["question_id"] for r in tasks.orderBy("pos").collect()] == ["s_task0", "s_task1"]
    runs = spark.createDataFrame([("s_task0", "x", None, 2.0), ("s_task1", "y", "timeout", 4.0)], "question_id string, predicted_answer string, error string, elapsed_time double")
    files.append_runs(runs, str(tmp_path / "runs"))
    again = files.read_runs(spark, str(tmp_path / "runs"))
    assert tuple(files.run_stats(again).first()) == (2, 1, 1, 3.0)
    assert [r["question_id"] for r in files.unanswered(tasks, again).collect()] == ["s_task1"]
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "f.bin").write_bytes(b"abc")
    import hashlib

    manifest = spark.createDataFrame([("f.bin", 3, hashlib.sha256(b"abc").hexdigest()), ("g.bin", 1, "")], "name string, size long, sha256 string")
    assert {r["name"]: r["status"] for r in files.verify_manifest(spark, str(tmp_path / "data"), manifest).collect()} == {"f.bin": "ok", "g.bin": "missing"}


def test_utm_of_a_known_point(spark):
    from cindermap.functions import crs

    east, north = crs.utm(F.lit(48.8583), F.lit(2.2945), F.lit(31))
    assert one(spark, east) == pytest.approx(448_252, abs=2) and one(spark, north) == pytest.approx(5_411_943, abs=2)


def rect(spark, *rows):
    return spark.createDataFrame(rows, "id long, x0 long, y0 long, x1 long, y1 long")


def test_overlaps_once_each_and_not_at_edges(spark):
    a, b = rect(spark, (1, 0, 0, 40, 40)), rect(spark, (2, 10, 10, 50, 50), (3, 40, 0, 60, 10))
    got = vector.overlaps(a, b).collect()
    assert [(r["b_id"], (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])) for r in got] == [(2, 900)]


def test_point_on_the_boundary_is_outside(spark):
    points = spark.createDataFrame([(1, 0, 5), (2, 5, 5)], "id long, px long, py long")
    assert [r["p_id"] for r in vector.point_in_polygon(points, rect(spark, (9, 0, 0, 10, 10))).collect()] == [2]


def test_nearest_far_away_and_ties(spark):
    a = spark.createDataFrame([(1, 0, 0), (2, 5000, 0)], "id long, px long, py long")
    b = spark.createDataFrame([(7, 0, 3), (5, 3, 0), (8, 40, 0)], "id long, px long, py long")
    got = {(r["a_id"], r["rank"]): r["b_id"] for r in vector.nearest(a, b, 2).collect()}
    assert got == {(1, 1): 5, (1, 2): 7, (2, 1): 8, (2, 2): 5}


def test_hull_and_simplify(spark):
    pts = spark.createDataFrame([(0, x, y) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (2, 2))], "g int, px long, py long")
    assert tuple(vector.convex_hulls(pts, "g").first())[1:] == (5, 16.0)
    line = spark.createDataFrame([(0, i, i, 0) for i in range(9)], "g int, o int, px long, py long")
    assert tuple(vector.simplified(line, "g", "o", 0.5).first())[1:] == (9, 2)


def test_repair_prefers_fewest_repairs(spark):
    e = spark.createDataFrame([(0, 0, 1, 1, True), (0, 0, 2, 50, False), (0, 1, 2, 50, False)], "graph long, u long, v long, length long, damaged boolean")
    got = {r["node"]: (r["repairs"], r["length"]) for r in graph.repair_min_edges(e, 0).collect()}
    assert got[1] == (0, 100)
    assert {r["node"]: r["length"] for r in graph.shortest_path(e, 0).collect()}[1] == 100


def test_allocation(spark):
    d = spark.createDataFrame([("g", 1, 10.0, None), ("g", 2, 30.0, None)], "g string, id int, need double, cap double")
    got = lambda rows, supply, least: [r["allocated"] for r in records.allocate(rows, "g", supply, least).orderBy("id").collect()]
    assert got(d, 20.0, 0.0) == [5.0, 15.0]
    assert got(d, 100.0, 0.0) == [25.0, 75.0]  # shares don't stop at the need
    assert got(d, 7.0, 5.0) == [5.0, 2.0]
    capped = spark.createDataFrame([("g", 1, 10.0, 12.0), ("g", 2, 30.0, 40.0)], "g string, id int, need double, cap double")
    assert got(capped, 100.0, 0.0) == [12.0, 40.0] and got(capped.drop("cap"), 100.0, 0.0) == [25.0, 75.0]


def test_odd_scores(spark):
    nan = F.lit(float("nan"))
    assert [one(spark, scoring.close(g, p)) for g, p in ((nan, F.lit(5.0)), (F.lit(5.0), nan), (nan, nan), (F.lit(float("inf")), F.lit(float("inf"))), (F.lit(5.0), F.lit(None).cast("double")))] == [0.0, 0.0, 1.0, 1.0, 0.0]
    none, some = F.array().cast("array<string>"), F.array(F.lit("a"))
    for metric in (scoring.recall, scoring.prefix, scoring.lcs):
        assert [one(spark, metric(none, p)) for p in (none, some)] == [1.0, 0.0]
    for a, b in (("Phase 3", "p3"), ("phase_t1", "T 1"), ("p_2", "Phase2"), ("Yes!", "true"), ("5.0", "5"), ("A-b.", "a b")):
        assert one(spark, S.canonical(F.lit(a))) == one(spark, S.canonical(F.lit(b)))
    ranks = lambda items: spark.createDataFrame([("t", x, i) for i, x in enumerate(items)], "t string, k string, n int")
    assert [scoring.ranking_score(ranks(g), ranks(p), "t", "k", "n").first()["score"] for g, p in (("a", "a"), ("a", "b"), ("ab", "ac"), ("abc", "acb"))] == [1.0, 0.0, 0.0, pytest.approx(2 / 3)]


def test_reduce_takes_the_first_of_ties(spark):
    rows = spark.createDataFrame([(0, 0, 5.0), (0, 1, 5.0), (0, 2, 3.0), (0, 3, None)], "g int, i int, v double")
    assert records.reduce_by(rows, "g", "v", "i", "max").first()["best_index"] == 0
    assert records.reduce_by(rows, "g", "v", "i", "min").first()["best_index"] == 2


def test_scores(spark):
    assert [one(spark, scoring.close(F.lit(100.0), F.lit(p))) for p in (121.0, 122.0)] == [1.0, 0.0]
    assert one(spark, scoring.ratio_close(F.lit(0.55), F.lit(55.0))) == 1.0
    assert one(spark, scoring.set_f1(lit("a", "b"), lit("b", "c"))) == 0.5
    empty = F.array().cast("array<string>")
    assert one(spark, scoring.set_f1(empty, empty)) == 1.0
    g, p = lit("a", "b", "c"), lit("a", "c", "b")
    assert one(spark, scoring.prefix(g, p)) == pytest.approx(1 / 3)
    assert one(spark, scoring.lcs(g, p)) == pytest.approx(2 / 3)
    for metric in (scoring.recall, scoring.prefix, scoring.lcs, scoring.efficiency):
        assert one(spark, metric(g, g)) == 1.0


def test_ranking(spark):
    rank = lambda s: spark.createDataFrame([(0, x, i) for i, x in enumerate(s)], "t int, k string, n int")
    assert scoring.ranking_score(rank("abc"), rank("cba"), "t", "k", "n").first()["score"] == 0.0
    assert scoring.ranking_score(rank("abc"), rank("abc"), "t", "k", "n").first()["score"] == 1.0


def test_trend(spark):
    rows = [(s, t, v) for s, vs in enumerate(([1], [1, 2, 2], [3, 1], [1, 5, 2], [3, 1, 2])) for t, v in enumerate(vs)]
    got = evidence.trend(spark.createDataFrame(rows, "s int, t int, v int"), "s", "t", "v").orderBy("s").collect()
    assert [r["trend"] for r in got] == ["single", "expanding", "shrinking", "expand_then_recede", "mixed"]


def test_plan_errors_are_rows(spark, small):
    assert trajectory.outcome(spark, small, [{"call": "ras.nothing", "args": {}}]).first()["status"] == "stub"
    with pytest.raises(ValueError):
        trajectory.compiled(spark, small, [{"call": "ras.area", "args": {"mask": "<3>"}}])


def test_haversine_forms_agree(spark):
    a = one(spark, S.haversine_m(F.lit(10.0), F.lit(20.0), F.lit(-33.0), F.lit(151.0)))
    b = one(spark, scoring.haversine_score_m(F.lit(10.0), F.lit(20.0), F.lit(-33.0), F.lit(151.0)))
    assert a == pytest.approx(b) and math.isfinite(a)


def test_answers_as_text(spark):
    from cindermap.functions import answers as A

    texts = ['{} {"a": 1}', '} {"a": 5}', '{"a": 6', "[1]", "", None, 'x {no} {"a": {"c": 4}} y']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(A.parsed_answer(F.col("t"))).collect()]
    assert got == ["{}", None, None, None, None, None, '{"a": {"c": 4}}']
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(A.coerced(F.col("t"))).collect()]
    assert got[2:6] == ['"{\\"a\\": 6"', "[1]", '""', None]
    paths = spark.createDataFrame([("a/b.tif",), ("/x",), ("abc.d",), ("./q/r.tar.gz",), (None,)], "p string")
    assert [tuple(r) for r in paths.select(A.looks_like_path(F.col("p")), A.path_stem(F.col("p"))).collect()] == [(True, "b"), (False, "x"), (False, "abc"), (True, "r.tar"), (False, None)]
    sizes = spark.createDataFrame([('{"temporal_images": {"t1": {}, "t2": {"pixel_size_m": 3}}}',), ("{}",), (None,)], "m string")
    assert [r[0] for r in sizes.select(A.pixel_size(F.col("m"))).collect()] == [3.0, None, None]


def test_field_scores_of_odd_answers(spark):
    from cindermap.operators import evaluation

    rows = [
        (1, "both_missing", "scalar_count", None, None), (1, "text", "scalar_count", "abc", "5"), (1, "empty_map", "scalar_dict", "{}", "{}"), (1, "no_map", "scalar_dict", "5", "{}"),
        (1, "other", "unknown", "True", "yes"), (1, "a_row", "point_pixel", "5", None), (1, "a_col", "point_pixel", "5", "19"), (1, "half_row", "point_pixel", "5", "5"),
        (1, "no_list", "ranking_kendall", "1", "[]"), (1, "twice", "ranking_kendall", '["a", "b", "a"]', '["b", "a"]'), (1, "skip", "ignore", "1", "2"),
    ]
    frame = spark.createDataFrame([(*r, None) for r in rows], "task long, field string, kind string, gold string, pred string, pixel_m double")
    got = {r["field"]: r["score"] for r in evaluation.field_scores(frame).collect()}
    # Of "a", "b", "a" the last places count: the two pairs of "b" and "a" agree, "a" with itself does not.
    assert got == {"both_missing": 1.0, "text": 0.0, "empty_map": 1.0, "no_map": 0.0, "other": 1.0, "a__point_px": 1.0, "no_list": 0.0, "twice": pytest.approx(2 / 3)}


def test_loop_keeps_what_it_cannot_resolve(spark):
    items = spark.createDataFrame([(1, 2.0, None), (2, None, 4.0)], "index int, a double, steps double")
    out = trajectory.loop(items, [{"call": "calc.add", "args": {"a": "<item.a>", "b": 1.0}}, {"call": "calc.mul", "args": {"a": "<value> from step[0].obs", "b": 2}}], grid_n=2)
    assert [(r["row_idx"], r["col_idx"], r["last_obs"]["value"]) for r in out.orderBy("index").collect()] == [(0, 1, 6.0), (1, 0, None)]
    assert trajectory.loop(items.limit(0), [{"call": "calc.add", "args": {"a": "<item.a>", "b": 1}}]).count() == 0
    assert trajectory.loop(items, []).columns == ["index", "a", "last_obs"]
    with pytest.raises(ValueError, match="unknown call"):
        trajectory.loop(items, [{"call": "seg.flood", "args": {}}])


def test_routes_by_brute_force(spark):
    import heapq
    import random

    random.seed(5)
    rows = {}
    for g in range(6):
        for _ in range(14):
            u, v = sorted(random.sample(range(8), 2))
            rows[g, u, v] = (g, u, v, random.randint(0, 3), random.random() < 0.4)
    frame = spark.createDataFrame(list(rows.values()), "graph long, u long, v long, length long, damaged boolean")

    def best(g, repair):
        near = {}
        for gg, u, v, w, bad in rows.values():
            if gg == g and (repair or not bad):
                near.setdefault(u, []).append((v, (int(bad and repair), w, 1)))
                near.setdefault(v, []).append((u, (int(bad and repair), w, 1)))
        heap, done = [((0, 0, 0), 0)], {}
        while heap:
            cost, n = heapq.heappop(heap)
            if n not in done:
                done[n] = cost
                for m, w in near.get(n, []):
                    heapq.heappush(heap, (tuple(map(sum, zip(cost, w))), m))
        return done.get(7)

    for repair in (False, True):
        got = graph.routes(frame, 0, 7, repair).orderBy("graph", "seq").collect()
        for g in range(6):
            hops, want = [r for r in got if r["graph"] == g], best(g, repair)
            assert bool(hops) == (want is not None)
            if hops:
                assert (hops[0]["u"], hops[-1]["v"], [r["seq"] for r in hops]) == (0, 7, list(range(1, len(hops) + 1)))
                assert all(a["v"] == b["u"] for a, b in zip(hops, hops[1:]))
                assert (sum(r["damaged"] for r in hops), sum(r["length"] for r in hops), len(hops)) == want
    assert graph.routes(frame.limit(0), 0, 7).count() == graph.routes(frame, 0, 0).count() == 0


def test_all_touched_and_unions(spark):
    cells = spark.createDataFrame([(1, r, c, float(r * 4 + c)) for r in range(4) for c in range(4)], "raster_id long, r int, c int, value double")
    ring = "array<struct<x:double,y:double>>"
    layer = spark.createDataFrame([(1, 1, [(0.6, 0.6), (1.4, 0.6), (1.4, 1.4), (0.6, 1.4)]), (1, 2, [(3.5, 3.5)]), (1, 3, []), (1, 4, None), (2, 5, [(0.0, 0.0)]), (1, 6, [(9.0, 9.0)])], f"raster_id long, id long, ring {ring}")
    plain, _ = vector.raster_stats(layer, cells, None)
    assert [(r["id"], r["pixel_count"]) for r in plain.orderBy("id").collect()] == [(2, 1)]
    touched, together = vector.raster_stats(layer, cells, 15.0, all_touched=True)
    assert [(r["id"], r["pixel_count"], r["mean"]) for r in touched.collect()] == [(1, 4, 2.5)]
    assert [tuple(r)[:4] for r in together.collect()] == [(1, 4, 2.5, 0.0)]


def test_feature_and_graphml_files(spark, tmp_path):
    from cindermap.sources import files

    for name, text in {"a": '{"features": [{"n": 1}, {"n": 2}]}', "b": "[{\"n\": 3}]", "c": "{}"}.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = files.read_features(spark, f"file://{tmp_path}/*.json").collect()
    assert sorted((r["feature"] or "") for r in got) == ["", '{"n":1}', '{"n":2}', '{"n":3}']
    (tmp_path / "g.graphml").write_text(
        '<?xml version="1.0"?><graphml><key id="d0" for="edge" attr.name="length_m" attr.type="double"/><key id="d1" for="edge" attr.name="damaged" attr.type="boolean"/>'
        '<graph edgedefault="undirected"><node id="1"/><node id="2"/><edge source="1" target="2"><data key="d0">2.5</data><data key="d1">True</data></edge><edge source="2" target="3"/></graph></graphml>'
    )
    assert sorted(tuple(r) for r in files.read_graphml(spark, f"file://{tmp_path}/g.graphml").collect()) == [("1", "2", 2.5, True), ("2", "3", 1.0, False)]


def test_only_named_does_not_sort_a_frequent_name(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("n"), F.col("id").cast("string"))).alias("tool"))
    names = lambda *values: spark.createDataFrame([(v,) for v in values], "tool string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        common = records.only_named(rows, "tool", names("hot", "other"))
        assert "SortMergeJoin" not in common._jdf.queryExecution().executedPlan().toString() and common.count() == 2000
        both = records.only_named(rows, "tool", names("hot", "n1", "n3", "n3", None))
        assert both.columns == ["id", "tool"] and sorted(r["id"] for r in both.collect()) == sorted([1, 3, *range(0, 4000, 2)])
        assert sorted(r["id"] for r in records.only_named(rows, "tool", names("n5")).collect()) == [5]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_named_falls_back_to_all(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, tool string")
    names = lambda *t: spark.createDataFrame([(x,) for x in t], "tool string")
    ids = lambda wanted: sorted(r["id"] for r in records.only_named(rows, "tool", wanted).collect())
    assert ids(names("b", "b", "z", None)) == [2]
    assert ids(names("z", None)) == ids(names()) == [1, 2, 3]
    assert records.only_named(rows.limit(0), "tool", names("a")).columns == ["id", "tool"]


def test_decimate(spark):
    cells = spark.createDataFrame([(1, 0, 0, 1.0), (1, 1, 1, 3.0), (1, 2, 0, None), (1, 4, 4, 7.0)], "raster_id long, r int, c int, value double")
    assert sorted((r["r"], r["c"], r["value"]) for r in raster.decimate(cells, 2).collect() if r["value"]) == [(0, 0, 2.0), (2, 2, 7.0)]


def test_chart_data_takes_the_largest_unrounded(spark):
    """Values that are equal once rounded are told apart before: the largest are taken, whatever their ids."""
    rows = spark.createDataFrame([(1, "a", 9.96), (2, "a", 10.04), (3, "b", 10.01), (4, "b", 3.0)], "id long, label string, value double")
    got = records.chart_data(rows, F.col("label"), F.col("label"), F.round("value", 1), 2, 1, by=F.col("value")).collect()
    assert {(r["id"], r["label"], r["value"]) for r in got} == {(2, "a", 10.0), (3, "b", 10.0)}
    got = records.chart_data(rows, F.col("label"), F.col("label"), F.col("value"), 3, 1).collect()
    assert {(r["id"], r["label"], r["value"]) for r in got} == {(1, "a", 10.0), (2, "a (2)", 10.0), (3, "b", 10.0)}


def test_small_tables_are_dealt_out(spark, small):
    """A file that is one task becomes many before a row becomes or costs much."""
    from cindermap.plans.geometry import crossings
    from cindermap.sources import tables as T

    for made in (T.rects(spark, small), T.pois(spark, small), T.sites(spark, small), T.dem(spark, small)):
        assert made.rdd.getNumPartitions() >= 8
    assert "REPARTITION_BY_NUM" in crossings(spark, small)._jdf.queryExecution().executedPlan().toString()
