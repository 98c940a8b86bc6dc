"""Field scores worked out by hand from the rules."""

import json

import pytest
from pyspark.sql import functions as F

from cindermap.functions import answers
from cindermap.functions.scalar import canonical
from cindermap.operators import evaluation
from cindermap.plans import queries

RING = [[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]]
CASES = [
    # sets: normalized texts, no aliases, commas split what is no list
    ("set_f1", '["yes"]', '["true"]', 0.0), ("set_f1", '["Phase 3"]', '["p3"]', 0.0), ("set_f1", '["road", "school"]', "road, School", 1.0), ("set_f1", "a,b,,c", '["a", "B!"]', 0.8),
    ("set_f1", "[]", None, 1.0), ("set_f1", '["a"]', "", 0.0), ("set_f1", '{"a": 1}', None, 1.0),
    # maps: what is rescaled keeps the absolute tolerance of 1 for gold above 1.5
    ("scalar_dict", '{"x": 2}', '{"x": 0.01}', 1.0), ("scalar_dict", '{"x": 100}', '{"x": 0.8}', 1.0), ("scalar_dict", '{"x": 0.5}', '{"x": 1.4}', 0.0), ("scalar_dict", '{"x": 0.5}', '{"x": 55}', 1.0),
    # points in one value
    ("point_pixel", "[3, 4]", "[3, 5]", 1.0), ("point_pixel", "[3, 4]", "[3, 25]", 0.0), ("point_pixel", '{"pixel_row": 3, "pixel_col": 4}', "[3, 5]", 1.0), ("point_pixel", '{"x": 4, "y": 3}', '{"r": 3, "c": 24}', 1.0),
    ("point_pixel", "none", "none", 1.0), ("point_pixel", "5", "5.5", 1.0), ("point_pixel", "[1, 2, 3]", "[1, 2]", 0.0),
    ("point_haversine", '{"lat": 1.0, "lon": 2.0}', "[1.0001, 2.0]", 1.0), ("point_haversine", '{"latitude": 1.0, "longitude": 2.0}', '{"lat": 1.01, "lng": 2.0}', 0.0),
    # polygons
    ("polygon_iou", json.dumps({"type": "Polygon", "coordinates": [RING]}), json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 5.01], [0, 5.01]]]}}), 1.0),
    ("polygon_iou", json.dumps({"type": "Polygon", "coordinates": [RING]}), json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 4.9], [0, 4.9]]]}), 0.0),
    ("polygon_iou", json.dumps({"type": "FeatureCollection", "features": []}), "none", 1.0), ("polygon_iou", json.dumps({"type": "Polygon", "coordinates": [RING]}), "None", 0.0),
    ("polygon_iou", json.dumps({"type": "FeatureCollection", "features": []}), json.dumps({"type": "Polygon", "coordinates": [RING]}), 0.0), ("polygon_iou", "not json", "null", 0.0),
    (
        "polygon_iou", json.dumps({"type": "Feature", "pixel_grid": {"transform": [2, 0, 100, 0, -2, 50]}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1]]], [[[100, 30], [120, 30], [120, 50], [100, 50]]]]}}),
        json.dumps({"type": "FeatureCollection", "features": [{"geometry": {"type": "Polygon", "coordinates": [RING]}}]}), 1.0,
    ),
    # the rest as before
    ("ratio_pct", "0.55", "55%", 1.0), ("exact_match", "Phase 3", "p_3", 1.0), ("some_kind", "yes", "True", 1.0), ("scalar_count", "10", "13", 1.0), ("scalar_count", "10", "13.1", 0.0), ("ranking_kendall", '["a", "b"]', '["b", "a"]', 0.0),
]


def test_rules(spark):
    rows = [(i, "at", kind, gold, pred, 1.0) for i, (kind, gold, pred, _) in enumerate(CASES)]
    got = {r["task"]: r["score"] for r in evaluation.field_scores(spark.createDataFrame(rows, "task long, field string, kind string, gold string, pred string, pixel_m double")).collect()}
    for i, (kind, gold, pred, want) in enumerate(CASES):
        assert got[i] == pytest.approx(want), (kind, gold, pred)


def test_texts_are_normalized_once(spark):
    plan = spark.createDataFrame([("Phase 3", "p_3")], "a string, b string").select(canonical(F.col("a")).alias("c"), answers.same_key(F.col("b")).alias("k"))
    assert [tuple(r) for r in plan.collect()] == [("p3", "p3")]
    assert plan._jdf.queryExecution().analyzed().toString().count("lower(") == 2


def test_orders_are_dealt_out_before_their_fields_are_made(spark, small, monkeypatch):
    made = []
    monkeypatch.setattr(evaluation, "field_scores", lambda fields: made.append(fields) or fields)
    assert queries.evaluated(spark, small) is made[0]
    assert made[0].rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_halves_of_points(spark):
    rows = [(1, "a_row", "point_pixel", "1", "5"), (1, "a_col", "point_pixel", "1", None), (2, "a_row", "point_pixel", "1", "1"), (3, "spot", "point_pixel", "[1, 1]", "[1, 2]"), (4, "n", "ignore", "1", "1"), (5, "n", None, "1", "1.0")]
    fields = spark.createDataFrame([(*r, None) for r in rows], "task long, field string, kind string, gold string, pred string, pixel_m double")
    assert sorted(map(tuple, evaluation.field_scores(fields).collect())) == [(1, "a__point_px", 1.0), (3, "spot", 1.0), (5, "n", 1.0)]


def test_summary_helpers(spark, tmp_path):
    from pyspark.sql import functions as F

    from cindermap.operators import summary
    from cindermap.sources import files

    text = "one two " + "x" * 60 + " three " + " ".join(["word"] * 20)
    lines = spark.range(1).select(summary.wrapped(F.lit(text)).alias("w"), summary.wrapped(F.lit(None).cast("string")).alias("n")).first()
    assert " ".join(lines["w"]) == text and lines["n"] == [] and all(len(x) <= 48 or " " not in x for x in lines["w"]) and lines["w"][0] == "one two"
    modes = spark.range(1).select(*[c.alias(n) for n, c in summary.task_mode(F.lit("Briefing on the SCENE")).items()]).first()
    assert tuple(modes) == (False, True, True)
    rows = spark.createDataFrame([("D1", 0.5), ("overall", None)], "dimension string, score double")
    files.write_results(rows, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/json")).count() == 2
    assert sorted(r["value"].split() for r in spark.read.text(str(tmp_path / "r/text")).collect()) == [["D1", "0.5"], ["overall", "-"]]
