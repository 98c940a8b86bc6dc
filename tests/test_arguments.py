"""Nested arguments, by hand from the rules."""

import json

import pytest

from cindermap.operators import arguments

STEPS = "task long, step long, call string, args string, obs string"


def frame(spark, rows):
    return spark.createDataFrame([(t, i, c, a if isinstance(a, str) or a is None else json.dumps(a), o if isinstance(o, str) or o is None else json.dumps(o)) for t, i, c, a, o in rows], STEPS)


def test_walk_and_coercion(spark):
    rows = spark.createDataFrame([(1, '{"a/b": [1, "x", {"c": null}], "d": "[true, \\"{\\\\\\"e\\\\\\": 2.5}\\"]", "f": "{no", "g": {}}'), (2, "no json"), (3, None)], "id long, args string")
    got = {(r["id"], r["path"]): (r["kind"], r["size"], r["leaf"]) for r in arguments.walked(rows, ["id"], "args").collect()}
    assert got[1, "/a~1b"] == ("array", 3, None) and got[1, "/a~1b/0"] == ("number", None, "1") and got[1, "/a~1b/2/c"] == ("null", None, None)
    assert got[1, "/d"][0] == "string" and got[1, "/g"] == ("object", 0, None) and got[2, ""][0] == got[3, ""][0] == "null"
    got = {(r["id"], r["path"]): (r["kind"], r["leaf"]) for r in arguments.walked(rows, ["id"], "args", coerce=True).collect()}
    assert got[1, "/d"][0] == "array" and got[1, "/d/0"] == ("boolean", "true") and got[1, "/d/1/e"] == ("number", "2.5") and got[1, "/f"] == ("string", "{no")


CASES = [
    ({"a": 10}, {"a": 13}, 1.0), ({"a": 10}, {"a": "12.5"}, 1.0), ({"a": 10}, {"a": 14}, 0.0), ({"a": 1, "b": 2}, {"a": 1}, 0.5), ({}, {"a": 1}, 1.0), ({"a": "Big Road!"}, {"a": "big road"}, 1.0),
    ({"a": True}, {"a": 1}, 1.0), ({"a": True}, {"a": "true"}, 0.0), ({"a": None}, {"a": None}, 1.0), ({"a": None}, {"a": 0}, 0.0), ({"a": None}, {}, 0.0),
    ({"a": [1, [2, "x"]]}, {"a": [1, [2, "X"]]}, 1.0), ({"a": [1, 2]}, {"a": [1, 2, 3]}, 0.0), ({"a": {"k": [1]}}, {"a": {"k": [9]}}, 0.0), ({"a": {"k": 1}}, {"a": {"k": 1, "l": 2}}, 0.0), ({"a": []}, {"a": []}, 1.0), ({"a": []}, {"a": {}}, 0.0),
    ({"a": "<area> from trajectory[0].obs"}, {"a": 5}, 1.0), ({"a": "<area> from trajectory[0].obs"}, {"a": None}, 0.0),
    ({"a": "/data/in.png"}, {"a": "/other/name.png"}, 1.0), ({"a": "/data/in.png"}, {"a": "plain"}, 1.0),
]


def test_rules(spark):
    gold = frame(spark, [(t, 0, "seg_flood(x)", g, None) for t, (g, _, _) in enumerate(CASES)])
    pred = frame(spark, [(t, 5, "seg.flood", p, None) for t, (_, p, _) in enumerate(CASES)])
    got = {r["task"]: r["score"] for r in arguments.parameter_accuracy(gold, pred, "task").collect()}
    for t, (g, p, want) in enumerate(CASES):
        assert got[t] == pytest.approx(want), (g, p)


def test_files_by_role(spark):
    mask = {"mask_path": "/g/mask.tif", "n": 3}
    gold = frame(spark, [
        (1, 0, "seg.flood", {}, mask), (1, 1, "ras.area", {"m": "/g/mask.tif"}, None),  # the same step's output
        (2, 0, "seg.flood", {}, mask), (2, 1, "ras.stats", {}, {"o": "/g/b.tif"}), (2, 2, "ras.area", {"m": "/g/mask.tif"}, None),  # another step's
        (3, 0, "seg.flood", {}, mask), (3, 1, "ras.area", {"m": "/g/mask.tif"}, None),  # untracked, the same tool
        (4, 0, "seg.flood", {}, mask), (4, 1, "ras.area", {"m": "/g/mask.tif"}, None),  # untracked, another tool
        (5, 0, "seg.flood", {}, mask), (5, 1, "ras.area", {"m": "/g/mask.tif"}, None),  # alike but for the hash
        (6, 0, "tool.loop", {"x": 1}, None), (6, 1, "ras.area", {"m": 1}, None), (6, 2, "ras.area", {"m": 1}, None),
    ])
    text = lambda d: [{"text": json.dumps(d)}]
    pred = frame(spark, [
        (1, 0, "seg.flood", {}, text({"mask_path": "/p/x_1.tif"})), (1, 1, "ras.area", {"m": "/p/x_1.tif"}, None),
        (2, 0, "seg.flood", {}, text({"mask_path": "/p/x.tif"})), (2, 1, "ras.stats", {}, text({"o": "/p/y.tif"})), (2, 2, "ras.area", {"m": "/p/y.tif"}, None),
        (3, 0, "seg.flood", {}, None), (3, 1, "ras.area", {"m": "/p/z.tif"}, None),
        (4, 0, "seg.lava", {}, None), (4, 1, "ras.area", {"m": "/p/z.tif"}, None),
        (5, 0, "seg.lava", {"output_path": "/p/q.tif"}, None), (5, 1, "ras.area", {"m": "/p/mask_0a1b2c.tif"}, None),
        (6, 1, "ras.area", {"m": 1}, None), (7, 0, "ras.area", {}, None),
    ])
    got = {r["task"]: r["score"] for r in arguments.parameter_accuracy(gold, pred, "task").collect()}
    assert got == {1: 1.0, 2: pytest.approx(2 / 3), 3: 1.0, 4: 0.0, 5: 0.5, 6: 0.5, 7: 0.0}


def test_no_side_is_sent_to_every_task(spark):
    """Steps and arguments grow with the tasks: their joins shuffle both sides. One small file's texts are walked in many tasks."""
    rows = spark.range(50).coalesce(1).selectExpr("id AS task", "1L AS step", "'ras.area' AS call", "'{\"k\": [1, 2]}' AS args", "CAST(NULL AS string) AS obs")
    scores = arguments.parameter_accuracy(rows, rows, "task")
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and all("rightHint=(strategy=merge)" in line for line in joins if "task#" in line)
    assert {r["score"] for r in scores.collect()} == {1.0}
    nodes = arguments.walked(rows, ["task"], "args")
    assert nodes.count() == 200 and len({f.rsplit("/", 1)[0] for f in nodes.inputFiles()}) == 3 and len(nodes.inputFiles()) > 6
