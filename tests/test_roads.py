"""Centre lines against a walk over the same skeleton, whatever the tile; routes against a plain search over pixels."""

import heapq
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from cindermap.operators import perceive, roads
from cindermap.plans import queries
from cindermap.sources.shared import staged

STEPS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def drawn(seed, side=48):
    rng = np.random.default_rng(seed)
    grid = np.zeros((side, side), int)
    for _ in range(5):
        r, c = rng.uniform(2, side - 3, 2)
        angle, wide = rng.uniform(0, np.pi), rng.integers(0, 3)
        for t in np.linspace(-side, side, 4 * side):
            y, x = round(r + t * np.sin(angle)), round(c + t * np.cos(angle))
            if 0 <= y < side and 0 <= x < side:
                grid[max(0, y - wide) : y + wide + 1, max(0, x - wide) : x + wide + 1] = 1 if rng.uniform() < 0.7 or abs(t) < 8 else rng.integers(2, 4)
    grid[0:3, 0:3] = grid[side - 2, 1:7] = 1  # too small to stay, unless a road touches them
    return grid


def cells(spark, grids):
    rows = [(i, int(r), int(c), int(g[r, c])) for i, g in grids.items() for r, c in zip(*np.nonzero(g), strict=True)]
    return spark.createDataFrame(rows, "raster_id long, r int, c int, value int").repartition(3)


def length(path):
    return sum(1.41421356237 if abs(a[0] - b[0]) == abs(a[1] - b[1]) == 1 else 1.0 for a, b in zip(path, path[1:], strict=False))


def large(mask):
    left, kept = {tuple(map(int, p)) for p in np.argwhere(mask)}, np.zeros_like(mask)
    while left:
        seen = [left.pop()]
        for r, c in seen:
            for p in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if p in left:
                    left.discard(p)
                    seen.append(p)
        if len(seen) >= 32:
            kept[tuple(np.array(seen).T)] = True
    return kept


def walked(grid):
    """(pixels, damaged) by walking the skeleton."""
    road, hurt = large(np.isin(grid, (1, 2, 3))), np.isin(grid, (2, 3))
    side = grid.shape[0]
    wide = np.zeros_like(road)
    for r, c in np.argwhere(road):
        wide[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2] = True
    shut = np.array([[wide[max(0, r - 1) : r + 2, max(0, c - 1) : c + 2].all() for c in range(side)] for r in range(side)])
    on = {tuple(map(int, p)) for p in np.argwhere(perceive.thinned(shut))}
    near = {p: [q for i, j in STEPS if (q := (p[0] + i, p[1] + j)) in on] for p in on}
    nodes = sorted(p for p in on if len(near[p]) != 2)
    seen, edges, pairs = set(), [], set()
    for start in nodes:
        for way in near[start]:
            if (start, way) in seen:
                continue
            path = [start, way]
            while path[-1] not in nodes:
                path.append(next(q for q in near[path[-1]] if q != path[-2]))
            seen |= set(zip(path, path[1:], strict=False)) | set(zip(path[1:], path, strict=False))
            at = 0
            for i in range(1, len(path)):
                a, b = path[i - 1], path[i]
                turn = i < len(path) - 1 and (b[0] - a[0], b[1] - a[1]) != (path[i + 1][0] - b[0], path[i + 1][1] - b[1]) and i - at >= 4
                if i == len(path) - 1 or turn:
                    u, v = path[at], b
                    if u != v and frozenset((u, v)) not in pairs:
                        pairs.add(frozenset((u, v)))
                        edges.append((path[at : i + 1], at > 0 and i == len(path) - 1))
                    at = i
    degree = {}
    for path, _ in edges:
        for p in (path[0], path[-1]):
            degree[p] = degree.get(p, 0) + 1
    out = []
    share = lambda ps: sum(hurt[p] for p in ps) >= max(1, len(ps) / 2)
    for path, back in edges:
        a, b = (path[-1], path[0]) if back else (path[0], path[-1])
        left, right = (3 * (degree[x] >= 3) for x in (a, b))
        rest = path[left : len(path) - right] if left + right < len(path) else path
        out.append([path, share(rest)])
    groups = {p: {p} for p in degree if degree[p] >= 3}
    inner = lambda path: path[0] in groups and path[-1] in groups
    for path, _ in out:
        if inner(path) and length(path) <= 12 and groups[path[0]] is not groups[path[-1]]:
            both = groups[path[0]] | groups[path[-1]]
            for p in both:
                groups[p] = both
    for group in {id(g): g for g in groups.values()}.values():
        arms = sum(not d for path, d in out if (path[0] in group) != (path[-1] in group))
        if arms >= 2:
            for e in out:
                if e[0][0] in group and e[0][-1] in group and length(e[0]) <= 12:
                    e[1] = False
    return out


def told(edges):
    return sorted((min(p, p[::-1]), d) for p, d in edges)


@pytest.mark.parametrize("tile", [8, 256])
def test_centerlines(spark, tile):
    grids = {i: drawn(i) for i in range(4)}
    found = roads.centerlines(cells(spark, grids), 48, 48, tile=tile).collect()
    for i, grid in grids.items():
        own = [r for r in found if r["raster_id"] == i]
        got = [([(p["r"], p["c"]) for p in r["pixels"]], r["damaged"]) for r in own]
        assert told(got) == told(walked(grid)) and got
        assert all(abs(r["length"] - length([(p["r"], p["c"]) for p in r["pixels"]])) < 1e-9 for r in own)


def test_centerlines_of_nothing(spark):
    empty = cells(spark, {1: drawn(1)}).where("value > 9")
    assert roads.centerlines(empty, 48, 48).collect() == []
    assert roads.snapped_routes(roads.road_graph(roads.centerlines(empty, 48, 48))[1], requests(spark, [(1, 1, 0, 0, 3, 3)])).collect()[0]["status"] == "no_roads"


def requests(spark, rows):
    return spark.createDataFrame(rows, "id long, graph long, sr long, sc long, er long, ec long")


def test_routes(spark):
    grids = {i: drawn(i) for i in range(3)}
    _, edges = roads.road_graph(roads.centerlines(cells(spark, grids), 48, 48))
    rng = np.random.default_rng(4)
    asked = [(k, int(rng.integers(0, 3)), *map(int, rng.integers(0, 48, 4))) for k in range(60)]
    lines = {}
    for e in edges.collect():
        lines.setdefault(e["graph"], []).append(([(p["r"], p["c"]) for p in e["pixels"]], e["damaged"]))
    seen = set()
    for row in roads.snapped_routes(edges, requests(spark, asked), 2.0).collect():
        _, graph, sr, sc, er, ec = asked[row["id"]]
        picks = []
        for p in ((sr, sc), (er, ec)):
            near = sorted((math.dist(p, q) ** 2, q, d) for path, d in lines[graph] for q in path)[:64]
            near = [x for x in near if x[0] <= 100 + 1e-9]
            picks.append(min(near, key=lambda x: (x[2], round(x[0]), x[1])) if near else None)
        status = row["status"]
        seen.add(status)
        if None in picks:
            assert status == "snap_failed" and (row["start_r"], row["end_c"], row["path"]) == (sr, ec, None)
            continue
        if picks[0][2] or picks[1][2]:
            assert status == "snapped_on_damaged" and row["distance_px"] is None
            continue
        a, b = picks[0][1], picks[1][1]
        assert (row["start_r"], row["start_c"], row["end_r"], row["end_c"]) == (*a, *b)
        ways = {}
        for path, hurt in lines[graph]:
            for p, q in () if hurt else zip(path, path[1:], strict=False):
                ways.setdefault(p, set()).add(q)
                ways.setdefault(q, set()).add(p)
        best, heap = {}, [(0.0, a)]
        while heap:
            d, p = heapq.heappop(heap)
            if p not in best:
                best[p] = d
                for q in ways.get(p, ()):
                    heapq.heappush(heap, (d + length([p, q]), q))
        if b not in best:
            assert status == "no_path" and row["distance_m"] is None
            continue
        assert status == "ok" and abs(row["distance_px"] - best[b]) < 1e-6 and abs(row["distance_m"] - 2 * best[b]) < 1e-6
        path = [(p["r"], p["c"]) for p in row["path"]]
        assert path[0] == a and path[-1] == b and abs(length(path) - best[b]) < 1e-6
        assert all(q in ways[p] for p, q in zip(path, path[1:], strict=False))
    assert {"ok", "snap_failed"} <= seen


def test_tiles_together(monkeypatch):
    """Tiles of one array do not see each other, wherever batches and arrays end; a null raster is a raster, and a cell may come twice."""
    rng = np.random.default_rng(9)
    grids = {i: rng.random((20, 20)) < 0.2 for i in (None, -1, 0, 3, 4)}
    rows = [(i, r, c, tr, tc) for i, g in grids.items() for tr in range(-1, 4) for tc in range(-1, 4) for r, c in np.argwhere(g).tolist() if 8 * tr - 2 <= r < 8 * tr + 10 and 8 * tc - 2 <= c < 8 * tc + 10]
    batch = pa.RecordBatch.from_arrays([pa.array(k, t) for k, t in zip(zip(*[x for x in rows for _ in range(2)], strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["raster_id", "r", "c", "tr", "tc"])
    want = {(i, r, c) for i, g in grids.items() for r, c in np.argwhere(~roads.grown(~roads.grown(np.pad(g, 4)))[4:-4, 4:-4]).tolist()}
    for held, area, cut in ((1, 1, 7), (40, 700, 100), (10**6, 10**6, 10**6)):
        monkeypatch.setattr(roads, "HELD", held)
        monkeypatch.setattr(roads, "AREA", area)
        found = roads._tiled(8, lambda grid, r, c: ~roads.grown(~roads.grown(grid)) & (r >= 0) & (r < 20) & (c >= 0) & (c < 20))(iter([batch.slice(i, cut) for i in range(0, len(batch), cut)]))
        got = [(x["raster_id"], x["r"], x["c"]) for part in found for x in part.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("name", ["centerline_edges", "centerline_graph", "snapped_routes"])
def test_joins_are_shuffled(spark, tmp_path, monkeypatch, name):
    """Files of pixels and rows exploded from few look small, but no join may send them all through the driver."""
    spark.createDataFrame([(1, "a", 0, 1.0), (2, "b", 0, 2.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    plans = {}
    monkeypatch.setattr(roads, "staged", lambda df, purpose: plans.update({purpose: plan(df)}) or staged(df, purpose))
    made = queries.QUERIES[name](spark, str(tmp_path))
    plans["result"] = plan(made)
    assert sum(p.count("SortMergeJoin") for p in plans.values()) > 5 and made.count()
    for purpose, p in plans.items():  # but regions that tiles share, which few pixels do
        assert set(re.findall(r"Broadcast\w*Join \[(\w+)#", p)) <= {"region"} and "BroadcastNestedLoopJoin" not in p, purpose
