"""Road networks from masks: centre lines, their graph, and routes that start and end anywhere near a road.

A pixel's code is r * 65536 + c; nodes are named by their pixel's code. Rasters are worked on in tiles with a margin as wide as what a
round can reach, so results do not depend on the tile; lines are put together from pixels by pointer jumping, whose rounds are
logarithmic in the longest line. Every round is written to the shared folder.

Both sides of nearly all joins here grow with the rasters. Pixels in order take half a byte each in a file, and rows exploded from a small table look
as small as that table, so Spark would send them all through the driver: ``large`` keeps it from that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindermap.operators.graph import components, raster_components
from cindermap.operators.perceive import thinning_pass
from cindermap.sources.shared import staged, tasks

#: The least object, what makes an edge damaged, turns, junctions, snapping, and a diagonal step's length.
LEAST_PIXELS, DAMAGED_RATIO, DAMAGED_PIXELS = 32, 0.5, 1
TURN_DEGREES, TURN_STEPS = 5.0, 4
JUNCTION_DEGREE, JUNCTION_TRIM, CONNECTOR_PX, INTACT_ARMS = 3, 3, 12.0, 2
SNAP_PX, SNAP_SAMPLES = 10, 64
DIAGONAL = 1.41421356237

ROW = 1 << 16
#: Thinning passes a round; the margin is twice as wide.
PASSES = 8
#: Cells of the arrays that hold many tiles, and rows of tiles that are put into them together.
AREA, HELD = 1 << 20, 100_000
#: Empty cells around each tile of such an array.
RIM = 2
LINE = "raster_id long, head long, way long, piece int, u long, v long, u_turn boolean, v_turn boolean, pixels array<struct<r:int,c:int>>, hit array<boolean>"


def code(r: Column, c: Column) -> Column:
    return r.cast("long") * ROW + c


def large(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled, whatever size Spark takes it for."""
    return df.hint("merge")


def by_tile(cells: DataFrame, tile: int, margin: int, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``work`` (a boolean grid, and the row and the column of its cells) on each tile of the cells (raster_id, r, c), with a margin. What it returns
    for the tile itself (0 none, more: kept) is the new cells' ``state``. A grid holds many tiles, one below the other, ``RIM`` empty cells around each:
    a cell of the result may depend on cells of the grid that lie that far from it, or on farther ones over cells that are not empty."""
    reach = lambda k: F.explode(F.sequence(F.floor((F.col(k) - margin) / tile), F.floor((F.col(k) + margin) / tile)))
    named = cells.select(F.col("raster_id").cast("long").alias("raster_id"), F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"))
    dealt = named.select("*", reach("r").alias("tr")).select("*", reach("c").alias("tc"))
    dealt = dealt.repartition(tasks(cells), "raster_id", "tr", "tc").sortWithinPartitions("raster_id", "tr", "tc")
    return dealt.mapInArrow(_tiled(tile, work), "raster_id long, r int, c int, state int")


def _tiled(tile: int, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]):
    """``work`` on rows (raster_id, r, c, tr, tc) that come tile by tile."""

    def told(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        r, c, tr, tc = (rows.column(k).to_numpy() for k in ("r", "c", "tr", "tc"))
        raster = rows.column("raster_id").combine_chunks()
        starts = _firsts(rows)
        ends = np.concatenate([starts[1:], [len(r)]])
        (top, bottom), (left, right) = ((np.minimum.reduceat(k, starts) - RIM, np.maximum.reduceat(k, starts) + RIM + 1) for k in (r, c))
        high, wide = (bottom - top).tolist(), (right - left).tolist()
        a = 0
        while a < len(starts):
            b, height, width = a + 1, high[a], wide[a]
            while b < len(starts) and (height + high[b]) * max(width, wide[b]) <= AREA:
                height, width, b = height + high[b], max(width, wide[b]), b + 1
            own = slice(int(starts[a]), int(ends[b - 1]))
            of = np.repeat(np.arange(a, b), ends[a:b] - starts[a:b])
            line = np.repeat(np.arange(a, b), high[a:b])  # the tile of each of the grid's rows
            first = np.concatenate([[0], np.cumsum(high[a:b])])[:-1]
            grid = np.zeros((height, width), bool)
            grid[first[of - a] + r[own] - top[of], c[own] - left[of]] = True
            row = np.arange(height) - first[line - a] + top[line]
            state = work(grid, row[:, None], left[line][:, None] + np.arange(width))
            i, j = np.nonzero(state)
            at, i_row, i_column = line[i], row[i], left[line[i]] + j
            kept = (i_row // tile == tr[starts[at]]) & (i_column // tile == tc[starts[at]])
            found = [pa.array(k[kept].astype(np.int32)) for k in (i_row, i_column, state[i, j])]
            yield pa.RecordBatch.from_arrays([raster.take(pa.array(starts[at[kept]])), *found], ["raster_id", "r", "c", "state"])
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for rows in batches:
            held.append(rows)
            size += rows.num_rows
            if size < HELD:
                continue
            whole = pa.Table.from_batches(held)
            cut = int(_firsts(whole)[-1])  # a tile stays whole: its last rows may still come
            if cut:
                yield from told(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
                size = whole.num_rows - cut
        if size:
            yield from told(pa.Table.from_batches(held))

    return run


def _firsts(rows: pa.Table) -> np.ndarray:
    """The rows at which another tile starts; a null raster is a raster."""
    raster = rows.column("raster_id")
    at = np.stack([pc.fill_null(raster, 0).to_numpy(), raster.is_null().to_numpy().astype(np.int64), rows.column("tr").to_numpy(), rows.column("tc").to_numpy()])
    return np.flatnonzero(np.concatenate([[True], (np.diff(at, axis=1) != 0).any(0)]))


def grown(grid: np.ndarray) -> np.ndarray:
    """The grid's cells and their eight neighbours."""
    wide = np.pad(grid, 1)
    return np.logical_or.reduce([wide[1 + i : wide.shape[0] - 1 + i, 1 + j : wide.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)])


def closed(cells: DataFrame, height: int, width: int, tile: int) -> DataFrame:
    """Gaps of a pixel closed (grown, then shrunk by a 3 x 3 square); beyond the raster's border nothing grows and nothing shrinks."""

    def work(grid: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        inside = (r >= 0) & (r < height) & (c >= 0) & (c < width)
        return (~grown(inside & ~grown(grid)) & inside).astype(int)

    return by_tile(cells, tile, 2, work).drop("state")


def skeleton(cells: DataFrame, tile: int) -> DataFrame:
    """Lines of one pixel's width (Zhang-Suen thinning): rounds of ``PASSES`` passes until no tile changes."""

    def work(grid: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        before = grid
        for _ in range(PASSES):
            now = thinning_pass(grid)
            if (now == grid).all():
                break
            grid = now
        changed = before != grid
        near = grown(changed) if changed.any() else changed  # a pixel next to a change says so
        return grid.astype(int) + (grid & near)

    while True:
        now = staged(by_tile(cells, tile, 2 * PASSES + 2, work), "thinned")
        cells = now.drop("state")
        if now.where("state = 2").isEmpty():
            return cells


def steps_length(pixels: Column) -> Column:
    """Length along pixels: 1 a step, diagonals ``DIAGONAL``; any other step counts 1."""
    step = F.zip_with(F.slice(pixels, 1, F.greatest(F.lit(0), F.size(pixels) - 1)), F.slice(pixels, 2, F.greatest(F.lit(0), F.size(pixels) - 1)), lambda a, b: F.when((F.abs(a["r"] - b["r"]) == 1) & (F.abs(a["c"] - b["c"]) == 1), DIAGONAL).otherwise(1.0))
    return F.aggregate(step, F.lit(0.0), lambda t, x: t + x)


def damaged_share(hit: Column) -> Column:
    n = F.aggregate(hit, F.lit(0), lambda t, x: t + x.cast("int"))
    return (n >= DAMAGED_PIXELS) & (n >= DAMAGED_RATIO * F.size(hit))


def chains(pixels: DataFrame) -> DataFrame:
    """Lines between nodes (pixels without exactly two neighbours) of skeleton pixels (raster_id, p, hit): raster_id, head (the node
    it starts at), way (the next pixel), path: array of (place, q, hit) without the head, head_hit. Each line once, from its smaller node, a loop
    by the smaller way. Rings without a node have no line."""
    offsets = F.array(*[F.lit(i * ROW + j).cast("long") for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    near = pixels.select("raster_id", "p", F.col("hit").alias("p_hit"), F.explode(F.transform(offsets, lambda o: o + F.col("p"))).alias("q"))
    arcs = near.join(large(pixels.select("raster_id", F.col("p").alias("q"), F.col("hit").alias("q_hit"))), ["raster_id", "q"])
    arcs = staged(arcs.select("raster_id", "p", "q", "p_hit", "q_hit"), "arcs")
    degree = arcs.groupBy("raster_id", "p").agg(F.count(F.lit(1)).alias("degree"), F.sum("q").alias("both"))
    node = F.col("degree") != 2
    told = arcs.join(large(degree), ["raster_id", "p"])
    # Where an arc's line starts, as far as is known: at itself if it leaves a node, else at the arc before it.
    reach = told.select("raster_id", "p", "q", F.when(node, F.col("p")).otherwise(F.col("both") - F.col("q")).alias("hp"), F.when(node, F.col("q")).otherwise(F.col("p")).alias("hq"), F.when(node, 0).otherwise(1).alias("place"), node.alias("done"))
    reach = staged(reach, "lines")
    while True:
        ahead = reach.select("raster_id", F.col("p").alias("hp"), F.col("q").alias("hq"), F.col("hp").alias("np"), F.col("hq").alias("nq"), F.col("place").alias("more"), F.col("done").alias("there"))
        going = reach.where("NOT done").join(large(ahead), ["raster_id", "hp", "hq"])
        moved = going.select("raster_id", "p", "q", F.col("np").alias("hp"), F.col("nq").alias("hq"), (F.col("place") + F.col("more")).alias("place"), F.col("there").alias("done"), F.col("there").alias("new"))
        after = staged(reach.where("done").withColumn("new", F.lit(False)).unionByName(moved), "lines")
        reach = after.drop("new")
        if after.where("new").isEmpty():  # what is left runs in rings
            break
    hits = arcs.select("raster_id", "p", "q", "q_hit", "p_hit")
    lines = reach.where("done").join(large(hits), ["raster_id", "p", "q"]).groupBy("raster_id", F.col("hp").alias("head"), F.col("hq").alias("way"))
    lines = lines.agg(F.array_sort(F.collect_list(F.struct("place", "q", F.col("q_hit").alias("hit"), "p"))).alias("path"), F.max(F.when(F.col("place") == 0, F.col("p_hit"))).alias("head_hit"))
    last = F.element_at("path", -1)
    return lines.where((F.col("head") < last["q"]) | ((F.col("head") == last["q"]) & (F.col("way") <= last["p"])))


def _split(batches):
    """Lines cut where they turn, at least ``TURN_STEPS`` steps behind the last cut."""
    for rows in batches:
        out = []
        for raster, head, way, path, head_hit in zip(rows["raster_id"], rows["head"], rows["way"], rows["path"], rows["head_hit"], strict=True):
            at = [head, *(s["q"] for s in path)]
            hit = [bool(head_hit), *(bool(s["hit"]) for s in path)]
            at = [(int(p) // ROW, int(p) % ROW) for p in at]
            start, piece = 0, 0
            for i in range(1, len(at)):
                ends = i == len(at) - 1
                if not ends:
                    into, out_of = (at[i][0] - at[i - 1][0], at[i][1] - at[i - 1][1]), (at[i + 1][0] - at[i][0], at[i + 1][1] - at[i][1])
                    cosine = (into[0] * out_of[0] + into[1] * out_of[1]) / (np.hypot(*into) * np.hypot(*out_of) + 1e-6)
                    turns = np.degrees(np.arccos(np.clip(cosine, -1, 1))) >= TURN_DEGREES and i - start >= TURN_STEPS
                if ends or turns:
                    u, v = at[start], at[i]
                    if u != v:
                        pixels = [{"r": r, "c": c} for r, c in at[start : i + 1]]
                        out.append((raster, head, way, piece, u[0] * ROW + u[1], v[0] * ROW + v[1], start > 0, not ends, pixels, hit[start : i + 1]))
                    start, piece = i, piece + 1
        yield pd.DataFrame(out, columns=["raster_id", "head", "way", "piece", "u", "v", "u_turn", "v_turn", "pixels", "hit"])


def centerlines(mask: DataFrame, height: int, width: int, intact: tuple = (1,), damaged: tuple = (2, 3), tile: int = 256) -> DataFrame:
    """Road edges of masks (raster_id, r, c, value): raster_id, u, v (codes of their end pixels), length, damaged, pixels.

    Objects of fewer than ``LEAST_PIXELS`` cells go, gaps are closed, the rest is thinned; lines run between pixels without exactly two
    neighbours and are cut where they turn; of several lines between two nodes the first counts. An edge is damaged if half of its
    pixels are; at junctions, ``JUNCTION_TRIM`` pixels do not count; short connectors of junctions with two intact arms are intact.
    """
    roads = mask.where(F.col("value").isin(*intact, *damaged)).select("raster_id", "r", "c", "value")
    regions = raster_components(roads.withColumn("value", F.lit(1)), same_class=False, tile=tile)
    stay = regions.groupBy("raster_id", "region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_PIXELS)
    kept = regions.join(large(stay), ["raster_id", "region"], "left_semi").select("raster_id", "r", "c")
    thin = skeleton(staged(closed(kept, height, width, tile), "closed"), tile)
    hurt = roads.where(F.col("value").isin(*damaged)).select("raster_id", "r", "c", F.lit(True).alias("hurt")).distinct()
    pixels = thin.join(large(hurt), ["raster_id", "r", "c"], "left").select("raster_id", code(F.col("r"), F.col("c")).alias("p"), F.coalesce("hurt", F.lit(False)).alias("hit"))
    cut = chains(staged(pixels, "pixels")).mapInPandas(_split, LINE)
    first = F.row_number().over(Window.partitionBy("raster_id", F.least("u", "v"), F.greatest("u", "v")).orderBy("head", "way", "piece"))
    edges = staged(cut.withColumn("nth", first).where("nth = 1").drop("nth"), "cut-lines")
    return relaxed_junctions(edges).select("raster_id", "u", "v", steps_length(F.col("pixels")).alias("length"), "damaged", "pixels")


def relaxed_junctions(edges: DataFrame) -> DataFrame:
    """Column ``damaged`` of cut lines, with the junction rules."""
    ends = edges.select("raster_id", F.explode(F.array("u", "v")).alias("node"))
    degree = staged(ends.groupBy("raster_id", "node").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    for side in ("u", "v"):
        edges = edges.join(large(degree.select("raster_id", F.col("node").alias(side), F.col("degree").alias(f"{side}_degree"))), ["raster_id", side])
    junction = {s: F.col(f"{s}_degree") >= JUNCTION_DEGREE for s in ("u", "v")}
    trim = {s: F.when(junction[s], JUNCTION_TRIM).otherwise(0) for s in ("u", "v")}
    # The left end is that of the node made first, and turns are made after all others: from a turn to a node the ends change sides.
    swapped = F.col("u_turn") & ~F.col("v_turn")
    left, right = F.when(swapped, trim["v"]).otherwise(trim["u"]), F.when(swapped, trim["u"]).otherwise(trim["v"])
    rest = F.size("hit") - left - right
    edges = edges.withColumn("damaged", F.when(rest > 0, damaged_share(F.slice("hit", left + 1, F.greatest(F.lit(0), rest)))).otherwise(damaged_share(F.col("hit"))))
    edges = staged(edges.withColumn("length", steps_length(F.col("pixels"))), "edges")
    wide = lambda c: F.col("raster_id") * (1 << 32) + F.col(c)
    short = edges.where(junction["u"] & junction["v"] & (F.col("length") <= CONNECTOR_PX))
    groups = components(short.select(wide("u").alias("a"), wide("v").alias("b")), "junctions")
    placed = edges.withColumn("wu", wide("u")).withColumn("wv", wide("v"))
    for side in ("u", "v"):
        placed = placed.join(large(groups.select(F.col("node").alias(f"w{side}"), F.col("root").alias(f"{side}_group"))), f"w{side}", "left")
    placed = staged(placed.drop("wu", "wv"), "junctions")
    arms = placed.where("NOT damaged AND NOT (u_group <=> v_group)").select(F.explode(F.array("u_group", "v_group")).alias("group")).where(F.col("group").isNotNull())
    free = arms.groupBy("group").agg(F.count(F.lit(1)).alias("arms")).where(F.col("arms") >= INTACT_ARMS)
    inner = F.when(F.col("u_group") == F.col("v_group"), F.col("u_group"))
    told = placed.withColumn("group", inner).join(large(free), "group", "left")
    return told.withColumn("damaged", F.col("damaged") & ~(F.col("arms").isNotNull() & (F.col("length") <= CONNECTOR_PX)))


def road_graph(lines: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph, node, r, c, degree) and edges (graph, u, v, length, damaged, pixels) of lines (raster_id, pixels, damaged): end pixels
    are nodes, lines of fewer than two pixels go, of several lines between two nodes the last by ``order`` counts."""
    end = lambda i: code(F.element_at("pixels", i)["r"], F.element_at("pixels", i)["c"])
    rows = lines.where(F.size("pixels") >= 2).withColumns({"u": end(1), "v": end(-1), "graph": F.col("raster_id")})
    if order:
        last = F.row_number().over(Window.partitionBy("graph", F.least("u", "v"), F.greatest("u", "v")).orderBy(F.desc(order)))
        rows = rows.withColumn("nth", last).where("nth = 1")
    edges = rows.select("graph", "u", "v", steps_length(F.col("pixels")).alias("length"), F.coalesce("damaged", F.lit(False)).alias("damaged"), "pixels")
    ends = edges.select("graph", F.explode(F.array("u", "v")).alias("node"))
    nodes = ends.groupBy("graph", "node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("graph", "node", F.floor(F.col("node") / ROW).cast("int").alias("r"), (F.col("node") % ROW).cast("int").alias("c"), "degree"), edges


def snapped(edges: DataFrame, points: DataFrame, reach: int) -> DataFrame:
    """For each point (id, side, graph, r, c) the pixel of an edge it is moved to: the nearest intact one of the ``SNAP_SAMPLES`` nearest
    pixels within ``reach``, else the nearest damaged one; ties to the smaller row, column and edge. Points too far have no row."""
    size = max(1, reach)
    cell = lambda c: F.floor(F.col(c) / size)
    samples = edges.select("graph", "u", "v", "damaged", F.posexplode("pixels").alias("at", "pixel")).select("graph", "u", "v", "damaged", "at", F.col("pixel.r").alias("pr"), F.col("pixel.c").alias("pc"))
    samples = samples.withColumns({"bx": cell("pc"), "by": cell("pr")})
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    asked = points.select("id", "side", "graph", "r", "c", F.explode(around).alias("i")).select("*", F.explode(around).alias("j")).withColumns({"bx": cell("c") + F.col("j"), "by": cell("r") + F.col("i")})
    far = (F.col("pr") - F.col("r")) * (F.col("pr") - F.col("r")) + (F.col("pc") - F.col("c")) * (F.col("pc") - F.col("c"))
    near = asked.join(large(samples), ["graph", "bx", "by"]).withColumn("d2", far).where(F.col("d2") <= reach * reach)
    nearest = F.rank().over(Window.partitionBy("id", "side").orderBy("d2", "pr", "pc"))
    near = near.withColumn("nearest", nearest).where(F.col("nearest") <= SNAP_SAMPLES)
    best = F.row_number().over(Window.partitionBy("id", "side").orderBy("damaged", "d2", "pr", "pc", "u", "v", "at"))
    return near.withColumn("best", best).where("best = 1").select("id", "side", "graph", "u", "v", "at", "pr", "pc", "damaged")


def snapped_routes(edges: DataFrame, requests: DataFrame, pixel_m: float = 1.0, reach: int = SNAP_PX) -> DataFrame:
    """Shortest ways over intact edges (graph, u, v, length, damaged, pixels) between two pixels each (id, graph, sr, sc, er, ec).

    Both ends are moved to the nearest road pixel, and the edge there is cut in two. One row a request: id, status, distance_px, distance_m,
    start_r, start_c, end_r, end_c (the pixels moved to) and path, the way's pixels. status is ok, no_roads (the graph has no edges),
    snap_failed (an end is farther than ``reach`` from any road), snapped_on_damaged, or no_path; without a way distance and path are null,
    and without a snap the ends are the request's own. All requests are searched together.
    """
    edges = staged(edges.select("graph", "u", "v", "length", "damaged", "pixels"), "road-edges")
    side = lambda name, r, c: requests.select("id", "graph", F.lit(name).alias("side"), F.col(r).alias("r"), F.col(c).alias("c"))
    picks = snapped(edges, side("s", "sr", "sc").unionByName(side("t", "er", "ec")), reach)
    # How far the pixel lies from the edge's two ends along it.
    own = picks.join(large(edges.select("graph", "u", "v", "pixels")), ["graph", "u", "v"])
    own = own.withColumn("to_u", steps_length(F.slice("pixels", 1, F.col("at") + 1))).withColumn("to_v", steps_length(F.slice("pixels", F.col("at") + 1, F.size("pixels") - F.col("at"))))
    own = staged(own.withColumn("p", code(F.col("pr"), F.col("pc"))), "snaps")
    fields = ("u", "v", "at", "pr", "pc", "damaged", "to_u", "to_v", "p", "pixels")
    ends = requests.select("id", "graph", "sr", "sc", "er", "ec")
    for s in ("s", "t"):
        ends = ends.join(large(own.where(F.col("side") == s).select("id", *[F.col(f).alias(f"{s}_{f}") for f in fields])), "id", "left")
    known = edges.select("graph").distinct().withColumn("known", F.lit(True))
    ends = ends.join(large(known), "graph", "left")
    missing = F.col("s_u").isNull() | F.col("t_u").isNull()
    problem = F.when(F.col("known").isNull(), "no_roads").when(missing, "snap_failed").when(F.col("s_damaged") | F.col("t_damaged"), "snapped_on_damaged")
    ends = staged(ends.withColumn("problem", problem), "requests")
    open_ = ends.where("problem IS NULL")
    # The cut edges: from the start to its edge's ends, from the target's edge's ends to the target, and between the two on one edge.
    first = open_.select("id", F.explode(F.array(F.struct(F.col("s_u").alias("node"), F.col("s_to_u").alias("w")), F.struct(F.col("s_v").alias("node"), F.col("s_to_v").alias("w")))).alias("e"))
    start = open_.select("id", "graph", F.col("s_p").alias("node"), F.lit(0.0).alias("d"), F.lit(None).cast("long").alias("before"), F.lit(0).alias("hops"))
    leave = first.select("id", F.col("e.node").alias("to"), F.col("e.w").alias("w")).join(large(open_.select("id", F.col("s_p").alias("from"))), "id")
    arrive = open_.select("id", F.explode(F.array(F.struct(F.col("t_u").alias("node"), F.col("t_to_u").alias("w")), F.struct(F.col("t_v").alias("node"), F.col("t_to_v").alias("w")))).alias("e"), F.col("t_p").alias("to")).select("id", F.col("e.node").alias("from"), "to", F.col("e.w").alias("w"))
    same = (F.col("s_u") == F.col("t_u")) & (F.col("s_v") == F.col("t_v"))
    straight = open_.where(same).select("id", F.col("s_p").alias("from"), F.col("t_p").alias("to"), F.abs(F.col("s_to_u") - F.col("t_to_u")).alias("w"))
    extra = staged(leave.select("id", "from", "to", "w").unionByName(arrive).unionByName(straight).where(F.col("from") != F.col("to")), "cut-edges")
    intact = edges.where("NOT damaged")
    both = intact.select("graph", F.col("u").alias("from"), F.col("v").alias("to"), F.col("length").alias("w"))
    both = staged(both.unionByName(both.select("graph", F.col("to").alias("from"), F.col("from").alias("to"), "w")), "ways")
    best = staged(start, "front")
    front = best
    while True:
        offers = front.join(large(both), [front["graph"] == both["graph"], front["node"] == both["from"]]).select("id", front["graph"], F.col("to").alias("node"), (F.col("d") + F.col("w")).alias("d"), F.col("from").alias("before"), (F.col("hops") + 1).alias("hops"))
        own_offers = front.join(large(extra.withColumnRenamed("id", "own")), (F.col("id") == F.col("own")) & (front["node"] == F.col("from"))).select("id", "graph", F.col("to").alias("node"), (F.col("d") + F.col("w")).alias("d"), F.col("from").alias("before"), (F.col("hops") + 1).alias("hops"))
        offer = offers.unionByName(own_offers).groupBy("id", "graph", "node").agg(F.min(F.struct("d", "hops", "before")).alias("offer"))
        better = F.col("d").isNull() | (F.col("offer.d") < F.col("d"))
        after = best.join(offer, ["id", "graph", "node"], "full").withColumn("moved", F.coalesce(better & F.col("offer").isNotNull(), F.lit(False)))
        pick = lambda f: F.when(F.col("moved"), F.col(f"offer.{f}")).otherwise(F.col(f)).alias(f)
        after = staged(after.select("id", "graph", "node", pick("d"), pick("before"), pick("hops"), "moved"), "front")
        best, front = after.drop("moved"), after.where("moved").drop("moved")
        if front.isEmpty():
            break
    way = _walked(best, open_.select("id", F.col("t_p").alias("node")))
    target = open_.select("id", F.col("t_p").alias("node")).join(large(best.select("id", "node", "d")), ["id", "node"]).select("id", "d")
    # A step's pixels: the edge's, or the part of it between the cut and the step's other end.
    hop = way.select("id", "graph", "node", "before", "nth").join(large(ends.select("id", *[f"{s}_{f}" for s in ("s", "t") for f in ("p", "u", "v", "at", "pixels")])), "id")
    line = intact.select("graph", F.col("u"), F.col("v"), "pixels", F.col("length").alias("w"))
    line = line.unionByName(line.select("graph", F.col("v").alias("u"), F.col("u").alias("v"), F.reverse("pixels").alias("pixels"), "w"))
    hop = hop.join(large(line.select("graph", F.col("u").alias("before"), F.col("v").alias("node"), F.col("pixels").alias("whole"))), ["graph", "before", "node"], "left")

    def part(pixels: Column, i: Column, j: Column) -> Column:
        """Pixels i to j (from 0), in the direction from i to j."""
        run = F.slice(pixels, F.least(i, j) + 1, F.abs(i - j) + 1)
        return F.when(i <= j, run).otherwise(F.reverse(run))

    place = lambda s, n: F.when(n == F.col(f"{s}_p"), F.col(f"{s}_at")).when(n == F.col(f"{s}_u"), 0).when(n == F.col(f"{s}_v"), F.size(f"{s}_pixels") - 1)
    a, b = F.col("before"), F.col("node")
    on_s = part(F.col("s_pixels"), place("s", a), F.when(same & (b == F.col("t_p")), F.col("t_at")).otherwise(place("s", b)))
    on_t = part(F.col("t_pixels"), place("t", a), place("t", b))
    pieces = F.coalesce(on_s, on_t, F.col("whole"))
    hop = hop.withColumn("piece", F.when(F.col("before").isNull(), F.array(F.struct(F.floor(b / ROW).cast("int").alias("r"), (b % ROW).cast("int").alias("c")))).otherwise(F.slice(pieces, 2, F.greatest(F.lit(0), F.size(pieces) - 1))))
    path = hop.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", "piece"))), lambda s: s["piece"])).alias("path"))
    told = ends.join(large(target), "id", "left").join(large(path), "id", "left")
    pixel = lambda s, k, mine: F.when(F.col("problem").isin("no_roads", "snap_failed"), F.col(mine)).otherwise(F.col(f"{s}_{k}"))
    return told.select(
        "id", F.coalesce("problem", F.when(F.col("d").isNull(), "no_path").otherwise("ok")).alias("status"), F.col("d").alias("distance_px"), (F.col("d") * pixel_m).alias("distance_m"),
        pixel("s", "pr", "sr").alias("start_r"), pixel("s", "pc", "sc").alias("start_c"), pixel("t", "pr", "er").alias("end_r"), pixel("t", "pc", "ec").alias("end_c"), F.when(F.col("d").isNotNull(), F.col("path")).alias("path"),
    )


def _walked(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """The nodes on the way to each target (id, node) in the trees (id, graph, node, before, hops), with their number from the root as nth. The
    reach doubles every round: a node's 2^k-th predecessor is the 2^(k-1)-th one's 2^(k-1)-th."""
    jump = staged(tree.select("id", "node", F.col("before").alias("far")).where("far IS NOT NULL"), "jumps")
    on = targets
    while True:
        ahead = on.join(large(jump), ["id", "node"]).select("id", F.col("far").alias("node"))
        more = staged(on.unionByName(ahead).distinct(), "way")
        if jump.isEmpty():
            break
        on = more
        next_ = jump.select("id", F.col("node").alias("far"), F.col("far").alias("farther"))
        jump = staged(jump.join(large(next_), ["id", "far"]).select("id", "node", F.col("farther").alias("far")), "jumps")
    return more.join(large(tree), ["id", "node"]).withColumn("nth", F.col("hops"))
