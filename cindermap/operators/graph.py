"""Road graphs: edges (graph, u, v, length, damaged), many graphs at once. Iterations write each round to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindermap.sources.shared import staged


def build_graph(lines: DataFrame) -> DataFrame:
    """Nodes' degrees from edges: graph, node, degree."""
    ends = lines.select("graph", F.explode(F.array("u", "v")).alias("node"))
    return ends.groupBy("graph", "node").agg(F.count(F.lit(1)).alias("degree"))


def stars(edges: DataFrame) -> bool:
    """Whether ``edges`` (u, v: distinct, u > v) are stars around their smallest nodes: no u has a second v or is the v of another edge."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select(F.col("v"), F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg((F.sum("down") + F.max("up")).alias("n")).where("n > 1").limit(1).count()


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """``edges`` (a, b: long) to (node, root: long): each node that an edge names, and the smallest node it reaches.

    Every round is two aggregations and joins on the edges that are left, whose number never grows; the rounds are
    about logarithmic in the longest path, and end when the edges are stars. Each is written to the shared folder, so a lost executor costs one round.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), purpose)
    while not stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        now = staged(small.where("u <> v").distinct(), purpose)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Cells whose tiles are labelled together.
LABELLED = 200_000


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0..n-1 reaches over the edges (a, b): roots take over the smaller of two roots, then paths are cut short."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (root != root[root]).any():
            root = root[root]


def _tile_regions(same_class: bool, tile: int):
    """Regions within tiles; a region's number is its smallest cell number. Rows come tile by tile, row by row; many tiles are one array."""

    def label(rows: pa.Table) -> pa.RecordBatch:
        r, c, value, cell = (rows.column(k).to_numpy() for k in ("r", "c", "value", "cell"))
        at = np.stack([rows.column(k).to_numpy() for k in ("raster_id", "tr", "tc")])
        number = np.concatenate([[0], np.cumsum((np.diff(at, axis=1) != 0).any(0))])
        key = number * tile * tile + (r % tile).astype(np.int64) * tile + c % tile
        below = np.searchsorted(key, key + tile)
        below[below == len(key)] = 0
        beside = np.flatnonzero((np.diff(key) == 1) & (np.diff(c) == 1) & (np.diff(number) == 0))
        under = np.flatnonzero((key[below] == key + tile) & (r % tile < tile - 1))
        a, b = np.concatenate([beside, under]), np.concatenate([beside + 1, below[under]])
        kept = value[a] == value[b] if same_class else np.ones(len(a), bool)
        region = cell[joined(len(cell), a[kept], b[kept])]
        names = [n for n in rows.column_names if n not in ("tr", "tc", "cell")]
        return pa.RecordBatch.from_arrays([*(rows.column(n).combine_chunks() for n in names), pa.array(region, pa.int64())], [*names, "region"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for rows in batches:
            held.append(rows)
            size += rows.num_rows
            if size < LABELLED:
                continue
            whole = pa.Table.from_batches(held)
            last = np.stack([whole.column(k).to_numpy() for k in ("raster_id", "tr", "tc")])
            cut = np.flatnonzero((np.diff(last, axis=1) != 0).any(0))  # a tile stays whole: its last rows may still come
            if len(cut):
                yield label(whole.slice(0, int(cut[-1]) + 1))
                held = whole.slice(int(cut[-1]) + 1).to_batches()
                size = whole.num_rows - int(cut[-1]) - 1
        if size:
            yield label(pa.Table.from_batches(held))

    return run


def raster_components(mask: DataFrame, same_class: bool, tile: int = 256) -> DataFrame:
    """4-connected regions of non-zero cells (of one class, or of any): raster_id, r, c, value, region (its smallest cell number).

    Tiles of bounded size are labelled each in one task; only cells on the tiles' edges link regions of different tiles.
    """
    cell = (F.col("raster_id") * (1 << 20) + F.col("r")) * (1 << 20) + F.col("c")
    cells = mask.where("value > 0").select("raster_id", "r", "c", "value", cell.alias("cell"), F.floor(F.col("r") / tile).alias("tr"), F.floor(F.col("c") / tile).alias("tc"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.schema if f.name not in ("tr", "tc", "cell")) + ", region long"
    dealt = cells.repartition("raster_id", "tr", "tc").sortWithinPartitions("raster_id", "tr", "tc", "r", "c")
    labelled = staged(dealt.mapInArrow(_tile_regions(same_class, tile), schema), "regions")
    links = None
    for axis in ("r", "c"):
        last = labelled.where(F.col(axis) % tile == tile - 1).withColumn(axis, F.col(axis) + 1).select("raster_id", "r", "c", F.col("value").alias("other"), F.col("region").alias("a"))
        near = labelled.where(F.col(axis) % tile == 0).join(last, ["raster_id", "r", "c"])
        near = (near.where("value = other") if same_class else near).select("a", F.col("region").alias("b"))
        links = near if links is None else links.union(near)
    found = components(links)
    return labelled.join(found, labelled["region"] == found["node"], "left").select("raster_id", "r", "c", "value", F.coalesce("root", "region").alias("region"))


def shortest(edges: DataFrame, source: int, cost) -> DataFrame:
    """Least cost from ``source`` to each node it reaches, in each graph; ``cost`` is a struct or number column of the edges."""
    one_way = edges.select(F.col("graph").alias("g"), F.col("u").alias("from"), F.col("v").alias("to"), cost.alias("w"))
    both = staged(one_way.union(one_way.select("g", "to", "from", "w")), "edges")
    zero = F.lit(0).cast("long")
    best = staged(edges.select("graph").distinct().select("graph", F.lit(source).cast("long").alias("node"), F.struct(zero.alias("repairs"), zero.alias("length")).alias("d")), "front")
    front = best
    while True:
        step = front.join(both, (F.col("graph") == F.col("g")) & (F.col("node") == F.col("from")))
        offers = step.select("graph", F.col("to").alias("node"), F.struct((F.col("d.repairs") + F.col("w.repairs")).alias("repairs"), (F.col("d.length") + F.col("w.length")).alias("length")).alias("d"))
        offers = offers.groupBy("graph", "node").agg(F.min("d").alias("offer"))
        after = staged(best.join(offers, ["graph", "node"], "full").select("graph", "node", F.least("d", "offer").alias("d"), (F.col("d").isNull() | (F.col("offer") < F.col("d"))).alias("moved")), "front")
        front = after.where("moved").select("graph", "node", "d")
        best = after.select("graph", "node", "d")
        if not front.limit(1).count():
            return best.select("graph", "node", "d.repairs", "d.length")


def shortest_path(edges: DataFrame, source: int) -> DataFrame:
    """Lengths over intact edges alone."""
    cost = F.struct(F.lit(0).cast("long").alias("repairs"), F.col("length").cast("long").alias("length"))
    return shortest(edges.where("NOT damaged"), source, cost).select("graph", "node", "length")


def repair_min_edges(edges: DataFrame, source: int) -> DataFrame:
    """Fewest damaged edges to repair, then least length, to each node."""
    return shortest(edges, source, F.struct(F.col("damaged").cast("long").alias("repairs"), F.col("length").cast("long").alias("length")))


def routes(edges: DataFrame, source: int, target: int, repair: bool = False) -> DataFrame:
    """Edges of the best route in each graph: graph, seq (from 1 at the source), u, v, length, damaged; v is the later node.

    The route is shortest over intact edges, or with ``repair`` the one with fewest damaged edges and then the least length; its
    damaged rows are the edges to repair. Of equal routes the one with fewest edges counts, then each step back takes the smallest node. Graphs without a route have no
    rows, and neither has a route from a node to itself. A round writes the routes' next edges, so rounds grow with the longest route.
    """
    if not repair:
        edges = edges.where("NOT damaged")
    # Below the whole lengths a cost counts edges, so that every edge costs something and no route can circle.
    spend = F.col("length").cast("long") * (1 << 20) + 1
    cost = F.struct((F.col("damaged").cast("long") if repair else F.lit(0).cast("long")).alias("repairs"), spend.alias("length"))
    best = shortest(edges, source, cost).select("graph", "node", F.struct("repairs", "length").alias("d"))
    ways = edges.select("graph", F.col("u").alias("p"), F.col("v").alias("node"), "length", "damaged")
    ways = ways.unionByName(edges.select("graph", F.col("v").alias("p"), F.col("u").alias("node"), "length", "damaged"))
    before = best.select("graph", F.col("node").alias("p"), F.col("d").alias("pd"))
    # Edges that lie on some best route; each node keeps the one from its smallest predecessor.
    spent = F.struct((F.col("pd.repairs") + F.when(F.lit(repair) & F.col("damaged"), 1).otherwise(0)).alias("repairs"), (F.col("pd.length") + spend).alias("length"))
    tight = ways.join(before, ["graph", "p"]).join(best, ["graph", "node"]).where(spent == F.col("d")).where(F.col("node") != source)
    tree = staged(tight.groupBy("graph", "node").agg(F.min(F.struct("p", "length", "damaged")).alias("e")).select("graph", "node", "e.*"), "routes")
    front = staged(best.where(F.col("node") == target).select("graph", F.col("node").alias("at"), F.lit(0).alias("back")), "routes")
    found = []
    while True:
        hop = front.join(tree, (front["graph"] == tree["graph"]) & (F.col("at") == F.col("node")))
        hop = staged(hop.select(front["graph"], "back", F.col("p").alias("u"), F.col("at").alias("v"), "length", "damaged"), "routes")
        if hop.isEmpty():
            break
        found.append(hop)
        front = hop.select("graph", F.col("u").alias("at"), (F.col("back") + 1).alias("back"))
    rows = hop
    for f in found:
        rows = rows.unionByName(f)
    hops = rows.groupBy("graph").agg(F.max("back").alias("most"))
    return rows.join(hops, "graph").select("graph", (F.col("most") - F.col("back") + 1).alias("seq"), "u", "v", "length", "damaged")


def farthest_pair(edges: DataFrame, purpose: str = "pairs") -> DataFrame:
    """For each graph, the pair to route where none is named: the smallest node of the largest component (the one with the smallest
    node on ties) and the node most edges away from it (the smallest on ties): graph, source, target, hops. Nodes are whole numbers from 0 to 2^32 - 1, graphs below 2^31."""
    nodes = edges.select("graph", F.explode(F.array("u", "v")).alias("node")).distinct()
    code = lambda c: F.col("graph") * (1 << 32) + F.col(c)
    roots = components(edges.select(code("u").alias("a"), code("v").alias("b")), purpose).withColumnRenamed("node", "code")
    sized = nodes.withColumn("code", code("node")).join(roots, "code")
    sizes = sized.groupBy("graph", "root").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("source"))
    chosen = sizes.groupBy("graph").agg(F.max_by("source", F.struct("n", -F.col("source"))).alias("source"))
    # One search for all graphs: each starts from the node that is renumbered to -1.
    start = lambda c: F.when(F.col(c) == F.col("source"), -1).otherwise(F.col(c)).cast("long").alias(c)
    own = edges.join(chosen, "graph").select("graph", start("u"), start("v"), F.lit(1).alias("length"), F.lit(False).alias("damaged"))
    hops = shortest_path(own, -1).groupBy("graph").agg(F.max_by("node", F.struct("length", -F.col("node"))).alias("target"), F.max("length").alias("hops"))
    return chosen.join(hops, "graph").select("graph", "source", "target", "hops")
