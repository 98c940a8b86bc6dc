"""Operator 11: exact top-k inner products by norm-bucketed retrieval.

Components become whole numbers, floor(1024 x), and the score is their integer inner product.

1. Vectors are grouped by length into buckets whose longest and shortest member differ by less than a tenth, and a bucket into
   blocks of bounded bytes (``BLOCK_BYTES``), so neither a hot length nor a hot vector makes a large task.
2. Every query's score with the ``SEEDS`` longest vectors (a bounded sample) gives it a floor: its k-th best is at least that.
   A query skips each bucket whose longest vector, at an angle of zero, stays below the floor.
3. In a block the floor becomes a local cosine threshold, floor / (|query| longest). Above ``COORDINATE_FROM`` the block prunes by
   coordinates: a unit vector that reaches the threshold has each coordinate in an interval around the query's, so the
   sorted lists of the query's ``FOCUS`` largest coordinates leave few candidates. Below it the intervals are wide, and
   the block prunes by length alone: candidates are the vectors of at least floor / |query|.
4. Candidates' products are computed exactly; each block returns a query's k best that reach the floor, and a window ranks
   them.

Tasks stream: a block's vectors come first, then its queries batch by batch, so a task holds one block whatever the number
of queries. Vectors are shuffled once; queries once a block they visit. Bounds are widened by ``SLACK`` against rounding.

Defined cases: vectors that are null or hold null or non-finite components take no part; zero vectors do, and so do vectors of
other sizes (absent components count as zero). Rows with a null vec_id take no part. Rows that repeat a vec_id are candidates
each, but not of the query with that vec_id; of query rows with one vec_id the smallest vector asks. Ties go to the smaller
vec_id. Fewer candidates than k give all; empty tables give an empty result; other columns are ignored. Scores are exact at any
size; those beyond 64 bits are held at the largest or smallest long, and tie there.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cindermap.llm.common import batch, staged, table

K = 10
SCALE = 1024.0
#: Buckets an octave of length: members differ by a factor of 2 ** (1/8).
OCTAVE = 8
BLOCK_BYTES = 16 << 20
#: Blocks there are at least, where rows suffice, so that small tables use more than one task.
LEAST_BLOCKS, LEAST_ROWS = 32, 256
SEEDS = 1024
COORDINATE_FROM, FOCUS = 0.7, 6
#: Products computed at once.
AT_ONCE = 1 << 20
SLACK = 1e-9
EXACT = 2.0**53
LONG = np.iinfo(np.int64)
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
ROWS = pa.schema([("vec_id", pa.int64()), ("is_query", pa.bool_()), ("vector", pa.list_(pa.float64())), ("length", pa.float64()), ("width", pa.int32()), ("bucket", pa.int32()), ("salt", pa.int32())])
SENT = "vec_id long, is_query boolean, vector array<double>, length double, least double, block int"


def usable(vector: str = "embedding") -> Column:
    x = F.col(vector)
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """One row a vector, cut or filled with zeros to ``width``."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    offsets, values = vectors.offsets.to_numpy(), vectors.values.to_numpy()
    if np.array_equal(np.diff(offsets), np.full(len(vectors), width)):
        return values[offsets[0] : offsets[-1]].reshape(len(vectors), width)
    out = np.zeros((len(vectors), width))
    for i, (a, b) in enumerate(zip(offsets, offsets[1:], strict=False)):
        out[i, : min(width, b - a)] = values[a : min(b, a + width)]
    return out


def _whole_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        vectors = rows.column("embedding")
        offsets = vectors.offsets.to_numpy()
        values = vectors.values.to_numpy()[offsets[0] : offsets[-1]]
        with np.errstate(over="ignore"):
            values = np.clip(np.floor(values * SCALE), -np.finfo(float).max, np.finfo(float).max)
            squares = np.concatenate([[0.0], np.cumsum(values**2)]) if np.abs(values).max(initial=0) < 2**20 else None
            at = offsets - offsets[0]
            length = np.sqrt(np.diff(squares[at]) if squares is not None else [np.sum(values[a:b] ** 2) for a, b in zip(at, at[1:], strict=False)])
        sizes = np.diff(offsets)
        width = 2 ** np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int32)
        bucket = np.where(length > 0, np.floor(np.log2(np.clip(length, 1, 1e300)) * OCTAVE), -1).astype(np.int32)
        salt = np.random.default_rng().integers(0, 2**31 - 1, len(length), dtype=np.int32)
        yield batch(ROWS, rows.column("vec_id"), rows.column("is_query"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values)), length, width, bucket, salt)


def biggest(x: np.ndarray) -> float:
    return float(np.abs(x).max(initial=0))


def _ask(seed_ids: np.ndarray, seeds: np.ndarray, blocks: list[tuple[float, int, int]], k: int):
    """``blocks``: longest length, first block number and number of blocks of each bucket."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                ids, length = rows.column("vec_id").to_numpy(), rows.column("length").to_numpy()
                q = matrix(rows.column("vector"), seeds.shape[1])
                least = np.full(len(ids), -np.inf)
                if len(seeds) > k:
                    products = q @ seeds.T
                    products[ids[:, None] == seed_ids] = -np.inf
                    exact = np.abs(q).max(1, initial=0) * biggest(seeds) * seeds.shape[1] < EXACT
                    least = np.where(exact, np.partition(products, len(seeds) - k, axis=1)[:, len(seeds) - k], -np.inf)
                for longest, first, n in blocks:
                    with np.errstate(invalid="ignore"):
                        go = np.flatnonzero(~(longest * length * (1 + SLACK) < least))
                    if not len(go):
                        continue
                    own = rows.take(pa.array(go))
                    for block in range(first, first + n):
                        columns = [own.column(c) for c in ("vec_id", "is_query", "vector", "length")]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(least[go]), pa.array(np.full(len(go), block, np.int32))], ["vec_id", "is_query", "vector", "length", "least", "block"])

    return ask


class Block:
    """Vectors of about one length, longest first, with a sorted list a coordinate (made when first needed)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, length: np.ndarray):
        order = np.argsort(-length, kind="stable")
        self.ids, self.vectors, self.length = ids[order], vectors[order], length[order]
        self.by_id = np.argsort(self.ids, kind="stable")
        self.sorted_ids = self.ids[self.by_id]
        self.most = biggest(vectors)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """The unit vectors' coordinates f in ascending order, and whose they are."""
        if f not in self.lists:
            unit = self.vectors[:, f] / np.where(self.length > 0, self.length, 1)
            order = np.argsort(unit, kind="stable")
            self.lists[f] = unit[order], order
        return self.lists[f]

    def same(self, q_id: int) -> np.ndarray:
        a, b = np.searchsorted(self.sorted_ids, [q_id, q_id + 1])
        return self.by_id[a:b]

    def long_enough(self, least: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Length pruning: how many of the longest vectors can reach each query's floor."""
        with np.errstate(divide="ignore", invalid="ignore"):
            shortest = least / length * (1 - SLACK)
        n = np.searchsorted(-self.length, -shortest, side="right")
        return np.where((least > 0) & np.isfinite(shortest), n, np.where((least > 0) & (length == 0), 0, len(self.ids)))

    def near_coordinates(self, unit: np.ndarray, cosine: float) -> np.ndarray:
        """Coordinate pruning: the vectors whose focus coordinates allow an angle of at least ``cosine``."""
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        spread = np.sqrt(max(0.0, 1 - cosine**2)) * np.sqrt(np.maximum(0, 1 - unit[focus] ** 2)) + SLACK
        ranges = []
        for f, middle, s in zip(focus, unit[focus] * cosine, spread, strict=True):
            # An interval around cosine * q_f; beyond q_f itself the whole cap counts, so the side that q_f points to stays open.
            low, high = (middle - s, np.inf) if unit[f] >= cosine else (-np.inf, middle + s) if unit[f] <= -cosine else (middle - s, middle + s)
            values, whose = self.coordinate(int(f))
            ranges.append((np.searchsorted(values, low), np.searchsorted(values, high, side="right"), whose))
        ranges.sort(key=lambda r: r[1] - r[0])
        a, b, whose = ranges[0]
        found = np.sort(whose[a:b])
        for a, b, whose in ranges[1:]:
            if len(found) * 4 < b - a or not len(found):
                break  # the other lists cost more than the products they would save
            found = found[np.isin(found, whose[a:b])]
        return found

    def best(self, q_ids: np.ndarray, queries: np.ndarray, length: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple]:
        """(query ids, vec_ids, scores) of each query's k best that reach its floor."""
        if self.most * biggest(queries) * queries.shape[1] >= EXACT:
            yield from self._best_exact(q_ids, queries, k)
            return
        longest = self.length[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = least / (length * longest) * (1 - SLACK)
        cosine = np.where(np.isfinite(cosine), cosine, 0)
        reach = self.long_enough(least, length)
        reach[cosine > 1] = 0
        by_coordinate = (cosine >= COORDINATE_FROM) & (reach > 0)
        for i in np.flatnonzero(by_coordinate):
            near = self.near_coordinates(queries[i] / length[i], cosine[i])
            near = near[near < reach[i]]
            if len(near):
                near = near[self.ids[near] != q_ids[i]]
                yield self._top(q_ids[i : i + 1], (self.vectors[near] @ queries[i])[None], near, least[i : i + 1], k)
        rest = np.flatnonzero(~by_coordinate & (reach > 0))
        rest = rest[np.argsort(reach[rest], kind="stable")]
        at_once = max(1, AT_ONCE // len(self.ids))
        for own in (rest[i : i + at_once] for i in range(0, len(rest), at_once)):
            products = queries[own] @ self.vectors[: reach[own].max()].T
            for row, q_id in enumerate(q_ids[own]):
                same = self.same(q_id)
                products[row, same[same < products.shape[1]]] = -np.inf
            yield self._top(q_ids[own], products, np.arange(products.shape[1]), least[own], k)

    def _top(self, q_ids: np.ndarray, products: np.ndarray, whose: np.ndarray, least: np.ndarray, k: int) -> tuple:
        cut = np.maximum(least, np.finfo(float).min)
        if products.shape[1] > k:
            cut = np.maximum(cut, np.partition(products, products.shape[1] - k, axis=1)[:, products.shape[1] - k])
        row, column = np.nonzero(products >= cut[:, None])
        score, ids = products[row, column], self.ids[whose[column]]
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        return q_ids[row[kept]], ids[kept], score[kept].astype(np.int64)

    def _best_exact(self, q_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple]:
        own = [list(map(int, v)) for v in self.vectors]
        for q_id, query in zip(q_ids, queries, strict=True):
            q = list(map(int, query))
            scores = (max(LONG.min, min(LONG.max, sum(a * b for a, b in zip(v, q, strict=True)))) for v in own)
            found = heapq.nsmallest(k, ((-s, i) for s, i in zip(scores, self.ids.tolist(), strict=True) if i != q_id))
            yield np.full(len(found), q_id), np.array([i for _, i in found], np.int64), np.array([-s for s, _ in found], np.int64)


def _search(widths: list[int], k: int):
    """``widths``: of each block. Rows come block by block, a block's vectors before its queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ready = None, [], None
        for rows in batches:
            block, is_query = rows.column("block").to_numpy(), rows.column("is_query").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(block)], strict=True):
                if a == b:
                    continue
                if block[a] != at:
                    at, held, ready = int(block[a]), [], None
                part = rows.slice(a, b - a)
                ids, length = part.column("vec_id").to_numpy(), part.column("length").to_numpy()
                vectors = matrix(part.column("vector"), widths[at])
                if not is_query[a]:
                    held.append((ids, vectors.copy(), length))
                    continue
                if held:
                    ready, held = Block(*(np.concatenate(x) for x in zip(*held, strict=True))), []
                if ready is not None:
                    for found in ready.best(ids, vectors, length, part.column("least").to_numpy(), k):
                        if len(found[0]):
                            yield batch(FOUND, *found)

    return search


def top_products(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score (inner product of the whole-number vectors) of each query's k best."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable())
    # Written once: block and salt of a row must not change when a task is run again.
    rows = staged(rows.mapInArrow(_whole_numbers, "vec_id long, is_query boolean, vector array<double>, length double, width int, bucket int, salt int"), "whole-vectors")
    groups = rows.groupBy("width", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).orderBy(F.desc("longest"), "width").collect()
    total, blocks, widths, starts, counts = sum(g["n"] for g in groups), [], [], {}, {}
    for g in groups:
        most = max(1, min(BLOCK_BYTES // (8 * g["width"]), max(LEAST_ROWS, total // LEAST_BLOCKS)))
        name, n = f"{g['width']}/{g['bucket']}", -(-g["n"] // most)
        starts[name], counts[name] = len(widths), n
        blocks.append((g["longest"], len(widths), n))
        widths += [g["width"]] * n
    seeds = rows.orderBy(F.desc("length"), "vec_id").limit(SEEDS).select("vec_id", "vector").collect() if groups else []
    width = max([len(s["vector"]) for s in seeds], default=1)
    marks = np.array([s["vector"] + [0.0] * (width - len(s["vector"])) for s in seeds]).reshape(len(seeds), width)
    name = F.concat_ws("/", "width", "bucket")
    look = lambda d: F.create_map(*[F.lit(x) for item in d.items() for x in item])[name] if d else F.lit(1)
    stored = rows.select("vec_id", F.lit(False).alias("is_query"), "vector", "length", F.lit(0.0).alias("least"), (look(starts) + F.pmod("salt", look(counts))).cast("int").alias("block"))
    asking = rows.where("is_query").groupBy("vec_id").agg(F.min_by(F.struct("vector", "length"), "vector").alias("own")).select("vec_id", F.lit(True).alias("is_query"), "own.vector", "own.length")
    asked = asking.mapInArrow(_ask(np.array([s["vec_id"] for s in seeds], np.int64), marks, blocks, k), SENT)
    dealt = stored.unionByName(asked).repartition(max(1, len(widths)), "block").sortWithinPartitions("block", "is_query")
    found = dealt.mapInArrow(_search(widths, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
