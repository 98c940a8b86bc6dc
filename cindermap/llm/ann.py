"""Operator 1: nearest neighbours by a permutation index.

A vector is represented by the order of its ``PREFIX`` nearest pivots. Every pivot has an inverted file with the vectors that
name it and at what rank. A query reads the files of its own pivots and adds up, for each vector it meets, how far the two
orders' footrule distance falls below that of orders with nothing in common; the vectors of smallest footrule distance are
compared exactly, and the nearest stay.

Vectors are dealt to blocks of about ``BLOCK`` rows by a hash, each block with inverted files of its own; hot pivots so are spread over all
blocks. Every vector is shuffled once. The stated queries go to every block and stream past it batch by batch, so a task holds one block
and one batch, however many queries there are. Each block reranks ``SHARE`` of its rows and returns a query's k best, so that what is shuffled grows
with queries times blocks times k. Equal vectors of a block are indexed once, with all their ids, and entries that tie with the
last one to be reranked are reranked too, so a hot vector keeps neither its smaller ids nor other vectors out. Pivots are
the distinct vectors of a bounded sample (the ``PIVOTS`` smallest hashes of vec_id); all rows are indexed.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose number
of components is not the most frequent one (the larger, if two are); rows with a null vec_id take no part; rows that repeat a
vec_id are candidates each, but not of a query with that vec_id; ties go to the smaller vec_id; fewer candidates than k give all;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cindermap.llm.common import table

PIVOTS, PREFIX, SHARE = 256, 64, 0.12
BLOCK = 4096
K = 10
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vector: str = "embedding") -> Column:
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return x.isNotNull() & finite & F.exists(x, lambda v: v != 0)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each row's nearest pivots, nearest first."""
    near = (pivots**2).sum(1) - 2 * x @ pivots.T
    part = np.argpartition(near, prefix - 1, axis=1)[:, :prefix] if prefix < len(pivots) else np.tile(np.arange(len(pivots)), (len(x), 1))
    order = np.argsort(np.take_along_axis(near, part, 1), axis=1, kind="stable")
    return np.take_along_axis(part, order, 1)


class InvertedFiles:
    """For each pivot, the rows of a block that name it and the rank at which they do."""

    def __init__(self, orders: np.ndarray, pivots: int):
        n, self.prefix = orders.shape
        by_pivot = np.argsort(orders.ravel(), kind="stable")
        self.rows, self.ranks = by_pivot // self.prefix, by_pivot % self.prefix
        self.starts = np.searchsorted(orders.ravel()[by_pivot], np.arange(pivots + 1))
        self.n = n

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Footrule distance of every row's order to a query's; a pivot that an order does not name counts as ranked behind it."""
        p = self.prefix
        near = np.zeros(self.n, np.int64)
        for rank, pivot in enumerate(order):
            a, b = self.starts[pivot], self.starts[pivot + 1]
            # |rq - rx| instead of (p - rq) + (p - rx): less by 2 (p - max(rq, rx)).
            near[self.rows[a:b]] += p - np.maximum(rank, self.ranks[a:b])
        return p * (p + 1) - 2 * near


class Block:
    """Vectors with their inverted files. Equal vectors are one entry, with the rows that hold it in the order of their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, prefix: int, share: float, k: int):
        self.ids, self.pivots, self.prefix, self.k = ids, pivots, prefix, k
        self.distinct, entry = np.unique(vectors, axis=0, return_inverse=True)
        self.entry = entry.ravel()
        self.by_entry = np.lexsort((ids, self.entry))
        self.held = np.bincount(self.entry)
        self.starts = np.cumsum(self.held) - self.held
        self.files = InvertedFiles(nearest_pivots(self.distinct, pivots, prefix), len(pivots))
        self.most = min(len(self.distinct), max(20 * k, round(share * len(vectors))))
        by_id = np.argsort(ids, kind="stable")
        self.sorted_ids, self.by_id = ids[by_id], by_id

    def search(self, q_ids: np.ndarray, queries: np.ndarray) -> pa.RecordBatch:
        out: list[tuple] = []
        for order, q, q_id in zip(nearest_pivots(queries, self.pivots, self.prefix), queries, q_ids, strict=True):
            apart = self.files.footrule(order)
            near = np.flatnonzero(apart <= np.partition(apart, self.most - 1)[self.most - 1])
            a, b = np.searchsorted(self.sorted_ids, [q_id, q_id + 1])
            same_id = np.bincount(self.entry[self.by_id[a:b]], minlength=len(self.held))
            near = near[self.held[near] > same_id[near]]
            if not len(near):
                continue
            score = np.sqrt(((self.distinct[near] - q) ** 2).sum(1))
            kept = np.flatnonzero(score <= np.partition(score, min(self.k, len(near)) - 1)[min(self.k, len(near)) - 1])
            rows_of = [self.by_entry[self.starts[e] : self.starts[e] + min(self.held[e], self.k + same_id[e])] for e in near[kept]]
            score = np.repeat(score[kept], list(map(len, rows_of)))
            found = self.ids[np.concatenate(rows_of)]
            found, score = found[found != q_id], score[found != q_id]
            best = np.lexsort((found, score))[: self.k]
            out.append((np.full(len(best), q_id), found[best], score[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)


def _search(pivots: np.ndarray, prefix: int, share: float, k: int):
    """Rows come block by block, a block's vectors before its queries."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ready = None, [], None
        for rows in batches:
            block, is_query = rows.column("block").to_numpy(), rows.column("is_query").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(block)], strict=True):
                if a == b:
                    continue
                if block[a] != at:
                    at, held, ready = block[a], [], None
                part = rows.slice(a, b - a)
                own = part.column("vec_id").to_numpy(), part.column("embedding").flatten().to_numpy().reshape(b - a, -1)
                if not is_query[a]:
                    held.append(own)
                    continue
                if held:
                    ready, held = Block(*(np.concatenate(x) for x in zip(*held, strict=True)), pivots, prefix, share, k), []
                if ready is not None:
                    yield ready.search(*own)

    return search


def nearest(vectors: DataFrame, is_query: Column, k: int = K, pivots: int = PIVOTS, prefix: int = PREFIX, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance in double precision) of each query's k nearest found."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("is_query")).where(F.col("vec_id").isNotNull() & usable())
    sizes = rows.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    size, n = sizes[0][:2] if sizes else (0, 0)
    rows = rows.where(F.size("embedding") == size)
    drawn = rows.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    marks = np.unique(np.array([r["embedding"] for r in drawn], float).reshape(len(drawn), size), axis=0)
    blocks = max(1, -(-n // BLOCK))
    stored = rows.withColumn("is_query", F.lit(False)).withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).cast("int"))
    asked = rows.where("is_query").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = stored.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "is_query")
    found = dealt.mapInArrow(_search(marks, min(prefix, max(1, len(marks))), share, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
