"""Operator 10: packing documents into sequences by bin completion, a branch-and-bound search.

A document longer than a sequence is cut into pieces of a whole sequence, its first piece taking the rest; every piece
then is an item of 1 to ``capacity`` tokens. What a solution looks like depends only on how many items have each
length, and there are at most ``capacity`` lengths, so the search works on that histogram (bounded whatever the input):

* Take the largest length left and complete its bin: enumerate the undominated fillings of the rest of the bin, tightest first
  (one is dominated if some of its items could give way to one larger item that is at hand and still fits).
* A filling is first used as often as the counts allow at once; going back, it is also tried for one bin alone, so that
  nothing is left out.
* A branch ends when the space wasted so far exceeds what the best solution found leaves room for; that solution (the
  incumbent) starts as best-fit decreasing, and the search ends early at the lower bound (total tokens over capacity, or more if there are many large items).

The fillings of a node are made when they are asked for. The search is exact if it ends by itself; ``STEPS`` bounds its work,
which is the only limit, and then the best solution found stays.

The work on documents is Spark's: tokens, pieces, the histogram, a rank for every item among those of its length
(counted by hashed buckets, then prefix sums over the bucket counts, so that a length which a third of all items share
is spread out), and the join of (length, rank) with the solution's runs of bins.

Defined cases: a null or empty text is the end id alone; rows that repeat a doc_id are packed each; null doc_ids are
packed as well; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cindermap.llm.common import batch, staged, table
from cindermap.llm.tokens import encoded_texts

CAPACITY = 1024
#: Steps (nodes, and items tried in fillings) of the search.
STEPS = 50_000
#: Items a bucket, in which ranks are counted by one task.
BUCKET_ITEMS = 50_000
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than a sequence."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(tokenizer: str, end_id: int, capacity: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            for doc_id, ids in zip(rows.column("doc_id").to_pylist(), encoded_texts(tokenizer, rows.column("text"), end_id), strict=True):
                raw = memoryview(ids.astype("<u4").tobytes())
                out += [(doc_id, i, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids), capacity))]
            yield batch(PIECES, *zip(*out, strict=True)) if out else batch(PIECES, [], [], [], [], [])

    return pieces


def document_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, end_id, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


Run = tuple[tuple[int, ...], int]  # the lengths in a bin, and how many bins are filled so


def best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing on a histogram: each bin takes, again and again, the largest item that fits."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        bin_, space, need = [], capacity, {}
        while fits := [k for k in left if k <= space and left[k] > need.get(k, 0)]:
            k = max(fits)
            bin_.append(k)
            need[k] = need.get(k, 0) + 1
            space -= k
        out.append((tuple(bin_), times := min(left[k] // n for k, n in need.items())))
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


class Steps:
    """What is left of the search's budget."""

    def __init__(self, n: int):
        self.left = n

    def take(self) -> bool:
        self.left -= 1
        return self.left >= 0


def dominated(items: tuple[int, ...], counts: dict[int, int], space: int) -> bool:
    """Whether some of the items could give way to one item that is larger than they are together, at hand and fits."""
    slack, used = space - sum(items), {k: items.count(k) for k in set(items)}
    spare = [k for k, v in counts.items() if v > used.get(k, 0)]
    #: Sums of the filling's subsets, as bits; an empty one stands for an item that fits besides.
    sums = 1
    for k in items:
        sums |= sums << k
    # A single item that could be replaced by itself is none.
    return any(sums >> total & 1 for k in spare for total in range(max(0, k - slack), k + 1) if total != k or not used.get(k)) if len(items) > 1 or slack else False


def fillings(counts: dict[int, int], space: int, most_waste: int, steps: Steps) -> Iterator[tuple[int, ...]]:
    """The undominated fillings of ``space`` that waste at most ``most_waste``, tightest first, largest items first."""
    sizes = sorted((k for k, v in counts.items() if v and k <= space), reverse=True)
    if space <= 0 or not sizes:
        if space <= most_waste:
            yield ()
        return
    #: sums[i]: bit s is set if sizes[i:] can make the sum s.
    sums, mask = [1], (1 << space + 1) - 1
    for k in reversed(sizes):
        reach = sums[-1]
        for _ in range(min(counts[k], space // k)):
            more = (reach | reach << k) & mask
            if more == reach:
                break
            reach = more
        sums.append(reach)
    sums.reverse()

    def fill(i: int, goal: int, items: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if not steps.take():
            return
        if goal == 0:
            if not dominated(items, counts, space):
                yield items
            return
        for j in range(i, len(sizes)):
            if not sums[j] >> goal & 1:
                return
            for n in range(min(counts[sizes[j]], goal // sizes[j]), 0, -1):
                if sums[j + 1] >> (goal - n * sizes[j]) & 1:
                    yield from fill(j + 1, goal - n * sizes[j], items + (sizes[j],) * n)

    for goal in range(space, max(0, space - most_waste) - 1, -1):
        if steps.left <= 0:
            return
        if sums[0] >> goal & 1:
            yield from fill(0, goal, ())


def fewest(counts: dict[int, int], capacity: int) -> int:
    """A lower bound on the bins: for every k, items over capacity - k stand alone, those over half share no bin, and what of at least k the latter leave no room for needs more."""
    large = [(k, v) for k, v in counts.items() if 2 * k > capacity]
    small = sorted(((k, v) for k, v in counts.items() if 2 * k <= capacity), reverse=True)
    best = 0
    for least in {0, *(k for k, _ in small)}:
        alone = sum(v for k, v in large if k > capacity - least)
        shared = [(k, v) for k, v in large if k <= capacity - least]
        room = sum(v * (capacity - k) for k, v in shared)
        over = sum(k * v for k, v in small if k >= least) - room
        best = max(best, alone + sum(v for _, v in shared) + max(0, -(-over // capacity)))
    return best


def completions(left: dict[int, int], capacity: int, allowed: int, steps: Steps) -> Iterator[tuple[tuple[int, ...], int]]:
    """Ways to fill bins around the largest length: (lengths, bins). First each filling as often as it goes, then once."""
    largest = max(left)
    rest = dict(left)
    rest[largest] -= 1
    once = []
    for items in fillings(rest, capacity - largest, allowed, steps):
        items = (largest, *items)
        times = min(left[k] // items.count(k) for k in set(items))
        if lost := capacity - sum(items):
            times = min(times, allowed // lost)
        yield items, times
        if times > 1:
            once.append(items)
    for items in once:
        yield items, 1


def pack(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[Run]:
    """Bin completion on a histogram of lengths; the runs of equal bins of the best solution found."""
    counts = {k: v for k, v in counts.items() if v}
    total = sum(k * v for k, v in counts.items())
    least, best, budget = fewest(counts, capacity), best_fit(counts, capacity), Steps(steps)
    used = sum(n for _, n in best)
    if used <= least:
        return best
    #: Open nodes from the root down: what is left, waste, and the ways to go on that were not tried yet.
    room = lambda waste: (used - 1) * capacity - total - waste
    path: list[tuple[dict[int, int], int, Iterator]] = [(counts, 0, completions(counts, capacity, room(0), budget))]
    runs: list[Run] = []
    while path and budget.take():
        left, waste, ways = path[-1]
        step = next(ways, None)
        if step is None:
            path.pop()
            if runs:
                runs.pop()
            continue
        items, times = step
        lost = (capacity - sum(items)) * times
        if room(waste + lost) < 0:
            continue
        after = dict(left)
        for k in items:
            after[k] -= times
        after = {k: v for k, v in after.items() if v}
        if after:
            runs.append(step)
            path.append((after, waste + lost, completions(after, capacity, room(waste + lost), budget)))
            continue
        best, used = [*runs, step], (total + waste + lost) // capacity
        if used <= least:
            break
    return best


def slots(runs: list[Run]) -> list[tuple[int, int, int, int, int]]:
    """(length, from_rank, to_rank, first_sequence, offset): items of a length, in the order of their ranks, fill these places."""
    out, ranks, sequence = [], {}, 0
    for items, times in runs:
        offset = 0
        for k in items:
            at = ranks.get(k, 0)
            out.append((k, at, at + times, sequence, offset))
            ranks[k] = at + times
            offset += k
        sequence += times
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table with doc_id, piece and length), with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs: dict[int, list[tuple]] = {}
    for length, *run in slots(pack(histogram, capacity)):
        runs.setdefault(length, []).append(tuple(run))
    places = spark.createDataFrame(list(runs.items()), "length long, runs array<struct<from_rank:long,to_rank:long,first_sequence:long,offset:long>>")
    buckets = max(1, -(-sum(histogram.values()) // BUCKET_ITEMS))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = dealt.withColumn("within", rank).join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("within"))
    # One row a length, with the solution's runs of it: at most ``capacity`` rows, of a few runs each.
    placed = ranked.join(F.broadcast(places), "length")
    at = F.filter("runs", lambda r: (placed["rank"] >= r["from_rank"]) & (placed["rank"] < r["to_rank"]))[0]
    placed = placed.withColumn("at", at)
    return placed.select(*pieces.columns, (F.col("at.first_sequence") + F.col("rank") - F.col("at.from_rank")).alias("sequence_id"), F.col("at.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(staged(document_pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)
