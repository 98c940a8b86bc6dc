"""Operator 2: SimHash near-duplicates by a Gray-order hierarchical index.

A document's 64-bit fingerprint is the bitwise majority over the XXH64 hashes of its word shingles. Documents link when
their fingerprints differ in at most ``max_bits`` bits; a group is what links connect.

1. Equal fingerprints become one class, so copies are never paired.
2. Fingerprints are cut into blocks, of which two linked ones agree in all but ``max_bits``. Every choice of that many
   blocks is a table, whose buckets hold the fingerprints that agree there. More blocks are used where there are more
   fingerprints, so that buckets stay small. A bucket of over ``BUCKET`` fingerprints is dealt into parts, and each pair
   of parts becomes a group of its own: hot buckets are spread out, and nothing is lost.
3. Spark sorts each group by Gray rank, so that neighbours share leading bits. A task builds the index over it: nodes
   of ``FAN`` neighbours, and nodes of such nodes, each with the mask of the bits all its fingerprints share and their
   pattern. Pairs of nodes go down together; a pair whose shared patterns differ in over ``max_bits`` bits is dropped
   with all below it. What reaches the leaves is compared exactly.
4. A group returns, instead of all its pairs, one link from each fingerprint to the smallest one it reaches there.
   Components over these links are those over all pairs.

Defined cases: a null, empty or blank text has no shingles and fingerprint zero, linked like any other; a text of fewer
words than a shingle is one shingle; rows that repeat a doc_id each get a row; a null doc_id gets a row too, but a group's
id is its smallest doc_id that is not null (null if it has none); an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cindermap.llm.common import batch, staged, table, words
from cindermap.operators.graph import components

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Fingerprints that one group compares at most with as many others.
BUCKET = 4096
#: Comparisons that cost about as much as one more row to deal out, which decides on the number of blocks.
ROW_COST = 800
FAN = 16
#: Pairs of nodes held at once.
PAIRS = 2_000_000
PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle, repeats included; A-Z lowered, words joined by one space; a text of fewer words is one shingle."""
    own = [w.lower() for w in words(text)]
    if not own:
        return np.zeros(0, np.uint64)
    line = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(own) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle, len(own)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """Bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]) if len(h) else 0


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def _fingerprints(shingle: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in rows.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64))], schema=PRINTS)

    return prints


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(_fingerprints(shingle), "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a code in Gray order, as an unsigned number; shifted so that signed comparison sorts it."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(2**63)).cast("long"))


def tables(n: int, max_bits: int) -> list[list[tuple[int, int]]]:
    """For each table the (shift, width) of its blocks. Of b blocks, b - max_bits agree.

    More blocks make smaller buckets but more tables; b is where rows and comparisons of n random fingerprints cost least.
    """

    def split(blocks: int) -> list[list[tuple[int, int]]]:
        edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
        return [list(c) for c in combinations([(a, b - a) for a, b in zip(edges, edges[1:], strict=False)], blocks - max_bits)]

    def cost(made: list[list[tuple[int, int]]]) -> float:
        return sum(1 + n / 2 ** sum(w for _, w in spans) / ROW_COST for spans in made)

    return min((split(blocks) for blocks in range(max_bits + 1, max_bits + 5)), key=cost)


class GrayIndex:
    """Levels of nodes over Gray-sorted codes. Nodes don't reach over the starts of groups."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        self.levels = [(codes, np.full(len(codes), 2**64 - 1, np.uint64), None)]
        while True:
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            within = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
            first = np.flatnonzero(within % FAN == 0)
            pattern, mask, _ = self.levels[-1]
            low, high = np.bitwise_and.reduceat(pattern, first), np.bitwise_or.reduceat(pattern, first)
            shared = np.bitwise_and.reduceat(mask, first) & ~(low ^ high)
            self.levels.append((low & shared, shared, np.append(first, len(group))))
            group = group[first]
            if len(first) == len(starts):
                break

    def close_pairs(self, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions i < j of one group whose codes differ in at most ``max_bits`` bits."""
        top = np.arange(len(self.levels[-1][0]))
        yield from self._below(len(self.levels) - 1, top, top, max_bits)

    def _below(self, level: int, a: np.ndarray, b: np.ndarray, max_bits: int):
        if level == 0:
            keep = a < b
            yield a[keep], b[keep]
            return
        first, (pattern, mask, _) = self.levels[level][2], self.levels[level - 1]
        na, nb = np.diff(first)[a], np.diff(first)[b]
        made = np.cumsum(na * nb)
        at = 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(made, (made[at - 1] if at else 0) + PAIRS, "right")))
            n = (na * nb)[at:to]
            which = np.repeat(np.arange(at, to), n)
            k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            i, j = first[a[which]] + k // nb[which], first[b[which]] + k % nb[which]
            keep = i <= j
            i, j = i[keep], j[keep]
            keep = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= max_bits
            yield from self._below(level - 1, i[keep], j[keep], max_bits)
            at = to


def spanned(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest position that each of n positions reaches."""
    root = np.arange(n)
    for i, j in pairs:
        while len(i):
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            while (root[root] != root).any():
                root = root[root]
            open_ = root[i] != root[j]
            i, j = i[open_], j[open_]
    return root


def _by_group(of, columns: list[str]):
    """``of(group, *columns)`` on whole groups, of rows that come ordered by ``bucket``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * (len(columns) + 1)
        for rows in batches:
            held = [np.concatenate([h, rows.column(c).to_numpy()]) for h, c in zip(held, ["bucket", *columns], strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last group may go on
            if last:
                yield of(np.unique(held[0][:last], return_inverse=True)[1], *(h[:last] for h in held[1:]))
                held = [h[last:] for h in held]
        if len(held[0]):
            yield of(np.unique(held[0], return_inverse=True)[1], *held[1:])

    return each


def _links(max_bits: int):
    def of(group: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        root = spanned(len(code), GrayIndex(code.view(np.uint64), group).close_pairs(max_bits))
        own = np.flatnonzero(root != np.arange(len(root)))
        return batch(LINKS, code[own], code[root[own]])

    return _by_group(of, ["fp"])


def bucketed(classes: DataFrame, n: int, max_bits: int) -> DataFrame:
    """The rows of ``classes`` (fp and others), once for each table and part, in groups (``bucket``) that lie in one task in Gray order."""
    fp = F.col("fp")
    keys = []
    for t, spans in enumerate(tables(n, max_bits)):
        key = F.lit(t).cast("long")
        for shift, width in spans:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        keys.append(key)
    rows = classes.select("*", F.explode(F.array(*keys)).alias("key"))
    hot = rows.groupBy("key").count().where(F.col("count") > BUCKET).select("key", F.ceil(F.col("count") / BUCKET).cast("int").alias("parts"))
    dealt = rows.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    # Two pairs of parts that share a 64-bit hash would only be compared together.
    grouped = dealt.select(*classes.columns, F.when(F.col("parts") == 1, F.col("key")).otherwise(pair).alias("bucket"))
    return grouped.repartition("bucket").sortWithinPartitions("bucket", gray_rank(fp))


def near_links(classes: DataFrame, n: int, max_bits: int) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct ``fp`` within ``max_bits``. ``n``: rows of ``classes``."""
    return bucketed(classes.select("fp"), n, max_bits).mapInArrow(_links(max_bits), "a long, b long")


def fingerprint_groups(prints: DataFrame, max_bits: int) -> DataFrame:
    """fp, root: the groups of the distinct fingerprints (column ``fp``) under links of at most ``max_bits`` bits."""
    classes = staged(prints.select("fp").distinct(), "classes")
    groups = components(near_links(classes, classes.count(), max_bits), "groups").select(F.col("node").alias("fp"), "root")
    return classes.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row a document."""
    prints = staged(fingerprints(docs, shingle), "prints")
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    grouped = staged(fingerprint_groups(prints, max_bits).join(firsts, "fp"), "grouped")
    lowest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(lowest, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
