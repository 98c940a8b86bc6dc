"""The corpus pipeline's near-duplicate stage: SimHash groups, joined where word shingles are similar.

Fingerprints link within a few bits (operator 2's index). That alone misses most copies whose shingle sets have a Jaccard
similarity near the limit, and 64 bits cannot be searched much further: similar sets differ in ten bits and more, and so wide
a neighbourhood holds unlike texts by the thousand. What the fingerprints leave apart is therefore found by min-hashes of
the very same shingle hashes: ``BANDS`` bands of ``ROWS`` minima each. Two texts of similarity s share a band with probability
1 - (1 - s^ROWS)^BANDS (0.96 at 0.8), texts without common shingles never do; the numbers are fixed at every size.

1. Every distinct text (by its shingle set) gives a row a band. Bands that one text alone has are left out.
2. In rounds, every band that still holds texts of two groups picks a centre, and the others of other groups are
   compared with it: one comparison a row, so a band that a third of all texts share costs no more than its rows, and
   a group of near copies collapses in a round or two.
3. What stays mixed after ``STARS`` rounds is compared in full, so every pair of texts that share a band and are not in one
   group yet is verified: a band's rows are dealt into parts of about ``PART`` texts, and only the texts outside the band's
   largest group travel to every part.

Comparisons happen inside tasks on the shingle sets themselves; a task holds the texts of one part and streams the others
past them. Only links are written.

Defined cases: a null, empty or blank text has no shingles and fingerprint zero, linked like any other and without bands;
rows with a null doc_id are never dropped and speak for no group; rows that repeat a doc_id are told apart by their
texts, equal ones become one row; an empty table gives an empty result; all columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindermap.llm.common import staged
from cindermap.llm.simhash import fingerprint_groups, majority, shingle_hashes
from cindermap.operators.graph import components

SHINGLE, MAX_BITS, SIMILARITY = 5, 4, 0.8
ROWS, BANDS = 8, 18
STARS, PART = 3, 256
#: Parts that a centre's comparisons are dealt into.
CENTRE_PARTS = 256
#: Odd multipliers; each orders the shingles in a way of its own.
FACTORS = np.random.default_rng(42).integers(0, 2**31, ROWS * BANDS).astype(np.uint32) * np.uint32(2) + np.uint32(1)
PRINTS_DDL = "doc_id long, text_hash long, fp long, variant long, bands array<long>"
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_set(h: np.ndarray) -> np.ndarray:
    """Sorted distinct 32-bit halves of shingle hashes."""
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def bands(shingles: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band; none for an empty set."""
    if not len(shingles):
        return []
    low = np.full(len(FACTORS), 2**32 - 1, np.uint32)
    for i in range(0, len(shingles), 8192):
        np.minimum(low, np.multiply.outer(FACTORS, shingles[i : i + 8192]).min(1), out=low)
    raw = low.tobytes()
    keys = [xxhash.xxh3_64_intdigest(raw[4 * ROWS * b : 4 * ROWS * (b + 1)], b) for b in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _prints(shingle: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            fps, variants, keys = [], [], []
            for text in rows.column("text"):
                h = shingle_hashes(text.as_py(), shingle)
                own = shingle_set(h)
                fps.append(majority(h))
                variants.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                keys.append(bands(own))
            numbers = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, variants)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), rows.column("text_hash"), *numbers, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "text_hash", "fp", "variant", "bands"])

    return prints


def _sets(shingle: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield pa.RecordBatch.from_arrays([rows.column("node"), pa.array([shingle_set(shingle_hashes(t.as_py(), shingle)).tobytes() for t in rows.column("text")], pa.binary())], ["node", "shingles"])

    return sets


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have at least the Jaccard similarity ``least``."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or len(x) < least * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both >= least * (len(x) + len(y) - both)


def _compared(least: float):
    """Links between the groups (``root``) of each bucket's streamed rows and those of its held rows, which come first."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, joined = None, [], {}

        def find(r: int) -> int:
            while r in joined:
                r = joined[r]
            return r

        for rows in batches:
            links = []
            columns = [rows.column(c).to_pylist() for c in ("bucket", "streamed", "root", "shingles")]
            for b, streamed, root, raw in zip(*columns, strict=True):
                if b != bucket:
                    bucket, held, joined = b, [], {}
                own = np.frombuffer(raw, np.uint32)
                if not streamed:
                    held.append((root, own))
                    continue
                for other, there in held:
                    x, y = find(root), find(other)
                    if x != y and similar(own, there, least):
                        links.append((root, other))
                        joined[max(x, y)] = min(x, y)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], schema=LINKS)

    return compared


def links_between(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``rows``: bucket, streamed (0: held), node, root. (a, b): roots that one verified pair links."""
    with_sets = rows.join(sets, "node").select("bucket", "streamed", "root", "shingles")
    return with_sets.repartition("bucket").sortWithinPartitions("bucket", "streamed").mapInArrow(_compared(similarity), "a long, b long").distinct()


def star(named: DataFrame, turn: int) -> DataFrame:
    """Of ``named`` (key, node, root): every mixed key's centre, held, and its texts of other groups, streamed past it."""
    pick = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "root")
    centres = named.groupBy("key").agg(F.min(pick).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    met = named.join(centres, "key").where("root <> c.root")
    pairs = met.select("node", "root", F.col("c.node").alias("centre"), F.col("c.root").alias("centre_root")).distinct()
    dealt = pairs.withColumn("bucket", F.xxhash64("centre", F.pmod(F.xxhash64("node"), F.lit(CENTRE_PARTS))))
    held = dealt.select("bucket", F.lit(0).alias("streamed"), F.col("centre").alias("node"), F.col("centre_root").alias("root")).distinct()
    return dealt.select("bucket", F.lit(1).alias("streamed"), "node", "root").union(held)


def whole(named: DataFrame) -> DataFrame:
    """Of ``named``: each mixed key's texts in parts, held, and those outside its largest group streamed past every part."""
    counts = named.groupBy("key", "root").count()
    keys = counts.groupBy("key").agg(F.sum("count").alias("n"), F.max_by("root", F.struct("count", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    met = named.join(keys.select("key", F.ceil(F.col("n") / PART).cast("int").alias("parts"), "top"), "key")
    held = met.select(F.xxhash64("key", F.pmod(F.xxhash64("node"), "parts").cast("int")).alias("bucket"), F.lit(0).alias("streamed"), "node", "root")
    asking = met.where("root <> top").select("key", "node", "root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return held.union(asking.select(F.xxhash64("key", "part").alias("bucket"), F.lit(1).alias("streamed"), "node", "root"))


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links, "joined").select(F.col("node").alias("root"), F.col("root").alias("now"))
    return staged(groups.join(found, "root", "left").select("fp", F.coalesce("now", "root").alias("root")), "joined")


def similar_groups(docs: DataFrame, prints: DataFrame, groups: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``groups`` (fp, root), joined wherever two texts that share a band have at least the ``similarity``."""
    named = prints.where("doc_id IS NOT NULL").groupBy("fp", "variant").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.first("bands").alias("bands"))
    rows = named.select("fp", F.col("at.doc_id").alias("doc_id"), F.col("at.text_hash").alias("text_hash"), F.xxhash64("at.doc_id", "at.text_hash").alias("node"), F.explode("bands").alias("key"))
    shared = rows.groupBy("key").count().where("count > 1").select("key")
    rows = staged(rows.join(shared, "key", "left_semi"), "bands")
    asked = rows.select("doc_id", "text_hash", "node").distinct()
    texts = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text")).join(asked, ["doc_id", "text_hash"]).select("node", "text")
    sets = staged(texts.mapInArrow(_sets(shingle), "node long, shingles binary").dropDuplicates(["node"]), "shingles")
    for turn in range(STARS + 1):
        now = rows.join(groups, "fp").select("key", "node", "root")
        links = staged(links_between(star(now, turn) if turn < STARS else whole(now), sets, similarity), "links")
        if not links.isEmpty():
            groups = merged(groups, links)
    return groups


def near_duplicate_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, root: the group of each distinct document."""
    prints = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(_prints(shingle), PRINTS_DDL)
    prints = staged(prints, "prints")
    groups = staged(fingerprint_groups(prints, max_bits), "groups")
    return prints.select("doc_id", "text_hash", "fp").distinct().join(similar_groups(docs, prints, groups, shingle, similarity), "fp").select("doc_id", "text_hash", "root")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs``, all columns, with the document of the smallest doc_id of each group."""
    found = near_duplicate_groups(docs, shingle, max_bits, similarity).where("doc_id IS NOT NULL")
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("at")).select("at.doc_id", "at.text_hash")
    first = first.toDF("_doc", "_text")
    mark = "_near_text_hash"
    while mark in {c.lower() for c in docs.columns}:
        mark = f"_{mark}"
    rows = docs.where("doc_id IS NOT NULL").withColumn(mark, F.xxhash64("text"))
    kept = rows.join(first, (rows["doc_id"] == first["_doc"]) & (rows[mark] == first["_text"]), "left_semi")
    return kept.dropDuplicates(["doc_id", mark]).select(*docs.columns).union(docs.where("doc_id IS NULL"))
