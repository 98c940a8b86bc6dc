"""Operator 5: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

1. Benchmark items are cut into pairs of neighbouring words. A filter of fixed size (``FILTER_BITS`` bits, whatever the benchmark's
   size) lets each task drop, while it scans documents, nearly all pairs that no item has.
2. Of an item only its rarest pairs, by the number of documents that hold them, are seeds. A passage of ``min_score`` can lose
   so much score and no more, and a replaced or lost word costs at least 3 and two pairs, so of an item's G pairs at least t = G - 2/3 of
   that score are left. Whatever its most frequent t - l pairs are, a passage that keeps t holds l of the others; those are the
   seeds, and a document that holds l of them is a candidate (l is a third of t, at least 1). Frequent openings and phrases
   so join nothing, and no frequency is a limit: an item that thousands of documents copy loses no seed that its copies need.
3. The item is aligned with the stretches of the document around the seeds (+``MATCH``, ``MISMATCH``, ``GAP`` a word), as wide as the gaps that a
   passage of ``min_score`` can have; score over the item's best possible score is the pair's score, and pairs of at least
   ``min_score`` are reported. A stretch that shares too few words with the item to reach ``min_score`` in any order is not
   aligned. Documents and their candidates stream past each other in the order of documents; nothing is collected.

What is lost: an inserted word costs only 1 and one pair, so a copy with words inserted at many places can reach ``min_score`` with fewer than t
pairs. It is found if it keeps l seeds all the same, and lost else; with a word inserted after each of its words it keeps none.

Words are runs of letters and digits, lower case. Defined cases: null or empty texts and items of fewer than n words
match nothing; rows with a null doc_id or item_id take no part (and stay in ``drop_contaminated``); rows that repeat a doc_id
or item_id count as one document or item with each row's text, the best score counts; empty tables give an empty
result; other columns are ignored or, by ``drop_contaminated``, passed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cindermap.llm.common import give_back, staged, table

N, MIN_SCORE = 2, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
FILTER_BITS = 1 << 24
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"[^\W_]+")


def split(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams(own: list[str], n: int = N) -> np.ndarray:
    """64-bit hashes of the n-grams, in order."""
    if len(own) < n:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * MULTIPLIER + h[i : len(h) - n + 1 + i]
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def _item_grams(n: int, min_score: float):
    """Each item's distinct n-grams with their places, how many of them can be seeds, and how many of those a candidate holds."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys, hashes, places, seeds, least = [], [], [], [], []
            for key, text in zip(rows.column("item").to_pylist(), rows.column("text").to_pylist(), strict=True):
                own = split(text)
                found: dict[int, list[int]] = {}
                for i, g in enumerate(grams(own, n).tolist()):
                    found.setdefault(g, []).append(i)
                lost = MATCH * len(own) * (1 - min_score) * n // (MATCH - MISMATCH)
                kept = max(1, len(found) - int(lost))
                held = max(1, kept // 3)
                keys += [key] * len(found)
                hashes += found
                places += found.values()
                seeds += [len(found) - kept + held] * len(found)
                least += [held] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(keys, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(seeds, pa.int32()), pa.array(least, pa.int32())], ["gram", "item", "at", "seeds", "least"])

    return cut


def _scan(n: int, bits: np.ndarray):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys, sizes, hashes, places = [], [], [], []
            for key, text in zip(rows.column("doc").to_pylist(), rows.column("text"), strict=True):
                own = grams(split(text.as_py()), n)
                slot = own & (FILTER_BITS - 1)
                hit = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                if len(hit):
                    order = hit[np.argsort(own[hit], kind="stable")]
                    held, first = np.unique(own[order], return_index=True)
                    keys += [key] * len(held)
                    hashes.append(held)
                    places.append(order)
                    sizes.append(np.diff(np.append(first, len(order))))
            flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
            offsets = np.concatenate([[0], np.cumsum(flat(sizes))]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat(places).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(flat(hashes), pa.int64()), found], ["doc", "gram", "places"])

    return scan


def gram_filter(item_grams: DataFrame) -> np.ndarray:
    """The filter's bits, from at most ``FILTER_BITS`` distinct slots."""
    slots = item_grams.select((F.col("gram").bitwiseAND(F.lit(FILTER_BITS - 1))).cast("int").alias("slot")).distinct().toPandas()["slot"].to_numpy()
    bits = np.zeros(FILTER_BITS, np.uint8)
    bits[slots] = 1
    packed = np.packbits(bits, bitorder="little")
    del slots, bits
    give_back()
    return packed


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two sequences of word numbers, and where in ``text`` it ends."""
    row, best, end = np.zeros(len(text) + 1, np.int64), 0, 0
    ramp = np.arange(len(text) + 1) * -GAP
    for w in item:
        cell = np.maximum(row + GAP, 0)
        cell[1:] = np.maximum(cell[1:], row[:-1] + np.where(text == w, MATCH, MISMATCH))
        row = np.maximum.accumulate(cell + ramp) - ramp  # gaps in the item
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def aligned(item: list[str], own: list[str], diagonals: list[int], min_score: float) -> tuple[float, int]:
    """Score (1: the whole item stands in the text) and the number of the word behind the passage; 0 if it cannot reach ``min_score``."""
    slack = max(8, -int(MATCH * len(item) * (1 - min_score) // GAP))
    code: dict[str, int] = {}
    a = np.array([code.setdefault(w, len(code)) for w in item])
    best, end = 0, 0
    spans: list[list[int]] = []
    for d in sorted(diagonals):
        lo, hi = max(0, d - slack), min(len(own), d + len(item) + slack)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(hi, spans[-1][1])
        else:
            spans.append([lo, hi])
    wanted = np.bincount(a, minlength=len(code))
    for lo, hi in spans:
        text = np.array([code.get(w, -1) for w in own[lo:hi]], np.int64)
        shared = np.minimum(wanted, np.bincount(text[text >= 0], minlength=len(code))).sum()
        if shared < min_score * len(item):
            continue
        score, at = align(a, text)
        if score > best:
            best, end = score, lo + at
    return best / (MATCH * len(item)), end


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a task once, so that a row that repeats very often is no large group."""
    seen: set[int] = set()
    for rows in batches:
        keys = rows.column("doc").to_pylist()
        kept = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
        yield rows.select(["doc", "doc_id", "text"]).take(pa.array(kept, pa.int64()))


def _verify(min_score: float):
    """Rows come document by document: its text first, then the items to align it with."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, named, whole = None, None, None, None
        for rows in batches:
            out = []
            columns = [rows.column(c) for c in ("doc", "doc_id", "text", "item_id", "diagonals")]
            for doc, doc_id, text, item_id, diagonals in zip(*columns, strict=True):
                if item_id.as_py() is None:
                    if doc.as_py() != at:
                        at, own, named = doc.as_py(), None, doc_id.as_py()
                        whole = text
                elif doc.as_py() == at:
                    own = split(whole.as_py()) if own is None else own
                    score, end = aligned(split(text.as_py()), own, diagonals.as_py(), min_score)
                    if score >= min_score:
                        out.append((named, item_id.as_py(), score, end))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int32()))], ["doc_id", "item_id", "score", "end_word"])

    return verify


def seeded(hits: DataFrame, item_grams: DataFrame) -> DataFrame:
    """Candidates: doc, item and the diagonals on which they share seeds. ``hits`` are the documents' n-grams that items may have."""
    frequency = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rarest = F.row_number().over(Window.partitionBy("item").orderBy("df", "gram"))
    # What no document holds comes first: it takes seeds' places, as the bound counts all of an item's n-grams.
    ranked = item_grams.join(frequency, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("rank", rarest)
    seeds = staged(ranked.where("rank <= seeds AND df > 0").select("gram", "item", "at", "least"), "seeds")
    found = hits.join(seeds, "gram").select("doc", "item", "least", "places", "at")
    each = F.flatten(F.transform("places", lambda p: F.transform("at", lambda a: p - a)))
    pairs = found.select("doc", "item", "least", each.alias("diagonals")).groupBy("doc", "item").agg(F.count(F.lit(1)).alias("held"), F.max("least").alias("least"), F.array_distinct(F.flatten(F.collect_list("diagonals"))).alias("diagonals"))
    return pairs.where("held >= least").select("doc", "item", "diagonals")


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, item_id, score and end_word of each document that holds (most of) an item."""
    key = lambda c: F.xxhash64(c, "text")
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL").dropDuplicates().withColumn("item", key("item_id"))
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL").withColumn("doc", key("doc_id"))
    item_grams = staged(items.mapInArrow(_item_grams(n, min_score), "gram long, item long, at array<int>, seeds int, least int"), "item-grams")
    hits = staged(docs.mapInArrow(_scan(n, gram_filter(item_grams)), "doc long, gram long, places array<int>"), "gram-hits")
    pairs = staged(seeded(hits, item_grams), "candidates")
    asked = pairs.join(items, "item").select("doc", F.lit(None).cast("long").alias("doc_id"), "text", "item_id", "diagonals")
    # All texts are dealt out once, with their candidates behind them: one shuffle, the same at every size.
    held = docs.mapInArrow(_once, "doc long, doc_id long, text string").select("*", F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("array<int>").alias("diagonals"))
    rows = held.unionByName(asked).repartition("doc").sortWithinPartitions("doc", F.col("item_id").isNotNull(), "item_id")
    checked = rows.mapInArrow(_verify(min_score), "doc_id long, item_id long, score double, end_word int")
    return checked.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "end_word")).alias("best")).select("doc_id", "item_id", "best.score", "best.end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs``, all columns, without the documents that hold an item."""
    found = contaminated(docs, benchmark, n, min_score).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
