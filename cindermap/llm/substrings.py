"""Operator 4: removal of repeated passages by recompression.

A passage is ``WINDOW`` consecutive words that also start earlier (smaller doc_id, or the same document further left).

1. Recompression rewrites each document in ``ROUNDS`` rounds: runs of one symbol get a name, then pairs. Each round puts every
   symbol into one of two classes and names each pair of a first-class symbol before a second-class one; such pairs never
   overlap. Names and classes are hashes of what a symbol stands for, so all tasks of a Spark stage agree on them without
   talking to each other (a dictionary of names would take a shuffle of all symbols in every round), and equal passages get
   equal interior symbols, of about 18 words in the end.
2. Spark brings equal names together. A symbol that also stands earlier is a verified copy of that place; where
   neighbouring symbols copy neighbouring places of one document, they join to one long repeat. All windows inside a
   repeat are settled and take no further part: a copied document costs a row a symbol, not a row a window.
3. What is left are windows at the edges of repeats and repeats too short to hold symbols. Every such window picks, among the
   symbols of two rounds whose forming depended on words inside it alone, the one with the smallest hash. Equal
   windows pick equal symbols, and neighbouring windows mostly the same one, so there is about one key for eight words. Only
   keys that occur twice anywhere can belong to repeated windows; Spark counts them. (A window without such a symbol, deep
   in a long run of one word, is taken along unseen.) The first occurrence of a window is never settled, so it is among them.
4. The windows that remain are hashed whole and compared by their first places; their words are removed.

Names and windows are compared by 64 + 31 bits of independent hashes.

Each task first settles what repeats among its own documents (a portion of about ``AT_ONCE`` words at a time), so a passage that
everyone shares is one row a portion in every shuffle. Document texts are shuffled once, by doc_id.

Defined cases: a null text has no words; documents of fewer words than a window have no window; rows that repeat a doc_id are
one document to windows (equal places don't make each other earlier) and each get a row, from the places of all of
them; rows with a null doc_id take no part and keep all words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cindermap.llm.common import encoded, staged, table, words

WINDOW, ROUNDS = 20, 10
#: Rounds whose symbols are small enough to pick windows.
PICK_ROUNDS = 2
#: Words worked on at once (more, if one document has more).
AT_ONCE = 1_000_000
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 2**64)
FAR = 1 << 40
#: ``at`` is a symbol's start (high half) and length; ``text`` tells the texts of a repeated doc_id apart; the lead is null if not known yet.
SYMBOLS_DDL = "key long, check int, at long, doc_id long, text int, lead_doc long, lead_start long"
SETTLED_DDL = "doc_id long, settled array<struct<text:int,start:int,n:int>>"
RANGES_DDL = "key long, weight int, doc_id long, start int, n int"
#: Three numbers a place keep the largest shuffle small. ``at`` is a check hash in the high half and the start in the low one; or
#: negative, for a run of later copies: -1 - (its length in the high half, its start in the low one).
PLACES_DDL = "key long, at long, doc_id long"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    own = words(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))


class Stretches:
    """Hash of any stretch of a sequence of word hashes."""

    def __init__(self, h: np.ndarray):
        with np.errstate(over="ignore"):
            power = np.concatenate([[np.uint64(1)], np.full(len(h), ODD, np.uint64)]).cumprod(dtype=np.uint64)
            self.back = np.concatenate([[np.uint64(1)], np.full(len(h), INVERSE, np.uint64)]).cumprod(dtype=np.uint64)
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:-1], dtype=np.uint64)])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64))


def parse(h: np.ndarray, doc: np.ndarray, rounds: int = PICK_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the last round: the words [a, b) on which each depends, and where it starts. ``doc``: the document of each word."""
    n = len(h)
    fresh = np.ones(n, bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    lo = np.flatnonzero(fresh)
    hi = np.append(lo[1:], n)
    # A run has a name of its own for each length; that it ends is known from the words beside it.
    name = np.where(hi - lo > 1, mixed(h[lo] + np.uint64(ODD) * (hi - lo).astype(np.uint64)), h[lo])
    owner, a, b = doc[lo], lo - 1, hi + 1
    for r in range(rounds):
        first = (mixed(name + np.uint64(r + 1)) & np.uint64(1)) == 0
        same = np.append(owner[1:] == owner[:-1], False)
        pair = first & np.append(~first[1:], False) & same
        second = np.append(False, pair[:-1])
        # What a symbol that stays alone depends on: one of the first class on the next one, the others on the one before.
        near = np.where(first, np.arange(len(name)) + 1, np.arange(len(name)) - 1).clip(0, len(name) - 1)
        there = np.where(first, same, np.append(False, same[:-1]))
        a_near, b_near = np.where(there, a[near], np.where(first, a, -FAR)), np.where(there, b[near], np.where(first, FAR, b))
        a, b = np.minimum(a, a_near), np.maximum(b, b_near)
        name[:-1] = np.where(pair[:-1], mixed(name[:-1] * np.uint64(ODD) + name[1:]), name[:-1])
        keep = ~second
        # The second half's own dependence ends within the pair: its neighbour is the first half.
        a, b, name, lo, owner = a[keep], b[keep], name[keep], lo[keep], owner[keep]
    return a, b, lo


def symbols(h: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Names and starts of the symbols after ``rounds`` rounds."""
    name, lo, owner = h, np.arange(len(h)), doc
    for r in range(rounds):
        fresh = np.ones(len(name), bool)
        fresh[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
        if not fresh.all():
            head = np.flatnonzero(fresh)
            times = np.diff(np.append(head, len(name))).astype(np.uint64)
            name, lo, owner = np.where(times > 1, mixed(name[head] + np.uint64(ODD) * times), name[head]), lo[head], owner[head]
        first = (mixed(name + np.uint64(r + 1)) & np.uint64(1)) == 0
        pair = np.zeros(len(name), bool)
        pair[:-1] = first[:-1] & ~first[1:] & (owner[1:] == owner[:-1])
        keep = np.ones(len(name), bool)
        keep[1:] = ~pair[:-1]
        name = name.copy()
        at = np.flatnonzero(pair)
        name[at] = mixed(name[at] * np.uint64(ODD) + name[at + 1] + np.uint64(2 * r + 1))
        name, lo, owner = name[keep], lo[keep], owner[keep]
    return name, lo


def heads(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new combination of keys starts."""
    fresh = np.ones(len(sorted_keys[0]), bool)
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return fresh


def own_key(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A key of its own for a row that needs no partner."""
    return mixed(ids.view(np.uint64) * np.uint64(ODD) + place.astype(np.uint64) + np.uint64(1))


def text_mark(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest(encoded(text)) >> 33


def _symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for h, doc, starts, ends, ids, rest in gathered(rows, []):
            if not len(h):
                continue
            name, lo = symbols(h, doc)
            d = doc[lo]
            hi = np.append(lo[1:], len(h))
            check = Stretches(mixed(h + np.uint64(7)))(lo, hi) >> np.uint64(33)
            place, size = lo - starts[d], hi - lo
            mark = np.array([x[0] for x in rest], np.int64)
            order = np.lexsort((place, ids[d], check, name))
            name, check, place, size, d = name[order], check[order], place[order], size[order], d[order]
            lead = heads(name, check)
            head = np.flatnonzero(lead)[np.cumsum(lead) - 1]
            later = (ids[d] != ids[d[head]]) | (place != place[head])
            key = np.where(lead, name, own_key(ids[d], place))
            keep = lead | later  # a row that repeats doc_id and text says nothing new
            back = np.flatnonzero(keep)[np.argsort(lo[order][keep], kind="stable")]  # in the documents' order, rows of a shuffle compress better
            known = later[back]
            columns = [key[back].view(np.int64), check[back].astype(np.int32), (place[back] << 32) | size[back], ids[d][back], mark[d][back].astype(np.int32)]
            lead_at = [pa.array(x[head][back], pa.int64(), mask=~known) for x in (ids[d], place)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *lead_at], ["key", "check", "at", "doc_id", "text", "lead_doc", "lead_start"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring copies of neighbouring places become one; those of a window and more stay, counted in windows."""
    for rows in batches:
        parts = rows.column("parts")
        sizes = np.diff(parts.offsets.to_numpy())
        of = np.repeat(np.arange(rows.num_rows), sizes)
        flat = parts.flatten()
        at, text, lead_doc, lead_start = (flat.field(c).to_numpy() for c in ("at", "text", "lead_doc", "lead_start"))
        start, size = at >> 32, at & 0xFFFFFFFF
        order = np.lexsort((start, text, of))
        of, text, start, end, lead_doc, shift = of[order], text[order], start[order], (start + size)[order], lead_doc[order], (start - lead_start)[order]
        fresh = heads(of, text, lead_doc, shift)
        fresh[1:] |= start[1:] != end[:-1]
        run = np.flatnonzero(fresh)
        n = end[np.append(run[1:], len(end)) - 1] - start[run] - WINDOW + 1 if len(run) else start
        run, n = run[n > 0], n[n > 0]
        counts = np.bincount(of[run], minlength=rows.num_rows)
        items = pa.StructArray.from_arrays([pa.array(text[run], pa.int32()), pa.array(start[run], pa.int32()), pa.array(n, pa.int32())], ["text", "start", "n"])
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), items)], ["doc_id", "settled"])


def picked(h: np.ndarray, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray, settled: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, n, key): runs of windows that are not ``settled`` (by their first word) and picked one symbol, in words of the whole batch. Windows without one have key 0."""
    a, b, lo = parse(h, doc)
    owner = doc[lo]
    fits = np.flatnonzero((a >= starts[owner]) & (b <= ends[owner]) & (b - a <= width))
    a, b = a[fits], b[fits]
    key = Stretches(h)(a, b)
    low = np.uint64((1 << max(20, len(key).bit_length())) - 1)  # the hash decides, then the place
    value = (key & ~low) | np.arange(len(key), dtype=np.uint64)
    best = np.full(len(h), 2**64 - 1, np.uint64)
    for t in range(width):
        s = b - width + t
        ok = (s <= a) & (s >= 0)
        np.minimum.at(best, s[ok], value[ok])
    at = np.arange(len(h))
    window = np.flatnonzero((at + width <= ends[doc]) & ~settled)
    choice = np.where(best[window] == 2**64 - 1, -1, (best[window] & low).astype(np.int64))
    fresh = np.ones(len(window), bool)
    fresh[1:] = (choice[1:] != choice[:-1]) | (window[1:] != window[:-1] + 1) | (doc[window[1:]] != doc[window[:-1]])
    run = np.flatnonzero(fresh)
    return window[run], np.diff(np.append(run, len(window))), np.where(choice[run] < 0, 0, key[choice[run]]) if len(key) else np.zeros(len(run), np.uint64)


def gathered(rows: pa.RecordBatch, others: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list]]]:
    """Documents in portions: word hashes, document of each word, starts, ends, doc_ids, and the texts' marks and other columns' values."""
    size, portion = 0, []

    def out():
        hashes = [x for x, *_ in portion]
        sizes = np.array([len(x) for x in hashes])
        ends = np.cumsum(sizes)
        return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.repeat(np.arange(len(sizes)), sizes), ends - sizes, ends, np.array([x[1] for x in portion], np.int64), [x[2:] for x in portion]

    for text, doc_id, *rest in zip(*(rows.column(c) for c in ("text", "doc_id", *others)), strict=True):
        text = text.as_py()
        portion.append((word_hashes(text), doc_id.as_py(), text_mark(text), *(x.as_py() for x in rest)))
        size += len(portion[-1][0])
        if size >= AT_ONCE:
            yield out()
            size, portion = 0, []
    if portion:
        yield out()


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for h, doc, starts, ends, ids, rest in gathered(rows, ["settled"]):
            change = np.zeros(len(h) + 1, np.int64)
            for i, (mark, runs) in enumerate(rest):
                for r in runs or ():
                    if r["text"] == mark:
                        change[starts[i] + r["start"]] += 1
                        change[starts[i] + r["start"] + r["n"]] -= 1
            start, n, key = picked(h, doc, starts, ends, np.cumsum(change[:-1]) > 0)
            d = doc[start] if len(start) else np.zeros(0, np.int64)
            _, index, inverse, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            twice = (count[inverse] > 1) | (key == 0)
            # The first of a key here speaks for it; the others are known to repeat and travel under a number of their own.
            speaks = np.zeros(len(key), bool)
            speaks[index] = True
            speaks &= key != 0
            own = own_key(ids[d], start - starts[d]) if len(start) else key
            key = np.where(speaks, key, own)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.where(twice, 2, 1), pa.int32()), pa.array(ids[d] if len(d) else [], pa.int64()), pa.array(start - starts[d] if len(d) else [], pa.int32()), pa.array(n, pa.int32())], ["key", "weight", "doc_id", "start", "n"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the windows in question: one row a distinct window, and rows of runs known to be later copies."""
    for rows in batches:
        for h, doc, starts, ends, ids, rest in gathered(rows, ["ranges"]):
            sizes = np.array([len(x[1] or ()) for x in rest])
            flat = np.array([(r["start"], r["n"]) for x in rest for r in x[1] or ()], np.int64).reshape(-1, 2)
            owner = np.repeat(np.arange(len(rest)), sizes)
            n = flat[:, 1]
            d = np.repeat(owner, n)
            s = np.repeat(flat[:, 0] + starts[owner], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            inside = s + WINDOW <= ends[d] if len(d) else np.zeros(0, bool)  # a repeated doc_id brings the ranges of all its rows
            d, s = d[inside], s[inside]
            key = Stretches(h)(s, s + WINDOW)
            sure = Stretches(mixed(h + np.uint64(7)))(s, s + WINDOW) >> np.uint64(33)
            order = np.lexsort((s - starts[d], ids[d], sure, key)) if len(d) else np.zeros(0, np.int64)
            key, sure, d, s = key[order], sure[order], d[order], s[order]
            lead = heads(key, sure)
            head = np.flatnonzero(lead)[np.cumsum(lead) - 1] if len(key) else np.zeros(0, np.int64)
            place = s - starts[d] if len(d) else s
            later = (ids[d] != ids[d[head]]) | (place != place[head]) if len(d) else np.zeros(0, bool)
            ld, lp = ids[d[later]], place[later]
            order = np.lexsort((lp, ld))
            ld, lp = ld[order], lp[order]
            fresh = np.ones(len(ld), bool)
            fresh[1:] = (ld[1:] != ld[:-1]) | (lp[1:] > lp[:-1] + 1)
            run = np.flatnonzero(fresh)
            length = lp[np.append(run[1:], len(lp)) - 1] - lp[run] + 1 if len(run) else np.zeros(0, np.int64)
            own = mixed(ld[run].view(np.uint64) * np.uint64(ODD) + lp[run].astype(np.uint64)) if len(run) else np.zeros(0, np.uint64)
            lead = np.flatnonzero(lead)
            lead = lead[np.argsort(s[lead])]  # in the documents' order, rows of a shuffle compress better
            at = np.concatenate([(sure[lead].astype(np.int64) << 32) | place[lead], -1 - ((length << 32) | lp[run])])
            columns = [np.concatenate([key[lead], own]).view(np.int64), at, np.concatenate([ids[d[lead]] if len(lead) else ld[:0], ld[run]])]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["key", "at", "doc_id"])



def kept_words(text: str | None, runs: list[dict] | None, width: int = WINDOW) -> tuple[int, list[bytes]]:
    """Number of words, and those that no window of ``runs`` covers."""
    own = words(text)
    if not runs:
        return len(own), own
    change = np.zeros(len(own) + 1, np.int64)
    for r in runs:
        if r["start"] < len(own):
            change[r["start"]] += 1
            change[min(len(own), r["start"] + r["n"] + width - 1)] -= 1
    covered = np.cumsum(change[:-1]) > 0
    return len(own), [own[i] for i in np.flatnonzero(~covered)]


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        out = []
        for doc_id, text, runs in zip(rows.column("doc_id"), rows.column("text"), rows.column("runs"), strict=True):
            n, kept = kept_words(text.as_py(), runs.as_py())
            out.append((doc_id.as_py(), n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def settled_runs(docs: DataFrame) -> DataFrame:
    """doc_id, settled (text, start, n): windows inside symbols that also stand earlier."""
    rows = docs.select("doc_id", "text").mapInArrow(_symbols, SYMBOLS_DDL).repartition("key")
    place = F.struct("doc_id", F.shiftright("at", 32).alias("start"))
    found = rows.withColumn("first", F.min(place).over(Window.partitionBy("key", "check")))
    later = found.where(F.col("lead_doc").isNotNull() | (place > F.col("first")))
    copy = F.struct("at", "text", F.coalesce("lead_doc", "first.doc_id").alias("lead_doc"), F.coalesce("lead_start", "first.start").alias("lead_start"))
    return later.groupBy("doc_id").agg(F.collect_list(copy).alias("parts")).mapInArrow(_joined, SETTLED_DDL).where("size(settled) > 0")


def repeated_runs(docs: DataFrame, settled: DataFrame) -> DataFrame:
    """doc_id, runs (start, n): the other windows of each document that also start earlier. ``docs``: doc_id (not null) and text."""
    ranges = docs.join(settled, "doc_id", "left").select("doc_id", "text", "settled").mapInArrow(_ranges, RANGES_DDL)
    weight = F.sum("weight").over(Window.partitionBy("key"))
    asked = ranges.withColumn("weight", weight).where("weight > 1").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    # Dealt out before the columns that the window needs are made, so that only the three numbers are shuffled.
    places = docs.join(asked, "doc_id").mapInArrow(_places, PLACES_DDL).repartition("key").withColumn("check", F.shiftright("at", 32))
    low = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))
    at, run = F.col("at"), -1 - F.col("at")
    place = F.struct("doc_id", low(at).alias("start"))
    first = F.min(place).over(Window.partitionBy("key", "check"))
    later = places.withColumn("first", first).where((at < 0) | (place > F.col("first")))
    found = F.when(at < 0, F.struct(low(run).cast("int").alias("start"), F.shiftright(run, 32).cast("int").alias("n"))).otherwise(F.struct(low(at).cast("int").alias("start"), F.lit(1).alias("n")))
    return later.groupBy("doc_id").agg(F.collect_list(found).alias("runs"))


def passage_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words."""
    rows = docs.select("doc_id", "text")
    named = rows.where("doc_id IS NOT NULL")
    settled = staged(settled_runs(named), "repeats")
    joined = named.join(settled, "doc_id", "left").join(repeated_runs(named, settled), "doc_id", "left")
    runs_type = "array<struct<start:int,n:int>>"
    bare = F.transform("settled", lambda r: F.struct(r["start"].alias("start"), r["n"].alias("n")))
    runs = F.concat(*(F.coalesce(x, F.array().cast(runs_type)) for x in (bare, F.col("runs"))))
    unnamed = rows.where("doc_id IS NULL").withColumn("runs", F.lit(None).cast(runs_type))
    return joined.select("doc_id", "text", runs.alias("runs")).union(unnamed).mapInArrow(_report, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_report(table(spark, sf_dir, "documents"))
