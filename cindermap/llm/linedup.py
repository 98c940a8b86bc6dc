"""Operator 9: line deduplication by probing a sharded minimal perfect hash.

A line's key is the line without the six ASCII white-space characters at both ends, A-Z lowered. Keys of at least
``min_chars`` code points that stand in at least ``min_docs`` documents lose all their lines, except in the largest doc_id
that holds them.

1. Each task counts, for the keys of its own documents, documents and largest doc_id (so a line that everyone shares is one
   row a task), keyed by a 128-bit hash; Spark adds them up.
2. The keys that reach ``min_docs`` (no other key changes any decision) are dealt to shards by their hash. Every shard gets
   a minimal perfect hash - levels of bit arrays in which each key owns the first bit that no other key of its level
   claims, ranked by popcounts - and, in the ranks' order, an array of 64-bit fingerprints, one of counts and one of
   largest doc_ids. All 128 bits decide on a key's places, so two keys would have to share them all to meet. Shards are
   files in the shared folder, of bounded size.
3. Documents probe: a task collects the lines of a batch of documents (of ``PROBED`` bytes at least) and goes through them
   shard by shard, so each batch reads a shard at most once, and the last ones stay in memory; no line is shuffled or joined.

Defined cases: a null or empty text is one empty line; rows that repeat a doc_id count as documents and, if theirs is
the largest doc_id, all keep their lines; rows with a null doc_id count too but are never the largest (if only null ids
hold a key, the key stays); an empty table gives an empty result; other columns are ignored or, by
``drop_repeated_lines``, passed on.
"""

from __future__ import annotations

import hashlib
import io
from array import array
from collections import OrderedDict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindermap.llm.common import batch, encoded, read_file, shared_dir, staged, table, write_file

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys a shard: about 25 MB.
SHARD_KEYS = 1_000_000
#: Shards that a worker keeps in memory.
KEPT_SHARDS = 8
#: Bytes of text whose lines are probed together, in whole Arrow batches.
PROBED, ROW_BYTES = 16 << 20, 64
NO_ID = -(2**63)
COUNTS = pa.schema([("h", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("last", pa.int64())])
_shards: OrderedDict[str, "PerfectHash"] = OrderedDict()


def line_key(line: bytes) -> bytes:
    """bytes.strip() and bytes.lower() touch the six ASCII white-space characters and A-Z, and nothing else."""
    return line.strip().lower()


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


def mixed(h: np.ndarray, level: int) -> np.ndarray:
    """64-bit finalizer, salted by the level."""
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slot(h: np.ndarray, fp: np.ndarray, level: int, size: int) -> np.ndarray:
    return ((mixed(h, level) ^ mixed(fp.view(np.uint64), level + 1000)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Maps n distinct 128-bit keys to 0..n-1, with arrays in that order. Keys that were not given may map anywhere: compare fingerprints."""

    def __init__(self, levels: list[np.ndarray], fp: np.ndarray, count: np.ndarray, last: np.ndarray):
        self.levels, self.fp, self.count, self.last = levels, fp, count, last
        self.before = []
        base = 0
        for bits in levels:
            ones = np.cumsum(bits)
            self.before.append(base + ones - bits)
            base += int(ones[-1]) if len(ones) else 0

    @classmethod
    def build(cls, h: np.ndarray, fp: np.ndarray, count: np.ndarray, last: np.ndarray) -> PerfectHash:
        """``h`` and ``fp``: the halves of distinct 128-bit keys."""
        levels, left = [], np.arange(len(h))
        while len(left):
            size = max(2, len(left) * 3 // 2)
            at = slot(h[left], fp[left], len(levels), size)
            claims = np.bincount(at, minlength=size)
            levels.append((claims == 1).astype(np.uint8))
            left = left[claims[at] > 1]
        made = cls(levels, fp, count, last)
        rank = made.rank(h, fp)
        for name, values in (("fp", fp), ("count", count), ("last", last)):
            placed = np.empty_like(values)
            placed[rank] = values
            setattr(made, name, placed)
        return made

    def rank(self, h: np.ndarray, fp: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, bits in enumerate(self.levels):
            at = slot(h[open_], fp[open_], level, len(bits))
            hit = bits[at] == 1
            out[open_[hit]] = self.before[level][at[hit]]
            open_ = open_[~hit]
        return out

    def probe(self, h: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and largest doc_id of each key; count 0 for keys that are not in."""
        if not len(self.fp):
            return np.zeros(len(h), np.int64), np.full(len(h), NO_ID)
        rank = self.rank(h, fp)
        found = (rank >= 0) & (self.fp[rank] == fp)
        return np.where(found, self.count[rank], 0), np.where(found, self.last[rank], NO_ID)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, sizes=[len(x) for x in self.levels], bits=np.packbits(np.concatenate([*self.levels, np.zeros(0, np.uint8)])), fp=self.fp, count=self.count, last=self.last)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        with np.load(io.BytesIO(raw)) as z:
            sizes = z["sizes"].astype(int)
            bits = np.unpackbits(z["bits"])[: sizes.sum()]
            return cls(np.split(bits, np.cumsum(sizes)[:-1]) if len(sizes) else [], z["fp"], z["count"], z["last"])


def _hash(key: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(key)
    return x >> 64, x & (2**64 - 1)


def _count_keys(min_chars: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], list[int]] = {}

        def out() -> pa.RecordBatch:
            keys = np.array(list(seen), np.uint64).reshape(-1, 2).view(np.int64)
            values = np.array(list(seen.values()), np.int64).reshape(-1, 2)
            return batch(COUNTS, keys[:, 0], keys[:, 1], values[:, 0], values[:, 1])

        for rows in batches:
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                doc_id = NO_ID if doc_id is None else doc_id
                keys = {line_key(x) for x in encoded(text).split(b"\n") if len(x) >= min_chars}
                for key in keys:
                    if long_enough(key, min_chars):
                        got = seen.setdefault(_hash(key), [0, NO_ID])
                        got[0] += 1
                        got[1] = max(got[1], doc_id)
            if len(seen) > 500_000:
                yield out()
                seen.clear()
        yield out()

    return count


def _build_shards(folder: str):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[np.ndarray]] = {}
        for rows in batches:
            shard = rows.column("shard").to_numpy()
            values = np.stack([rows.column(c).to_numpy() for c in ("h", "fp", "n", "last")], 1)
            for s in np.unique(shard):
                parts.setdefault(int(s), []).append(values[shard == s])
        for s, own in parts.items():
            h, fp, n, last = np.concatenate(own).T
            write_file(f"{folder}/{s}", [PerfectHash.build(h.view(np.uint64) if h.flags.c_contiguous else np.ascontiguousarray(h).view(np.uint64), np.ascontiguousarray(fp), n, last).to_bytes()])
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32()), "keys": [len(h)]})

    return build


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[str, int]:
    """Folder and number of the shards over the keys that stand in at least ``min_docs`` documents."""
    spark = docs.sparkSession
    counts = docs.select("doc_id", "text").mapInArrow(_count_keys(min_chars), "h long, fp long, n long, last long")
    common = staged(counts.groupBy("h", "fp").agg(F.sum("n").alias("n"), F.max("last").alias("last")).where(F.col("n") >= min_docs), "line-counts")
    shards = max(1, -(-common.count() // SHARD_KEYS))
    folder = shared_dir(spark, "line-index")
    dealt = common.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    dealt.mapInArrow(_build_shards(folder), "shard int, keys long").agg(F.sum("keys")).collect()
    return folder, shards


def shard_of(folder: str, s: int) -> PerfectHash:
    name = f"{folder}/{s}"
    if name not in _shards:
        try:
            _shards[name] = PerfectHash.from_bytes(read_file(name))
        except FileNotFoundError:  # no key fell into it
            _shards[name] = PerfectHash([], *(np.zeros(0, np.int64),) * 3)
        while len(_shards) > KEPT_SHARDS:
            _shards.popitem(last=False)
    _shards.move_to_end(name)
    return _shards[name]


def kept_lines(docs: list[tuple[pa.Array, pa.Array]], folder: str, shards: int, min_chars: int) -> Iterator[tuple[int, list[bytes]]]:
    """``docs``: arrays of doc_ids and texts. For each document: its number of lines, and the lines that stay. Every shard is visited once."""
    asked, own, where = array("Q"), array("q"), array("q")
    n = 0
    for ids, texts in docs:
        for doc_id, text in zip(ids, texts, strict=True):
            doc_id = doc_id.as_py()
            for line in encoded(text.as_py()).split(b"\n"):
                if len(line) >= min_chars and long_enough(key := line_key(line), min_chars):
                    asked.extend(_hash(key))
                    own.append(NO_ID if doc_id is None else doc_id)
                    where.append(n)
                n += 1
    gone: set[int] = set()  # numbers of lines
    if asked:
        h, fp = np.ascontiguousarray(np.frombuffer(asked, np.uint64).reshape(-1, 2).T)
        own, dropped, shard = np.frombuffer(own, np.int64), np.zeros(len(h), bool), h.view(np.int64) % shards
        order = np.argsort(shard, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            count, last = shard_of(folder, int(shard[mine[0]])).probe(h[mine], fp[mine].view(np.int64))
            dropped[mine] = (count > 0) & (own[mine] != last)
        gone = set(np.frombuffer(where, np.int64)[dropped].tolist())
    n = 0
    for _, texts in docs:
        for text in texts:
            lines = encoded(text.as_py()).split(b"\n")
            yield len(lines), [x for i, x in enumerate(lines, n) if i not in gone]
            n += len(lines)


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches put together until they hold ``PROBED`` bytes of text; a row counts ``ROW_BYTES`` beside its text."""
    held, size = [], 0
    for rows in batches:
        held.append(rows)
        size += (pc.sum(pc.binary_length(rows.column("text"))).as_py() or 0) + ROW_BYTES * rows.num_rows
        if size >= PROBED:
            yield held
            held, size = [], 0
    if held:
        yield held


def _probe(folder: str, shards: int, min_chars: int, digest: bool, names: list[str]):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for portion in portions(batches):
            found = kept_lines([(rows.column("doc_id"), rows.column("text")) for rows in portion], folder, shards, min_chars)
            for rows in (whole.slice(i, 1000) for whole in portion for i in range(0, whole.num_rows, 1000)):
                sizes, kept = [], []
                for n, lines in islice(found, rows.num_rows):
                    sizes.append((n, n - len(lines)))
                    kept.append(b"\n".join(lines))
                if digest:
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array([x[i] for x in sizes], pa.int64()) for i in (0, 1)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])
                else:
                    own = [None if not t.is_valid else k.decode("utf-8", "surrogatepass") for t, k in zip(rows.column("text"), kept, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(own, rows.schema.field("text").type) if c == "text" else rows.column(c) for c in names], names)

    return probe


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs``, all columns, with the repeated lines cut from ``text`` (null stays null)."""
    folder, shards = build_index(docs, min_chars, min_docs)
    return docs.mapInArrow(_probe(folder, shards, min_chars, False, docs.columns), docs.schema)


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text's SHA-256."""
    folder, shards = build_index(docs, min_chars, min_docs)
    probed = docs.select("doc_id", "text").mapInArrow(_probe(folder, shards, min_chars, True, []), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    return probed


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), common AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, i, line, c.k IS NOT NULL AND doc_id <> c.last AS dropped FROM keyed LEFT JOIN common c USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
