"""Operator 12: alignment of two tokenizers' tokens over the same text.

A text is encoded whole by a byte-level vocabulary (A, over a space and the text) and by a piece vocabulary (B, which adds that
space itself). Both token sequences spell the same bytes, which is verified; a text for which they do not has no tokens.

1. Anchors: byte positions at which an A token and a B token both start with a space, and so end the tokens before. They cut both
   sequences into windows, about a word each. Anchors, windows and their hashes are array operations over many texts.
2. A window is aligned once: its groups (cut where tokens of both end) and its links (tokens whose bytes overlap) are remembered
   by the tuple of its A and B ids. Windows that hash alike are compared id by id before they share an alignment.
3. Every document leaves its digest and its distinct (A id, B id) pairs with the number of times each is linked, written once to
   the shared folder. Spark adds up, per pair, the documents that link it, and takes each A id's highest count (one row an A id,
   so at most a vocabulary, which bounds that broadcast).
4. The counts are files of ``SHARD_PAIRS`` sorted pairs in the shared folder; documents look their pairs up there, so no link is
   shuffled and a pair that every document holds is as cheap as any other.

Defined cases: null and empty texts, and texts whose tokens do not spell a space and the text, have zeros and an empty
``groups_sha256``; special tokens' strings are plain text; rows that repeat a doc_id, or have none, are documents of their own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindermap.llm.common import read_file, shared_dir, staged, table, write_file
from cindermap.llm.tokens import BYTE_LETTERS, Encoder

#: Bytes of text, and texts at most, that are aligned together.
TEXT_BYTES, TEXTS = 4 << 20, 4000
#: Windows that a worker remembers, and the tokens of the longest one it does.
REMEMBERED_WINDOWS, LONGEST_WINDOW = 200_000, 64
#: Distinct pairs that a task counts before it passes them on; pairs a file; files that a worker keeps; pairs looked up together.
COUNTED, SHARD_PAIRS, KEPT_SHARDS, LOOKED_UP = 2_000_000, 500_000, 8, 2_000_000
DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_aligners: dict[tuple[str, str], "Aligner"] = {}
_shards: OrderedDict[str, tuple[np.ndarray, np.ndarray]] = OrderedDict()


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + sizes[i] - 1 of all i, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Bytes of every token, as one pool."""

    def __init__(self, tokens: list[bytes]):
        self.size = len(tokens)
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.spaced = np.fromiter((t[:1] == b" " for t in tokens), bool, len(tokens))

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[spans(self.starts[ids], self.lengths[ids])]


class Tokens:
    """Ids of many texts, one after the other."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, words: Vocabulary):
        self.ids, self.counts, self.words = ids.astype(np.int64), counts.astype(np.int64), words
        self.sizes = words.lengths[self.ids]

    def bytes_each(self) -> np.ndarray:
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        edges = np.concatenate([[0], np.cumsum(self.counts)])
        return np.diff(ends[edges])

    def of(self, kept: np.ndarray) -> Tokens:
        return self if kept.all() else Tokens(self.ids[np.repeat(kept, self.counts)], self.counts[kept], self.words)


class Digits:
    """The numbers below n in decimal digits, as one pool."""

    def __init__(self, n: int):
        written = [str(i).encode() for i in range(n)]
        self.lengths = np.fromiter(map(len, written), np.int64, n)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(written), np.uint8)


def align(a: Tokens, b: Tokens, digits: Digits) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Windows (their tokens one after the other, ``counts`` a window) whose two sequences spell the same bytes: each one's groups
    as text and number of groups, and all overlapping pairs with their number in each."""
    a_end, b_end = np.cumsum(a.sizes), np.cumsum(b.sizes)
    first = np.searchsorted(b_end, a_end - a.sizes, side="right")
    overlaps = np.searchsorted(b_end - b.sizes, a_end, side="left") - first
    pairs = np.repeat(a.ids, overlaps) * b.words.size + b.ids[spans(first, overlaps)]
    a_cut, b_cut = b_end[np.searchsorted(b_end, a_end)] == a_end, a_end[np.searchsorted(a_end, b_end)] == b_end
    a_first, b_first = np.cumsum(a.counts) - a.counts, np.cumsum(b.counts) - b.counts
    # A group's A tokens stand before its B tokens: where each token comes in the text.
    a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
    a_place = np.arange(len(a.ids)) + np.searchsorted(b_group, a_group, side="left")
    b_place = np.arange(len(b.ids)) + np.searchsorted(a_group, b_group, side="right")
    ids, after = np.empty(len(a.ids) + len(b.ids), np.int64), np.empty(len(a.ids) + len(b.ids), np.uint8)
    for place, t, cut, mark in ((a_place, a, a_cut, "|"), (b_place, b, b_cut, ";")):
        ids[place], after[place] = t.ids, np.where(cut, ord(mark), ord(","))
    sizes = digits.lengths[ids]
    ends = np.cumsum(sizes + 1)
    text = np.empty(int(ends[-1]), np.uint8)
    text[ends - 1] = after
    text[spans(ends - 1 - sizes, sizes)] = digits.pool[spans(digits.starts[ids], sizes)]
    edges = np.concatenate([[0], ends[np.cumsum(a.counts + b.counts) - 1]]).tolist()
    raw = text.tobytes()
    return [raw[x : y - 1] for x, y in zip(edges, edges[1:], strict=False)], np.add.reduceat(a_cut.astype(np.int64), a_first), pairs.astype(np.uint64), np.add.reduceat(overlaps, a_first)


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.encoder = Encoder(a_path)
        self.encoder.tokenizer.encode_special_tokens = True
        letters = {c: b for b, c in BYTE_LETTERS.items()}
        vocabulary = self.encoder.tokenizer.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.a = Vocabulary(tokens)
        self.pieces = p = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b = Vocabulary([bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.get_piece_size())])
        self.digits = Digits(max(self.a.size, self.b.size))
        self.known: dict[tuple[bytes, bytes], tuple[bytes, int, bytes]] = {}

    def encode(self, texts: pa.Array) -> tuple[Tokens, Tokens]:
        """Whole texts by both; for A a word stands before the space, whose id is taken away again."""
        ids, counts = self.encoder.batch(pc.binary_join_element_wise(pa.scalar("a ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        own = np.ones(len(ids), bool)
        own[np.cumsum(counts) - counts] = False
        pieces = self.pieces.encode(texts.to_pylist(), num_threads=1)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.fromiter(chain.from_iterable(pieces), np.int64, int(sizes.sum()))
        return Tokens(ids[own], counts - 1, self.a), Tokens(flat, sizes, self.b)

    def verified(self, a: Tokens, b: Tokens, texts: pa.Array) -> np.ndarray:
        """Which texts both sequences spell, with the space before."""
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())).cast(pa.large_binary())
        sizes = pc.binary_length(spaced).to_numpy(zero_copy_only=False).astype(np.int64)
        good = (a.bytes_each() == sizes) & (b.bytes_each() == sizes) & (sizes > 1)
        want = np.frombuffer(b"".join(spaced.filter(pa.array(good)).to_pylist()), np.uint8)
        wrong = (self.a.spell(a.of(good).ids) != want) | (self.b.spell(b.of(good).ids) != want)
        if wrong.any():
            where = np.flatnonzero(good)
            ends = np.cumsum(sizes[where])
            good[where[np.unique(np.searchsorted(ends, np.flatnonzero(wrong), side="right"))]] = False
        return good

    def windows(self, a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First tokens of every window in ``a`` and ``b``, and the number of windows of each text."""
        a_at, b_at = np.cumsum(a.sizes) - a.sizes, np.cumsum(b.sizes) - b.sizes
        anchor = np.zeros(int(a.sizes.sum()) + 1, np.uint8)
        anchor[a_at[self.a.spaced[a.ids]]] |= 1
        anchor[b_at[self.b.spaced[b.ids]]] |= 2
        first = np.cumsum(a.counts) - a.counts
        anchor[a_at[first]] = 3
        starts = np.flatnonzero(anchor[a_at] == 3)
        return starts, np.flatnonzero(anchor[b_at] == 3), np.diff(np.concatenate([np.searchsorted(starts, first), [len(starts)]]))

    def distinct(self, a: Tokens, b: Tokens, a_from: np.ndarray, b_from: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A window for each distinct one, and whose turn each window is."""
        n_a, n_b = np.diff(np.append(a_from, len(a.ids))), np.diff(np.append(b_from, len(b.ids)))
        h = np.zeros(len(a_from), np.uint64)
        for side, (t, starts, n) in enumerate(((a, a_from, n_a), (b, b_from, n_b))):
            place = (np.arange(len(t.ids)) - np.repeat(starts, n)) * 2 + side
            h ^= mixed(np.add.reduceat(mixed(t.ids.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64)), starts))
        _, shown, turn = np.unique(h, return_index=True, return_inverse=True)
        like = shown[turn]
        same = (n_a == n_a[like]) & (n_b == n_b[like])
        for t, starts, n in ((a, a_from, n_a), (b, b_from, n_b)):
            cut = np.where(same, n, 0)
            unequal = t.ids[spans(starts, cut)] != t.ids[spans(starts[like], cut)]
            if unequal.any():
                same[np.repeat(np.arange(len(n)), cut)[unequal]] = False
        alone = np.flatnonzero(~same)  # two windows of one hash: the later ones stand for themselves
        turn[alone] = len(shown) + np.arange(len(alone))
        return np.append(shown, alone), turn

    def aligned(self, texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """For each text n_a, n_b, n_groups, n_links (a row each), its groups; then, text by text, pairs, their times, and the pairs' number."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        a, b = self.encode(texts)
        good = self.verified(a, b, texts)
        a, b = a.of(good), b.of(good)
        counts, groups, n_pairs = np.zeros((4, len(good)), np.int64), [b""] * len(good), np.zeros(len(good), np.int64)
        if not good.any():
            return counts, groups, np.zeros(0, np.uint64), np.zeros(0, np.int64), n_pairs
        a_from, b_from, n_windows = self.windows(a, b)
        shown, turn = self.distinct(a, b, a_from, b_from)
        n_a, n_b = np.diff(np.append(a_from, len(a.ids)))[shown], np.diff(np.append(b_from, len(b.ids)))[shown]
        a_own, b_own = spans(a_from[shown], n_a), spans(b_from[shown], n_b)
        a_shown, b_shown = (Tokens(t.ids[own], n, t.words) for t, own, n in ((a, a_own, n_a), (b, b_own, n_b)))
        a_raw, b_raw = (t.ids.astype(np.uint32).tobytes() for t in (a_shown, b_shown))
        a_edges, b_edges = (np.concatenate([[0], np.cumsum(n) * 4]).tolist() for n in (n_a, n_b))
        keys = [(a_raw[w:x], b_raw[y:z]) for w, x, y, z in zip(a_edges, a_edges[1:], b_edges, b_edges[1:], strict=False)]
        found = list(map(self.known.get, keys))
        new = np.fromiter((f is None for f in found), bool, len(found))
        if new.any():
            told, n_own, links, n_links = align(a_shown.of(new), b_shown.of(new), self.digits)
            raw, ends = links.tobytes(), np.cumsum(n_links * 8).tolist()
            if len(self.known) + len(told) > REMEMBERED_WINDOWS:
                self.known.clear()
            for i, text, n, x, y in zip(np.flatnonzero(new).tolist(), told, n_own.tolist(), [0, *ends], ends, strict=False):
                found[i] = text, n, raw[x:y]
                if len(keys[i][0]) + len(keys[i][1]) <= LONGEST_WINDOW * 4:
                    self.known[keys[i]] = found[i]
        pool = np.frombuffer(b"".join(x for _, _, x in found), np.uint64)
        sizes = np.fromiter((len(x) // 8 for _, _, x in found), np.int64, len(found))
        n_groups = np.fromiter((n for _, n, _ in found), np.int64, len(found))
        edges = np.concatenate([[0], np.cumsum(n_windows)])
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[turn])])[edges])
        counts[:, good] = a.counts, b.counts, total(n_groups), total(sizes)
        parts, order = [x for x, _, _ in found], turn.tolist()
        for i, x, y in zip(np.flatnonzero(good).tolist(), edges.tolist(), edges[1:].tolist(), strict=False):
            groups[i] = b";".join([parts[w] for w in order[x:y]])
        linked = pool[spans((np.cumsum(sizes) - sizes)[turn], sizes[turn])]
        owner = np.repeat(np.arange(len(n_windows), dtype=np.uint64), counts[3, good])
        bits = np.uint64(int(self.a.size * self.b.size).bit_length())
        keys, times = np.unique(owner << bits | linked, return_counts=True)
        n_pairs[good] = np.bincount((keys >> bits).astype(np.int64), minlength=len(n_windows))
        return counts, groups, keys & ((np.uint64(1) << bits) - np.uint64(1)), times, n_pairs


def aligner(a_path: str, b_path: str) -> Aligner:
    """One a worker process and pair of files."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def portions(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of bounded bytes; one text is never cut."""
    size = pc.fill_null(pc.binary_length(rows.column("text")), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and (held + n > TEXT_BYTES or i - start >= TEXTS):
            yield rows.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < rows.num_rows:
        yield rows.slice(start)


def _align_texts(a_path: str, b_path: str, text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in (part for whole in batches for part in portions(whole)):
            counts, groups, pairs, times, n_pairs = aligner(a_path, b_path).aligned(rows.column("text"))
            ends = np.cumsum(n_pairs).tolist()
            cut = lambda x: pa.array([x[e - n : e].tobytes() for e, n in zip(ends, n_pairs.tolist(), strict=True)], pa.binary())  # noqa: E731,B023
            told = [g.decode() for g in groups] if text else [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
            columns = [rows.column("doc_id"), *map(pa.array, counts), pa.array(told, pa.string()), cut(pairs), cut(times.astype(np.uint32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups" if text else "groups_sha256", "pairs", "times"])

    return run


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for rows in batches:
        new = np.frombuffer(b"".join(rows.column("pairs").to_pylist()), np.uint64)
        distinct, at = np.unique(np.concatenate([pairs, new]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([counts, np.ones(len(new), np.int64)]), len(distinct)).astype(np.int64)
        pairs = distinct
        if len(pairs) > COUNTED:
            yield pa.RecordBatch.from_pydict({"pair": pairs.view(np.int64), "n": counts})
            pairs, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    yield pa.RecordBatch.from_pydict({"pair": pairs.view(np.int64), "n": counts})


def _write_shards(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[np.ndarray]] = {}
        for rows in batches:
            shard = rows.column("shard").to_numpy()
            values = np.stack([rows.column("pair").to_numpy(), rows.column("told").to_numpy()])
            for s in np.unique(shard):
                parts.setdefault(int(s), []).append(values[:, shard == s])
        for s, own in parts.items():
            pair, told = np.concatenate(own, axis=1)
            order = np.argsort(pair)
            write_file(f"{folder}/{s}", [pair[order].tobytes(), told[order].tobytes()])
            yield pa.RecordBatch.from_pydict({"pairs": [len(pair)]})

    return write


def _shard(folder: str, s: int) -> tuple[np.ndarray, np.ndarray]:
    name = f"{folder}/{s}"
    if name not in _shards:
        raw = np.frombuffer(read_file(name), np.int64)
        _shards[name] = raw[: len(raw) // 2], raw[len(raw) // 2 :]
        while len(_shards) > KEPT_SHARDS:
            _shards.popitem(last=False)
    _shards.move_to_end(name)
    return _shards[name]


def looked_up(pairs: np.ndarray, folder: str, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that link each pair, and whether no pair of its A id is linked by more."""
    told, shard = np.zeros(len(pairs), np.int64), pairs % shards
    order = np.argsort(shard, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(pairs) else ():
        keys, values = _shard(folder, int(shard[mine[0]]))
        told[mine] = values[np.searchsorted(keys, pairs[mine])]
    return told >> 1, (told & 1).astype(bool)


def _score(folder: str, shards: int, names: list[str]):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = np.cumsum(pc.binary_length(whole.column("pairs")).to_numpy(zero_copy_only=False).astype(np.int64) // 8)
            at = 0
            while at < whole.num_rows:
                upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + LOOKED_UP, side="right")))
                rows, at = whole.slice(at, upto - at), upto
                pairs, times = (np.frombuffer(b"".join(rows.column(c).to_pylist()), kind).astype(np.int64) for c, kind in (("pairs", np.uint64), ("times", np.uint32)))
                n, best = looked_up(pairs, folder, shards)
                edges = np.concatenate([[0], np.cumsum(pc.binary_length(rows.column("pairs")).to_numpy(zero_copy_only=False) // 8)])
                n_best, total = (np.diff(np.concatenate([[0], np.cumsum(x)])[edges]) for x in (times * best, times * n))
                columns = [pa.array(n_best) if c == "n_best" else pa.array(total) if c == "count_sum" else rows.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    return score


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, text: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (``text``) or their SHA-256, n_best and count_sum of every document."""
    spark = docs.sparkSession
    told = "groups string" if text else "groups_sha256 string"
    schema = f"doc_id long, n_a long, n_b long, n_groups long, n_links long, {told}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = staged(rows.mapInArrow(_align_texts(a_path, b_path, text), f"{schema}, pairs binary, times binary"), "alignments")
    pieces = aligner(a_path, b_path).b.size
    counts = rows.select("pairs").mapInArrow(_count_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = staged(counts.withColumn("a", F.floor(F.col("pair") / pieces)), "pair-counts")
    best = counts.groupBy("a").agg(F.max("n").alias("most"))  # at most a row for each id of A
    shards = max(1, -(-counts.count() // SHARD_PAIRS))
    folder = shared_dir(spark, "pair-index")
    indexed = counts.join(F.broadcast(best), "a").select("pair", (F.col("n") * 2 + (F.col("n") == F.col("most")).cast("long")).alias("told"), F.pmod("pair", F.lit(shards)).cast("int").alias("shard"))
    indexed.repartition(shards, "shard").mapInArrow(_write_shards(folder), "pairs long").agg(F.sum("pairs")).collect()
    names = [c.split()[0] for c in schema.split(", ")] + ["n_best", "count_sum"]
    return rows.mapInArrow(_score(folder, shards, names), f"{schema}, n_best long, count_sum long")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
