"""Operator 13: groups of spelling variants by Bloom-guided neighbourhoods.

1. Tasks count the words of their texts (A-Z lowered, letters up to U+00FF, so a code point is a byte of Latin-1) and Spark adds
   them up: words of at least ``MIN_LENGTH`` code points and ``MIN_COUNT`` occurrences are the vocabulary. A word's hash is the
   exclusive or of a number for each place and letter, so that an edited word's hash costs one or two operations.
2. Every length of the vocabulary gets a blocked Bloom filter (a word sets bits within one block of 512), built in shards of at
   most ``SHARD_BLOCKS`` blocks. Filters are broadcast ``FILTER_BYTES`` at a time, which bounds the broadcast at any size of the
   vocabulary; a larger one takes more passes over the words.
3. Each word generates its edits, as arrays over many words: all deletions, and all replacements by a larger letter. Insertions and
   replacements by smaller letters are these edits seen from the other word. What the filters let pass is shuffled, as
   numbers, to an exact join with the vocabulary; the join's rows are verified letter by letter, so neither filter nor hash can
   add a pair, and the filters cannot lose one.
4. A word's form is its commonest neighbour, if at least twice as common. Roots follow forms by pointer jumping: each
   step doubles the reach, and as counts double along a chain, six steps suffice.

Defined cases: null and empty texts have no words; a null doc_id is written as an empty string before the colon; rows that repeat a doc_id
count like any other; an empty table, or one without words common enough, gives an empty result; ties between forms go to the
smaller word in code-point order; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindermap.llm.common import staged, table

MIN_LENGTH, MIN_COUNT, LOSS = 5, 3, 97
#: In Latin-1, where A-Z are lowered.
RUN = re.compile(rb"[a-z\xc0-\xff]+")
LETTERS = np.r_[ord("a") : ord("z") + 1, 0xC0:0x100].astype(np.uint64)
#: Words, and letters of words, that a task counts before it passes the counts on.
COUNTED, COUNTED_BYTES = 400_000, 16 << 20
#: A block has 512 bits and about 32 words; a word sets HASHES bits in it.
BLOCK_WORDS, HASHES = 32, 6
SHARD_BLOCKS = 1 << 15
FILTER_BYTES = 32 << 20
#: Letters of words, and words, whose edits are generated together; words a task of generation.
AT_ONCE, WORDS_AT_ONCE, TASK_WORDS = 1 << 18, 2048, 20_000
EDITS = pa.schema([("source", pa.int64()), ("edited", pa.int64()), ("place", pa.int32()), ("letter", pa.int32())])


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def placed(place: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """The number that a letter at a place adds to a word's hash."""
    return mixed(place.astype(np.uint64) << np.uint64(8) | letter)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, size = Counter(), 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    for rows in batches:
        for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text"), strict=True):
            text = text.as_py()
            if not text:
                continue
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for word, n in Counter(RUN.findall(text.encode("latin-1", "replace").lower())).items():
                h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                if h % LOSS == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                if len(word) >= MIN_LENGTH:
                    before = len(counts)
                    counts[word] += n
                    size += len(word) * (len(counts) - before)
            if len(counts) > COUNTED or size > COUNTED_BYTES:
                yield out()
                counts.clear()
                size = 0
    yield out()


def matrices(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of one length, as rows of letters, and which they are; at most ``AT_ONCE`` letters together."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(length):
        own = np.flatnonzero(length == n)
        step = max(1, min(WORDS_AT_ONCE, AT_ONCE // int(n)))
        for part in (own[i : i + step] for i in range(0, len(own), step)):
            yield np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), n).astype(np.uint64), part


def hashes(letters: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(placed(np.arange(letters.shape[1])[None], letters), axis=1)


def _hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        words = [w.encode("latin-1") for w in rows.column("word").to_pylist()]
        h = np.zeros(len(words), np.uint64)
        for letters, part in matrices(words):
            h[part] = hashes(letters)
        yield pa.RecordBatch.from_arrays([rows.column("word"), rows.column("n"), pa.array([len(w) for w in words], pa.int32()), pa.array(h.view(np.int64))], ["word", "n", "length", "h"])


def vocabulary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n, length and hash of every word that is common enough, written to the shared folder."""
    counts = docs.select("doc_id", "text").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return staged(counts.where(F.col("n") >= min_count).mapInArrow(_hash_words, "word string, n long, length int, h long"), "vocabulary")


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


def _shard_bits(blocks: dict[int, int]):
    def build(rows: pa.Table) -> pa.Table:
        length, shard = rows.column("length")[0].as_py(), rows.column("shard")[0].as_py()
        h = rows.column("h").to_numpy().view(np.uint64)
        first = shard * SHARD_BLOCKS
        bits = np.zeros(min(SHARD_BLOCKS, blocks[length] - first) * 8, np.uint64)
        at, draws = (block_of(h, blocks[length]) - first) * 8, mixed(h)
        for i in range(HASHES):
            bit = (draws >> np.uint64(9 * i)) & np.uint64(511)
            np.bitwise_or.at(bits, at + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        return pa.table({"length": pa.array([length], pa.int32()), "shard": pa.array([shard], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    return build


class Filters:
    """The shards of one pass: for each length its number of blocks, and where its shards begin in ``bits`` (-1: in another pass)."""

    def __init__(self, blocks: dict[int, int], shards: list[tuple[int, int, bytes]]):
        self.blocks, self.starts, parts, size = blocks, {}, [], 0
        for length, shard, raw in shards:
            self.starts.setdefault(length, np.full(-(-blocks[length] // SHARD_BLOCKS), -1, np.int64))[shard] = size
            parts.append(raw)
            size += len(raw) // 8
        self.bits = np.frombuffer(b"".join(parts), np.uint64)

    def hold(self, length: int, h: np.ndarray) -> np.ndarray:
        """Which hashes may be words of that length: indices into ``h``."""
        if length not in self.starts:
            return np.zeros(0, np.int64)
        block = block_of(h, self.blocks[length])
        at = self.starts[length][block // SHARD_BLOCKS]
        alive = np.arange(len(h)) if self.starts[length].min() >= 0 else np.flatnonzero(at >= 0)
        at = (at + (block % SHARD_BLOCKS) * 8)[alive]
        draws = mixed(h[alive])
        for i in range(HASHES):  # most edits fall at the first bits
            bit = (draws >> np.uint64(9 * i)) & np.uint64(511)
            hit = (self.bits[at + (bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
            alive, at, draws = alive[hit], at[hit], draws[hit]
        return alive


def edits(letters: np.ndarray, h: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(row, edited hash, letter or -1, place) of the words' deletions and upward replacements that the filters let pass."""
    n, length = letters.shape
    own = placed(np.arange(length)[None], letters)
    before = np.bitwise_xor.accumulate(own, axis=1)
    if length - 1 in filters.starts:
        moved = placed(np.arange(length)[None] - 1, letters)  # the first column is not used
        after = np.bitwise_xor.accumulate(moved[:, ::-1], axis=1)[:, ::-1]
        for i in range(length):
            # Of a run of equal letters, the loss of each gives the same word: only the first counts.
            rows = np.flatnonzero(letters[:, i] != letters[:, i - 1]) if i else np.arange(n)
            edited = (before[rows, i - 1] if i else np.uint64(0)) ^ (after[rows, i + 1] if i + 1 < length else np.uint64(0))
            found = filters.hold(length - 1, edited)
            yield rows[found], edited[found], np.full(len(found), -1), i
    if length in filters.starts:
        for i in range(length):
            row, to = np.nonzero(LETTERS[None] > letters[:, i, None])
            edited = (h ^ own[:, i])[row] ^ placed(np.array(i), LETTERS)[to]
            found = filters.hold(length, edited)
            yield row[found], edited[found], LETTERS[to[found]].astype(np.int64), i


def _probe(shared: Broadcast):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        for rows in batches:
            words, h = [w.encode("latin-1") for w in rows.column("word").to_pylist()], rows.column("h").to_numpy().view(np.uint64)
            for letters, part in matrices(words):
                for row, edited, letter, place in edits(letters, h[part], filters):
                    if len(row):
                        columns = h[part][row].view(np.int64), edited.view(np.int64), np.full(len(row), place, np.int32), letter.astype(np.int32)
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), schema=EDITS)

    return probe


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near and near_n: every two words of the vocabulary one edit apart, in both directions."""
    spark = words.sparkSession
    sizes = {r["length"]: r["n"] for r in words.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    blocks = {length: -(-n // BLOCK_WORDS) for length, n in sizes.items()}
    each = F.create_map(*[F.lit(x) for item in blocks.items() for x in item])[F.col("length")] if blocks else F.lit(1)
    # As block_of: the hash's upper half, unsigned, scaled to the blocks.
    shard = F.floor(F.shiftright(F.shiftrightunsigned("h", 32) * each, 32) / SHARD_BLOCKS).cast("int")
    built = words.select("length", shard.alias("shard"), "h").groupBy("length", "shard").applyInArrow(_shard_bits(blocks), "length int, shard int, bits binary")
    built = staged(built, "filters")
    passes: list[list[tuple[int, int]]] = [[]]
    held = 0
    for length, n in sorted(blocks.items()):
        for s in range(-(-n // SHARD_BLOCKS)):
            size = 64 * min(SHARD_BLOCKS, n - s * SHARD_BLOCKS)
            if held + size > FILTER_BYTES and passes[-1]:
                passes.append([])
                held = 0
            passes[-1].append((length, s))
            held += size
    n_words = sum(sizes.values())
    # Edits of a short word are as many as those of a long one are few: words are dealt evenly, whatever their length.
    dealt = words.select("word", "h").repartition(max(1, min(-(-n_words // 256), max(spark.sparkContext.defaultParallelism * 2, -(-n_words // TASK_WORDS)))), "h")
    found = None
    for own in passes:
        keys = F.array(*[F.struct(F.lit(a).alias("length"), F.lit(b).alias("shard")) for a, b in own]) if own else F.array()
        mine = built.where(F.array_contains(keys, F.struct("length", "shard"))).collect() if own else []  # FILTER_BYTES at most
        shared = spark.sparkContext.broadcast(Filters(blocks, [(r["length"], r["shard"], bytes(r["bits"])) for r in mine]))
        part = staged(dealt.mapInArrow(_probe(shared), "source long, edited long, place int, letter int"), "edits")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    other = words.select(F.col("h").alias("edited"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    source = words.select(F.col("h").alias("source"), "word", "n")
    head, tail = F.expr("substring(word, 1, place)"), F.expr("substring(word, place + 2)")
    exact = F.when(F.col("letter") < 0, F.concat(head, tail)).otherwise(F.concat(head, F.expr("decode(unhex(hex(letter)), 'ISO-8859-1')"), tail))
    pairs = staged(found.join(other, "edited").join(source, "source").where(exact == F.col("near")).select("word", "n", "near", "near_n"), "near-words")
    return pairs.select("word", "near", "near_n").unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """word and root, where ``forms`` (word, form) leads from word to word without a circle; only words with a form have a row."""
    reached = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = reached.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = staged(step, "roots")
        reached = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reached


def variant_groups(docs: DataFrame, min_count: int = MIN_COUNT, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the vocabulary."""
    words = vocabulary(docs, min_count)
    best = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    told = words.select("word", "n").join(best, "word", "left")
    enough = -F.col("best.less") >= ratio * F.col("n")
    told = staged(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    reached = roots(told.where(F.col("form").isNotNull()))
    return told.join(reached, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(table(spark, sf_dir, "documents"))
