"""Token ids of whole texts by a given tokenizer file, quickly.

Merges never cross from a word into the white space behind it, so a text's ids are those of its chunks, one after
the other; a chunk is a word with the one space or line break before it. Natural texts repeat chunks: Arrow finds
the distinct ones of a batch, and a worker process remembers the ids of those it has met. A new chunk of letters and
punctuation is cut into its pre-tokens, which are remembered too, and the library merges those that are new. Texts that
do not cut cleanly this way (two white-space characters in a row before a word, rare white space, special tokens) are
encoded whole.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: RE2: what keeps a text from being cut: two white-space characters, rare ones, the mark below, special tokens.
UNCLEAN = r"[ \t-\r][ \t-\r]|[\x{1}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\||[\t\v\f\r]|^[ \n]"
#: Stands before the first chunk of a text, which has no space before it.
FIRST = "\x01"
#: Distinct chunks, and as many pre-tokens, that a worker remembers (about 50 bytes each); beyond that it keeps those of the batch at hand.
REMEMBERED = 400_000
#: The same limit in bytes of strings and ids, for long chunks.
REMEMBERED_BYTES = 1 << 26
#: A word of plain letters and the ASCII punctuation behind it: two pre-tokens, on which the merges alone decide.
PLAIN = r"^(?P<lead>[\x{1}\n]?)(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-/:-@\[-`{-~]*)$"
#: Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
OTHER = [b for b in range(256) if b not in PRINTABLE]
BYTE_LETTERS = {b: chr(256 + OTHER.index(b)) if b in OTHER else chr(b) for b in range(256)}
LARGE = pa.large_string()
_encoders: dict[str, "Encoder"] = {}


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` one after the other."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Memory:
    """Ids of the strings met so far, in flat arrays; ``make`` gives the ids of strings, one after the other, and the number of each."""

    def __init__(self, make: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        self.make = make
        self.keys = pa.array([], LARGE)
        self.pool = np.empty(0, np.uint32)
        self.starts = self.sizes = np.empty(0, np.int64)

    def _keep(self, at: np.ndarray) -> None:
        self.keys = self.keys.take(pa.array(at))
        self.pool = gathered(self.pool, self.starts[at], self.sizes[at])
        self.sizes = self.sizes[at]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def places(self, distinct: pa.Array) -> np.ndarray:
        """Where each of the distinct strings stands in ``starts`` and ``sizes``."""
        found = pc.index_in(distinct, value_set=self.keys)
        if not found.null_count:
            return found.to_numpy().astype(np.int64)
        missing = found.is_null().to_numpy(zero_copy_only=False)
        at = found.fill_null(0).to_numpy().astype(np.int64)
        fresh = distinct.filter(pa.array(missing))
        if len(self.keys) + len(fresh) > REMEMBERED or self.keys.nbytes + fresh.nbytes + self.pool.nbytes > REMEMBERED_BYTES:
            self._keep(at[~missing])
            at[~missing] = np.arange(len(self.keys))
        at[missing] = len(self.keys) + np.arange(len(fresh))
        ids, sizes = self.make(fresh)
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, ids])
        self.keys = pa.concat_arrays([self.keys, fresh])
        return at

    def ids(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        code = strings.dictionary_encode()
        at = self.places(code.dictionary)[code.indices.to_numpy()]
        return gathered(self.pool, self.starts[at], self.sizes[at]), self.sizes[at]


class Encoder:
    """``batch(texts)``: the ids of all texts in one array, and each text's number of ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, "rb") as f:
            normalizer = json.load(f)["normalizer"]
        self.tokenizer = Tokenizer.from_file(path)
        #: With a normalizer the two known vocabularies drop white space and lower letters; without one, a space is part of the word behind it.
        self.drops_space = normalizer is not None
        self.chunks = Memory(self._chunks)
        self.runs = Memory(self._runs)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, by the library's merges."""
        tokenize = self.tokenizer.model.tokenize
        ids, sizes = array("I"), []
        # All bytes become letters at once; the mark between two runs is in none of them.
        letters = FIRST.join(runs.to_numpy(zero_copy_only=False)).encode().decode("latin-1").translate(BYTE_LETTERS)
        for run in letters.split(BYTE_LETTERS[ord(FIRST)]):
            own = [t.id for t in tokenize(run)]
            ids.extend(own)
            sizes.append(len(own))
        return np.array(ids, np.uint32), np.array(sizes, np.int64)

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut = pc.extract_regex(chunks, PLAIN)
        plain = cut.is_valid()
        lead, word, tail = (x.cast(LARGE) for x in cut.filter(plain).flatten())
        none = pa.scalar("", LARGE)
        if self.drops_space:
            lead, word = pa.repeat(none, len(word)), pc.utf8_lower(word)
        else:
            word = pc.binary_join_element_wise(pc.if_else(pc.equal(lead, none), pa.scalar(" ", LARGE), none), word, none)
            lead = pc.if_else(pc.equal(lead, pa.scalar(FIRST, LARGE)), none, lead)
        # A chunk's three runs stand next to each other; those that it lacks have no ids.
        runs = pa.concat_arrays([lead, word, tail]).take(pa.array(np.arange(3 * len(word)).reshape(3, -1).T.ravel()))
        some = pc.not_equal(runs, none)
        ids, own = self.runs.ids(runs.filter(some))
        each = np.zeros(len(runs), np.int64)
        each[some.to_numpy(zero_copy_only=False)] = own
        sizes = np.zeros(len(chunks), np.int64)
        plain = plain.to_numpy(zero_copy_only=False)
        sizes[plain] = each.reshape(-1, 3).sum(1)
        if plain.all():
            return ids, sizes
        rest = [k[1:] if k[:1] == FIRST else k if k[:1] == "\n" else " " + k for k in chunks.filter(pa.array(~plain)).to_pylist()]
        others = [e.ids for e in self.tokenizer.encode_batch(rest, add_special_tokens=False)]
        sizes[~plain] = [len(x) for x in others]
        out = np.empty(sizes.sum(), np.uint32)
        from_rest = np.repeat(~plain, sizes)
        out[~from_rest] = ids
        out[from_rest] = [i for x in others for i in x]
        return out, sizes

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(LARGE), "")
        unclean = pc.match_substring_regex(texts, UNCLEAN).to_numpy(zero_copy_only=False)
        cut = pc.if_else(pa.array(unclean), pa.scalar("", LARGE), texts)
        first, none = pa.scalar(FIRST, LARGE), pa.scalar("", LARGE)
        parts = pc.split_pattern(pc.binary_join_element_wise(first, pc.replace_substring(cut, "\n", " \n"), none), " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        out, each = self.chunks.ids(parts.values)
        ends = np.cumsum(each)
        ends = np.concatenate([[0], ends])[offsets]
        counts = np.diff(ends)
        if unclean.any():
            pieces, at = [], 0
            for i in np.flatnonzero(unclean):
                own = self.whole(texts[int(i)].as_py())
                pieces += [out[at : ends[i]], own]
                at, counts[i] = ends[i + 1], len(own)  # an unclean text was cut as an empty one: its chunk has no ids
            out = np.concatenate([*pieces, out[at:]])
        return out, counts


def encoder(path: str) -> Encoder:
    """One encoder a worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded_texts(path: str, texts: pa.Array, end_id: int, at_once: int = 2000):
    """Yields each text's ids with ``end_id`` behind them, ``at_once`` texts worked on at a time."""
    encode = encoder(path)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for i in range(0, len(texts), at_once):
        ids, counts = encode.batch(texts.slice(i, at_once))
        ends = np.cumsum(counts)
        for a, b in zip(ends - counts, ends, strict=True):
            own = np.empty(b - a + 1, np.uint32)
            own[:-1], own[-1] = ids[a:b], end_id
            yield own
