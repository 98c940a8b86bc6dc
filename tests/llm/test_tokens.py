"""The encoder against the library, also where its memory is full."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from cindermap.llm import tokens

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
#: Words, leads and tails that are put together at random.
WORDS = ["the", "The", "Straße", "ÀÉÎ", "ÿ", "don't", "x2y", "éa", "H̱", "İ", "Σας", "a_b", "日本", "555-0129", "", "...", "(so)", "_", "\x7f", "µ", "ªº"]
TAILS = ["", "", ".", ",", "'s", "!?", ")]", "`", "’"]
LEADS = [" ", " ", " ", "\n", "  ", "\t", " "]


class Counted:
    """A tokenizer that notes which pre-tokens its model merges."""

    def __init__(self, tokenizer):
        self.own, self.asked, self.model = tokenizer, [], self

    def tokenize(self, run):
        self.asked.append(run)
        return self.own.model.tokenize(run)

    def __getattr__(self, name):
        return getattr(self.own, name)


def ids_of(encoder, texts):
    out, counts = encoder.batch(pa.array(texts))
    return [x.tolist() for x in np.split(out, np.cumsum(counts)[:-1])]


def by_library(encoder, texts):
    return [encoder.whole(t or "").tolist() for t in texts]


@pytest.mark.parametrize("name", NAMES)
def test_words_of_every_batch_are_merged_once(name, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 100)
    encoder = tokens.Encoder(public_tokenizers.path(name))
    encoder.tokenizer = counted = Counted(encoder.tokenizer)
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4)) + "q"
    common = [word(i) for i in range(30)]
    for k in range(1, 9):  # the first batch has the common words alone, each further one brings 40 new words
        texts = [" ".join(["a", *common, *([word(1000 * k + i) for i in range(40)] if k > 1 else [])])] * 2
        assert ids_of(encoder, texts) == by_library(encoder, texts)
    assert len(counted.asked) == len(set(counted.asked)) == 31 + 7 * 40


@pytest.mark.parametrize("limits", [(400_000, 1 << 26), (20, 1 << 26), (400_000, 500)])
@pytest.mark.parametrize("name", NAMES)
def test_ids_are_the_librarys(name, limits, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", limits[0])
    monkeypatch.setattr(tokens, "REMEMBERED_BYTES", limits[1], raising=False)
    encoder = tokens.Encoder(public_tokenizers.path(name))
    rng = np.random.default_rng(5)
    pick = lambda of: of[rng.integers(len(of))]
    for _ in range(12):
        texts = [None, "", *("".join(x for _ in range(rng.integers(1, 9)) for x in (pick(WORDS), pick(TAILS), pick(LEADS[: rng.integers(1, 8)]))) for _ in range(40))]
        assert ids_of(encoder, texts) == by_library(encoder, texts)
    assert ids_of(encoder, [None, "", "..."]) == by_library(encoder, [None, "", "..."])
