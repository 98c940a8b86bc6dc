"""Operator 12 against a plain alignment of whole texts by the two libraries."""

import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cindermap.llm import align
from cindermap.llm.tokens import BYTE_LETTERS

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n", "a", "Plain words, twice. Plain words, twice.", " two  spaces   three ", "tab\tand\r\nbreaks\n\n\nmore\n ", "<|endoftext|> and <s> x </s><unk><0x41>", "▁ mark ▁▁", "Ünïcödé straße İ ﬁ é  x　y", "日本語の文章です。漢字",
    "👩‍👩‍👧 emoji 🏳️‍🌈!", "x" * 3000, "don't can't we'll I'd", "\x00nul\x01 \x7f", "the the the the", "https://example.org/a?b=c&d=%20 1234567890 3.14159", "word \n word", " line\u0085sep", "the cat", "the cat sat",
]


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(text, libraries):
    """A ids, B ids, groups and links, by comparing every A token's bytes with every B token's near it."""
    t, p = libraries
    if not text:
        return None
    letters = {c: b for b, c in BYTE_LETTERS.items()}
    a = [(i, bytes(letters[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()) for i in p.encode(text)]
    if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
        return None
    ranges = []
    for tokens in (a, b):
        at, out = 0, []
        for i, x in tokens:
            out.append((i, at, at + len(x)))
            at += len(x)
        ranges.append(out)
    ends = sorted({e for _, _, e in ranges[0]} & {e for _, _, e in ranges[1]})
    start, groups = 0, []
    for end in ends:
        groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in ranges))
        start = end
    links = [(i, j) for i, s, e in ranges[0] for j, u, v in ranges[1] if s < v and u < e]
    return len(a), len(b), groups, links


def brute(texts, libraries):
    found = [plain(x, libraries) for x in texts]
    counts = Counter(pair for f in found if f for pair in set(f[3]))
    most = {}
    for (i, _), n in counts.items():
        most[i] = max(most.get(i, 0), n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, "", 0, 0))
        else:
            out.append((f[0], f[1], len(f[2]), len(f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest(), sum(counts[x] == most[x[0]] for x in f[3]), sum(counts[x] for x in f[3])))
    return out


def rows(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"))) for r in df.collect())


def test_odd_texts(spark, libraries):
    data = [(i if i != 5 else None, x, "n", None) for i, x in enumerate(ODD)] + [(20, "the cat", "n", None)] * 2
    df = spark.createDataFrame(data, "doc_id long, text string, pairs string, n_a string").repartition(3)
    want = brute([x for _, x, *_ in data], libraries)
    assert rows(align.align_tokenizers(df, A, B)) == sorted((i is None, i or 0, *w) for (i, *_), w in zip(data, want, strict=True))
    assert rows(align.align_tokenizers(df.limit(0), A, B)) == []


def test_real_texts(spark, small, libraries):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(5)
    data = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if len(r["text"] or "") < 12_000]
    keep = docs.where("text is null or length(text) < 12000")
    want = brute([x for _, x in data], libraries)
    assert rows(align.align_tokenizers(keep, A, B)) == sorted((i is None, i or 0, *w) for (i, _), w in zip(data, want, strict=True))


def test_small_portions_shards_and_memory(spark, small, libraries, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40).where("length(text) < 6000")
    before = rows(align.align_tokenizers(docs, A, B))
    looked = align.looked_up
    monkeypatch.setattr(align, "SHARD_PAIRS", 300)  # read by the driver
    assert looked is align.looked_up and rows(align.align_tokenizers(docs, A, B)) == before
    own = align.Aligner(A, B)
    texts = pa.array([r["text"] for r in docs.select("text").collect()])
    whole = own.aligned(texts)
    monkeypatch.setattr(align, "REMEMBERED_WINDOWS", 3)
    monkeypatch.setattr(align, "mixed", lambda x: x & 1)  # nearly all windows share a hash
    again = align.Aligner(A, B).aligned(texts)
    assert (whole[0] == again[0]).all() and whole[1] == again[1] and (whole[2] == again[2]).all() and (whole[3] == again[3]).all()


def test_groups_as_text(spark):
    got = align.align_tokenizers(spark.createDataFrame([(1, "the cat")], "doc_id long, text string"), A, B, text=True).collect()[0]
    assert got["n_groups"] == 2 and got["groups"].count("|") == 2 and got["groups"].count(";") == 1
