"""Operator 13 against all pairs of words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cindermap.llm import spelling


def counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    i = next((i for i, (x, y) in enumerate(zip(short, long, strict=False)) if x != y), len(short))
    return short[i:] == long[i + 1 :]


def brute(rows):
    words = counted(rows)
    near = {w: [] for w in words}
    by_length = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for n, own in by_length.items():
        for a in own:
            near[a] += [b for m in (n - 1, n, n + 1) for b in by_length.get(m, ()) if one_apart(a, b)]
    form = {w: min(near[w], key=lambda v: (-words[v], v)) if near[w] else None for w in words}
    form = {w: f if f and words[f] >= 2 * words[w] else None for w, f in form.items()}
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    letters = list("abcdeé×ÿ")
    base = ["".join(rng.choice(letters, rng.integers(5, 9))) for _ in range(40)] + ["aaaaa", "aaaaaa", "aaaaaaa", "abababab", "babababa"]
    out = []
    for i in range(300):
        words = []
        for w in rng.choice(base, 30):
            for _ in range(rng.integers(0, 3)):
                at, kind, c = rng.integers(0, len(w)), rng.integers(0, 4), rng.choice(letters)
                w = w[:at] + c + w[at:] if kind == 0 else w[:at] + w[at + 1 :] if kind == 1 else w[:at] + c + w[at + 1 :] if kind == 2 else w
            words.append(w.upper() if rng.integers(0, 9) == 0 and w.isascii() else w)
        out.append((i if i % 50 else None, " ".join(words)))
    chain = [("chainaaaa", 3), ("chainaaab", 6), ("chainaabb", 12), ("chainabbb", 24), ("chainbbbb", 48), ("chainbbbc", 96), ("chainbbcc", 192)]
    out += [(7, None), (8, ""), (9, "日本 12 _ "), (10, "x" * 5000 + " " + "x" * 4999), (10, "x" * 5000), (11, "x" * 5000 + " " + "x" * 4999 + "\n" + "x" * 4999 + "Éa"), (11, "Éa")]
    return out + [(1000, " ".join(w for w, n in chain for _ in range(n)))] * 2


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "x") for i, t in rows], "doc_id long, text string, h long, word string").repartition(5)


def test_against_all_pairs(spark, rows):
    want = brute(rows)
    assert sum(w[1] is not None for w in want) > 40 and got(spelling.variant_groups(frame(spark, rows))) == want


def test_many_passes_and_shards(spark, rows, monkeypatch):
    monkeypatch.setattr(spelling, "FILTER_BYTES", 256)
    assert got(spelling.variant_groups(frame(spark, rows))) == brute(rows)


def test_shards_of_one_length():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    blocks = {7: 125}
    real, spelling.SHARD_BLOCKS = spelling.SHARD_BLOCKS, 10
    try:
        shard = spelling.block_of(h, 125) // 10
        import pyarrow as pa

        built = [spelling._shard_bits(blocks)(pa.table({"length": [7] * (shard == s).sum(), "shard": [int(s)] * (shard == s).sum(), "h": h[shard == s].view(np.int64)})) for s in np.unique(shard)]
        made = [(7, t["shard"][0].as_py(), t["bits"][0].as_py()) for t in built]
        assert len(spelling.Filters(blocks, made).hold(7, h)) == len(h)
        half = [spelling.Filters(blocks, made[a::2]).hold(7, h) for a in (0, 1)]
        assert sorted(np.concatenate(half).tolist()) == list(range(len(h)))
        other = rng.integers(0, 2**63, 100_000).astype(np.uint64)
        assert len(spelling.Filters(blocks, made).hold(7, other)) < 2000
    finally:
        spelling.SHARD_BLOCKS = real


def test_empty_and_rare(spark):
    df = frame(spark, [(1, "seldom words only"), (2, None)])
    assert got(spelling.variant_groups(df)) == [] == got(spelling.variant_groups(df.limit(0)))


def test_real_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert got(spelling.op13_spelling_variants(spark, small)) == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
