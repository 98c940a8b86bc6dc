"""Each operator on a small hard table, against brute force, and on the cases its docstring defines."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from cindermap.llm import ann, decontaminate, linedup, neardup, packing, shards, simhash, substrings, tokenbin, toxicity, warc
from cindermap.llm.common import shared_dir
from cindermap.operators.graph import components

WORDS = [f"w{i:02d}" for i in range(60)]
#: Extra columns whose names the operators use inside.
CLASH = "fp long, key long, score double, line string, n long, rank int, found string"


def passage(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, 60, n))


def texts():
    shared = passage(1, 30)
    line = "One line that many of these documents share, word for word."
    out = [
        (1, passage(2, 80)), (2, passage(2, 80)), (3, passage(2, 80) + " tail"), (4, f"{passage(3, 25)} {shared} {passage(4, 9)}"), (5, f"{shared}\n{passage(5, 40)}"),
        (6, None), (7, ""), (8, " \t\n "), (9, "Short"), (10, "a " * 90 + "b"), (11, "b " + "a " * 70), (12, shared + " " + shared), (13, "x y " * 60), (14, "Ünïcödé   ſtraße   İ Σας\r\nend"),
        (15, f"{line}\n{passage(6, 8)}"), (16, f"  {line.upper()} \n{passage(7, 8)}"), (17, f"{passage(8, 8)}\n{line}"), (18, f"{line}\n{line}"), (19, f"{line}\n\n"), (20, " ".join(passage(30, 20_000).split())),
        (20, passage(9, 30)), (21, passage(9, 30)), (21, passage(9, 30)), (None, passage(2, 80)), (22, "tab\tsep  two\x0bthree\x0cfour"), (23, "<|endoftext|> mid <|endoftext|>"),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i is None or i % 3 == 0 else "en", "s", 1, *[None] * 7) for i, t in texts()]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def distinct_texts():
    """The table without repeated and null ids, for brute force."""
    seen = {}
    for i, t in texts():
        if i is not None and i not in (20, 21):
            seen[i] = t
    return seen | {20: texts()[20][1], 21: passage(9, 30)}


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(list(distinct_texts().items()), "doc_id long, text string").repartition(4)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- 1 -----------------------------------------------------------------------------------------------------------------


def vectors(spark, n, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, 24)).astype(np.float32)
    return x, spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], "vec_id long, embedding array<float>, label int")


def test_nearest_recall(spark):
    x, df = vectors(spark, 6000)
    got = ann.nearest(df, F.col("vec_id") % 100 == 0).toPandas()
    hits = 0
    for q in range(0, 6000, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own["score"], d[own["vec_id"]], rtol=1e-12)
        assert own["score"].is_monotonic_increasing
        hits += len(set(np.argsort(d)[:10]) & set(own["vec_id"]))
    assert hits / 600 >= 0.9


def test_nearest_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [0.0, 1.0]), (8, [0.0, 1.0]), (None, [1.0, 1.0]), (0, [5.0, 5.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).toPandas()
    assert set(got["vec_id"]) <= {0, 7, 8, 100}
    first = got[got["query_id"] == 100].sort_values("rank")
    assert first["vec_id"].tolist() == [0, 7, 8, 0] and first["score"].iloc[0] == 0.0
    assert ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_nearest_among_equal_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 16)).astype(np.float32)
    x[rng.permutation(6000)[:2000]] = x[0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("vec_id") % 100 == 0).toPandas()
    same = np.flatnonzero((x == x[0]).all(1))
    queries = [q for q in range(0, 6000, 100) if q in set(same)]
    assert len(queries) > 10
    for q in queries:
        own = got[got["query_id"] == q].sort_values("rank")
        assert own["vec_id"].tolist() == same[same != q][:10].tolist() and (own["score"] == 0).all()


def test_footrule_of_inverted_files():
    rng = np.random.default_rng(3)
    orders = np.stack([rng.permutation(20)[:6] for _ in range(50)])
    files = ann.InvertedFiles(orders, 20)
    rank = np.full((50, 20), 6)
    for i, o in enumerate(orders):
        rank[i, o] = np.arange(6)
    assert (files.footrule(orders[7]) == np.abs(rank - rank[7]).sum(1)).all()


# --- 2 -----------------------------------------------------------------------------------------------------------------


def slow_fingerprint(t, k=4):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates(plain):
    fps = {i: slow_fingerprint(t) for i, t in distinct_texts().items()}
    want = grouped([(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4], fps)
    got = simhash.near_duplicates(plain).toPandas().set_index("doc_id")
    assert got["fingerprint"].to_dict() == {i: f"{f:016x}" for i, f in fps.items()}
    assert got["component_id"].to_dict() == want


def test_links_of_clustered_fingerprints(spark, monkeypatch):
    """Close fingerprints in hot buckets that are dealt into parts."""
    monkeypatch.setattr(simhash, "BUCKET", 40)
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 4)
    fps = {int(b) for b in rng.integers(-(2**63), 2**63, 300)}
    for b in base:
        for _ in range(150):
            x = int(b)
            for bit in rng.choice(63, rng.integers(0, 7), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), len(fps), 4)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    want = grouped([(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4], fps)
    assert {f: got.get(f, f) for f in fps} == want


def test_near_duplicates_cases(docs, empty):
    got = simhash.near_duplicates(docs)
    assert got.count() == len(texts())
    assert {tuple(r) for r in got.where("doc_id IN (6, 7, 8)").collect()} == {(i, "0" * 16, 6) for i in (6, 7, 8)}
    assert got.where("doc_id IS NULL").first()["component_id"] == 1
    assert simhash.near_duplicates(empty).count() == 0


def test_kept_documents(docs, empty):
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    ids = [i for i, _ in rows]
    # 20's two texts are two documents; its second one equals 21's, so of that group 20 stays.
    assert 1 in ids and 2 not in ids and None in ids and ids.count(20) == 2 and 21 not in ids
    assert len(rows) == len(set(rows))
    assert neardup.drop_near_duplicates(empty).count() == 0


def edited(seed, groups, copies, size, edits):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        base = [f"t{x}" for x in rng.integers(0, 5000, size)]
        rows.append((1000 * g, " ".join(base)))
        for k in range(1, copies):
            copy = list(base)
            for e in range(edits):
                copy[int(rng.integers(0, size))] = f"e{g}x{k}x{e}"
            rows.append((1000 * g + k, " ".join(copy)))
    return rows


@pytest.mark.parametrize("stars,part", [(3, 256), (0, 3), (1, 2)])
def test_similar_texts_share_a_group(spark, monkeypatch, stars, part):
    """All pairs over the limit that share a band, by stars or by parts, against all pairs."""
    monkeypatch.setattr(neardup, "STARS", stars)
    monkeypatch.setattr(neardup, "PART", part)
    rows = [*edited(12, 20, 4, 160, 2), *((i + 100_000, t) for i, t in edited(13, 1, 40, 120, 2))]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["root"] for r in neardup.near_duplicate_groups(d).collect()}
    h = {i: simhash.shingle_hashes(t, 5) for i, t in rows}
    sets, fps = {i: neardup.shingle_set(x) for i, x in h.items()}, {i: simhash.majority(x) for i, x in h.items()}
    keys = {i: set(neardup.bands(x)) for i, x in sets.items()}
    links = []
    for a in h:
        for b in h:
            if a < b:
                both = len(np.intersect1d(sets[a], sets[b]))
                alike = both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)
                if (fps[a] ^ fps[b]).bit_count() <= 4 or (alike and keys[a] & keys[b]):
                    links.append((a, b))
    want = grouped(links, h)
    assert {frozenset(i for i in got if got[i] == r) for r in set(got.values())} == {frozenset(i for i in want if want[i] == r) for r in set(want.values())}
    assert len(links) > 100


# --- 3 -----------------------------------------------------------------------------------------------------------------


def labelled(n=400):
    rng = np.random.default_rng(8)
    bad = ["scoundrel", "blockhead", "numbskull"]
    rows = []
    for i in range(n):
        w = [WORDS[j].replace("w", "word") + "abcdefghij"[j % 10] * 2 + "klmnopqrst"[j // 6] for j in rng.integers(0, 60, 25)]
        if toxic := int(i % 4 == 0):
            w[int(rng.integers(0, 25))] = bad[i // 4 % 3]
        rows.append((i, " ".join(w), toxic))
    return rows


def test_toxicity_learns_and_tolerates_gaps(spark):
    rows = labelled()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).toPandas().set_index("doc_id")
    for i, _, toxic in rows:
        assert got.loc[i, "held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = got[got["held_out"]]
    want = np.array([rows[i][2] for i in held.index])
    assert ((held["score"] >= 0.3).astype(int) == held["predicted"]).all()
    assert (held["predicted"] == want).mean() > 0.97
    model = toxicity.fit(docs, labels)
    assert toxicity.text_tokens("s c o u n d r e l!") == ["scoundrel"]
    assert toxicity.text_tokens("good,scoundrel\u00a0tr*sh") == ["good", "goodscoundrel", "scoundrel", "trsh"]

    def reached(texts):
        return model.probability(toxicity.largest_margins(model, pa.array(texts))) >= 0.3

    plain = ("scoundrel", "blockhead", "numbskull")
    edits = [e for w in plain for i in range(1, len(w)) for e in (w[:i] + "y" + w[i:], w[:i] + w[i] + w[i:], w[:i] + "*" + w[i + 1 :], w[:i] + w[i + 1 :])]
    around = [f"{a}{w}{b}" for w in plain for a, b in (("", ""), ("wordaaak,", ""), ("wordbbm\t", "\twordccn"), ("wordddo\u00a0", "\u00a0"), ("(", ")!"), ("", ".wordeep"))]
    assert reached(around).all() and reached(edits).mean() >= 0.9
    assert reached(["-".join(w) for w in plain]).all() and reached([" ".join(w) for w in plain]).all()
    clean = {t for _, text, toxic in rows if not toxic for t in text.split()}
    assert not reached([*clean, " ".join(clean), "", None, "wordaaxk wordbybl"]).any()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34"), (None, "s c o u n d r e l")], "doc_id long, text string")
    scored = {r["doc_id"]: (r["score"], r["held_out"]) for r in odd.select("doc_id", "text", toxicity.held_out_column().alias("held_out")).mapInArrow(toxicity._score(model, None), "doc_id long, held_out boolean, score double, predicted int").collect()}
    assert scored[1] == scored[2] and scored[3][0] == scored[1][0] and scored[None][0] > 0.3 and scored[None][1] is False


def slow_triples(token):
    """Weights of a token's letter triples, counted one by one."""
    code, out = [toxicity.END, *(int(toxicity.CODES[ord(c)]) for c in token), toxicity.END], {}
    for i in range(len(code)):
        for j in range(i + 1, min(len(code), i + 1 + toxicity.REACH)):
            for k in range(j + 1, min(len(code), j + 1 + toxicity.REACH)):
                key = (code[i], code[j], code[k])
                out[key] = out.get(key, 0.0) + toxicity.DECAY ** (j - i - 1 + k - j - 1)
    return out


def slow_scale(token):
    n = len(token) + 2
    return 1 / np.sqrt(sum(toxicity.DECAY ** (2 * (a + b - 2)) * max(0, n - a - b) for a in range(1, toxicity.REACH + 1) for b in range(1, toxicity.REACH + 1)))


def test_kernel_against_plain_triple_counts():
    tokens, marks = ["idiot", "idot", "trash", "abcabc", "été"], ["idiot", "trxash", "abcabc", "mmnop"]
    got = toxicity.features(tokens, marks)
    for i, t in enumerate(tokens):
        for j, m in enumerate(marks):
            a, b = slow_triples(t), slow_triples(m)
            assert np.isclose(got[i, j], sum(v * b.get(k, 0.0) for k, v in a.items()) * slow_scale(t) * slow_scale(m), rtol=1e-5)
    model = toxicity.Model(toxicity.collapsed(marks, np.array([1.0, -0.5, 0.25, 2.0])), 0.1, 1.0, 0.0)
    assert np.allclose(model.margins(tokens), np.maximum(got @ [1.0, -0.5, 0.25, 2.0] + 0.1, toxicity.LOWEST), atol=1e-5)


def test_toxicity_training_leaves_the_driver_no_memory(spark):
    """A sample of many distinct tokens; what the driver's Python holds besides mapped files, in MB."""
    held = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024  # noqa: E731, SIM115
    letters = lambda c: F.translate(F.sha2(F.concat_ws(" ", "doc_id", c.cast("string")), 256), "0123456789", "ghijklmnop")[1:9]
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(100)), letters), F.when(F.col("id") % 4 == 0, "scoundrel")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    toxicity.fit(docs.limit(100), labels)
    before = held()
    model = toxicity.fit(docs, labels)
    assert model is not None and held() - before < 25


def test_toxicity_without_labels(docs, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    assert toxicity.toxicity(empty, none).count() == 0
    assert toxicity.drop_toxic(docs, none).columns == docs.columns


# --- 4 -----------------------------------------------------------------------------------------------------------------


def slow_passages(rows):
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        w = words(t)
        cover = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                cover[s : s + 20] = [True] * 20
            seen.add(key)
        kept = [x for x, c in zip(w, cover, strict=True) if not c]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_passages(plain):
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.passage_report(plain).collect()}
    assert got == slow_passages(distinct_texts())


@pytest.mark.parametrize("seed", range(3))
def test_passages_of_few_words(spark, seed):
    """Runs, periods and dense repeats."""
    rng = np.random.default_rng(seed)
    rows = {i: " ".join(str(x) for x in rng.integers(0, 2 + seed, rng.integers(0, 160)) // (1 + i % 2)) for i in range(60)}
    rows |= {100 + i: " ".join(["ab"] * int(n)) for i, n in enumerate(rng.integers(0, 60, 10))}
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.passage_report(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)).collect()}
    assert got == slow_passages(rows)


def test_passages_cases(docs, empty):
    got = substrings.passage_report(docs).collect()
    assert len(got) == len(texts())
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [0]
    same = [tuple(r) for r in got if r["doc_id"] == 21]
    assert len(same) == 2 and same[0] == same[1]
    assert substrings.passage_report(empty).count() == 0


# --- 5 -----------------------------------------------------------------------------------------------------------------


def test_contaminated(spark, docs, empty):
    item = passage(40, 24)
    edited = item.split()
    edited[5], edited[17] = "other", "words"
    rows = [(1, f"{passage(41, 50)} {item} {passage(42, 30)}"), (2, f"{passage(43, 50)}, {' '.join(edited).upper()}!"), (3, passage(44, 200)), (4, " ".join(item.split()[:6])), (5, None), (None, item)]
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (None, item), (10, passage(45, 30))], "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(d, bench).collect()}
    assert set(got) == {(1, 7), (2, 7)} and got[1, 7] == 1.0
    for (doc, it), score in got.items():
        own, code = decontaminate.split(dict(rows)[doc]), {}
        a = np.array([code.setdefault(w, len(code)) for w in item.split()])
        assert decontaminate.align(a, np.array([code.get(w, -1) for w in own]))[0] / 48 == score
    assert sorted(r["doc_id"] or 0 for r in decontaminate.drop_contaminated(d, bench).collect()) == [0, 3, 4, 5]
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns


def test_edited_copies_beside_exact_ones(spark):
    item = passage(40, 24)
    edited = [w if i % 5 != 4 else f"other{i}" for i, w in enumerate(item.split())]  # 8 of 22 3-grams are left
    gap = item.split()[:12] + passage(47, 16).split() + item.split()[12:]
    rows = [(1, f"{passage(41, 50)} {item} {passage(42, 30)}")]
    rows += [(k, f"{passage(40 + 10 * k, 50)} {' '.join(edited)} {passage(41 + 10 * k, 30)}") for k in (2, 3, 4)]
    rows += [(5, f"{passage(95, 30)} {' '.join(gap)}"), (6, f"{passage(96, 30)} {' '.join(item.split()[:3])} {passage(97, 30)}")]
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    got = {r["doc_id"]: r["score"] for r in found.collect()}
    assert got == {1: 1.0, 2: 36 / 48, 3: 36 / 48, 4: 36 / 48, 5: 32 / 48}


def test_every_third_word_replaced_and_shared_openings(spark):
    """Copies without a common run of three words are found; an opening that all documents and items share makes no candidates."""
    item = [f"own{i}" for i in range(24)]
    third = [w if i % 3 != 2 else f"new{i}" for i, w in enumerate(item)]
    opening = "which of the following"
    items = [(7, " ".join(item))] + [(100 + i, f"{opening} {passage(300 + i, 14)}") for i in range(40)]
    rows = [(1, f"{passage(41, 50)} {' '.join(third)} {passage(42, 30)}")] + [(10 + i, f"{opening} {' '.join(f'd{i}x{j}' for j in range(30))}") for i in range(200)]
    rows += [(1000 + i, f"{passage(500 + i, 9)} {t}") for i, (_, t) in enumerate(items[1:4])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert got.pop((1, 7)) >= 0.5 and {k for k, v in got.items() if v == 1.0} == {(1000 + i, 100 + i) for i in range(3)}
    named = docs.withColumn("doc", F.col("doc_id"))
    grams = bench.withColumn("item", F.col("item_id")).mapInArrow(decontaminate._item_grams(2, 0.5), "gram long, item long, at array<int>, seeds int, least int")
    hits = named.mapInArrow(decontaminate._scan(2, decontaminate.gram_filter(grams)), "doc long, gram long, places array<int>")
    assert decontaminate.seeded(hits, grams).where("doc >= 10 AND doc < 1000").count() == 0


def test_pairs_against_all_alignments(spark, small):
    """On the smallest tables: every pair, aligned whole."""
    docs = [(r["doc_id"], decontaminate.split(r["text"])) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    bench = [(r["item_id"], decontaminate.split(r["text"])) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = set()
    for i, item in bench:
        for d, own in docs:
            if len(set(item) & set(own)) * 2 >= len(set(item)):
                code = {}
                a = np.array([code.setdefault(w, len(code)) for w in item])
                if decontaminate.align(a, np.array([code.get(w, -1) for w in own], np.int64))[0] >= len(item):
                    want.add((d, i))
    found = decontaminate.op5_benchmark_decontamination(spark, small)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want and want


def test_alignment_against_the_plain_table():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(0, 20))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


# --- 6 -----------------------------------------------------------------------------------------------------------------


def test_lake(spark, docs, empty):
    lake = shards.Lake(spark, shared_dir(spark, "lake"), docs.schema, target=200_000, fan=3)
    for i in range(7):
        lake.append(docs.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(7)) == i).coalesce(1))
    before = lake.version()
    assert lake.compact() > 0
    got = lake.read()
    assert got.count() == len(texts()) and got.columns == [*docs.columns, "shard_id", "merged"]
    assert {r["text"] for r in got.collect()} == {t for _, t in texts()}
    assert lake.read(before).count() == len(texts())
    assert lake.vacuum() > 0 and lake.read().count() == len(texts())
    none = shards.Lake(spark, shared_dir(spark, "lake"), docs.schema)
    assert none.read().count() == 0
    none.append(empty)
    assert none.read().count() == 0


def filled(spark, arrivals=4, rows=250, **options):
    table = spark.range(arrivals * rows).withColumns({"merged": F.lit("own"), "shard_id": F.col("id"), "_arrival": F.lit(1)})
    lake = shards.Lake(spark, shared_dir(spark, "lake"), table.schema, target=1 << 20, fan=4, **options)
    for i in range(arrivals):
        lake.append(table.where(F.floor(F.col("id") / rows) == i).coalesce(1))
    return table, lake


def ids_in(lake):
    return sorted(r["id"] for r in lake.read().select("id").collect())


def test_two_compactors_and_an_append(spark):
    table, lake = filled(spark)
    assert lake.read().columns == ["id", "merged", "shard_id", "_arrival", "_shard_id", "_merged"]
    other = shards.Lake(spark, lake.folder, table.schema, target=1 << 20, fan=4)
    run = lake.due()
    assert other.due() == run and len(run) == 4
    other.append(table.where("id < 3").coalesce(1))  # arrives while both merge
    assert lake.merge(run) and not other.merge(run)
    assert ids_in(lake) == sorted([*range(1000), 0, 1, 2])
    assert {r["merged"] for r in lake.read().collect()} == {"own"}


def test_append_between_a_change_and_its_commit(spark):
    table, lake = filled(spark, arrivals=1)
    calls = []

    def change(now):
        calls.append(len(now))
        if len(calls) == 1:
            lake.append(table.where("id < 2").coalesce(1))
        return now[1:] if len(calls) > 1 else now

    assert lake.update(change) and calls == [1, 2]
    assert ids_in(lake) == [0, 1]


def test_dead_and_slow_writers(spark):
    table, lake = filled(spark, arrivals=1, rows=10, lease=0.0)
    # Dead after its claim: the version is not there, and the next writer takes it over.
    dead = lake.version() + 1
    assert lake._claim(dead) == 0 and lake.version() == dead - 1
    lake.append(table.where("id < 2").coalesce(1))
    assert lake.versions()[dead] == 1 and ids_in(lake) == sorted([*range(10), 0, 1])
    # A live claim is waited for, not taken.
    waiting = shards.Lake(spark, lake.folder, table.schema, lease=1e6)
    assert waiting._claim(dead + 1) == 0 and waiting._claim(dead + 1) is None
    # The slow writer's manifest is in place before the one who took over looks: it is passed on, and nobody's change is lost or doubled.
    slow = lake.manifest()[:1]
    real, done = lake._claim, []

    def claim(version):
        if not done:
            done.append(version)
            lake._publish(version, 0, slow)
            assert lake._fs.createNewFile(lake._file(version, 1, "claim"))
            return 1
        return real(version)

    lake._claim = claim
    lake.append(table.where("id = 5").coalesce(1))
    assert lake.manifest(done[0]) == slow and ids_in(lake) == sorted([*range(10), 5])


def test_late_claims_and_dead_winners(spark):
    table, lake = filled(spark, arrivals=1, rows=10, lease=0.0)
    last = lake.version()
    # A claim that comes late for a committed version hides nothing.
    assert lake._fs.createNewFile(lake._file(last, 7, "claim"))
    assert lake.version() == last and len(ids_in(lake)) == 10
    lake.append(table.where("id < 2").coalesce(1))
    assert len(ids_in(lake)) == 12
    # A slow writer whose claim was voided learns it, and its change is made on the version of the one who took over.
    slow = shards.Lake(spark, lake.folder, table.schema, lease=0.0)
    real = slow._publish

    def overtaken(version, attempt, own):
        slow._publish = real
        lake.append(table.where("id = 3").coalesce(1))
        return real(version, attempt, own)

    slow._publish = overtaken
    slow.append(table.where("id = 4").coalesce(1))
    assert ids_in(lake) == sorted([*range(10), 0, 1, 3, 4])
    # A writer that dies after it has won: the next one puts its manifest into place.
    rename = lake._renamed
    lake._renamed = lambda v, k, a, b: False if b == "json" else rename(v, k, a, b)
    with pytest.raises(OSError):
        lake.append(table.where("id = 5").coalesce(1))
    lake._renamed = rename
    slow.append(table.where("id = 6").coalesce(1))
    assert ids_in(lake) == sorted([*range(10), 0, 1, 3, 4, 5, 6])
    # Vacuum: old manifests go, what no manifest lists only after its time.
    table.where("id = 7").coalesce(1).write.parquet(lake._new(0))
    assert lake.vacuum() == 0 and len(lake.versions()) == 1 and lake.vacuum(orphans=-1.0) == 1
    assert ids_in(lake) == sorted([*range(10), 0, 1, 3, 4, 5, 6])


def test_near_dedup_keeps_a_column_of_its_own_name(spark):
    rows = [(1, passage(2, 80), 5), (2, passage(2, 80), 6), (3, passage(9, 80), 7)]
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, _near_text_hash long"))
    assert sorted((r["doc_id"], r["_near_text_hash"]) for r in kept.collect()) == [(1, 5), (3, 7)]


# --- 7 -----------------------------------------------------------------------------------------------------------------


def test_archives(spark):
    long = "p" * 150
    rows = [(1, "http://a/ b\n", "x"), (2, None, long), (3, "u", long), (4, "u", None), (5, "u", "x"), (None, "u", long), (6, "u", "é" * 60), (7, "u", "é" * 60), (8, "u", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(2)
    written = warc.write_archives(pages, shared_dir(spark, "warc")).select("path").collect()
    got = {r["page_id"]: r for r in warc.read_archives(spark.createDataFrame(written, "path string")).collect()}
    assert len(got) == len(rows)
    for page_id, url, html in rows:
        raw, r = (html or "").encode(), got[page_id]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r["payload"] == raw) if r["record_type"] == "response" else r["payload"] is None
    assert {p: r["refers_to"] for p, r in got.items() if r["refers_to"]} == {3: 2, None: 2, 7: 6}
    assert got[1]["url"] == "http://a/%20b%0A" and got[2]["url"] is None


def test_archive_with_dictionary_and_damage():
    import io

    records = [warc.record(i, "u", f"<html><body>{passage(i, 400)}</body></html>".encode(), hashlib.sha256(f"<html><body>{passage(i, 400)}</body></html>".encode()).hexdigest(), None) for i in range(300)]
    raw = b"".join(warc.archive(records))
    assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_FRAME
    assert list(warc.frames(io.BytesIO(raw))) == records
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(raw[:-3])))
    good = records[3]
    for bad in (good.replace(b"WARC/1.1", b"WARC/9.9"), good + b"x", good.replace(b"<body>", b"<bodY>"), good.replace(b"Content-Length: ", b"Content-Length: 1", 1)):
        with pytest.raises(ValueError):
            warc.parsed(bad)


def test_no_archives(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_archives(none, shared_dir(spark, "warc")).count() == 0


# --- 8, 10 -------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_token_files(spark, docs, empty, tokenizers):
    folder = shared_dir(spark, "tokens")
    parts = tokenbin.write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"), 49_408, 2)
    got = tokenbin.read_tokens(spark, folder, parts, 49_408).collect()
    start = 0
    want = []
    for i, t in sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        own = np.array(ids_of(tokenizers["word_bpe_49k.json"], t), "<u4")
        want.append((i, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokenbin.read_tokens(spark, folder, tokenbin.write_tokens(empty, shared_dir(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), 49_408, 2), 49_408).count() == 0


def test_packing(docs, empty, tokenizers):
    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack_documents(docs, path, 2).toPandas()
    want = []
    for i, t in texts():
        ids = np.array(ids_of(tokenizers["byte_bpe_50k.json"], t), "<u4")
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i or -1, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(tuple(int(x) for x in r) for r in got.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == sorted(want)
    for _, own in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert own["length"].sum() <= 1024 and own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]]
    assert got["sequence_id"].nunique() == packing.fewest(got["length"].value_counts().to_dict(), 1024)
    assert packing.pack_documents(empty, path, 2).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_pack_is_valid_and_no_worse_than_best_fit(seed):
    rng = np.random.default_rng(seed)
    counts = {}
    for k in np.clip(rng.lognormal(5.5, 1.2, [5, 40, 300, 3000, 900, 60][seed]).astype(int), 1, 1024):
        counts[int(k)] = counts.get(int(k), 0) + 1
    runs, placed = packing.pack(counts), {}
    for items, n in runs:
        assert sum(items) <= 1024
        for k in items:
            placed[k] = placed.get(k, 0) + n
    assert placed == counts
    used = sum(n for _, n in runs)
    assert packing.fewest(counts, 1024) <= used <= sum(n for _, n in packing.best_fit(counts, 1024))


def least_bins(items, capacity):
    """The optimum, by trying every place of every item."""
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in sorted({x for x in bins if x + items[i] <= capacity}):
            j = bins.index(b)
            go(i + 1, [*bins[:j], b + items[i], *bins[j + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_pack_finds_the_optimum_of_small_instances(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(12, 60))
    items = sorted((int(x) for x in rng.integers(1, capacity // 2 + 6, rng.integers(3, 11))), reverse=True)
    counts = {k: items.count(k) for k in set(items)}
    assert sum(n for _, n in packing.pack(counts, capacity, 400_000)) == least_bins(items, capacity)


def test_bin_completion_beats_best_fit():
    # Best fit puts 6 with 4 and needs three bins of 10.
    assert sum(n for _, n in packing.pack({6: 1, 5: 1, 4: 1, 3: 1, 2: 1}, 10)) == 2
    small = {44: 2, 24: 2, 22: 2, 21: 2, 17: 2, 8: 2, 6: 4}
    assert sum(n for _, n in packing.pack(small, 61)) <= sum(n for _, n in packing.best_fit(small, 61))


# --- 9 -----------------------------------------------------------------------------------------------------------------


def slow_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    holders = {}
    for i, t in rows.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in rows.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_lines(plain):
    got = {r["doc_id"]: tuple(r)[1:] for r in linedup.line_report(plain).collect()}
    want = slow_lines(distinct_texts())
    assert got == want and sum(n for _, n, _ in want.values()) > 3


def test_lines_over_many_shards(plain, monkeypatch):
    monkeypatch.setattr(linedup, "SHARD_KEYS", 1)
    got = {r["doc_id"]: tuple(r)[1:] for r in linedup.line_report(plain, min_chars=4, min_docs=2).collect()}
    assert got == slow_lines(distinct_texts(), 4, 2)


def test_lines_cases(docs, empty):
    assert linedup.line_report(docs).count() == len(texts())
    assert linedup.line_report(docs).where("doc_id = 6").first()["n_lines"] == 1
    kept = linedup.drop_repeated_lines(docs)
    assert kept.schema == docs.schema and kept.where("doc_id = 6").first()["text"] is None
    assert linedup.line_report(empty).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    fp, n, last = (rng.integers(0, 2**62, len(h)) for _ in range(3))
    made = linedup.PerfectHash.from_bytes(linedup.PerfectHash.build(h, fp, n, last).to_bytes())
    assert sorted(made.rank(h, fp)) == list(range(len(h)))
    got = made.probe(h, fp)
    assert (got[0] == n).all() and (got[1] == last).all()
    # Keys that share one half are told apart by the other.
    same = np.full(50, h[0])
    twins = linedup.PerfectHash.build(same, fp[:50], n[:50], last[:50])
    assert (twins.probe(same, fp[:50])[0] == n[:50]).all() and not twins.probe(same, fp[50:100])[0].any()
    other = rng.integers(0, 2**63, 1000).astype(np.uint64)
    assert not made.probe(other, rng.integers(0, 2**62, 1000))[0].any()
