"""Operator 3: toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The unit is the token. Texts are split at white space (any of Unicode's); a word without its non-letters, lower-cased, is a token, so
that "i-d*iot" is "idiot", and so is each run of three or more letters in it, so that "good,idiot" holds "idiot"; a letter written more
than twice in a row counts twice; runs of single letters ("i d i o t") count as one more token. Training and scoring use
the same rule (``word_tokens``). The kernel compares two tokens by the triples of letters (with marks at
both ends) they have in common as subsequences: a triple that skips g letters counts ``DECAY`` ** g, up to ``REACH``
letters apart, over the square root of the token's number of triples. An inserted or lost letter changes few triples.

Training, on the driver, from at most ``POSITIVES`` + ``NEGATIVES`` labelled texts (the smallest hashes of their doc_ids; all, if
fewer):

1. Landmarks are the tokens that tell the labels apart best, and tokens of the other texts. Their kernel matrix gives the
   Nystroem features.
2. Labels belong to texts, insults are single tokens: the most toxic token stands for a toxic text (first by its odds,
   then by the machine's own margin), besides tokens that clean texts hardly have and chance does not explain; all tokens of a clean text are negative, the hardest of them in each round.
3. A squared-hinge support vector machine is fitted by Newton steps, and its margins, the largest token's margin of
   held-back training texts, become probabilities by a logistic fit that weighs labels as they occur. The round whose fit
   has the smallest loss on the held-back texts stays.
4. So that an inserted, lost or starred letter stays near the original, the positive tokens are joined by one-letter
   variants of themselves, and the logistic fit sees the held-back toxic texts a second time with variants in place of their words.

The machine is linear in the triples, so scoring needs one table of 2^18 weights: Spark's tasks score the distinct tokens of
their texts, whole, and each text gets its largest margin. Only the text is used.

Defined cases: a null, empty or letterless text has the lowest margin and score; labels with a null doc_id or label are not
used, of repeated ones the largest counts, and of texts that repeat a doc_id the smallest is trained on; texts of over ``LONGEST``
characters are scored whole but not trained on; without both labels among the training texts all scores are 0; rows that
repeat a doc_id each get a row; a null doc_id is not held out; empty tables give an empty result; other columns are
ignored or, by ``drop_toxic``, passed on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindermap.llm.common import give_back, table

#: Bounds of the labelled sample.
POSITIVES, NEGATIVES = 1500, 3000
LONGEST = 1_000_000
LANDMARKS = 240
#: Tokens that are miswritten in training, the one-letter variants of each, and these variants' share of its cost.
MISWRITTEN, VARIANTS, VARIANT_COST = 20, 12, 4.0
#: The variants' share of a held-back toxic text's weight in the logistic fit.
VARIANT_WEIGHT = 0.4
REACH, DECAY = 3, 0.6
THRESHOLD = 0.3
ROUNDS, HARDEST, PENALTY = 5, 2000, 4.0
LOWEST = -3.0
#: Tokens scored at once, which bounds memory.
AT_ONCE = 50_000
LETTERS = 64
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][\W_]+){3,}[^\W\d_](?![^\W_])")
#: RE2's form of SPACED, to find the few texts that need it.
SPACED_RE2 = r"(?:^|[^\pL\pN])(?:\pL[^\pL\pN]+){3,}\pL(?:$|[^\pL\pN])"
STEPS = [(a, b, DECAY ** (a + b - 2)) for a in range(1, REACH + 1) for b in range(1, REACH + 1)]


def letter_codes() -> np.ndarray:
    """a-z are 1 to 26; other letters share 27 to 62; what is no letter is 0. The marks at a token's ends are 63."""
    table_ = np.zeros(0x250, np.int32)
    for c in range(0x250):
        x = chr(c).lower()
        if x.isalpha():
            table_[c] = ord(x[0]) - 96 if "a" <= x[0] <= "z" else 27 + ord(x[0]) * 7 % 36
    return table_


CODES = letter_codes()
END = LETTERS - 1


def coded(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all tokens, an end mark before and behind each, and where each token starts."""
    points = np.frombuffer((" " + "  ".join(tokens) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 2
    code = np.where(points < len(CODES), CODES[np.minimum(points, len(CODES) - 1)], 27 + (points % 36).astype(np.int32))
    starts = np.cumsum(sizes) - sizes
    code[starts] = END
    code[starts + sizes - 1] = END
    keep = code > 0
    keep[2:] &= (code[2:] != code[1:-1]) | (code[2:] != code[:-2]) | (code[2:] == END)
    before = np.cumsum(keep) - keep
    return code[keep], before[starts]


def triples(code: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pattern of gaps: positions of the first letters, the triples' numbers, and their weight."""
    ends = np.repeat(np.append(starts[1:], len(code)), np.diff(np.append(starts, len(code))))
    at = np.arange(len(code))
    for a, b, weight in STEPS:
        first = np.flatnonzero(at + a + b < ends)
        yield first, (code[first] * LETTERS + code[first + a]) * LETTERS + code[first + a + b], weight


def scales(starts: np.ndarray, total: int) -> np.ndarray:
    """1 / sqrt(weight of a token's triples), which depends on its length alone."""
    sizes = np.diff(np.append(starts, total))
    return 1 / np.sqrt(1e-9 + sum(w * w * np.maximum(0, sizes - a - b) for a, b, w in STEPS))


@dataclass
class Model:
    weights: np.ndarray  # one for each triple
    bias: float
    slope: float
    offset: float

    def margins(self, tokens: list[str]) -> np.ndarray:
        if len(tokens) > AT_ONCE:
            return np.concatenate([self.margins(tokens[i : i + AT_ONCE]) for i in range(0, len(tokens), AT_ONCE)])
        if not tokens:
            return np.zeros(0)
        code, starts = coded(tokens)
        sums = np.zeros(len(code))
        for first, number, weight in triples(code, starts):
            sums[first] += weight * self.weights[number]
        out = np.add.reduceat(sums, starts) * scales(starts, len(code)) + self.bias
        return np.maximum(np.where(np.diff(np.append(starts, len(code))) < 5, LOWEST, out), LOWEST)  # under three letters: no token

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def features(tokens: list[str], marks: list[str]) -> np.ndarray:
    """Kernel of each token with each landmark."""
    code, starts = coded(marks)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(code))))
    parts = [(number, owner[first], np.full(len(first), weight)) for first, number, weight in triples(code, starts)]
    number, owner, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    present, slot = np.unique(number, return_inverse=True)
    by_slot = np.zeros((len(present) + 1, len(marks)), np.float32)
    np.add.at(by_slot, (slot, owner), weight * scales(starts, len(code))[owner])
    where = np.full(LETTERS**3, len(present))
    where[present] = np.arange(len(present))
    out = np.zeros((len(tokens), len(marks)), np.float32)
    for i in range(0, len(tokens), 500):
        code, starts = coded(tokens[i : i + 500])
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(code))))
        for first, number, weight in triples(code, starts):
            known = np.flatnonzero(where[number] < len(present))
            if len(known):
                of = owner[first[known]]  # in order
                heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                out[i + of[heads]] += np.add.reduceat(weight * by_slot[where[number[known]]], heads, axis=0)
        out[i : i + len(starts)] *= scales(starts, len(code))[:, None]
    return out


def collapsed(marks: list[str], alpha: np.ndarray) -> np.ndarray:
    """The weight of each triple in sum(alpha_l * k(., landmark l))."""
    code, starts = coded(marks)
    share = np.repeat(alpha * scales(starts, len(code)), np.diff(np.append(starts, len(code))))
    out = np.zeros(LETTERS**3)
    for first, number, weight in triples(code, starts):
        np.add.at(out, number, weight * share[first])
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Squared-hinge machine with a bias in the last column of ``x``, by Newton steps on the support vectors."""
    w, ridge = np.zeros(x.shape[1]), np.ones(x.shape[1])
    ridge[-1] = 1e-3
    for _ in range(30):
        inside = np.flatnonzero(y * (x @ w) < 1)
        gram, pull = np.diag(ridge), np.zeros(len(w))
        for i in range(0, len(inside), 1000):
            at = inside[i : i + 1000]
            xs = x[at].astype(np.float64)
            weighed = (xs * cost[at, None]).T
            gram += weighed @ xs
            pull += weighed @ y[at]
        new = np.linalg.solve(gram, pull)
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def logistic(margin: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1."""
    target = np.where(toxic == 1, 0.99, 0.01)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, v = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * margin).sum() + 1e-3 * a, g.sum()])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def word_tokens(word: str) -> list[str]:
    """Tokens of one lower-case word: its letters, and each run of three or more of them if others stand between."""
    if word.isalpha():
        return [word]
    runs = "".join(c if c.isalpha() else " " for c in word).split()
    return ["".join(runs), *(r for r in runs if len(r) >= 3 and len(runs) > 1)]


def spaced_tokens(text: str) -> list[str]:
    """Tokens of a lower-case text that are spelled out in single letters."""
    return ["".join(filter(str.isalpha, m)) for m in SPACED.findall(text)]


def text_tokens(text: str | None) -> list[str]:
    """Distinct tokens of one text."""
    text = (text or "").lower()
    return sorted({t for w in set(text.split()) for t in word_tokens(w) if len(t) >= 3} | set(spaced_tokens(text)))


def variants(token: str, most: int = VARIANTS) -> list[str]:
    """One-letter edits of a token of four or more letters: each inner letter lost, and a letter inserted at each inner place."""
    n = len(token)
    lost = [token[:i] + token[i + 1 :] for i in range(1, n - 1)] if n > 3 else []
    letters = "xetqoanz"
    more = [token[:i] + letters[(i + n + ord(token[0])) % 8] + token[i:] for i in range(1, n)] if n > 3 else []
    both = [v for pair in zip(lost, more, strict=False) for v in pair] + more[len(lost) :]
    return list(dict.fromkeys(both[:: max(1, len(both) // most)]))[:most]


def train(tokens: list[str], own: list[np.ndarray], toxic: list[int], rates: tuple[float, float] = (1.0, 1.0)) -> Model | None:
    """``tokens``: the distinct ones, sorted; ``own``: the numbers of each text's. ``rates``: how many texts of label 0 and 1 stand for each one given. None without both labels."""
    toxic_ = np.array(toxic)
    if len({*toxic}) < 2:
        return None
    fitted = np.arange(len(own)) % 4 != 3
    df = np.zeros((2, len(tokens)))
    for numbers, label, f in zip(own, toxic, fitted, strict=True):
        if f:
            df[label, numbers] += 1
    n = [max(1, int((fitted & (toxic_ == k)).sum())) for k in (0, 1)]
    with np.errstate(divide="ignore"):
        odds = np.where(df[1] > 0, np.log((df[1] + 0.1) / (n[1] + 1)) - np.log((df[0] + 0.1) / (n[0] + 1)) + 0.3 * np.log(df[1]), -9.0)
    # Tokens that hardly stand in clean texts, and in so many toxic ones that chance does not explain it.
    sure = np.flatnonzero((df[1] >= 3) & (df[0] * n[1] < 0.02 * df[1] * n[0]) & (df[1] * np.log((n[0] + n[1]) / n[1]) > 7))
    surest = sure[np.argsort(-df[1][sure], kind="stable")]
    told = np.argsort(-odds, kind="stable")[: int((df[1] > 0).sum())]
    negatives = np.flatnonzero(df[0] > 0)
    plain = negatives[np.argsort(-df[0][negatives], kind="stable")]
    first = [*told[: LANDMARKS * 3 // 5], *plain[: LANDMARKS // 5], *plain[LANDMARKS // 5 :: max(1, len(plain) * 5 // LANDMARKS)]]
    marks = list(dict.fromkeys(first))[:LANDMARKS]
    hard = list(negatives[:: max(1, len(negatives) // HARDEST)])
    positive_texts = [x for x, label, f in zip(own, toxic, fitted, strict=True) if f and label == 1 and len(x)]
    back = np.flatnonzero(~fitted) if len({*toxic_[~fitted]}) == 2 else np.arange(len(own))
    named = lambda numbers: [tokens[i] for i in numbers]
    clean = {tokens[i] for i in negatives}
    toxicity_of, best, least = odds, None, np.inf
    for _ in range(ROUNDS):
        landmarks = named(marks)
        values, vectors = np.linalg.eigh(features(landmarks, landmarks).astype(np.float64))
        white = vectors[:, values > 1e-4 * values.max()] / np.sqrt(values[values > 1e-4 * values.max()])
        # A toxic text's witness is its most toxic token.
        positives = Counter(int(x[np.argmax(toxicity_of[x])]) for x in positive_texts) | Counter({int(t): float(np.sqrt(df[1, t])) for t in sure})
        # The tokens that most texts bear out stand for their one-letter edits as well.
        known = sorted((t for t in positives if df[1, t] > 1), key=lambda t: (-df[1, t], t))[:MISWRITTEN]
        edits = {v: VARIANT_COST * positives[t] / VARIANTS for t in known for v in variants(tokens[t]) if v not in clean}
        names = [*named(positives), *edits, *named(hard)]
        y = np.where(np.arange(len(names)) < len(positives) + len(edits), 1.0, -1.0)
        cost = PENALTY * np.array([*positives.values(), *edits.values(), *[1.0] * len(hard)])
        x = np.ones((len(names), white.shape[1] + 1), np.float32)
        for i in range(0, len(names), 1000):
            x[i : i + 1000, :-1] = features(names[i : i + 1000], landmarks) @ white
        w = fit_svm(x, y, cost)
        model = Model(collapsed(landmarks, white @ w[:-1]), float(w[-1]), 1.0, 0.0)
        margin = model.margins(tokens)
        loss = calibrated(model, tokens, margin, [own[i] for i in back], toxic_[back], rates)
        if loss < least:
            best, least = model, loss
        hard = list(dict.fromkeys([*negatives[np.argsort(-margin[negatives], kind="stable")[:HARDEST]], *hard]))
        marks = list(dict.fromkeys([*marks, *hard[: LANDMARKS // 4], *surest[: LANDMARKS // 4]]))
        toxicity_of = margin + 0.05 * odds
    return best


def calibrated(model: Model, tokens: list[str], margin: np.ndarray, own: list[np.ndarray], toxic: np.ndarray, rates: tuple[float, float]) -> float:
    """Fit slope and offset on held-back texts (their tokens' numbers, and labels); returns the loss of the fit."""
    top = [max(LOWEST, margin[x].max()) if len(x) else LOWEST for x in own]
    # Toxic texts once more, with their most toxic word miswritten.
    worst = [tokens[x[np.argmax(margin[x])]] for x, label in zip(own, toxic, strict=True) if label == 1 and len(x)]
    edits = [v[i % len(v)] for i, t in enumerate(worst) if (v := variants(t))]
    top, label = np.array([*top, *model.margins(edits)]), np.array([*toxic, *[1] * len(edits)])
    weight = np.where(label == 1, float(rates[1]), float(rates[0]))
    weight[len(own) :] *= VARIANT_WEIGHT
    model.slope, model.offset = logistic(top, label, weight)
    p = np.clip(model.probability(top), 1e-9, 1 - 1e-9)
    return float(-(weight * np.log(np.where(label == 1, p, 1 - p))).sum() / weight.sum())


def numbered(token_lists: pa.Array) -> tuple[list[str], list[np.ndarray]]:
    """The distinct tokens of all lists, sorted, and each list as numbers of them."""
    values = token_lists.flatten()
    distinct = pc.unique(values)
    distinct = distinct.take(pc.sort_indices(distinct))
    numbers = pc.index_in(values, distinct).to_numpy(zero_copy_only=False).astype(np.int32)
    sizes = pc.list_value_length(token_lists).to_numpy(zero_copy_only=False)
    return distinct.to_pylist(), np.split(numbers, np.cumsum(sizes)[:-1])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("toxic"), pa.array([text_tokens(t.as_py()) for t in rows.column("text")], pa.list_(pa.string()))], ["doc_id", "toxic", "tokens"])


def held_out_column():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> Model | None:
    """Train on a bounded sample of the labelled texts that are not held out."""
    usable = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out_column())
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = usable.where("toxic = 1").orderBy(*order).limit(positives).union(usable.where("toxic = 0").orderBy(*order).limit(negatives))
    # At most positives + negatives rows of two numbers; of their texts, the driver gets the distinct tokens.
    texts = docs.where(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST).select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = one.mapInArrow(_tokens, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic {labels.schema['toxic'].dataType.simpleString()}, tokens array<string>").toArrow()
    if not rows.num_rows:
        return None
    # In an order that does not depend on partitions or labels.
    ids = rows.column("doc_id").to_numpy()
    rows = rows.take(np.lexsort((ids, (ids * 2654435761) % 2**32))).combine_chunks()
    toxic = rows.column("toxic").to_numpy().astype(int)
    drawn = [max(1, int((toxic == k).sum())) for k in (0, 1)]
    tokens, own = numbered(rows.column("tokens").combine_chunks())
    del rows, ids
    model = train(tokens, own, toxic.tolist(), (counts.get(0, 0) / drawn[0], counts.get(1, 0) / drawn[1]))
    del tokens, own
    give_back()
    return model


def largest_margins(model: Model, texts: pa.Array) -> np.ndarray:
    """The largest token margin of each text. Each distinct token of the batch is scored once."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    words = pc.utf8_split_whitespace(texts)
    code = words.values.dictionary_encode()
    tokens = [word_tokens(w.lower()) for w in code.dictionary.to_pylist()]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    scored = np.maximum.reduceat(model.margins([t for own in tokens for t in own]), np.cumsum(sizes) - sizes) if len(tokens) else np.zeros(0)
    each = scored[code.indices.to_numpy()] if len(scored) else np.zeros(0)
    starts = words.offsets.to_numpy()[:-1].astype(np.int64)
    out = np.maximum.reduceat(np.append(each, LOWEST), starts) if len(texts) else np.zeros(0)
    out[np.diff(words.offsets.to_numpy()) == 0] = LOWEST
    for i in np.flatnonzero(pc.match_substring_regex(texts, SPACED_RE2).to_numpy(zero_copy_only=False)):
        out[i] = max([out[i], *model.margins(spaced_tokens(texts[int(i)].as_py().lower()))])
    return out


def _score(model: Model | None, names: list[str] | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                rows = whole.slice(i, 500)
                p = model.probability(largest_margins(model, rows.column("text"))) if model else np.zeros(rows.num_rows)
                if names is None:
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
                else:
                    yield rows.filter(pa.array(p < THRESHOLD))

    return score


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    rows = docs.select("doc_id", "text", held_out_column().alias("held_out"))
    return rows.mapInArrow(_score(fit(docs, labels), None), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, all columns, without the documents that are predicted toxic."""
    return docs.mapInArrow(_score(fit(docs, labels), docs.columns), docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
