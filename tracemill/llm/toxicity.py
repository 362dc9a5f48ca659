"""Toxicity of whole texts: subword-bag embeddings averaged into a linear softmax.

Each word is the mean of the vectors of its hashed character n-grams; a window
of words is the mean of its words; a linear softmax gives its two class
probabilities. Vectors and softmax are trained jointly in numpy. Words that
were never seen share n-gram vectors with those that were, misspellings
included. A text's score is that of its worst window, so a short insult in a
long text is not averaged away; training picks each text's worst window under
the current weights in the same way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.staging import released, small_batches, without

_WORDS = re.compile(r"\w+").findall


@dataclass(frozen=True)
class ToxicityParams:
    """``max_rows``: labelled rows of each class that are fitted at most; the choice is by a hash of the id."""

    max_rows: int = 4000
    max_chars: int = 16_000_000
    dims: int = 4
    buckets: int = 1 << 18
    shortest: int = 3
    longest: int = 6
    window: int = 6
    warm_words: int = 200
    warm_steps: int = 20
    rounds: int = 12
    steps: int = 10
    rate: float = 0.5
    #: every so manieth row of the sample sets the bias and is not fitted
    check_every: int = 4
    #: how much a wrongly rejected share counts against a rightly rejected one when the bias is set
    caution: float = 6.0
    threshold: float = 0.7
    seed: int = 5


def ngrams(words: list[str], p: ToxicityParams) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all n-grams (of UTF-8 bytes, with < and > around a word) and the start of each word among them."""
    raw = [b"<%b>" % w.encode("utf-8", "replace") for w in words]
    sizes = np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(data))  # bytes from here to the word's end
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    h = np.zeros(len(data), np.uint64)
    found, owners = [], []
    for n in range(p.longest):
        h[: len(data) - n] = h[: len(data) - n] * np.uint64(0x100000001B3) + data[n:] + np.uint64(1)
        if n + 1 >= p.shortest:
            ok = np.flatnonzero(left > n)
            mixed = h[ok] + np.uint64(n << 56)
            mixed ^= mixed >> np.uint64(31)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            found.append(((mixed >> np.uint64(40)) % np.uint64(p.buckets)).astype(np.int32))
            owners.append(owner[ok])
    ids, own = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    counts = np.bincount(own, minlength=len(words))
    return ids[order], np.cumsum(counts) - counts


def tokens(text: str) -> list[str]:
    return _WORDS(text.lower())


def fresh(words: np.ndarray, width: int) -> np.ndarray:
    """Where a word does not occur among the ``width`` words before it; repeats count for nothing, or junk that repeats one word would be judged by it alone."""
    order = np.argsort(words, kind="stable")
    again = (np.diff(words[order]) == 0) & (np.diff(order) < width)
    out = np.ones(len(words), bool)
    out[order[1:][again]] = False
    return out


def window_starts(n: int, width: int) -> np.ndarray:
    """Starts of half-overlapping windows that cover ``n`` words."""
    return np.array([0]) if n <= width else np.append(np.arange(0, n - width, max(1, width // 2)), n - width)


def window_means(values: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.minimum(starts + width, len(values))
    return (total[ends] - total[starts]) / np.maximum(ends - starts, 1)


class _Descent:
    """Momentum steps whose largest component is ``rate``: common n-grams move first, and rare ones cannot memorise the texts."""

    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate = value, rate
        self.m = np.zeros_like(value)

    def step(self, grad: np.ndarray) -> None:
        self.m += 0.2 * (grad - self.m)
        self.value -= self.rate * self.m / max(np.abs(self.m).max(), 1e-12)


class ToxicityModel:
    """``weights``: for each n-gram bucket, its vector's part in the difference of the two logits; ``bias`` likewise."""

    def __init__(self, weights: np.ndarray, bias: float, params: ToxicityParams, max_cached: int = 200_000):
        self.weights, self.bias, self.params, self.max_cached = weights, bias, params, max_cached
        self.known: dict[str, float] = {}

    def learn_words(self, words: list[str]) -> None:
        for a in range(0, len(words), 50_000):
            part = words[a : a + 50_000]
            ids, starts = ngrams(part, self.params)
            counts = np.diff(np.append(starts, len(ids)))
            self.known.update(zip(part, (np.add.reduceat(self.weights[ids], starts) / counts).tolist()))

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -60, 60)))

    def logits(self, texts: list[str]) -> np.ndarray:
        split = [tokens(t) for t in texts]
        if len(self.known) > self.max_cached:
            self.known.clear()
        if new := {w for words in split for w in words if w not in self.known}:
            self.learn_words(list(new))
        look, width = self.known.__getitem__, self.params.window
        best = np.full(len(texts), self.bias)
        for i, words in enumerate(split):
            if words:
                values = np.fromiter(map(look, words), float, len(words))
                values *= fresh(values, width)  # equal words have equal values
                best[i] = window_means(values, window_starts(len(words), width), width).max() + self.bias
        return best

    def calibrated(self, texts: list[str], y: np.ndarray) -> ToxicityModel:
        """The bias moved so that ``threshold`` parts these unfitted texts best; kept where a class is missing."""
        if len(set(y.tolist())) < 2:
            return self
        at, p = self.logits(texts), self.params
        cuts = np.unique(at)
        cuts = (cuts[1:] + cuts[:-1]) / 2
        if not len(cuts):
            return self
        above = at[:, None] >= cuts
        gain = above[y == 1].mean(0) - p.caution * above[y == 0].mean(0)
        best = np.flatnonzero(gain >= gain.max() - 1e-12)
        cut = float(cuts[best[len(best) // 2]])
        return ToxicityModel(self.weights, self.bias - cut + float(np.log(p.threshold / (1 - p.threshold))), p)


def fit(texts: list[str], labels: list[int], params: ToxicityParams | None = None) -> ToxicityModel:
    """A model fitted to most rows and calibrated on the others."""
    p = params or ToxicityParams()
    y = np.array(labels, int)
    held = np.zeros(len(y), bool)
    for c in (0, 1):  # of either class alike
        held[np.flatnonzero(y == c)[p.check_every - 1 :: p.check_every]] = True
    model = train([t for t, h in zip(texts, held) if not h], y[~held], p)
    return model.calibrated([t for t, h in zip(texts, held) if h], y[held])


def train(texts: list[str], y: np.ndarray, p: ToxicityParams) -> ToxicityModel:
    """Trains vectors and softmax jointly on whole texts, first on averages of the texts, then on their worst windows.

    Without texts of both classes the model is constant: the share of label 1.
    """
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.0, 0.001, 0.999))
        return ToxicityModel(np.zeros(p.buckets), float(np.log(share / (1 - share))), p)
    rng = np.random.default_rng(p.seed)
    number: dict[str, int] = {}
    rows = [np.array([number.setdefault(w, len(number)) for w in tokens(t)], np.int64) for t in texts]
    words = list(number)
    parts = [ngrams(words[a : a + 50_000], p) for a in range(0, len(words), 50_000)]  # some at a time, for memory
    ids = np.concatenate([i for i, _ in parts])
    counts = np.concatenate([np.diff(np.append(s, len(i))) for i, s in parts])
    starts = np.cumsum(counts) - counts
    del number, words, parts
    table = _Descent(rng.normal(0, 0.01, (p.buckets, p.dims)), p.rate)
    soft = _Descent(np.stack([-np.ones(p.dims), np.ones(p.dims)], 1) * rng.uniform(0.5, 1.0, (p.dims, 1)), p.rate / 20)
    bias = _Descent(np.zeros(2), p.rate / 20)

    def descend(bags: list[np.ndarray], target: np.ndarray, steps: int) -> None:
        """Full-batch steps over bags of words, each word once; each class weighs the same."""
        if len(set(target.tolist())) < 2:
            return
        bags = [np.unique(b) for b in bags]
        flat = np.concatenate(bags)
        bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        words, at = np.unique(flat, return_inverse=True)
        sizes = counts[words]
        begin = np.cumsum(sizes) - sizes
        grams = ids[np.repeat(starts[words] - begin, sizes) + np.arange(sizes.sum())]
        share = 1.0 / np.bincount(bag, minlength=len(bags))
        weight = np.where(target == 1, 0.5 / max((target == 1).sum(), 1), 0.5 / max((target == 0).sum(), 1))
        hot = np.eye(2)[target]
        for _ in range(steps):
            means = np.empty((len(bags), p.dims))
            for j in range(p.dims):  # one dimension at a time, for memory
                vectors = np.add.reduceat(table.value[:, j][grams], begin) / sizes
                means[:, j] = np.bincount(bag, vectors[at], len(bags)) * share
            logits = means @ soft.value + bias.value
            prob = np.exp(logits - logits.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            g = (prob - hot) * weight[:, None]
            to_bag = (g @ soft.value.T) * share[:, None]
            grad = np.empty_like(table.value)
            for j in range(p.dims):
                to_word = np.bincount(at, to_bag[bag, j], len(words)) / sizes
                grad[:, j] = np.bincount(grams, np.repeat(to_word, sizes), p.buckets)
            soft.step(means.T @ g)
            bias.step(g.sum(0))
            table.step(grad)

    short = [i for i, r in enumerate(rows) if 0 < len(r) <= p.warm_words]
    descend([rows[i] for i in short], y[short], p.warm_steps)
    full = [i for i, r in enumerate(rows) if len(r)]
    hard: dict[tuple[int, int], np.ndarray] = {}  # windows of label 0 that were ever the worst
    for _ in range(p.rounds):
        per_gram = (table.value @ (soft.value[:, 1] - soft.value[:, 0])).astype(np.float32)
        value = np.add.reduceat(per_gram[ids], starts).astype(float) / counts
        worst: list[np.ndarray] = []
        for i in full:
            at = window_starts(len(rows[i]), p.window)
            new = value[rows[i]] * fresh(rows[i], p.window)
            s = int(at[window_means(new, at, p.window).argmax()])
            if y[i]:
                worst.append(rows[i][s : s + p.window])
            else:
                for s in {s, *rng.choice(at, 2).tolist()}:
                    hard[i, s] = rows[i][s : s + p.window]
        descend([*worst, *hard.values()], np.repeat([1, 0], [len(worst), len(hard)]), p.steps)
    return ToxicityModel(table.value @ (soft.value[:, 1] - soft.value[:, 0]), float(bias.value[1] - bias.value[0]), p)


def labelled_sample(docs: DataFrame, labels: DataFrame, params: ToxicityParams, label_col: str = "toxic") -> tuple[list[str], list[int]]:
    """A bounded sample of labelled texts: of each class the ``max_rows`` ids that come first by a hash, while their texts hold ``max_chars``.

    Ids and lengths are chosen first, then only the chosen texts are fetched. Of
    rows that repeat an id one counts, the shortest; an id with both labels has 1.
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    chosen = [known.where(F.col("y") == c).orderBy("h", "doc_id").limit(params.max_rows) for c in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])  # at most twice max_rows short rows, so it may be broadcast
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"size": F.length("text"), "key": F.xxhash64("text")})
    met = texts.drop("text").join(F.broadcast(chosen), "doc_id")
    sizes = met.groupBy("doc_id", "y", "h").agg(F.min(F.struct("size", "key")).alias("at")).select("doc_id", "y", "h", "at.*").collect()
    wanted, room = {}, params.max_chars
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if r["size"] <= room:  # whole texts only
            room -= r["size"]
            wanted[r["doc_id"]] = r
    if not wanted:
        return [], []
    picks = docs.sparkSession.createDataFrame([(i, r["key"]) for i, r in wanted.items()], "doc_id long, key long")
    found = texts.join(F.broadcast(picks), ["doc_id", "key"]).dropDuplicates(["doc_id"]).select("doc_id", "text")
    got = {r["doc_id"]: r["text"] for r in found.toLocalIterator()}
    order = [i for i in wanted if i in got]
    return [got[i] for i in order], [wanted[i]["y"] for i in order]


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """Probability of label 1 for each whole text; null and empty texts get the model's constant."""
    weights, bias, params = model.weights.astype(np.float32), model.bias, model.params
    held: dict[str, ToxicityModel] = {}

    @F.arrow_udf("double")
    @released
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held.setdefault("model", ToxicityModel(weights.astype(float), bias, params))
        for texts in batches:
            out = [own.score([t or "" for t in texts.slice(a, 200).to_pylist()]) for a in range(0, len(texts), 200)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score(text)


def held_out(doc_id: Column) -> Column:
    """Rows that are never fitted: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fitted(docs: DataFrame, labels: DataFrame, params: ToxicityParams | None = None, label_col: str = "toxic") -> ToxicityModel:
    """A model fitted on the bounded sample of labelled rows that are not held out."""
    params = params or ToxicityParams()
    small_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return fit(*labelled_sample(docs, known, params, label_col), params)


def classify(docs: DataFrame, labels: DataFrame, params: ToxicityParams | None = None, threshold: float = 0.7, label_col: str = "toxic") -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 if score >= ``threshold``).

    Fits on labelled rows that are not held out. Only the text is an input of a
    score. Null and empty texts get the constant of the model; texts of any
    length are scored whole; repeated rows are scored each. Null ids are not held
    out. Without labels of both classes every score is their share of label 1
    (0.001 without any). Input columns with the three output names, in any case,
    are replaced. An empty table gives no rows.
    """
    score = toxicity_score(F.col("text"), fitted(docs, labels, params, label_col))
    kept = [F.col(f"`{c}`") for c in without(docs.columns, "held_out", "score", "predicted")]
    out = docs.select(*kept, F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
