"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its hashed character n-grams, so a misspelling nobody has labelled shares most of
its vectors with the word it hides. A window of a few words is the average of their n-grams' vectors;
a linear softmax tells toxic windows from clean ones. Vectors and softmax are trained together. Only
documents are labelled: windows of a toxic document first all count as toxic, and then, from round to
round, those that the model finds toxic do. A document's score is a logistic function of its most
toxic windows over the whole text.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.base import crc_fold, read, release, with_arrow

BUCKETS = 1 << 18
DIM = 8
NGRAMS = (3, 4, 5)
WINDOW = 4
#: Bounds of the sample of labelled rows that is fitted on: clean and toxic rows, characters of a row.
MOST_ROWS = (2500, 1500)
MOST_CHARS = 20_000
MOST_WORDS = 300_000
SEED = 11

_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xFF51AFD7ED558CCD)


def ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all n-grams, how many each word has); a word stands between < and >."""
    raw = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8)
    size = np.array([len(w) + 2 for w in words], np.int64)
    begin = np.cumsum(size) - size
    left = np.repeat(begin + size, size) - np.arange(len(raw))  # bytes of the word from here on
    found, owners = [], []
    owner = np.repeat(np.arange(len(words)), size)
    h = np.zeros(len(raw), np.uint64)
    for n in range(1, max(NGRAMS) + 1):
        m = len(raw) - n + 1
        if m <= 0:
            break
        h = h[:m] * _P + raw[n - 1 :] + np.uint64(1)
        if n in NGRAMS:
            ok = left[:m] >= n
            mixed = h[ok]
            mixed = (mixed ^ (mixed >> np.uint64(33))) * _M
            found.append((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS)
            owners.append(owner[:m][ok])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
    order = np.argsort(np.concatenate(owners), kind="stable")
    counts = np.bincount(np.concatenate(owners), minlength=len(words))
    return np.concatenate(found)[order], counts


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


class Model:
    """What scoring needs: each bucket's share of the toxic logit, and the documents' logistic function."""

    def __init__(self, gain: np.ndarray, bias: float, top: np.ndarray) -> None:
        self.gain, self.bias, self.top = gain.astype(np.float32), float(bias), top
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.sums, self.sizes = np.zeros(0), np.zeros(0)

    def __getstate__(self):
        return self.gain, self.bias, self.top

    def __setstate__(self, state):
        self.__init__(*state)

    def rows(self, tokens: list[bytes]) -> np.ndarray:
        if len(self.known) > MOST_WORDS:
            self.clear()
        known = self.known
        new: list[bytes] = []
        for w in set(tokens).difference(known):
            known[w] = len(known)
            new.append(w)
        if new:
            buckets, counts = ngrams(new)
            owner = np.repeat(np.arange(len(new)), counts)
            self.sums = np.concatenate([self.sums, np.bincount(owner, self.gain[buckets], len(new))])
            self.sizes = np.concatenate([self.sizes, counts])
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """For each text: logits of its most and second most toxic window, and the log of its windows' number."""
        split = [words_of(t) for t in texts]
        n = np.array([len(s) for s in split], np.int64)
        row = self.rows([w for s in split for w in s])
        total = np.concatenate([[0], np.cumsum(self.sums[row])])
        size = np.concatenate([[0], np.cumsum(self.sizes[row])])
        out = np.zeros((len(texts), 3))
        out[:, :2] = self.bias
        at = np.concatenate([[0], np.cumsum(n)])
        for k in np.flatnonzero(n):
            a, b = at[k], at[k + 1]
            w = min(WINDOW, b - a)
            z = self.bias + (total[a + w : b + 1] - total[a : b + 1 - w]) / np.maximum(1, size[a + w : b + 1] - size[a : b + 1 - w])
            first = int(np.argmax(z))
            rest = np.concatenate([z[: max(0, first - w + 1)], z[first + w :]])
            out[k] = z[first], rest.max() if len(rest) else self.bias, np.log1p(b - a)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        f = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(f @ self.top[:3] + self.top[3], -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> np.ndarray:
    """Newton's method with a light ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-2 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(texts: list[str | None], toxic: np.ndarray, share: float, seed: int = SEED) -> Model:
    """Fits on labelled texts; share: of toxic rows among all that are labelled."""
    rng = np.random.default_rng(seed)
    vocab: dict[bytes, int] = {}
    parts = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t)], np.int32) for t in texts]
    n = np.array([len(p) for p in parts], np.int64)
    token = np.concatenate([np.zeros(0, np.int32), *parts])
    names = list(vocab)
    parts = [ngrams(names[k : k + 20_000]) for k in range(0, len(names), 20_000)] or [ngrams([])]
    buckets = np.concatenate([b.astype(np.int32) for b, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    windows = -(-n // WINDOW)
    doc = np.repeat(np.arange(len(n)), windows)
    inside = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
    window = (np.repeat(np.cumsum(windows) - windows, n) + inside // WINDOW).astype(np.int32)
    del inside
    size = np.maximum(1, np.bincount(window, counts[token], len(doc)))
    hidden = toxic[doc].astype(float)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.5, DIM)
    bias = 0.0
    state = [[], [np.zeros_like(soft), np.zeros_like(soft)], [0.0, 0.0]]
    step = 0

    def adam(value, grad, s, rate):
        s[0] = 0.9 * s[0] + 0.1 * grad
        s[1] = 0.999 * s[1] + 0.001 * grad * grad
        return value - rate * (s[0] / (1 - 0.9**step)) / (np.sqrt(s[1] / (1 - 0.999**step)) + 1e-8)

    used = np.flatnonzero(np.bincount(buckets, minlength=BUCKETS))
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    local = place[buckets]
    del buckets, parts
    vectors, state[0] = vectors[used], [np.zeros((len(used), DIM), np.float32), np.zeros((len(used), DIM), np.float32)]
    ends = np.concatenate([[0], np.cumsum(counts)])
    blocks = [(a, min(a + 20_000, len(vocab))) for a in range(0, len(vocab), 20_000)]
    for epoch in range(24 if len(vocab) else 0):
        if epoch in (8, 16):  # of a toxic document, the windows that look toxic stay so; its most toxic one always
            z = logits  # noqa: F821
            best = np.full(len(n), -np.inf)
            np.maximum.at(best, doc, z)
            hidden = (toxic[doc] > 0) & ((z > 0) | (z >= best[doc]))
            hidden = hidden.astype(float)
        word_vectors = np.empty((len(vocab), DIM))
        for a, b in blocks:
            word_vectors[a:b] = np.add.reduceat(vectors[local[ends[a] : ends[b]]], ends[a:b] - ends[a])
        word_gain = word_vectors @ soft
        logits = bias + np.bincount(window, word_gain[token], len(doc)) / size
        p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
        positive = max(1.0, hidden.sum())
        weight = np.where(hidden > 0, 0.5 / positive, 0.5 / max(1.0, len(doc) - positive))
        error = weight * (p - hidden)
        by_word = np.bincount(token, (error / size)[window], len(vocab))
        to_vector = np.zeros(len(used))
        for a, b in blocks:
            to_vector += np.bincount(local[ends[a] : ends[b]], np.repeat(by_word[a:b], counts[a:b]), len(used))
        grad_vectors = (to_vector[:, None] * soft[None, :]).astype(np.float32) + np.float32(1e-7) * vectors
        grad_soft = by_word @ word_vectors + 1e-5 * soft
        step += 1
        vectors = adam(vectors, grad_vectors, state[0], 0.2)
        soft = adam(soft, grad_soft, state[1], 0.2)
        bias = adam(bias, error.sum(), state[2], 0.2)
    gain = np.zeros(BUCKETS)
    gain[used] = vectors @ soft
    model = Model(gain, bias, np.zeros(4))
    y = toxic.astype(float)
    weight = np.where(y > 0, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    features = np.concatenate([model.features(texts[k : k + 256]) for k in range(0, len(texts), 256)])
    model.top = _logistic(features, y, weight)
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: tuple[int, int] = MOST_ROWS, most_chars: int = MOST_CHARS) -> Model:
    """Fits on a bounded sample of labelled rows: at most most_rows clean and toxic ones, by a hash of the id.

    labels has one row for each labelled document to learn from (label 0 or 1; rows with a null don't
    count, and of several labels of one id the greatest does). Sampled rows of more than most_chars characters aren't fitted on (all are scored). Without rows
    of both labels the model gives each text the share of toxic ones, 0 if there are none.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    known = known.filter("y IN (0, 1)")
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    mixed = F.xxhash64("id", F.lit(SEED))
    picked = [known.filter(F.col("y") == y).orderBy(mixed, "id").limit(most_rows[y]) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])  # so many rows at most, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.length("text") <= most_chars)
    rows = texts.join(F.broadcast(picked), "id").dropDuplicates(["id"]).select("id", "text", "y").repartition(1).sortWithinPartitions("id")
    fitted = rows.mapInArrow(_fit(share), "model binary").collect()  # in one task, as the sample is bounded
    if not fitted:
        flat = np.array([0, 0, 0, np.log(share / (1 - share))]) if 0 < share < 1 else np.array([0, 0, 0, 40.0 if share else -40.0])
        return Model(np.zeros(BUCKETS), 0.0, flat)
    model = pickle.loads(fitted[0]["model"])
    return model


def _fit(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True)]
        y = np.array([r[1] for r in rows], np.int64)
        if len(y) and 0 < y.sum() < len(y):
            model = train([r[0] for r in rows], y, share)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])
        del rows, y
        release()

    return run


def scorer(model: Model) -> Callable[[], Callable[[pa.Array], list[pa.Array]]]:
    def make() -> Callable[[pa.Array], list[pa.Array]]:
        own = pickle.loads(pickle.dumps(model))  # words met go with the task
        return lambda texts: [pa.array(own.score(texts.to_pylist()), pa.float64())]

    return make


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """Adds the probability that a text is toxic, from the whole text; a null text counts as empty. A column score_col is replaced."""
    return with_arrow(docs, [text_col], f"`{score_col}` double", scorer(model))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").filter(crc_fold(F.col("doc_id")) != 0)
    scored = score_toxicity(docs, fit(docs, labels), score_col="score")
    held_out = (crc_fold(F.col("doc_id")) == 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
