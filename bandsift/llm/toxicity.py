"""Toxicity: bags of subwords, embedded and averaged into a linear softmax.

A word is its character n-grams of 3 to 5 letters (with marks for its ends) and itself, hashed to
BUCKETS; its vector is the mean of theirs, so a misspelling never seen shares most of its vector with
the word. Buckets in a few documents only are left out, since they would learn these by heart. WINDOW words in a row are averaged and a softmax of two classes is taken of the average; a
text is as toxic as its most toxic window, so that one insult in a very long text counts like one in a
short one. Vectors and softmax are trained together, in numpy, by Adam on the labels of whole texts: a
text is clean if all of its windows are.

The model is fitted on at most TRAIN_DOCS labelled documents of each kind (lowest hash of doc_id) with
at most TRAIN_CHARS characters, whole; every document is scored, whole. Once trained, a word's vector
only counts by its share in the softmax, so scoring adds one number a bucket.

Edge cases: a null or empty text, or one without words, gets what the softmax gives the zero vector;
labels that lack one of the two kinds give 0 to every text (no toxic ones) or 1; a doc_id with two
labels is toxic if one says so; repeated rows are scored alike and one of them at most is trained on;
rows with a null doc_id are scored, not trained on; an empty table gives no rows; other columns are
left behind.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandsift.llm.common import MEMO, batches, texts

#: Bound of the sample: labelled documents of each kind, and characters of each.
TRAIN_DOCS, TRAIN_CHARS = 1200, 8000

#: Buckets, numbers in a vector, words averaged, and steps of training.
BUCKETS, WIDTH, WINDOW, STEPS = 1 << 16, 8, 12, 50

#: Share of the sampled documents that must have a bucket for it to be used; rate and decay of vectors.
LEAST_SHARE, RATE, SHRINK = 0.008, 0.15, 1e-5

#: Runs of letters and digits; longer ones count as several words.
WORD = re.compile(r"\w{1,32}")

#: Words remembered in a worker; beyond that it starts afresh.
REMEMBERED = 400_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def subwords(word: str) -> list[int]:
    """Buckets of a word's n-grams and of the word."""
    marked = f"<{word}>"
    n = len(marked)
    grams = [marked[i : i + k] for k in (3, 4, 5) for i in range(n - k + 1)]
    grams.append(marked)
    return [xxhash.xxh32_intdigest(g) % BUCKETS for g in grams]


def windows(n: int) -> np.ndarray:
    """Where windows of a text of n words begin; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    starts = np.arange(0, n - WINDOW + 1, WINDOW)
    return starts if starts[-1] + WINDOW == n else np.append(starts, n - WINDOW)


class Ragged:
    """Means over lists of indices, and their gradients, by sorted runs instead of scattered adds."""

    def __init__(self, index: np.ndarray, sizes: np.ndarray, n: int):
        self.index, self.sizes, self.n = index, sizes, n
        self.starts = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.order = np.argsort(index, kind="stable")
        ordered = index[self.order]
        self.heads = np.flatnonzero(np.diff(ordered, prepend=-1))
        self.named = ordered[self.heads]
        self.share = (1 / sizes).astype(np.float32)[:, None]

    def mean(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values[self.index], self.starts, axis=0) * self.share

    def back(self, grad: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, grad.shape[1]), np.float32)
        spread = (grad * self.share)[self.owner[self.order]]
        out[self.named] = np.add.reduceat(spread, self.heads, axis=0)
        return out


class Adam:
    def __init__(self, shape: tuple, rate: float):
        self.m, self.v, self.rate, self.t = np.zeros(shape, np.float32), np.zeros(shape, np.float32), rate, 0

    def step(self, value: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.05 * (grad * grad - self.v)
        value -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.95**self.t)) + 1e-9)


def fit(documents: list[tuple[int, str]], steps: int | None = None) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias) for the toxic class against the other, trained with all vectors.

    documents: (label, text). A text is toxic unless every window is clean (noisy or).
    """
    documents = [(y, w) for y, w in ((y, words_of(t)) for y, t in documents) if w]
    kinds = {y for y, _ in documents}
    if kinds != {0, 1}:
        return np.zeros(BUCKETS, np.float32), 50.0 if kinds == {1} else -50.0
    known: defaultdict[str, int] = defaultdict()
    known.default_factory = known.__len__
    index, sizes, per_doc, held = [], [], [], []
    for _, own in documents:
        ids = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
        held.append(np.unique(ids))
        starts = windows(len(ids))
        size = min(WINDOW, len(ids))
        index.append(ids[starts[:, None] + np.arange(size)].ravel())
        sizes.append(np.full(len(starts), size))
        per_doc.append(len(starts))
    grams = [subwords(w) for w in known]
    flat, n_grams = np.fromiter((g for own in grams for g in own), np.int64), np.array([len(g) for g in grams])
    of_words = Ragged(flat, n_grams, BUCKETS)
    common = document_counts(held, flat, n_grams) >= max(2, LEAST_SHARE * len(documents))
    of_windows = Ragged(np.concatenate(index), np.concatenate(sizes), len(known))
    first = np.cumsum(per_doc) - per_doc
    owner = np.repeat(np.arange(len(per_doc)), per_doc)
    y = np.array([y for y, _ in documents], np.float32)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()).astype(np.float32)

    random = np.random.default_rng(12)
    vectors = (random.standard_normal((BUCKETS, WIDTH)) * 0.1).astype(np.float32)
    out = (random.standard_normal((WIDTH, 2)) * 0.5).astype(np.float32)
    bias = np.array([0.0, -4.0], np.float32)
    vectors *= common[:, None]
    steps_of = [Adam(vectors.shape, RATE), Adam(out.shape, 0.1), Adam(bias.shape, 0.1)]
    for _ in range(steps or STEPS):
        by_word = of_words.mean(vectors)
        mean = of_windows.mean(by_word)
        score = mean @ out + bias
        z = score[:, 1] - score[:, 0]
        clean = -np.logaddexp(0, z)  # log probability that a window is clean
        p = 1 - np.exp(clean)
        all_clean = np.minimum(np.add.reduceat(clean, first), -1e-6)
        toxic = -np.expm1(all_clean)
        # Of -log likelihood by z: p for clean texts, -p (1 - P) / P for toxic ones.
        factor = np.where(y == 1, -np.exp(all_clean) / toxic, 1.0) * weight
        gz = (p * factor[owner]).astype(np.float32)
        g_score = np.stack([-gz, gz], axis=1)
        g_mean = g_score @ out.T
        g_vectors = of_words.back(of_windows.back(g_mean)) * common[:, None] + SHRINK * vectors
        steps_of[1].step(out, mean.T @ g_score)
        steps_of[2].step(bias, g_score.sum(axis=0))
        steps_of[0].step(vectors, g_vectors)
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def document_counts(held: list[np.ndarray], flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """In how many documents each bucket is; held: numbers of the words of each."""
    ends = np.cumsum(sizes)
    out = np.zeros(BUCKETS, np.int64)
    for own in held:
        at = np.repeat(ends[own] - np.cumsum(sizes[own]), sizes[own]) + np.arange(sizes[own].sum())
        out[np.unique(flat[at])] += 1
    return out


class Weights(dict):
    """word -> mean weight of its subwords."""

    def __init__(self, weight: np.ndarray):
        super().__init__()
        self.weight = weight

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = float(self.weight[subwords(word)].mean())
        return value


def score(text: str, weights: Weights, bias: float) -> float:
    """Probability of the toxic class in the window where it is highest."""
    words = words_of(text)
    at = windows(len(words))
    z = 0.0
    if len(at):
        total = np.concatenate([[0.0], np.cumsum(np.fromiter(map(weights.__getitem__, words), float, len(words)))])
        size = min(WINDOW, len(words))
        z = float((total[at + size] - total[at]).max()) / size
    return float(1 / (1 + np.exp(-np.clip(z + bias, -50, 50))))


def held_out(doc_id: F.Column, modulus: int, left_out: int) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == left_out, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, modulus: int, left_out: int) -> list[tuple[int, str]]:
    """(label, whole text) of the documents to train on: bounded by TRAIN_DOCS and TRAIN_CHARS."""
    marks = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, left_out))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    short = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id").alias("rank"))
    short = short.filter(F.length("text").between(1, TRAIN_CHARS))
    own = short.select("id", "rank").distinct().join(marks, "id")
    chosen = [own.filter(F.col("toxic") == k).orderBy("rank", "id").limit(TRAIN_DOCS) for k in (0, 1)]
    rows = short.join(F.broadcast(chosen[0].union(chosen[1]).drop("rank")), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).collect()
    return [(r["toxic"], r["text"]) for r in sorted(rows, key=lambda r: r["id"])]


def _scored(it: Iterator[pa.RecordBatch], known) -> Iterator[pa.RecordBatch]:
    weight, bias = known.value
    own = MEMO.of(("toxicity", hash(weight.tobytes()), bias), lambda: Weights(weight))
    for batch in batches(it):
        found = [score(t, own, bias) for t in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int, left_out: int, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted; rows that hash to `left_out` are never trained on."""
    model = fit(sample(docs, labels, modulus, left_out))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run = partial(_scored, known=docs.sparkSession.sparkContext.broadcast(model))
    found = own.mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), modulus, left_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
