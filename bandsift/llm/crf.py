"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Each line has a few features of its own and of its place in the text (shape of words, symbols,
repeats, whether it is one of the lines that documents are known to share). Viterbi decoding finds the
likeliest labels of all lines of a document together; the share of its words that lie in content lines
decides. Fixed rules come first: very short texts and texts made of repeats are rejected whatever the
labels.

The field is fitted on at most TRAIN_DOCS labelled documents, those whose doc_id hashes lowest, whole,
less those that the fixed rules decide or that have more than TRAIN_LINES lines. Only documents are
labelled, so lines get weak labels: in a good document a line is content unless it is known, that is
short and found in documents of the sample after LEAST_CONTEXTS different lines (copies of one document
have it after the same line always); in a bad one all lines are boilerplate at first. After a first
fit those lines of bad documents that decode as content become content, if they are less than half of
the document's words; then the field is fitted again. Everything else covers every row.

Edge cases: a null or empty text has no words and fails the fixed rules; a document without a label
is judged like any other; labels that lack one of the two kinds (or are missing) give a field that
calls every line content; of equally likely labels content is taken; lines without words have no label;
repeated doc_ids give a row each, but one of them at most is fitted on; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructType

from bandsift.llm.common import batches, texts

#: Labelled documents that the field may be fitted on, and lines of one at most.
TRAIN_DOCS, TRAIN_LINES = 2000, 200

#: A known line has at most so many words, and comes after so many different lines.
KNOWN_WORDS, LEAST_CONTEXTS = 30, 3

#: Share of words in content lines from which a document is kept.
CONTENT_SHARE = 0.5

SYMBOLS = b"#*$%&|<>"

FEATURES = ["one", "repeated", "symbols", "upper", "shouts", "duplicate", "short", "long_words", "digits", "bars", "known"]

#: Weights of features, of moves, and the known lines (sorted hashes).
Model = tuple[np.ndarray, np.ndarray, np.ndarray]


class Text:
    """Counts of a text and its lines: words are runs without ASCII white space."""

    def __init__(self, text: str):
        data = text.encode()
        self.lines = data.split(b"\n")
        by_line = [line.split() for line in self.lines]
        self.sizes = np.array([len(w) for w in by_line])
        words = [w for line in by_line for w in line]
        self.n_words = len(words)
        blank = sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
        self.word_chars = len(text) - blank
        self.n_symbols = len(data) - len(data.translate(None, SYMBOLS))
        seen: set[bytes] = set()
        self.duplicate = np.zeros(len(self.lines), bool)
        for i, line in enumerate(self.lines):
            if self.sizes[i]:
                self.duplicate[i] = line in seen
                seen.add(line)
        self.repeated = repeats(words)
        self.words = words
        self.n_repeat = int(self.repeated.sum())
        self.failed = self.n_words < 50 or 100 * self.n_repeat > 50 * self.n_words

    def keys(self) -> np.ndarray:
        """A hash of each line with words, without the white space around it and ASCII capitals."""
        own = [self.lines[i].strip().lower() for i in np.flatnonzero(self.sizes)]
        return np.array([xxhash.xxh64_intdigest(x) for x in own], np.uint64).view(np.int64)

    def features(self, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(words of each line with words, features of those lines)."""
        at = np.flatnonzero(self.sizes)
        is_known = np.zeros(len(at))
        if known is not None and len(known) and len(at):
            is_known = (np.isin(self.keys(), known) & (self.sizes[at] <= KNOWN_WORDS)).astype(float)
        starts = np.concatenate([[0], np.cumsum(self.sizes[at])[:-1]]).astype(np.int64) if len(at) else np.zeros(0, np.int64)
        n = self.sizes[at].astype(float)
        per = lambda v: np.add.reduceat(np.asarray(v, float), starts) / n if len(at) else np.zeros(0)
        lines = [self.lines[i] for i in at]
        size = np.array([len(x) for x in lines], float)
        of = lambda found: np.array([len(x) - len(x.translate(None, found)) for x in lines], float)
        f = np.stack(
            [
                np.ones(len(at)),
                per(self.repeated),
                np.minimum(1, 8 * of(SYMBOLS) / np.maximum(size, 1)),
                per([w.isupper() for w in self.words]),
                np.minimum(1, of(b"!") / n),
                self.duplicate[at].astype(float),
                1 / n,
                per([len(w) > 20 for w in self.words]),
                of(b"0123456789") / np.maximum(size, 1),
                np.minimum(1, 2 * of(b"|") / n),
                is_known,
            ],
            axis=1,
        )
        return self.sizes[at], f


def repeats(words: list[bytes]) -> np.ndarray:
    """Whether each word lies in a 3-word window found twice or more in the text."""
    out = np.zeros(len(words), bool)
    if len(words) < 4:
        return out
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    pair = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pair[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    for k in range(3):
        out[k : k + len(twice)] |= twice
    return out


def viterbi(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The likeliest labels (0 boilerplate, 1 content) given scores of labels and of moves between them."""
    if not len(emit):
        return np.zeros(0, np.int8)
    (m00, m01), (m10, m11) = move.tolist()
    rows = emit.tolist()
    a, b = rows[0]
    came: list[tuple[int, int]] = []
    for e0, e1 in rows[1:]:
        a0, b0, a1, b1 = a + m00, b + m10, a + m01, b + m11
        came.append((int(b0 > a0), int(b1 > a1)))
        a, b = max(a0, b0) + e0, max(a1, b1) + e1
    label = int(b >= a)
    out = [label]
    for back in reversed(came):
        label = back[label]
        out.append(label)
    return np.array(out[::-1], np.int8)


def fit(documents: list[tuple[np.ndarray, float, np.ndarray]], rounds: int = 80, rate: float = 0.2, shrink: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features for each label and of moves, by gradient ascent on the likelihood of labels.

    documents: (labels of its lines, weight, features of its lines). Sequences of equal length are
    handled together.
    """
    weights, move = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    groups: dict[int, list[tuple[np.ndarray, float, np.ndarray]]] = {}
    for labels, weight, f in documents:
        groups.setdefault(len(f), []).append((labels, weight / len(f), f))
    packed = []
    for length, own in groups.items():
        y = np.stack([labels for labels, _, _ in own]).astype(int)
        true = np.eye(2)[y]
        moves = np.einsum("dla,dlb->dab", true[:, :-1], true[:, 1:]) if length > 1 else np.zeros((len(own), 2, 2))
        packed.append((np.stack([f for _, _, f in own]), true, moves, np.array([w for _, w, _ in own])))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, move)]
    for step in range(1, rounds + 1):
        gw, gm = -shrink * weights, -shrink * move
        for x, true, moves, weight in packed:
            node, edge = marginals(x @ weights, move)
            gw = gw + np.einsum("dlf,dlk,d->fk", x, true - node, weight)
            gm = gm + ((moves - edge) * weight[:, None, None]).sum(axis=0)
        for value, grad, (m, v) in zip((weights, move), (gw, gm), state, strict=True):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return weights, move


def known_lines(documents: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Sorted hashes of lines that come after several different ones; documents: (words, hashes) of lines."""
    before: dict[int, set[int]] = {}
    for sizes, keys in documents:
        own = keys.tolist()
        for size, prior, key in zip(sizes.tolist(), [0, *own], own, strict=False):
            if size <= KNOWN_WORDS:
                before.setdefault(key, set()).add(prior)
    return np.array(sorted(k for k, own in before.items() if len(own) >= LEAST_CONTEXTS), np.int64)


def learned(sample: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> Model:
    """The field from documents (label, words, hashes and features of lines), by weak labels in two fits."""
    sample = [s for s in sample if len(s[1])]
    if {s[0] for s in sample} != {0, 1}:
        weights = np.zeros((len(FEATURES), 2))
        weights[0, 1] = 1.0
        return weights, np.zeros((2, 2)), np.zeros(0, np.int64)
    known = known_lines([(sizes, keys) for _, sizes, keys, _ in sample])
    share = {k: 0.5 / sum(label == k for label, *_ in sample) for k in (0, 1)}
    documents = []
    for label, sizes, keys, f in sample:
        hit = np.isin(keys, known) & (sizes <= KNOWN_WORDS)
        f[:, FEATURES.index("known")] = hit
        documents.append((np.where(hit, 0, label), share[label], f))
    weights, move = fit(documents)
    for n, (label, sizes, _, f) in enumerate(sample):
        if not label:
            own = viterbi(f @ weights, move)
            if 2 * (sizes * own).sum() < sizes.sum():
                documents[n] = (own, share[label], f)
    return *fit(documents), known


def marginals(emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over documents of equal length: label shares, and expected moves."""
    d, n, _ = emit.shape
    ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
    ahead[:, 0] = emit[:, 0]
    for t in range(1, n):
        ahead[:, t] = emit[:, t] + np.logaddexp(*(ahead[:, t - 1, k, None] + move[k] for k in (0, 1)))
    for t in range(n - 2, -1, -1):
        after = emit[:, t + 1] + behind[:, t + 1]
        behind[:, t] = np.logaddexp(*(after[:, k, None] + move[:, k] for k in (0, 1)))
    total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    node = np.exp(ahead + behind - total[:, None, None])
    edge = np.zeros((d, 2, 2))
    if n > 1:
        joint = ahead[:, :-1, :, None] + move + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]
        edge = np.exp(joint).sum(axis=1)
    return node, edge


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the bounded sample; only features of its lines reach the driver."""
    marked = labels.select(F.col("doc_id").alias("labelled_id"), F.col("quality").cast("int").alias("good"))
    marked = marked.filter(F.col("good").isin(0, 1)).dropDuplicates(["labelled_id"])
    some = marked.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(TRAIN_DOCS)
    own = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("labelled_id"))

    def features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            own = [Text(t) for t in texts(batch)]
            used = [not x.failed and len(x.lines) <= TRAIN_LINES for x in own]
            batch = batch.filter(pa.array(used, pa.bool_()))
            found = [(*x.features(), x.keys()) for x, use in zip(own, used, strict=True) if use]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("labelled_id"),
                    batch.column("good"),
                    pa.array([s.tolist() for s, _, _ in found], pa.list_(pa.int64())),
                    pa.array([k.tolist() for _, _, k in found], pa.list_(pa.int64())),
                    pa.array([f.ravel().tolist() for _, f, _ in found], pa.list_(pa.float64())),
                ],
                names=["labelled_id", "good", "sizes", "keys", "features"],
            )

    schema = StructType().add("labelled_id", labels.schema["doc_id"].dataType).add("good", IntegerType())
    schema = schema.add("sizes", ArrayType(LongType())).add("keys", ArrayType(LongType())).add("features", ArrayType(DoubleType()))
    # One row for each sampled doc_id, however often documents repeat it.
    found = own.select("labelled_id", "good", "text").mapInArrow(features, schema)
    rows = found.groupBy("labelled_id", "good").agg(F.min(F.struct("features", "sizes", "keys")).alias("d")).collect()
    sample = [(r["good"], np.array(r["d"]["sizes"], np.int64), np.array(r["d"]["keys"], np.int64), np.array(r["d"]["features"]).reshape(-1, len(FEATURES))) for r in rows]
    return learned(sorted(sample, key=lambda s: (s[0], s[3].tobytes(), s[2].tobytes())))


def judge(text: str, model: Model) -> tuple[int, int, int, int, int, bool, bool, float]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content share."""
    own = Text(text)
    sizes, features = own.features(model[2])
    labels = viterbi(features @ model[0], model[1])
    share = float((sizes * labels).sum() / own.n_words) if own.n_words else 0.0
    kept = not own.failed and share >= CONTENT_SHARE
    return own.n_words, own.word_chars, own.n_symbols, int(own.duplicate.sum()), own.n_repeat, own.failed, kept, share


VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
_TYPES = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]


def _judged(it: Iterator[pa.RecordBatch], model: Model, kept: list[str], only: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in VERDICT.split(", ")]
    for batch in batches(it):
        rows = [judge(t, model) for t in texts(batch)]
        if only:
            yield batch.filter(pa.array([r[6] for r in rows], pa.bool_())).select(kept)
            continue
        found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], names=[*kept, *names])


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id with the counts and the verdict of each document."""
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    run = partial(_judged, model=fitted(docs, labels), kept=["doc_id"], only=False)
    return own.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {VERDICT}")


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, all columns as they were."""
    run = partial(_judged, model=fitted(docs, labels), kept=docs.columns, only=True)
    return docs.mapInArrow(run, docs.schema)
