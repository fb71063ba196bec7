"""Periodic run detection: an online pass over the words of a text that follows diagonals.

A diagonal is a lag: the words that equal the word so many places before. In one pass, each word's
earlier occurrences lengthen the matches of their lags; a diagonal that ends with a match of
sufficient length is a run and is emitted at once.

What keeps the pass sparse is that short matches can't count. A run of period q and at least
max(12, 2 q) words has max(12 - q, q) matches in a row on its diagonal: six at least, and at least L
for a period of L or more. So a word opens a diagonal only by an earlier occurrence whose last six
words (lags up to 7), or last L words (lags L to 2 L - 1; L = 8, 16, ...) are equal too. Most texts
have no such occurrence and end there. Where the last L words themselves have a period p of at most
L / 2 and the match of p is already L long, nothing is opened: a run of a longer period has matched
words before that place, or beyond the stretch of period p, by which it is opened (two periods of one
stretch as long as their sum give a common divisor). So a text of one repeated word costs as little.

Edge cases: a null text has no words; words are split at ASCII white space only; a text is one unit
of work, its memory some 40 bytes a word; repeated rows give a row each; a null doc_id is left out
of the rule by which texts are altered; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandsift.llm.common import batches, texts

#: Words of the shortest run, and of the window that opens diagonals of lags below 8.
LEAST, WINDOW = 12, 6

Run = tuple[int, int, int]


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words; for a tenth of the ids, from some place on, a few of them over and over again."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    unit = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (unit * (-(-(n - a) // len(unit))))[: n - a]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes."""
    out = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    return out ^ (out >> np.uint64(29))


def _links(hashes: np.ndarray, length: int, n: int, most: int) -> array | None:
    """For the last word of each window, that of the latest earlier equal window less than `most` back, or -1."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return None
    later, earlier = order[1:][same], order[:-1][same]
    near = later - earlier < most
    out = np.full(n, -1, np.int32)
    out[later[near] + length - 1] = earlier[near] + length - 1
    return array("i", out.tobytes())


def levels(ids: np.ndarray) -> Iterator[tuple[int, int, int, array]]:
    """(window, lowest lag, lag too high, links to earlier equal windows) while any window repeats."""
    n = len(ids)
    if n < LEAST:
        return
    one = ids.astype(np.uint64)
    two = _mixed(one[:-1], one[1:])
    four = _mixed(two[:-2], two[2:])
    found = _links(_mixed(four[:-2], two[4:]), WINDOW, n, 8)
    six_repeat = len(np.unique(_mixed(four[:-2], two[4:]))) < len(four) - 2
    if found is not None:
        yield WINDOW, 1, 8, found
    hashes, length = _mixed(four[:-4], four[4:]), 8
    while six_repeat and 2 * length <= n:
        found = _links(hashes, length, n, 2 * length)
        if found is None:
            return
        yield length, length, 2 * length, found
        hashes, length = _mixed(hashes[:-length], hashes[length:]), 2 * length


def runs(ids: np.ndarray) -> list[Run]:
    """All maximal runs (start, length, period) of a sequence, as they end."""
    ids = np.ascontiguousarray(ids, np.int32)
    own = list(levels(ids))
    if not own:
        return []
    hot = np.zeros(len(ids), bool)
    for *_, links in own:
        hot |= np.frombuffer(links, np.int32) >= 0
    data, word = ids.tobytes(), array("i", ids.tobytes())
    active: dict[int, int] = {}
    blocked = [-1] * len(own)
    out: list[Run] = []
    last = -2

    def ended(lag: int, at: int) -> None:
        """The diagonal's match ends before a place: a run, if long enough and of no smaller period."""
        start = active[lag] - lag
        size = at - start
        if size >= max(LEAST, 2 * lag) and not any(lag % d == 0 and d < lag and s - d <= start for d, s in active.items()):
            out.append((start, size, lag))

    def leave(lags: list[int], at: int) -> None:
        for lag in lags:
            ended(lag, at)
        for lag in lags:
            del active[lag]

    def opens(i: int, j: int, length: int, before: bool) -> None:
        """Open the diagonal of equal windows that end at i and j, if it is new and can get long enough."""
        lag = i - j
        if lag in active or any(lag % p == 0 and i - s + 1 >= lag - p + length for p, s in active.items() if p < lag):
            return
        a, b = i - length + 1, j - length + 1
        if b and word[a - 1] == word[b - 1]:
            if before:
                return  # judged when the window ended one word earlier
            step = 64
            while b >= step and data[4 * (b - step) : 4 * b] == data[4 * (a - step) : 4 * a]:
                a, b, step = a - step, b - step, 2 * step
            while b and word[a - 1] == word[b - 1]:
                a, b = a - 1, b - 1
        need = max(lag, LEAST - lag)
        if data[4 * a : 4 * (a + need)] == data[4 * b : 4 * (b + need)] and a + need <= len(word):
            active[lag] = a

    for i in np.flatnonzero(hot).tolist():
        if active:
            over = list(active) if i != last + 1 else [lag for lag in active if word[i - lag] != word[i]]
            if over:
                leave(over, last + 1)
        last = i
        spans = [(2 * lag, i - s + 1) for lag, s in active.items()]
        for k, (length, low, high, links) in enumerate(own):
            j = links[i]
            if j < 0:
                continue
            for twice, size in spans:
                if twice <= length <= size and k:
                    blocked[k] = i
                    j = -1
                    break
            while j >= 0 and i - j < high:
                if i - j >= low:
                    opens(i, j, length, blocked[k] != i - 1)
                j = links[j]
    leave(list(active), last + 1)
    return out


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words less those that a run repeats: all of it after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, size, period in found:
        change[start + period] += 1
        change[start + size] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


FOUND = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed string"


def _found(it: Iterator[pa.RecordBatch], altered: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *(x.split()[0] for x in FOUND.split(", "))]
    for batch in batches(it):
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
            words = text.encode().split()
            if altered:
                words = repeated_tail(words, doc_id)
            own = sorted(runs(numbered(words)), key=lambda r: (r[0], r[2]))
            best = min(own, key=lambda r: (-r[1], r[0], r[2])) if own else None
            digest = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in own).encode()).hexdigest()
            rows.append((len(own), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest, b" ".join(collapsed(words, own)).decode()))
        columns = zip(*rows, strict=True) if rows else [()] * 7
        types = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)


def periodic_runs(docs: DataFrame, altered: bool = False) -> DataFrame:
    """For each document its longest run, a digest of all runs and the text with runs cut to one period.

    altered: first repeat the tail of a tenth of the texts (by doc_id), which plants runs.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(partial(_found, altered=altered), f"doc_id long, {FOUND}")
