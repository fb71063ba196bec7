"""SimHash near-dedup by Golay keys.

A fingerprint has 64 bits, cut into segments of 22, 21 and 21. The binary Golay code of length 23 is
perfect: each word is within 3 bits of one codeword. Decoding a segment and each word one bit away
gives a few codeword indices; two segments that differ in at most 2 bits share one, since both are at
most one bit away from some word between them. If two fingerprints differ in at most 4 bits, then
either no segment has more than 2 of them, and all three indices can be shared; or one has 3 or 4, and
of the other two one is equal and one differs in at most one bit. So keys of three indices, and keys of
one whole segment with the index of another, miss no link. Rows that share a key are verified bit by
bit; within a key only links that join something new go on, never all pairs.

Edge cases: a null or empty text has fingerprint zero and links like any other; equal fingerprints
are one vertex, however many documents have them; a null doc_id is never a component's name, and a
component of such rows only has none; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandsift.llm.common import MEMO, batches, cut_lineage, texts
from bandsift.llm.components import components, forest

#: Fixed values of the code: its generator polynomial and length.
GENERATOR, LENGTH = 0b101011100011, 23

#: Where segments begin and how many bits they have.
SEGMENTS = ((0, 22), (22, 21), (43, 21))

#: Bits in which linked fingerprints may differ: what the keys are made for.
REACH = 4

#: Bytes of keys that one task should hold; runs of equal keys up to this are compared by shifts.
SHARD_BYTES, SHORT_RUN = 32 << 20, 48

SEED = 42


def fingerprint(text: str, words: int) -> int:
    """Majority of each bit over the hashes of all shingles."""
    found = text.encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate([[0], ends[:-1]])
    last = (ends[words - 1 :] if len(found) >= words else ends[-1:]) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist(), strict=False)]
    return majority(np.array(hashes, dtype="<u8"))


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((1 << np.flatnonzero(2 * counts > len(h)).astype(object)).sum()) if (2 * counts > len(h)).any() else 0


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp) with the fingerprint's bits as a signed long."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            fp = np.array([fingerprint(t, words) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, fp long")


def decoder() -> np.ndarray:
    return MEMO.of(("golay",), _decoder)


def _decoder() -> np.ndarray:
    """For each 23-bit word, the index (upper 12 bits) of the nearest codeword."""
    rest = LENGTH - 12
    word = np.arange(1 << LENGTH, dtype=np.uint32)
    syndrome = word.copy()
    for bit in range(LENGTH - 1, rest - 1, -1):
        syndrome ^= np.where(syndrome >> np.uint32(bit) & np.uint32(1), np.uint32(GENERATOR << (bit - rest)), np.uint32(0))
    nearest = np.zeros(1 << rest, np.uint32)
    one = np.uint32(1) << np.arange(LENGTH, dtype=np.uint32)
    zero = np.zeros(1, np.uint32)
    sets = [zero, one, (one[:, None] | one)[np.triu_indices(LENGTH, 1)]]
    sets.append(np.unique((sets[2][:, None] | one).ravel()))
    for errors in reversed(sets):
        nearest[syndrome[errors]] = errors
    return ((word ^ nearest[syndrome]) >> np.uint32(rest)).astype(np.uint16)


def indices(segment: np.ndarray, bits: int) -> list[np.ndarray]:
    """Sorted codeword indices of each word within one bit; repeats are marked by -1."""
    near = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
    found = np.sort(decoder()[segment.astype(np.uint32)[:, None] ^ near].astype(np.int32), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in fp) of all keys."""
    segments = [(fp >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]
    most = 6
    ids = []
    for (_, n), s in zip(SEGMENTS, segments, strict=True):
        found = -np.sort(-indices(s, n), axis=1)[:, :most]
        ids.append(found)
    out_keys, out_at = [], []

    def put(tag: int, parts: list[np.ndarray], widths: list[int]) -> None:
        ok = np.ones(len(fp), bool)
        key = np.full(len(fp), tag, np.uint64)
        for part, width in zip(parts, widths, strict=True):
            ok &= part >= 0
            key = key << np.uint64(width) | (part.astype(np.int64) & ((1 << width) - 1)).astype(np.uint64)
        at = np.flatnonzero(ok)
        out_keys.append(key[at])
        out_at.append(at)

    for i, j, k in product(range(most), repeat=3):
        put(0, [ids[0][:, i], ids[1][:, j], ids[2][:, k]], [12, 12, 12])
    whole = [s.astype(np.int64) for s in segments]
    for tag, (a, b) in enumerate(((0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1)), 1):
        for i in range(most):
            put(tag, [whole[a], ids[b][:, i]], [22, 12])
    return np.concatenate(out_keys), np.concatenate(out_at)


def near(a: np.ndarray, b: np.ndarray, reach: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= reach


def links(key: np.ndarray, fp: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is within reach under an equal key."""
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([start, [len(key)]]))
    left, right = [], []
    short = np.repeat((size > 1) & (size <= SHORT_RUN), size)
    k, f = key[short], fp[short]
    for shift in range(1, min(SHORT_RUN, int(size.max(initial=0)))):
        if shift >= len(k):
            break
        hit = np.flatnonzero((k[shift:] == k[:-shift]) & near(f[shift:], f[:-shift], reach))
        left.append(f[hit])
        right.append(f[hit + shift])
    for i in np.flatnonzero(size > SHORT_RUN):
        a, b = spread(fp[start[i] : start[i] + size[i]], reach)
        left.append(a)
        right.append(b)
    if not left:
        return np.zeros(0, fp.dtype), np.zeros(0, fp.dtype)
    pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def spread(fp: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a long run: from each one reached, only to those not reached before."""
    left, right = [], []
    rest = np.unique(fp)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = near(rest, x, reach)
            found = rest[hit]
            if len(found):
                left.append(np.full(len(found), x))
                right.append(found)
                queue.extend(found)
                rest = rest[~hit]
    if not left:
        return np.zeros(0, fp.dtype), np.zeros(0, fp.dtype)
    return np.concatenate(left), np.concatenate(right)


def near_links(distinct: DataFrame, shards: int, reach: int = REACH) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp, enough of them to connect all within reach.

    Keys travel packed, by shard; a shard's keys are compared in memory. Enough shards keep that
    within bounds, as a fingerprint has a bounded number of keys.
    """
    if not 0 <= reach <= REACH:
        raise ValueError(f"keys reach {REACH} bits at most")

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            key, at = keys(fp)
            shard = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            key, own, shard = key[order], fp[at[order]], shard[order]
            ids, first = np.unique(shard, return_index=True)
            cut = [*first.tolist(), len(key)]
            data = [(key[a:b].tobytes(), own[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids.astype(np.int32)), pa.array([x for x, _ in data], pa.binary()), pa.array([y for _, y in data], pa.binary())],
                names=["shard", "key", "own"],
            )

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[bytes], list[bytes]]] = {}
        for batch in it:
            for shard, key, own in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if shard not in held:
                    held[shard] = ([], [])
                held[shard][0].append(key)
                held[shard][1].append(own)
        for shard in list(held):
            key, own = (np.frombuffer(b"".join(x), np.uint64) for x in held.pop(shard))
            found = forest(*(x.view(np.int64) for x in map(np.ascontiguousarray, links(key, own, reach))))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    dealt = distinct.select("fp").mapInArrow(deal, "shard int, key binary, own binary")
    return dealt.repartition(shards, "shard").mapInArrow(meet, "a long, b long")


def golay_shards(distinct: DataFrame) -> int:
    """Shards for the keys of so many fingerprints: about 200 of 16 bytes each."""
    least = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, distinct.count() * 200 * 16 // SHARD_BYTES)


def near_groups(docs: DataFrame, words: int = 4, reach: int = REACH) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links. Runs jobs when called."""
    own = cut_lineage(fingerprints(docs, words))
    first = cut_lineage(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(near_links(first, golay_shards(first), reach))
    named = first.join(found, first["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = cut_lineage(named.join(names, "root").select(F.col("fp").alias("own"), "component_id"))
    return own.join(names, own["fp"] == names["own"]).select("doc_id", "fp", "component_id")
