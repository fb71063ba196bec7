"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come by the method of `simhash`: each set has a fingerprint, the Golay keys of fingerprints
meet, and links of at most REACH bits, checked bit by bit, go on. Pairs at the asked similarity may
differ in more bits than such keys reach, so further keys find these: a print is the smallest of all
shingle hashes under one multiplier, which two documents share with a probability equal to their
similarity; ROWS prints make a key, and there are so many keys that a pair at the asked similarity
shares none with a probability of at most MISSED. Whoever is linked by a fingerprint, or shares a key,
at sizes that allow the similarity, is in one loose group. The shingle hashes of the documents of such
groups are then compared exactly, group by group, by a search that leaves out what it has reached; so
no pair is linked that isn't similar enough. Equal sets are one vertex.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandsift.llm.bloom import bits_for, held_filter, split_by
from bandsift.llm.common import batches, cut_lineage, free, give_back, texts
from bandsift.llm.components import components, forest
from bandsift.llm.simhash import SEED, SHARD_BYTES, golay_shards, majority, near_links

#: Prints in a key, and the share of pairs at the asked similarity that no key may find.
ROWS, MISSED = 6, 1e-8

#: Shards at least.
SHARDS = 48


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of so many words; a shorter text is one run."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate([[0], ends[:-1]])
    last = (ends[words - 1 :] if len(found) >= words else ends[-1:]) - 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist(), strict=False)], np.uint64))


def vertex_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def bands(similarity: float) -> int:
    """Keys of a document."""
    return max(1, math.ceil(math.log(MISSED) / math.log(1 - similarity**ROWS))) if similarity < 1 else 1


def keys(own: np.ndarray, n: int) -> np.ndarray:
    """n keys of a set of shingles; none of an empty set."""
    if not len(own):
        return np.zeros(0, np.uint64)
    factor = np.random.default_rng(SEED).integers(0, 1 << 63, n * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(n * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 256):
        np.minimum(least, (own[at : at + 256, None] * factor).min(axis=0), out=least)
    out = (least.reshape(n, ROWS) * factor[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(n, dtype=np.uint64) * factor[-1]
    out = (out ^ out >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ out >> np.uint64(29)


def _loose(key: np.ndarray, vertex: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect vertices under one key. By size, neighbours connect what any pairs would."""
    order = np.lexsort((vertex, size, key))
    key, vertex, size = key[order], vertex[order], size[order]
    hit = np.flatnonzero((key[1:] == key[:-1]) & (size[:-1] >= similarity * size[1:] * (1 - 1e-9)))
    a, b = vertex[hit], vertex[hit + 1]
    return np.minimum(a, b), np.maximum(a, b)


def groups_of(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the number of the first one of its component of exact similarity."""
    size = np.array([len(x) for x in sets], np.int64)
    which = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begin = np.cumsum(size) - size
    out = np.full(len(sets), -1, np.int64)
    mark = np.zeros(int(which.max()) + 1, bool)
    rest, flat = np.arange(len(sets)), which
    while len(rest):
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        out[root] = root
        flat = flat[size[root] :]
        while queue and len(rest):
            x = queue.pop()
            own = which[begin[x] : begin[x] + size[x]]
            mark[own] = True
            shared = np.add.reduceat(mark[flat], np.cumsum(size[rest]) - size[rest], dtype=np.int64)
            mark[own] = False
            hit = shared / (size[rest] + size[x] - shared) >= similarity
            if hit.any():
                out[rest[hit]] = root
                queue.extend(rest[hit].tolist())
                flat = flat[np.repeat(~hit, size[rest])]
                rest = rest[~hit]
    return out


def golay_links(own: DataFrame) -> DataFrame:
    """Links (a, b) that connect the vertices of own(vertex, size, fp) whose fingerprints have Golay links.

    Vertices with one fingerprint are linked to the smallest of them, which stands for all in links between
    fingerprints. Empty sets have none. Runs jobs when called.
    """
    marked = own.filter("size > 0").select("vertex", "fp").distinct()
    least = cut_lineage(marked.groupBy("fp").agg(F.min("vertex").alias("least")))
    first, second = (least.select(F.col("fp").alias(x), F.col("least").alias(y)) for x, y in (("a", "x"), ("b", "y")))
    between = near_links(least.select("fp"), golay_shards(least)).join(first, "a").join(second, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = marked.join(least, "fp").filter("vertex != least").select(F.col("vertex").alias("a"), F.col("least").alias("b"))
    return between.unionByName(same)


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id of each group of near copies. Runs jobs when called.

    Null and empty texts are alike; rows without an id never name a group.
    """
    return _grouped(docs, words, similarity).select("doc_id", "component_id")


def _grouped(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(doc_id, hash, component_id) of each row; the hash is that of its text."""
    n = bands(similarity)

    def fingerprint(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            sets = [shingles(t, words) for t in texts(batch)]
            cols = [pa.array([vertex_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([keys(x, n).tobytes() for x in sets], pa.binary())]
            cols.append(pa.array(np.array([majority(x) for x in sets], np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), *cols], names=["doc_id", "hash", "vertex", "size", "keys", "fp"])

    texts_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts_ = texts_.withColumn("hash", F.xxhash64("text"))
    own = cut_lineage(texts_.mapInArrow(fingerprint, "doc_id long, hash long, vertex long, size long, keys binary, fp long"))
    # A vertex is a distinct set of shingles, named by a hash of it.
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash"))
    vertices = own.groupBy("vertex").agg(least.alias("least")).select("vertex", F.col("least.doc_id").alias("first"), F.col("least.hash").alias("its"))
    shards = max(SHARDS, own.count() * n * 20 // SHARD_BYTES)

    def packed(shard: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row for each shard, with what the columns hold for it."""
        order = np.argsort(shard, kind="stable")
        ids, first = np.unique(shard[order], return_index=True)
        cuts = [*first.tolist(), len(shard)]
        cols = [pa.array([c[order[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *cols], names=["shard", *"abc"[: len(cols)]])

    def shard_of(x: np.ndarray) -> np.ndarray:
        return ((x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt: set[int] = set()
        for batch in it:
            new = []
            for v in batch.column("vertex").to_pylist():
                new.append(v not in dealt)
                dealt.add(v)
            batch = batch.filter(pa.array(new))
            raw = [np.frombuffer(x, "<u8") for x in batch.column("keys").to_pylist()]
            if any(map(len, raw)):
                at = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
                key = np.concatenate(raw)
                yield from packed(shard_of(key), key, np.asarray(batch.column("vertex"))[at], np.asarray(batch.column("size"))[at].astype("<u4"))

    def by_shard(it: Iterator[pa.RecordBatch], n_columns: int) -> Iterator[list[bytes]]:
        held: dict[int, list[tuple]] = {}
        for batch in it:
            for shard, *row in zip(*(batch.column(c).to_pylist() for c in range(1 + n_columns)), strict=True):
                held.setdefault(shard, []).append(tuple(row))
        for shard in list(held):
            yield [b"".join(c) for c in zip(*held.pop(shard), strict=True)]
        give_back()

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, vertex, size in by_shard(it, 3):
            a, b = _loose(np.frombuffer(key, "<u8"), np.frombuffer(vertex, "<i8"), np.frombuffer(size, "<u4").astype(np.int64), similarity)
            links = np.unique(np.stack([a, b], axis=1), axis=0)
            found = forest(links[:, 0], links[:, 1])
            x, y = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    dealt = own.select("vertex", "size", "keys").mapInArrow(deal, "shard int, a binary, b binary, c binary")
    by_prints = dealt.repartition(shards, "shard").mapInArrow(meet, "a long, b long")
    loose = components(golay_links(own).unionByName(by_prints))
    # One row of each vertex of a loose group is enough; only copies under one doc_id, or none, come along.
    member = vertices.join(loose, vertices["vertex"] == loose["node"]).select(F.col("first").alias("own"), "its", "vertex", F.col("component").alias("loose"))
    member = cut_lineage(member)
    held = held_filter(member.select(F.xxhash64("own", "its")), bits_for(member.count()))
    maybe, _ = split_by(texts_, [F.xxhash64("doc_id", "hash")], held)
    again = maybe.join(member, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("hash") == F.col("its"))).select("vertex", "loose", "text")

    def send(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            vertex, group = (np.asarray(batch.column(c)) for c in ("vertex", "loose"))
            sets = [shingles(t, words) for t in texts(batch)]
            ok = [i for i, x in enumerate(sets) if len(x) and vertex_of(x) == vertex[i]]
            if not ok:
                continue
            shard = shard_of(group[ok])
            for s in np.unique(shard).tolist():
                at = [i for i, k in zip(ok, shard.tolist(), strict=True) if k == s]
                head = np.array([(group[i], vertex[i], len(sets[i])) for i in at], "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([head.tobytes()], pa.binary()), pa.array([np.concatenate([sets[i] for i in at]).tobytes()], pa.binary())],
                    names=["shard", "a", "b"],
                )

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, found in by_shard(it, 2):
            group, vertex, size = np.frombuffer(head, "<i8").reshape(-1, 3).T
            data, end = np.frombuffer(found, "<u8"), np.cumsum(size)
            order = np.lexsort((vertex, group))
            new = np.ones(len(order), bool)
            new[1:] = vertex[order][1:] != vertex[order][:-1]
            order = order[new]
            for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                root = groups_of([data[end[i] - size[i] : end[i]] for i in at], similarity)
                yield pa.RecordBatch.from_arrays([pa.array(vertex[at], pa.int64()), pa.array(vertex[at[root]], pa.int64())], names=["node", "component"])

    found = again.mapInArrow(send, "shard int, a binary, b binary").repartition(shards, "shard").mapInArrow(verify, "node long, component long")
    named = vertices.join(found, vertices["vertex"] == found["node"], "left").select("vertex", "first", F.coalesce("component", "vertex").alias("root"))
    named = cut_lineage(named)
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = cut_lineage(named.join(names, "root").select(F.col("vertex").alias("own"), "component_id"))
    rows = own.select("doc_id", "hash", "vertex")
    return rows.join(names, rows["vertex"] == names["own"]).select("doc_id", "hash", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The document with the smallest doc_id of each group, all columns as they were.

    Of rows that share that doc_id the first by the order of their columns stays. Rows without a doc_id
    stay if no row of their group has one.
    """
    found = cut_lineage(_grouped(docs, words, similarity))
    stays = F.col("component_id").eqNullSafe(F.col("doc_id"))
    lost = cut_lineage(found.filter(~stays).select("doc_id", "hash").distinct())
    several = found.filter(stays & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    several = cut_lineage(several.filter("n > 1").select("doc_id"))
    numbers = lost.select(F.xxhash64("doc_id", "hash").alias("number")).unionByName(several.select(F.xxhash64("doc_id").alias("number")))
    held = held_filter(numbers, bits_for(lost.count() + several.count()))
    id_, hash_ = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    maybe, kept = split_by(docs, [F.xxhash64(id_, hash_), F.xxhash64(id_)], held)
    # Of those picked, few are not lost.
    own, its, rank = (free(c, docs.columns) for c in ("_own", "_its", "_rank"))
    gone = lost.select(F.col("doc_id").alias(own), F.col("hash").alias(its))
    left = cut_lineage(maybe.join(gone, id_.eqNullSafe(F.col(own)) & (hash_ == F.col(its)), "left_anti"))
    again = several.select(F.col("doc_id").alias(own))
    order = [F.col(c) for c in docs.columns if c != "doc_id"]
    first = left.join(again, id_ == F.col(own), "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))
    single = left.join(again, id_ == F.col(own), "left_anti")
    return kept.unionByName(single).unionByName(first.filter(F.col(rank) == 1).drop(rank))
