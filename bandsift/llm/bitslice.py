"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to whole numbers. For a block of rows, slice s of component j is a bitmap of
the rows in which bit s of that component (raised to be non-negative) is set. A query's scores are
themselves built as slices: for each bit t of |q_j| the slices of component j count with weight
2^(s+t), complemented where q_j is negative, which only adds a constant; carry-save adders sum all
bitmaps of a weight at once. Selection then walks the score slices from the most significant one
down, and keeps rows surely above the k-th score and rows equal to it so far; of the rows that stay
equal the smallest ids are taken, exactly.

Queries and rows meet block by block: each block of rows sees each block of queries once, and yields
k rows a query; these are ranked again over all blocks.

Edge cases: a vector that is null, or holds null, NaN or infinity, takes no part; neither does a row
without an id. Shorter vectors count as zero in what they lack. Rows with equal ids are different
rows, but a query never meets a row with its own id. An empty table gives no rows. Components are
cut to 64 bits. Where scores of a block could need more than 62 bits they are summed as Python
integers instead of slices; a score itself is cut to 64 bits, and ranks as cut.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandsift.llm.common import cut_lineage

#: Rows and queries of a block, and bytes of bitmaps that queries of one step may gather.
ROWS, QUERIES, STEP_BYTES = 8192, 512, 16 << 20


def quantised(column: Column, scale: float) -> Column:
    """floor(scale * x) of each component; null if the vector takes no part."""
    as_double = F.transform(column, lambda x: x.cast("double"))
    bad = F.exists(as_double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(column.isNotNull() & ~bad, F.transform(as_double, lambda x: F.floor(F.lit(scale) * x)))


def slice_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(bitmaps by component and bit, least value of each component, bits) of rows x components."""
    low = x.min(axis=0)
    raised = (x - low).astype(np.uint64)
    bits = max(1, int(raised.max(initial=0)).bit_length())
    words = -(-len(x) // 64)
    out = np.zeros((x.shape[1], bits, words * 8), np.uint8)
    for s in range(bits):
        packed = np.packbits((raised >> np.uint64(s) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
        out[:, s, : packed.shape[1]] = packed
    return out.view(np.uint64), low, bits


def add(own: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sum bitmaps (queries, bitmaps, words) of one weight: the sum's slice, and carries of twice the weight."""
    carries = []
    while own.shape[1] > 1:
        third = own.shape[1] // 3
        if third:
            a, b, c = own[:, :third], own[:, third : 2 * third], own[:, 2 * third : 3 * third]
            half = a ^ b
            carries.append((a & b) | (half & c))
            own = np.concatenate([half ^ c, own[:, 3 * third :]], axis=1)
        else:
            carries.append(own[:, :1] & own[:, 1:])
            own = own[:, :1] ^ own[:, 1:]
    return own, carries


def score_slices(slices: np.ndarray, bits: int, queries: np.ndarray) -> list[np.ndarray]:
    """Slices of sum |q_j| * v_j, where v_j is component j or its complement (all queries at once)."""
    words, width = slices.shape[2], slices.shape[0]
    flat = np.concatenate([slices.reshape(-1, words), ~slices.reshape(-1, words), np.zeros((1, words), np.uint64)])
    none = len(flat) - 1
    size, negative = np.abs(queries), queries < 0
    # The largest possible sum has so many bits; carries beyond it are empty.
    weights = max(1, (int(size.sum(axis=1).max(initial=0)) * ((1 << bits) - 1)).bit_length())
    out: list[np.ndarray] = []
    carries: list[np.ndarray] = []
    for w in range(weights):
        picked = [np.full((len(queries), 1), none)]
        for s in range(max(0, w - 62), min(bits, w + 1)):
            place = np.arange(width) * bits + s + width * bits * negative
            picked.append(np.where(size >> (w - s) & 1, place, none))
        at = np.sort(np.concatenate(picked, axis=1), axis=1)
        most = int((at < none).sum(axis=1).max(initial=0))
        own, carries = add(np.concatenate([flat[at[:, :most]], *carries], axis=1))
        out.append(own[:, 0] if own.shape[1] else np.zeros((len(queries), words), np.uint64))
    return out


def select(scores: list[np.ndarray], member: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of rows surely among the k highest, and of rows that tie for the places left."""
    sure, tied = np.zeros_like(member), member.copy()
    for s in reversed(scores):
        with_bit = tied & s
        n = (np.bitwise_count(sure) + np.bitwise_count(with_bit)).sum(axis=1, dtype=np.int64)
        enough = (n >= k)[:, None]
        sure = np.where(enough, sure, sure | with_bit)
        tied = np.where(enough, with_bit, tied & ~s)
    return sure, tied


#: Scores surely below this are summed by slices.
SLICED = 2.0**61
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def too_wide(rows: np.ndarray, queries: np.ndarray) -> bool:
    """Whether a score, or a sum on the way to it, may not fit."""
    if not rows.size or not queries.size:
        return False
    high, low = rows.max(axis=0).astype(float), rows.min(axis=0).astype(float)
    reach = np.maximum(high - low, np.maximum(np.abs(high), np.abs(low)))
    return bool(reach.max() >= SLICED or (np.abs(queries.astype(float)) @ reach).max() >= SLICED)


def top_by_integers(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `top`, with integers of any size."""
    found: list[tuple[int, int, int]] = []
    wide = rows.astype(object)
    for n, (q, own) in enumerate(zip(queries.astype(object), query_ids.tolist(), strict=True)):
        scores = [min(max(x, LEAST), MOST) for x in (wide @ q).tolist()]
        best = heapq.nsmallest(k, ((-x, i) for x, i in zip(scores, ids.tolist(), strict=True) if i != own))
        found += [(n, i, -x) for x, i in best]
    return tuple(np.array([f[c] for f in found], np.int64) for c in range(3))


def first_bits(bitmap: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))[:n]


def top(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row id, score) of each query's k best rows of a block; rows ascend by id."""
    if too_wide(rows, queries):
        return top_by_integers(rows, ids, queries, query_ids, k)
    slices, _, bits = slice_rows(rows)
    words = slices.shape[2]
    all_rows = np.zeros(words * 64, np.uint8)
    all_rows[: len(ids)] = 1
    every = np.packbits(all_rows, bitorder="little").view(np.uint64)
    found: list[list[np.ndarray]] = [[], [], []]
    at_once = max(1, STEP_BYTES // (words * 8 * rows.shape[1] * (bits + 4)))
    for begin in range(0, len(queries), at_once):
        q = queries[begin : begin + at_once]
        member = np.repeat(every[None], len(q), axis=0)
        for i, own in enumerate(query_ids[begin : begin + at_once]):
            for p in range(np.searchsorted(ids, own, side="left"), np.searchsorted(ids, own, side="right")):
                member[i, p >> 6] &= ~(np.uint64(1) << np.uint64(p & 63))
        sure, tied = select(score_slices(slices, bits, q), member, k)
        for i in range(len(q)):
            best = first_bits(sure[i], k)
            best = np.concatenate([best, first_bits(tied[i], k - len(best))])
            found[0].append(np.full(len(best), begin + i))
            found[1].append(ids[best])
            found[2].append(rows[best] @ q[i])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def _block(packed: pa.StructArray, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids, rows x components) of a block; shorter vectors are filled up with zeros."""
    vectors = packed.field("v")
    sizes = np.asarray(vectors.value_lengths())
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.asarray(vectors.flatten())
    return np.asarray(packed.field("vec_id")), out


def search(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query(vec_id, v) its k highest rows(vec_id, v)."""

    def block(df: DataFrame, size: int) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // size))
        # The place in the written table spreads rows that are alike, too.
        key = F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(n)).cast("int")
        packed = df.withColumn("block", key).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("rows"))
        return packed, n

    stored, n_stored = block(rows, ROWS)
    asked, _ = block(queries, QUERIES)
    pairs = asked.select(F.col("block").alias("q"), F.col("rows").alias("asked"), F.explode(F.sequence(F.lit(0), F.lit(n_stored - 1))).alias("block"))
    # Each pair of blocks is a row of its own; the blocks are of bounded size.
    met = pairs.join(stored, "block").repartition("q", "block")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                ids, own = _block(batch.column("rows")[i].values)
                query_ids, wanted = _block(batch.column("asked")[i].values, own.shape[1])
                if wanted.shape[1] > own.shape[1]:
                    own = np.pad(own, ((0, 0), (0, wanted.shape[1] - own.shape[1])))
                which, found, score = top(own, ids, wanted, query_ids, k)
                q = np.full(len(which), batch.column("q")[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (query_ids[which], q, which, found, score)], names=["query_id", "q", "n", "vec_id", "score"])

    best = met.select("q", "rows", "asked").mapInArrow(run, "query_id long, q long, n long, vec_id long, score long")
    # (q, n) tells apart queries that share an id.
    order = Window.partitionBy("query_id", "q", "n").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_inner_products(vectors: DataFrame, scale: float = 64.0, every: int = 20, k: int = 20) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by `every`; candidates are all other rows."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v"))
    own = cut_lineage(own.filter("vec_id is not null and v is not null"))
    return search(own, own.filter(F.col("vec_id") % every == 0), k)
