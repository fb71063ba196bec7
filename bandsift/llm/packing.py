"""Packing token pieces into as few sequences of fixed length as it can.

Sizes are whole numbers up to the capacity, so the instance is a histogram of at most `capacity`
counts, whatever the number of documents. On it, Martello and Toth's reduction first fixes bins that
provably dominate every alternative for their largest item; best fit by decreasing size packs what
is left. Both work on counts, so a plan is a bounded list of patterns, each with how often it is
used. Items then find their place by their rank among items of the same size; ranks come from
running numbers within written partitions plus per-partition offsets, not from one sort.

Edge cases: a null or empty text is one piece with the end id only; repeated rows and ids are packed
like any others; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandsift.llm.chunks import chunks
from bandsift.llm.common import batches, cut_lineage, documents, texts

#: Sizes that share a bin, largest first, and how many such bins there are.
Pattern = tuple[tuple[int, ...], int]


class Counts:
    """How many items of each size are left, with the nearest size that has some."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        for size, n in counts.items():
            self.n[size] += n
        self.sizes = sorted(s for s, n in counts.items() if n)

    def at_most(self, size: int) -> int:
        """The largest size left that is no more than this, or 0."""
        k = bisect_right(self.sizes, size)
        return self.sizes[k - 1] if k else 0

    def take(self, size: int, n: int) -> None:
        self.n[size] -= n
        if not self.n[size]:
            self.sizes.remove(size)

    def least(self, n: int) -> list[int]:
        """The n smallest items left, repeats included."""
        out: list[int] = []
        for size in self.sizes:
            out += [size] * min(n - len(out), int(self.n[size]))
            if len(out) == n:
                break
        return out


def dominating(left: Counts, size: int, capacity: int) -> tuple[int, ...] | None:
    """A bin for an item of this size that dominates every other feasible one, if one is proven.

    With room r beside the item and b the largest other item that fits: nothing fits; or b fills the
    room; or no two others fit together; or any two that do weigh at most b, and no three fit. In each
    case whatever else shares the bin can trade places with b (or with nothing). If no three fit and
    b and another item fill the room, they dominate when the smaller member of any other pair is no
    larger than that item: members are then exchanged one by one.
    """
    left.n[size] -= 1
    gone = not left.n[size]
    if gone:
        left.sizes.remove(size)
    try:
        room = capacity - size
        b = left.at_most(room)
        if not b:
            return (size,)
        small = left.least(3)
        if b == room or len(small) < 2 or small[0] + small[1] > room:
            return (size, b)
        if len(small) == 3 and sum(small) <= room:
            return None
        pairs = list(_pairs(left, room))
        if max(low + high for low, high in pairs) <= b:
            return (size, b)
        best = max(low for low, high in pairs if high == b) if any(high == b for _, high in pairs) else 0
        if best + b == room and all(low <= best for low, _ in pairs):
            return (size, b, best)
        return None
    finally:
        left.n[size] += 1
        if gone:
            insort(left.sizes, size)


def _pairs(left: Counts, room: int) -> Iterator[tuple[int, int]]:
    """For each smaller member, the largest one that fits beside it."""
    for low in left.sizes:
        if 2 * low > room:
            return
        high = left.at_most(room - low)
        if high > low or left.n[low] > 1:
            yield low, high


def reduce(left: Counts, capacity: int) -> list[Pattern]:
    """Fix dominating bins, largest items first, until no item above half the capacity has one."""
    fixed: list[Pattern] = []
    again = True
    while again:
        again = False
        for size in [s for s in reversed(left.sizes) if 2 * s >= capacity]:
            while left.n[size]:
                found = dominating(left, size, capacity)
                if found is None:
                    break
                # Fewer items leave fewer alternatives: the proof holds until a size runs out.
                need = {s: found.count(s) for s in found}
                times = min(int(left.n[s]) // k for s, k in need.items())
                for s, k in need.items():
                    left.take(s, k * times)
                fixed.append((found, times))
                again = True
    return fixed


def best_fit(left: Counts, capacity: int) -> list[Pattern]:
    """Best fit by decreasing size, on counts: open bins are kept by the room they have left."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)

    def put(own: tuple[int, ...], free: int, n: int) -> None:
        room[free][own] = room[free].get(own, 0) + n

    for size in reversed(list(left.sizes)):
        n = int(left.n[size])
        # The fullest bin that has room gets the item; it stays the fullest until it has no room.
        for free in sorted(f for f in room if f >= size and room[f]):
            each = free // size
            for own in list(room[free]):
                if not n:
                    break
                bins = room[free].pop(own)
                whole = min(bins, n // each)
                if whole:
                    put(own + (size,) * each, free - size * each, whole)
                    n -= whole * each
                    bins -= whole
                if bins and n:
                    put(own + (size,) * n, free - size * n, 1)
                    n, bins = 0, bins - 1
                if bins:
                    put(own, free, bins)
            if not n:
                break
        each = capacity // size
        if n // each:
            put((size,) * each, capacity - size * each, n // each)
        if n % each:
            put((size,) * (n % each), capacity - size * (n % each), 1)
    return [(own, n) for bins in room.values() for own, n in bins.items()]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that pack all items: dominating bins first, best fit for the remainder."""
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("sizes must be from 1 to the capacity")
    left = Counts(counts, capacity)
    fixed = reduce(left, capacity)
    return fixed + best_fit(left, capacity)


Places = dict[int, np.ndarray]


def places(patterns: list[Pattern]) -> Places:
    """For each size: rank of the first item, first sequence, offset in it, items in each sequence."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    first = 0
    for own, n in patterns:
        at = 0
        for size in sorted(set(own), reverse=True):
            k = own.count(size)
            rows[size].append((used[size], first, at, k))
            used[size] += k * n
            at += k * size
        first += n
    return {s: np.array(r, dtype=np.int64).T for s, r in rows.items()}


def find(known: Places, sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the items with these ranks among those of their size."""
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        begin, first, place, each = known[int(size)]
        k = np.searchsorted(begin, ranks[at], side="right") - 1
        beyond = ranks[at] - begin[k]
        sequence[at] = first[k] + beyond // each[k]
        offset[at] = place[k] + beyond % each[k] * size
    return sequence, offset


PIECES = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, part int, number long"


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """Encode documents, add the end id, cut what is longer than the capacity.

    The table is written: `part` and `number` (running within part and length) must not change.
    """
    last = np.array([end_id], "<u4").tobytes()

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = chunks(vocabulary, False), TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches(it):
            cols: list[list] = [[] for _ in range(8)]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts(batch)), strict=True):
                ids += last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    for col, v in zip(cols, (doc_id, piece, at // 4, length, own, zlib.crc32(own), part, seen[length]), strict=True):
                        col.append(v)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PIECES.types, strict=True)], schema=_PIECES)

    return cut_lineage(documents(docs).mapInArrow(cut, PIECES))


_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("number", pa.int64())]
)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for a table of pieces.

    What reaches the driver is one count for each size up to the capacity.
    """
    spark = pieces.sparkSession
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    known = spark.sparkContext.broadcast(places(plan(totals, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    slim = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "part", "number")
    ranked = slim.join(offsets, ["part", "length"]).withColumn("rank", F.col("before") + F.col("number"))

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sizes, ranks = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            sequence, offset = find(known.value, sizes, ranks)
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], schema=_PACKED)

    own = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return own.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


_PACKED = pa.schema([*list(_PIECES)[:4], _PIECES.field("ids_crc32"), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): each sequence's ids in order; a group is one sequence at most."""
    own = packed.select("doc_id", "piece", "sequence_id", "offset").join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = own.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def packed_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    return pack(token_pieces(docs, vocabulary, end_id, capacity), capacity)
