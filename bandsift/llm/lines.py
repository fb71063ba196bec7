"""Line dedup: two Bloom filters find suspected repeats; only those shuffle to be confirmed exactly.

The filters hold hashes seen at least once and at least twice. Each task fills its own pair; pairs are
merged slice by slice: what two tasks have both seen once has been seen twice. A missing hash was
certainly not repeated, so all but the suspects stop there. Digests of the suspects are counted
exactly, and lines found in enough documents go from all documents but the one with the largest
doc_id. The filter that is broadcast has FILTER_BITS bits whatever the input; when it fills up, more
lines are suspects, and the result is the same.

Edge cases: a null or empty text is one empty line; a null doc_id counts as less than any other, and
all rows without one as one document; so do rows that share a doc_id, which all keep their lines if
theirs is the largest; repeats of a line within one document count once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from bandsift.llm.common import batches, cut_lineage, free, texts

#: Bits of each filter, of a slice in which filters are merged, and how many bits a line sets.
FILTER_BITS, SLICE_BITS, PROBES = 1 << 26, 1 << 22, 3


def key(line: bytes) -> bytes:
    """What makes lines equal: no ASCII white space around, no ASCII capitals."""
    return line.strip().lower()


def digests(text: str, least: int) -> list[bytes]:
    """For each line, 16 bytes that stand for its key; none for keys that are too short to count."""
    out = []
    for line in text.encode().split(b"\n"):
        own = key(line)
        long = len(own) >= least and (len(own) if own.isascii() else len(own.decode())) >= least
        out.append(xxhash.xxh3_128_digest(own) if long else b"")
    return out


def _halves(found: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)


def probes(low: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of each hash, PROBES in a row: low and odd high parts step through the filter."""
    h = low.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    k = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((h + k * step) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


class Pair:
    """Filters of hashes seen once and twice, as bytes of eight bits."""

    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, low: np.ndarray) -> None:
        own, counts = np.unique(low, return_counts=True)
        at = probes(own, self.bits)
        place, bit = at >> 3, (128 >> (at & 7)).astype(np.uint8)
        again = (counts > 1) | (self.once[place] & bit > 0).all(axis=0)
        np.bitwise_or.at(self.once, place.ravel(), bit.ravel())
        np.bitwise_or.at(self.twice, place[:, again].ravel(), bit[:, again].ravel())

    def slices(self, size: int) -> Iterator[tuple[int, bool, bool, bytes]]:
        """(slice, whether twice, whether positions, data): positions where they are shorter."""
        for twice, all_bits in ((False, self.once), (True, self.twice)):
            for i in range(0, self.bits, size):
                own = all_bits[i // 8 : (i + size) // 8]
                if not (n := int(np.bitwise_count(own).sum(dtype=np.int64))):
                    continue
                few = 4 * n < size // 8
                yield i // size, twice, few, np.flatnonzero(np.unpackbits(own)).astype("<u4").tobytes() if few else own.tobytes()


def _unpacked(data: bytes, few: bool, size: int) -> np.ndarray:
    if few:
        out = np.zeros(size, bool)
        out[np.frombuffer(data, "<u4")] = True
        return out
    return np.unpackbits(np.frombuffer(data, np.uint8), count=size).astype(bool)


def repeated_filter(docs: DataFrame, least: int, bits: int = FILTER_BITS, slice_bits: int = SLICE_BITS) -> np.ndarray:
    """The twice-seen filter over all lines, packed; its size is fixed by `bits`."""
    slice_bits = min(bits, slice_bits)

    def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(bits)
        for batch in batches(it):
            found = [x for t in texts(batch) for x in set(digests(t, least)) if x]
            if found:
                pair.add(np.ascontiguousarray(_halves(found)[:, 0]))
        for row in pair.slices(slice_bits):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _SLICE.types, strict=True)], schema=_SLICE)

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # All of a slice is in one partition; slices stay open until the end of it.
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for batch in it:
            for i, is_twice, few, data in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                new = _unpacked(data, few, slice_bits)
                if i not in once:
                    once[i], twice[i] = np.zeros(slice_bits // 8, np.uint8), np.zeros(slice_bits // 8, np.uint8)
                packed = np.packbits(new)
                if is_twice:
                    twice[i] |= packed
                else:
                    twice[i] |= once[i] & packed
                    once[i] |= packed
        for i, own in twice.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["slice", "data"])

    parts = docs.select("text").mapInArrow(fill, "slice int, twice boolean, few boolean, data binary")
    merged = parts.repartition(max(1, bits // slice_bits), "slice").mapInArrow(merge, "slice int, data binary")
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        at = row["slice"] * (slice_bits // 8)
        out[at : at + slice_bits // 8] = np.frombuffer(row["data"], np.uint8)
    return out


_SLICE = pa.schema([("slice", pa.int32()), ("twice", pa.bool_()), ("few", pa.bool_()), ("data", pa.binary())])


def suspects(docs: DataFrame, least: int, twice: np.ndarray) -> DataFrame:
    """(doc_id, hi, lo): digests of lines that the twice-seen filter doesn't rule out, once a document."""
    known = docs.sparkSession.sparkContext.broadcast(twice)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        for batch in batches(it):
            found = [list({x for x in digests(t, least) if x}) for t in texts(batch)]
            halves = _halves([x for f in found for x in f])
            ids = np.repeat(np.arange(len(found)), [len(f) for f in found])
            at = probes(np.ascontiguousarray(halves[:, 0]), len(own) * 8)
            hit = ((own[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(ids[hit])), pa.array(halves[hit, 0]), pa.array(halves[hit, 1])],
                names=["doc_id", "hi", "lo"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(run, "doc_id long, hi long, lo long")


def without_repeated_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, bits: int = FILTER_BITS) -> DataFrame:
    """The documents with their text less the repeated lines, then n_lines (before) and n_dropped.

    Two jobs run while this is called: the filter is built, and suspects are written.
    """
    lines = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = cut_lineage(suspects(lines, least_chars, repeated_filter(lines, least_chars, bits)))
    counted = found.groupBy("hi", "lo").agg(F.count_distinct(F.struct("doc_id")).alias("n"), F.max("doc_id").alias("stays"))
    confirmed = cut_lineage(counted.filter(F.col("n") >= least_docs).select("hi", "lo", "stays"))
    losing = found.join(confirmed, ["hi", "lo"]).filter((F.col("doc_id") < F.col("stays")) | (F.col("doc_id").isNull() & F.col("stays").isNotNull()))
    drops = losing.select(F.col("doc_id").alias("_doc"), F.struct("hi", "lo").alias("_d")).distinct()
    drops = drops.groupBy("_doc").agg(F.collect_list("_d").alias("_drops"))
    n_lines, n_dropped, marked = (free(c, docs.columns) for c in ("n_lines", "n_dropped", "_drops"))
    own = drops.withColumnRenamed("_drops", marked).withColumnRenamed("_doc", free("_doc", docs.columns))
    id_, names = own.columns[0], docs.columns
    joined = docs.join(own, docs["doc_id"].cast("long").eqNullSafe(own[id_]), "left").drop(id_)

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            all_drops = batch.column(marked).to_pylist()
            before, lost, out = [], [], []
            for text, drop in zip(batch.column("text").to_pylist(), all_drops, strict=True):
                before.append((text or "").count("\n") + 1)
                if not drop:
                    lost.append(0)
                    out.append(text)
                    continue
                gone = {np.array([d["hi"], d["lo"]], "<i8").tobytes() for d in drop}
                kept = [line for line, d in zip(text.split("\n"), digests(text, least_chars), strict=True) if d not in gone]
                lost.append(before[-1] - len(kept))
                out.append("\n".join(kept))
            columns = [pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(lost, pa.int64())], names=[*names, n_lines, n_dropped])

    as_text = joined.withColumn("text", F.col("text").cast("string"))
    counts = [StructField(c, LongType()) for c in (n_lines, n_dropped)]
    return as_text.mapInArrow(apply, StructType([*as_text.drop(marked).schema.fields, *counts]))

