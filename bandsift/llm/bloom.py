"""A filter over 64-bit numbers, of bounded size: what it does not hold is certainly not among them.

Tasks fill filters of their own, which are merged slice by slice. A filter has about BITS_EACH bits a
number, at most FILTER_BITS; where there are more numbers it lets more rows through that an exact join
then sends back, with the same result.

Edge cases: null numbers are left out; no numbers give a filter that holds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandsift.llm.common import free, give_back
from bandsift.llm.lines import probes

#: Bits a number, of a filter at least and at most, and of a slice in which filters are merged.
BITS_EACH, LEAST_BITS, FILTER_BITS, SLICE_BITS = 16, 1 << 16, 1 << 26, 1 << 22


def bits_for(n: int) -> int:
    return min(FILTER_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n).bit_length()))


def held_filter(numbers: DataFrame, bits: int) -> np.ndarray:
    """The filter over a table with one column of numbers, as bytes of eight bits."""
    size = min(bits, SLICE_BITS)

    def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits, bool)
        for batch in it:
            own = np.asarray(batch.column(0).drop_null(), np.int64)
            held[probes(own, bits).ravel()] = True
        for i in range(0, bits, size):
            if held[i : i + size].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // size], pa.int32()), pa.array([np.packbits(held[i : i + size]).tobytes()], pa.binary())], names=["slice", "data"])

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in it:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(data, np.uint8)
                held[i] = held[i] | own if i in held else own
        for i, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["slice", "data"])

    schema = "slice int, data binary"
    # The numbers are few next to the rows they stand for; a filter of each of many tasks would not be.
    parts = numbers.coalesce(32).mapInArrow(fill, schema)
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.repartition(max(1, bits // size), "slice").mapInArrow(merge, schema).toLocalIterator():
        at = row["slice"] * (size // 8)
        out[at : at + size // 8] = np.frombuffer(row["data"], np.uint8)
    return out


def holds(held: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    at = probes(numbers, len(held) * 8)
    return ((held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def split_by(df: DataFrame, numbers: list[F.Column], held: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(rows that may be among the held ones by one of their numbers, rows that certainly aren't)."""
    known = df.sparkSession.sparkContext.broadcast(held)
    names, columns = [], df.columns
    wide = df
    for number in numbers:
        names.append(free("_number", wide.columns))
        wide = wide.withColumn(names[-1], number)

    def run(it: Iterator[pa.RecordBatch], inside: bool) -> Iterator[pa.RecordBatch]:
        for batch in it:
            hit = np.zeros(batch.num_rows, bool)
            for name in names:
                hit |= holds(known.value, np.asarray(batch.column(name), np.int64))
            yield batch.filter(pa.array(hit == inside)).select(columns)
        give_back()

    return wide.mapInArrow(partial(run, inside=True), df.schema), wide.mapInArrow(partial(run, inside=False), df.schema)
