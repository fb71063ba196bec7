"""Ordered per-key primitives that never put one key's whole history into one task.

Each history is cut into chunks by an expression that does not decrease along the
order. Work inside a chunk is an ordinary window over (key, chunk); what crosses a
boundary comes from a summary with one row per (key, chunk), which is joined back.
A key that holds a third of all rows is therefore spread over all its chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bandsift.runtime import cut_lineage

Keys = Sequence[str]

_CHUNK = "_chunk"


def time_chunk(ts: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000))


def number_chunk(name: str, width: int) -> Column:
    return F.floor(F.col(name) / F.lit(width))


def attach(df: DataFrame, side: DataFrame, on: Keys, how: str = "left") -> DataFrame:
    """Join `side` by columns of the same name. Key columns hold no nulls, so this stays a
    plain equi join that keeps the partitioning of `df`."""
    return df.join(side, list(on), how)


def with_place(ordered: DataFrame, name: str = "place") -> DataFrame:
    """Number the rows of a sorted result from 1, whatever their number.

    The sorted rows are written with their range partition; the counts of partitions then give
    each partition's first number, so no task sees more than its own range.
    """
    rows = ordered.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    rows = cut_lineage(rows)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a partition.
    first = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_least"))
    first = first.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), "_least")
    place = F.col("_before") + F.col("_row") - F.col("_least") + 1
    return rows.join(first, "_part").withColumn(name, place).drop("_part", "_row", "_before", "_least")


def _struct(names: Sequence[str]) -> Column:
    return F.struct(*[F.col(n) for n in names])


def with_neighbours(
    df: DataFrame,
    keys: Keys,
    order: Keys,
    values: Sequence[str],
    chunk: Column,
    before: bool = True,
    after: bool = True,
) -> DataFrame:
    """Add prev_<value> and next_<value>: what the key's neighbouring rows hold, or null."""
    within = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    rows = df.withColumn(_CHUNK, chunk)
    edges = rows.groupBy(*keys, _CHUNK).agg(
        F.min_by(_struct(values), _struct(order)).alias("_head"),
        F.max_by(_struct(values), _struct(order)).alias("_tail"),
    )
    along = Window.partitionBy(*keys).orderBy(_CHUNK)
    carry = edges.select(
        *keys,
        _CHUNK,
        F.lag("_tail").over(along).alias("_carry_prev"),
        F.lead("_head").over(along).alias("_carry_next"),
    )
    sides = [("prev", F.lag, before), ("next", F.lead, after)]
    for side, neighbour, wanted in sides:
        if wanted:
            rows = rows.withColumn(f"_{side}", neighbour(_struct(values)).over(within))
    joined = attach(rows, carry, [*keys, _CHUNK])
    for side, _, wanted in sides:
        if wanted:
            found = F.coalesce(f"_{side}", f"_carry_{side}")
            for name in values:
                joined = joined.withColumn(f"{side}_{name}", found[name])
    return joined.drop("_prev", "_next", "_carry_prev", "_carry_next", _CHUNK)


def with_previous(
    df: DataFrame, keys: Keys, order: Keys, values: Sequence[str], chunk: Column
) -> DataFrame:
    return with_neighbours(df, keys, order, values, chunk, after=False)


def with_next(
    df: DataFrame, keys: Keys, order: Keys, values: Sequence[str], chunk: Column
) -> DataFrame:
    return with_neighbours(df, keys, order, values, chunk, before=False)


def with_running_sum(
    df: DataFrame, keys: Keys, order: Keys, sums: dict[str, Column], chunk: Column
) -> DataFrame:
    """Add inclusive running sums; rows tied in the order are counted one by one."""
    within = (
        Window.partitionBy(*keys, _CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = df.withColumn(_CHUNK, chunk)
    for name, value in sums.items():
        rows = rows.withColumn(f"_v_{name}", value)
    totals = rows.groupBy(*keys, _CHUNK).agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *keys,
        _CHUNK,
        *[
            F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_c_{name}")
            for name in sums
        ],
    )
    for name in sums:
        rows = rows.withColumn(name, F.sum(f"_v_{name}").over(within))
    joined = attach(rows, carry, [*keys, _CHUNK])
    for name in sums:
        joined = joined.withColumn(name, F.col(name) + F.col(f"_c_{name}"))
    return joined.drop(
        _CHUNK, *[f"_v_{name}" for name in sums], *[f"_c_{name}" for name in sums]
    )


def with_position(
    df: DataFrame, keys: Keys, order: Keys, chunk: Column, name: str = "position"
) -> DataFrame:
    """Add the 1-based place of each row in its key's order."""
    return with_running_sum(df, keys, order, {name: F.lit(1).cast("bigint")}, chunk)


def with_last_known(
    df: DataFrame, keys: Keys, order: Keys, values: dict[str, str], chunk: Column
) -> DataFrame:
    """For value -> new name: latest non-null value up to and including the row."""
    within = (
        Window.partitionBy(*keys, _CHUNK)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = df.withColumn(_CHUNK, chunk)
    tails = rows.groupBy(*keys, _CHUNK).agg(
        *[
            F.max_by(F.col(v), F.when(F.col(v).isNotNull(), _struct(order))).alias(f"_t_{n}")
            for v, n in values.items()
        ]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = tails.select(
        *keys,
        _CHUNK,
        *[
            F.last(f"_t_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}")
            for n in values.values()
        ],
    )
    for v, n in values.items():
        rows = rows.withColumn(f"_w_{n}", F.last(v, ignorenulls=True).over(within))
    joined = attach(rows, carry, [*keys, _CHUNK])
    for n in values.values():
        joined = joined.withColumn(n, F.coalesce(f"_w_{n}", f"_c_{n}"))
    return joined.drop(
        _CHUNK, *[f"_w_{n}" for n in values.values()], *[f"_c_{n}" for n in values.values()]
    )


def with_run_start(
    df: DataFrame,
    keys: Keys,
    order: Keys,
    values: Sequence[str],
    starts: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    chunk: Column,
    mark: str,
    name: str,
) -> DataFrame:
    """Cut each key into runs and name every row's run by `mark` of the run's first row.

    `starts(here, before)` tells from a row's and its predecessor's values whether a run
    begins; before a key's first row they are null and it must say so. Also adds
    prev_<value>. Both the predecessor and the run cross chunk borders by one summary row
    per chunk, so the input is read twice, however many things are carried.
    """
    within = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    rows = df.withColumn(_CHUNK, chunk).withColumn("_before", F.lag(_struct(values)).over(within))
    begins = F.col("_before").isNotNull() & starts(F.col, lambda n: F.col("_before")[n])
    rows = rows.withColumn("_mark", F.when(begins, F.col(mark)))
    rows = rows.withColumn(
        "_local",
        F.last("_mark", ignorenulls=True).over(
            within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    )
    head = F.struct(*[F.col(v) for v in values], F.col(mark).alias("_m"))
    chunks = rows.groupBy(*keys, _CHUNK).agg(
        F.min_by(head, _struct(order)).alias("_head"),
        F.max_by(_struct(values), _struct(order)).alias("_tail"),
        F.max_by("_local", _struct(order)).alias("_last"),
    )
    along = Window.partitionBy(*keys).orderBy(_CHUNK)
    carried = chunks.withColumn("_carry", F.lag("_tail").over(along))
    first = starts(lambda n: F.col("_head")[n], lambda n: F.col("_carry")[n])
    carried = carried.withColumn("_first", F.when(first, F.col("_head._m")))
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carry = carried.select(
        *keys,
        _CHUNK,
        "_carry",
        F.coalesce(
            "_first", F.last(F.coalesce("_last", "_first"), ignorenulls=True).over(earlier)
        ).alias("_entry"),
    )
    joined = attach(rows, carry, [*keys, _CHUNK]).withColumn(
        "_before", F.coalesce("_before", "_carry")
    )
    for v in values:
        joined = joined.withColumn(f"prev_{v}", F.col("_before")[v])
    return joined.withColumn(name, F.coalesce("_local", "_entry")).drop(
        "_before", "_carry", "_mark", "_local", "_entry", _CHUNK
    )


def newest_per_key(
    df: DataFrame, keys: Keys, order: Keys, n: int, chunk: Column, rank: str | None = None
) -> DataFrame:
    """The n rows of each key that come last in the order.

    Chunk counts tell which chunks can hold them, so older chunks are dropped by a
    join on (key, chunk) before anything is ranked.
    """
    rows = df.withColumn(_CHUNK, chunk)
    counts = rows.groupBy(*keys, _CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    later = (
        Window.partitionBy(*keys)
        .orderBy(F.col(_CHUNK).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    needed = counts.select(
        *keys, _CHUNK, F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later")
    ).filter(F.col("_later") < n)
    within = Window.partitionBy(*keys, _CHUNK).orderBy(*[F.col(c).desc() for c in order])
    name = rank or "_rank"
    kept = (
        attach(rows, needed, [*keys, _CHUNK], how="inner")
        .withColumn(name, F.row_number().over(within) + F.col("_later"))
        .filter(F.col(name) <= n)
        .drop(_CHUNK, "_later")
    )
    return kept if rank else kept.drop(name)


class Fold:
    """Sequential state of one key. Rows come in order, a batch at a time."""

    def __init__(self, key: tuple):
        self.key = key

    def step(self, rows: pa.RecordBatch) -> list[tuple]:
        """Take the next rows; return finished output rows."""
        return []

    def finish(self) -> list[tuple]:
        """The key is over; return what is left."""
        return []


class PrefixFold(Fold):
    """Steps s' = a*s + b of one chunk: each row with the composition of those before it."""

    def __init__(self, key: tuple):
        super().__init__(key)
        self.a, self.b = 1.0, 0.0

    def step(self, rows: pa.RecordBatch) -> list[tuple]:
        out = []
        for at, a, b in columns_of(rows, rows.schema.names[-3:]):
            out.append((*self.key, at, a, b, self.a, self.b))
            self.a, self.b = a * self.a, a * self.b + b
        return out


class StateFold(Fold):
    """The state before each step of one key."""

    def __init__(self, key: tuple):
        super().__init__(key)
        self.state: float | None = None

    def step(self, rows: pa.RecordBatch) -> list[tuple]:
        out = []
        for at, a, b, seed in columns_of(rows, rows.schema.names[-4:]):
            if self.state is None:
                self.state = seed
            out.append((*self.key, at, self.state))
            self.state = a * self.state + b
        return out


def density(df: DataFrame, keys: Keys, position: str) -> DataFrame:
    """(keys, _low, _spacing): where each key's positions begin and how far apart they lie on average."""
    least, most = F.min(position), F.max(position)
    return df.groupBy(*keys).agg(
        least.alias("_low"), F.greatest(F.lit(1.0), (most - least + 1) / F.count(F.lit(1))).alias("_spacing")
    )


def dense_chunk(position: str, rows: int) -> Column:
    """Chunks of about so many rows, for a table with the columns of `density`: positions may be frame
    numbers or samples."""
    return F.floor((F.col(position) - F.col("_low")) / (F.col("_spacing") * rows))


def affine_scan(
    df: DataFrame,
    keys: Keys,
    position: str,
    a: str,
    b: str,
    seed: DataFrame,
    width: int,
    levels: int = 1,
) -> DataFrame:
    """State before each row of s' = a*s + b, started per key from `seed` (keys, seed).

    Steps compose, so chunks of about `width` rows are folded independently, with more `levels` chunks of
    chunks as well, and only the top level, a row for each of its chunks, folds along a key. Every fold
    passes over its rows once and holds two numbers. Adds `state_before`.
    """
    group = f"_group{levels}"
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ddl = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    placed = attach(df, density(df, keys, position), keys).withColumn(group, dense_chunk(position, width))
    folded = cut_lineage(
        fold_sorted(
            placed.select(*keys, group, position, a, b),
            [*keys, group],
            [position],
            PrefixFold,
            f"{ddl}, `{group}` BIGINT, `{position}` {kinds[position]}, `{a}` DOUBLE, `{b}` DOUBLE, _pa DOUBLE, _pb DOUBLE",
        )
    )
    whole = F.struct((F.col(a) * F.col("_pa")).alias("a"), (F.col(a) * F.col("_pb") + F.col(b)).alias("b"))
    groups = folded.groupBy(*keys, group).agg(F.max_by(whole, position).alias("_g"))
    groups = groups.select(*keys, group, F.col("_g.a").alias("_ga"), F.col("_g.b").alias("_gb"))
    if levels > 1:
        entry = affine_scan(groups, keys, group, "_ga", "_gb", seed, width, levels - 1)
    else:
        entry = fold_sorted(
            attach(groups, seed.withColumn("seed", F.col("seed").cast("double")), keys),
            keys,
            [group],
            StateFold,
            f"{ddl}, `{group}` BIGINT, state_before DOUBLE",
        )
    entry = entry.select(*keys, group, F.col("state_before").alias("_entry"))
    before = F.col("_pa") * F.col("_entry") + F.col("_pb")
    return attach(folded, entry, [*keys, group]).select(*keys, position, a, b, before.alias("state_before"))


def fold_sorted(
    df: DataFrame, keys: Keys, order: Keys, start: Callable[[tuple], Fold], schema: str
) -> DataFrame:
    """Stream each key's rows, in order, through a `Fold`.

    Spark shuffles by key and sorts inside partitions, spilling as needed; a Python
    worker sees one batch at a time and keeps only the state of the key at hand.
    """
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out: list[tuple] = []
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in names]
            changed = np.zeros(batch.num_rows, dtype=bool)
            for col in cols:
                changed[1:] |= col[1:] != col[:-1]
            edges = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                key = tuple(col[low].item() if hasattr(col[low], "item") else col[low] for col in cols)
                if fold is None or fold.key != key:
                    if fold is not None:
                        out += fold.finish()
                    fold = start(key)
                out += fold.step(batch.slice(low, high - low))
            yield _rows(out, kinds)
        if fold is not None:
            yield _rows(fold.finish(), kinds)

    arranged = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return arranged.mapInArrow(run, schema)


def _rows(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=kinds)


def columns_of(rows: pa.RecordBatch, names: Sequence[str]) -> Iterator[tuple]:
    """The named columns of a batch, row by row."""
    return zip(*[rows.column(n).to_pylist() for n in names], strict=True)
