"""Sequential folds day by day: each day starts from the state in which the day before ended.

A long history is never folded in one group: a task sees one key of one day. States are a table, a row
a key; so a new day costs a day, and a day whose rows have changed is folded again with the days after
it, not before. The results are those of one pass over everything.

    root/results/date=2024-01-03/...   root/states/date=2024-01-03/...   root/runs/0000000002.json

A run writes what it has folded last, so one that died begins again where the last whole run ended.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bandsift import params as P
from bandsift.operators.cluster import _REGION_COLUMNS, ASSIGNED_SCHEMA
from bandsift.operators.noise import BIN_NOISE_SCHEMA, BinNoiseFold, bin_blocks
from bandsift.sources import files
from bandsift.streaming.buffer import LiveFold
from bandsift.streaming.folds import LiveChannelFold

Start = Callable[[tuple], LiveFold]


def _tuples(value):
    """Structs as tuples of their values, lists as lists of these."""
    if isinstance(value, dict):
        return tuple(_tuples(v) for v in value.values())
    return [_tuples(v) for v in value] if isinstance(value, list) else value


def _parts(keys: Sequence[str], rows: DataFrame, start: Start, schema: str) -> T.StructType:
    own = T.StructType.fromDDL(start(tuple([0] * len(keys))).STATE)
    named = [rows.schema[k] for k in keys]
    return T.StructType([*named, T.StructField("_result", T.StructType.fromDDL(schema)), T.StructField("_state", own)])


def fold_piece(rows: DataFrame, states: DataFrame | None, keys: Sequence[str], order: Sequence[str], start: Start, schema: str) -> DataFrame:
    """(keys, _result, _state): the results of one piece of a fold, and a row for each key with its
    state afterwards (`_result` is null there). `states` (keys, _state) is what the piece before left."""
    out = _parts(keys, rows, start, schema)
    kinds = to_arrow_schema(out)
    state = out["_state"].dataType
    data = [c for c in rows.columns if c not in keys]
    both = rows.select(*keys, *data, F.lit(None).cast(state).alias("_state"), F.lit(True).alias("_is_row"))
    if states is not None:
        blank = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in data]
        both = both.unionByName(states.select(*keys, *blank, F.col("_state").cast(state).alias("_state"), F.lit(False).alias("_is_row")))

    def batch_of(key: tuple, results: list[tuple], left: tuple | None) -> pa.RecordBatch:
        n = len(results) + (left is not None)
        columns = [pa.array([k] * n, f.type) for k, f in zip(key, kinds, strict=False)]
        none = [None] * (left is not None)
        names = [f.name for f in out["_result"].dataType.fields]
        found = [dict(zip(names, r, strict=True)) for r in results] + none
        held = [None] * len(results) + ([dict(zip([f.name for f in state.fields], left, strict=True))] if left is not None else [])
        columns += [pa.array(found, kinds.field("_result").type), pa.array(_named(held, state), kinds.field("_state").type)]
        return pa.RecordBatch.from_arrays(columns, schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            changed = np.zeros(batch.num_rows, bool)
            for col in cols:
                changed[1:] |= col[1:] != col[:-1]
            edges = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                key = tuple(col[low].item() if hasattr(col[low], "item") else col[low] for col in cols)
                if fold is None or fold.key != key:
                    if fold is not None:
                        yield batch_of(fold.key, [], fold.saved())
                    fold = start(key)
                if not batch.column("_is_row")[low].as_py():
                    fold.restore(_tuples(batch.column("_state")[low].as_py()))
                    low += 1
                if low < high:
                    yield batch_of(key, fold.step(batch.slice(low, high - low)), None)
        if fold is not None:
            yield batch_of(fold.key, [], fold.saved())

    arranged = both.repartition(*keys).sortWithinPartitions(*keys, "_is_row", *order)
    return arranged.mapInArrow(run, out)


def _named(values: list, kind: T.DataType) -> list:
    """Tuples as the dicts that Arrow takes for structs, as deep as the type goes."""
    if isinstance(kind, T.StructType):
        return [
            v if v is None else {f.name: _named([x], f.dataType)[0] for f, x in zip(kind.fields, v.values() if isinstance(v, dict) else v, strict=True)}
            for v in values
        ]
    if isinstance(kind, T.ArrayType):
        return [v if v is None else _named(list(v), kind.elementType) for v in values]
    return values


def left_over(states: DataFrame, keys: Sequence[str], start: Start, schema: str) -> DataFrame:
    """What the folds still hold when nothing more comes."""
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fold = start(tuple(row[k] for k in keys))
                fold.restore(_tuples(row["_state"]))
                rows = fold.finish()
                columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return states.select(*keys, "_state").mapInArrow(run, schema)


class Daily:
    """A fold kept up to date day by day below `root`."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str], start: Start, schema: str):
        self.spark, self.root, self.keys, self.order, self.start, self.schema = spark, root.rstrip("/"), list(keys), list(order), start, schema

    def _runs(self) -> list[str]:
        return [n for n in files.names(self.spark, f"{self.root}/runs") if n.endswith(".json")]

    def folded(self) -> dict[str, list]:
        """Of each day that is folded, a fingerprint of its rows."""
        runs = self._runs()
        return json.loads(files.read_text(self.spark, f"{self.root}/runs/{runs[-1]}")) if runs else {}

    def update(self, rows: DataFrame) -> list[str]:
        """Fold what is new or changed of `rows`, which have a `date`; returns the days that were folded."""
        columns = [c for c in rows.columns if c != "date"]
        prints = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("h"))
        now = {r["date"].isoformat(): [r["n"], r["h"]] for r in prints.collect()}
        was = self.folded()
        days = sorted(now)
        changed = [d for d in sorted({*days, *was}) if now.get(d) != was.get(d)]
        todo = [d for d in days if changed and d >= changed[0]]
        before = [d for d in days if not changed or d < changed[0]]
        states = self._read("states", before[-1]) if before else None
        for day in todo:
            own = rows.filter(F.col("date") == F.lit(day).cast("date")).drop("date")
            piece = f"{self.root}/pieces/date={day}"
            fold_piece(own, states, self.keys, self.order, self.start, self.schema).write.mode("overwrite").parquet(piece)
            done = self.spark.read.parquet(piece)
            done.filter("_result is not null").select("_result.*").write.mode("overwrite").parquet(f"{self.root}/results/date={day}")
            done.filter("_state is not null").select(*self.keys, "_state").write.mode("overwrite").parquet(f"{self.root}/states/date={day}")
            files.delete(self.spark, piece)
            states = self._read("states", day)
        for day in [d for d in was if d not in now]:
            for part in ("results", "states"):
                files.delete(self.spark, f"{self.root}/{part}/date={day}")
        if changed:
            files.write_text(self.spark, f"{self.root}/runs/{len(self._runs()) + 1:010d}.json", json.dumps(now))
        return todo

    def _read(self, part: str, day: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{part}/date={day}")

    def results(self) -> DataFrame:
        """All results, with what the folds still hold."""
        days = sorted(self.folded())
        if not days:
            return self.spark.createDataFrame([], self.schema)
        names = T.StructType.fromDDL(self.schema).names
        done = self.spark.read.schema(self.schema).parquet(*[f"{self.root}/results/date={d}" for d in days])
        return done.select(*names).unionByName(left_over(self._read("states", days[-1]), self.keys, self.start, self.schema))


class DailyNoiseFold(BinNoiseFold, LiveFold):
    STATE = (
        "noise ARRAY<DOUBLE>, held ARRAY<STRUCT<first_bin INT, segment_start BIGINT, frame_id BIGINT, "
        "frame_start BIGINT, f0_hz DOUBLE, bin_hz DOUBLE, power ARRAY<DOUBLE>>>, at BIGINT, tuning ARRAY<DOUBLE>"
    )

    def saved(self) -> tuple:
        noise = None if self.noise is None else self.noise.tolist()
        held = [(*meta, power.tolist()) for meta, power in self.held]
        return noise, held, self.index, None if self.tuning is None else [float(x) for x in self.tuning]

    def restore(self, state: tuple) -> None:
        noise, held, self.index, tuning = state
        self.noise = None if noise is None else np.array(noise)
        self.held = [(tuple(h[:-1]), np.array(h[-1])) for h in held]
        self.tuning = None if tuning is None else tuple(tuning)


def daily_noise(spark: SparkSession, root: str) -> Daily:
    """`bin_noise_floor` day by day, over `noise_rows`."""
    return Daily(spark, root, ["session_id", "bin_block"], ["frame_start"], DailyNoiseFold, BIN_NOISE_SCHEMA)


def noise_rows(frames: DataFrame, block_bins: int = 32) -> DataFrame:
    """Frames, which have a `date`, cut into blocks of bins."""
    return bin_blocks(frames, block_bins, ["date"])


def daily_clusters(spark: SparkSession, root: str, proximity_hz: int = P.PROXIMITY_HZ) -> Daily:
    """`cluster_regions` day by day, over `cluster_rows`; times are in microseconds."""
    return Daily(spark, root, ["session_id"], ["frame_seq", "center_hz"], lambda key: LiveChannelFold(key, proximity_hz), ASSIGNED_SCHEMA)


def cluster_rows(regions: DataFrame) -> DataFrame:
    rows = regions.withColumn("ts_us", F.unix_micros("ts")).withColumn("date", F.to_date("ts"))
    return rows.select("date", "session_id", *_REGION_COLUMNS)
