"""An event-time ordered buffer in front of a fold: live results do not depend on how rows arrive.

Rows travel packed, one row for all that a batch holds of a key, and wait in the state store. When the
watermark has passed a time slot, a timer hands its rows to the fold in order; so a micro-batch may hold any rows in
any order, as long as they come before the watermark passes them. A row that comes after a later one
of its key has been folded is late: it is not folded but put out on its own side, with its time, and
counted in the state. A closing mark, which a source sends when a key is over, releases all that waits
and finishes the fold; so the end of an input needs no further rows.

Time must not decrease along the order in which a fold takes its rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from bandsift.operators.ordered import Fold

#: How long rows wait for earlier ones, and the width of a slot.
LATENESS, SLOT_US = "10 seconds", 1_000_000

#: Event time of a late row; null on results.
LATE = "late_us"

_TIME, _ROWS, _CLOSING = "_time_us", "_rows", "_closing"

#: Waiting rows that lie beside a fold's state, rows of a part, and rows that are handled at a time.
FEW, PART, MANY = 64, 4_000, 32_000


class LiveFold(Fold):
    """A fold whose state can be kept between micro-batches.

    STATE declares it; `saved` gives it and `restore` takes it back, as plain values.
    """

    STATE = ""

    def saved(self) -> tuple:
        raise NotImplementedError

    def restore(self, state: tuple) -> None:
        raise NotImplementedError

    def due(self) -> int | None:
        """When, in event time (us), something happens unless a row comes first."""
        return None

    def advance(self, now_us: int) -> list[tuple]:
        """Time has passed without rows up to `now_us`."""
        return []


def plain(value):
    """Rows and nested rows as tuples and lists."""
    if isinstance(value, Row):
        return tuple(plain(v) for v in value)
    if isinstance(value, list | tuple):
        return type(value)(plain(v) for v in value)
    return value


def _sent(rows: list[tuple]) -> bytes:
    return pickle.dumps(rows, pickle.HIGHEST_PROTOCOL)


class OrderedProcessor(StatefulProcessor):
    """Holds rows back until the watermark, then runs a `LiveFold` over them in order.

    A key has one timer, for the first thing that waits; it releases all that the watermark has passed.
    A few waiting rows lie beside the fold's state. More are put away as parts, runs of neighbouring
    slots, which are read again when their first slot is due; so neither a micro-batch nor all that
    waits is ever held as a whole.
    """

    def __init__(self, start: Callable[[tuple], LiveFold], keys: Sequence[str], order: Sequence[str], rows: T.StructType, out: T.StructType, slot_us: int):
        self.start, self.keys, self.order, self.slot_us = start, list(keys), list(order), slot_us
        self.rows, self.out = rows, [f.name for f in out.fields]
        self.kinds = to_arrow_schema(rows)
        self.at = [rows.names.index(c) for c in order]
        # Types are parsed here, on the driver; workers have no session.
        own = T.StructType.fromDDL(start(tuple([0] * len(keys))).STATE)
        seen = T.StructType([rows[c] for c in order])
        # `waiting`: the few rows, the first slot and number of each part, and the next number.
        self.held = T.StructType(
            [T.StructField("seen", seen), T.StructField("late", T.LongType()), T.StructField("timer", T.LongType()), T.StructField("waiting", T.BinaryType()), T.StructField("fold", own)]
        )

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "number BIGINT", "rows BINARY")
        self.state = handle.getValueState("fold", self.held)

    def load(self, key: tuple) -> tuple[LiveFold, dict]:
        fold, held = self.start(key), {"seen": None, "late": 0, "timer": None, "few": [], "parts": [], "next": 0}
        state = self.state.get()
        if state is not None:
            held["seen"], held["late"], held["timer"], waiting, own = plain(state)
            held["few"], held["parts"], held["next"] = pickle.loads(waiting)
            fold.restore(own)
        return fold, held

    def save(self, fold: LiveFold, held: dict) -> None:
        if len(held["few"]) > FEW:
            self.put_away(held)
        slots = [r[-1] // self.slot_us for r in held["few"]] + [slot for slot, _ in held["parts"]]
        due = fold.due()
        if due is not None:
            slots.append(due // self.slot_us)
        timer = (min(slots) + 1) * self.slot_us // 1000 if slots else None
        if timer != held["timer"]:
            if held["timer"] is not None:
                self.handle.deleteTimer(held["timer"])
            if timer is not None:
                self.handle.registerTimer(timer)
        held["timer"] = timer
        self.state.update((held["seen"], held["late"], timer, _sent((held["few"], held["parts"], held["next"])), fold.saved()))

    def put_away(self, held: dict) -> None:
        rows = sorted(held["few"], key=lambda r: r[-1])
        for low in range(0, len(rows), PART):
            part = rows[low : low + PART]
            self.parts.updateValue((held["next"],), (_sent(part),))
            held["parts"].append((part[0][-1] // self.slot_us, held["next"]))
            held["next"] += 1
        held["few"] = []

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        key = tuple(key)
        fold, held = self.load(key)
        closing = None
        for row in rows:
            at = row[_CLOSING]
            if at is not None:
                closing = at if closing is None else max(closing, at)
            else:
                held["few"] += pickle.loads(row[_ROWS])
                if len(held["few"]) > MANY:
                    self.put_away(held)
        if closing is not None:
            yield from self.release(key, fold, held, closing // self.slot_us + 1)
            yield from self.results([*fold.advance(closing), *fold.finish()])
        self.save(fold, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        key, now = tuple(key), timerValues.getCurrentWatermarkInMs() * 1000
        fold, held = self.load(key)
        if held["timer"] == expiredTimerInfo.getExpiryTimeInMs():
            held["timer"] = None  # Spark deletes it
        yield from self.release(key, fold, held, now // self.slot_us)
        yield from self.results(fold.advance(now // self.slot_us * self.slot_us))
        self.save(fold, held)

    def release(self, key: tuple, fold: LiveFold, held: dict, until: int) -> Iterator[Row]:
        """Hand the rows of the slots before `until` to the fold, those that come too late aside."""
        rows = held["few"]
        parts = sorted(p for p in held["parts"] if p[0] < until)
        held["parts"] = [p for p in held["parts"] if p[0] >= until]
        for i, (_, number) in enumerate(parts):
            rows = rows + pickle.loads(self.parts.getValue((number,))[0])
            self.parts.removeKey((number,))
            if len(rows) > MANY and i + 1 < len(parts):
                # What lies before the next part is all here.
                first = parts[i + 1][0] * self.slot_us
                ready = [r for r in rows if r[-1] < first]
                if len(ready) > PART:
                    rows = [r for r in rows if r[-1] >= first]
                    yield from self.results(self.fold_rows(key, fold, held, ready))
        ready = [r for r in rows if r[-1] < until * self.slot_us]
        held["few"] = [r for r in rows if r[-1] >= until * self.slot_us]
        if ready:
            yield from self.results(self.fold_rows(key, fold, held, ready))

    def fold_rows(self, key: tuple, fold: LiveFold, held: dict, rows: list[tuple]) -> list[tuple]:
        """Rows of whole slots, with none before them still waiting."""
        rows = sorted(rows, key=lambda r: (r[-1] // self.slot_us, *(r[i] for i in self.at)))
        out = []
        # Rows are in order within a slot; between slots only late ones lie behind what was folded.
        last, kept, late = held["seen"], [], []
        slot, limit = None, last
        for r in rows:
            if r[-1] // self.slot_us != slot:
                slot, limit = r[-1] // self.slot_us, last
            place = tuple(r[i] for i in self.at)
            if limit is not None and place <= limit:
                late.append(r)
            else:
                kept.append(r)
                last = place
        held["seen"] = last
        held["late"] += len(late)
        for low in range(0, len(kept), MANY):
            columns = list(zip(*kept[low : low + MANY], strict=True))[:-1]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, self.kinds, strict=True)]
            out += [(*r, None) for r in fold.step(pa.RecordBatch.from_arrays(arrays, schema=self.kinds))]
        # Of a late row the columns that a result has as well, and its time.
        for r in late:
            own = dict(zip(self.keys, key, strict=True)) | dict(zip(self.rows.names, r, strict=False)) | {LATE: r[-1]}
            out.append(tuple(own.get(c) if c in (*self.keys, *self.order, LATE) else None for c in self.out))
        return out

    def results(self, rows: list[tuple]) -> Iterator[Row]:
        width = len(self.out)
        for low in range(0, len(rows), MANY):
            yield Row(**{_ROWS: _sent([r if len(r) == width else (*r, None) for r in rows[low : low + MANY]])})

    def close(self) -> None:
        pass


def _packed(batches: Iterator[pa.RecordBatch], keys: list[str], carried: list[str]) -> Iterator[pa.RecordBatch]:
    """One row for all rows of a key in a batch, and one for each closing mark."""
    for batch in batches:
        held: dict[tuple, list[tuple]] = {}
        marks = []
        of = lambda names: zip(*(batch.column(c).to_pylist() for c in names), strict=True)
        for key, row, closes in zip(of(keys), of([*carried, _TIME]), batch.column(_CLOSING).to_pylist(), strict=True):
            if closes:
                marks.append((key, row[-1]))
            else:
                held.setdefault(key, []).append(row)
        own = [*((k, max(r[-1] for r in rows), _sent(rows), None) for k, rows in held.items()), *((k, at, None, at) for k, at in marks)]
        named = list(zip(*(o[0] for o in own), strict=True)) or [()] * len(keys)
        cols = [pa.array(c, batch.schema.field(k).type) for k, c in zip(keys, named, strict=True)]
        cols += [pa.array([o[i] for o in own], t) for i, t in ((1, pa.int64()), (2, pa.binary()), (3, pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=[*keys, _TIME, _ROWS, _CLOSING])


def _unpacked(batches: Iterator[pa.RecordBatch], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, FEW):
            rows = [r for x in batch.column(0).slice(low, FEW).to_pylist() for r in pickle.loads(x)]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)


def in_order(
    stream: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    time: Column,
    start: Callable[[tuple], LiveFold],
    schema: str,
    closing: DataFrame | None = None,
    lateness: str = LATENESS,
    slot_us: int = SLOT_US,
) -> DataFrame:
    """Fold each key's rows in order of event time; results, and late rows beside them.

    `time` is the event time of a row; `closing` has the keys and `ts`, the time at which a key is
    over. Columns are those of `schema` and `late_us`, which is null on results.
    """
    kinds = stream.schema
    rows = stream.select("*", time.cast("timestamp").alias("_ts"), F.lit(False).alias(_CLOSING))
    if closing is not None:
        blank = [F.col(f.name) if f.name in keys else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields]
        rows = rows.unionByName(closing.select(*blank, F.col("ts").cast("timestamp").alias("_ts"), F.lit(True).alias(_CLOSING)))
    rows = rows.withColumn(_TIME, F.unix_micros("_ts")).drop("_ts")
    out = T.StructType([*(T.StructField(f.name, f.dataType) for f in T.StructType.fromDDL(schema).fields), T.StructField(LATE, T.LongType())])
    carried = T.StructType([T.StructField(f.name, f.dataType) for f in kinds.fields if f.name not in keys])
    named = T.StructType([kinds[k] for k in keys]).add(_TIME, "long").add(_ROWS, "binary").add(_CLOSING, "long")
    packed = rows.mapInArrow(partial(_packed, keys=list(keys), carried=carried.names), named)
    # The processor gets no time column, so that Spark drops no row by its watermark.
    timed = packed.withColumn("_ts", F.timestamp_micros(_TIME)).withWatermark("_ts", lateness).drop("_ts", _TIME)
    found = timed.groupBy(*keys).transformWithState(
        OrderedProcessor(start, keys, order, carried, out, slot_us), outputStructType=T.StructType().add(_ROWS, "binary"), outputMode="append", timeMode="eventTime"
    )
    return found.mapInArrow(partial(_unpacked, kinds=to_arrow_schema(out)), out)


def on_time(results: DataFrame) -> DataFrame:
    """Results without the late rows beside them."""
    return results.filter(F.col(LATE).isNull()).drop(LATE)


def late_rows(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys and time of the rows that came too late to be folded."""
    return results.filter(F.col(LATE).isNotNull()).select(*keys, F.timestamp_micros(LATE).alias("ts"))


def write_sides(results: DataFrame, keys: Sequence[str], root: str, checkpoint: str):
    """A writer that puts results and late rows into two folders, once a batch however often it runs."""

    def write(df: DataFrame, batch: int) -> None:
        both = df.persist()
        on_time(both).write.mode("overwrite").parquet(f"{root}/results/batch={batch}")
        late_rows(both, keys).write.mode("overwrite").parquet(f"{root}/late/batch={batch}")
        both.unpersist()

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
