"""Throttles and triggered captures."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandsift import params as P
from bandsift.operators.acquisition import block_at
from bandsift.operators.ordered import (
    Fold,
    attach,
    columns_of,
    fold_sorted,
    number_chunk,
    with_run_start,
)
from bandsift.runtime import cut_lineage


class ThrottleFold(Fold):
    """Time of the last kept row of one key."""

    def __init__(self, key: tuple, names: Sequence[str], interval_us: int):
        super().__init__(key)
        self.names = names
        self.interval_us = interval_us
        self.last: int | None = None

    def step(self, rows: pa.RecordBatch) -> list[tuple]:
        kept = []
        for row in columns_of(rows, self.names):
            now = row[-2]
            if self.last is None or now - self.last >= self.interval_us:
                self.last = now
                kept.append(row)
        return kept


class PieceFold(Fold):
    """One piece of a run: kept rows where they are known, otherwise where it leads.

    Which row of a piece is kept first depends only on the last row kept before it, and
    can only be one of its rows within the first interval (or the one after). From there
    the rule is fixed, so the piece is a short table: kept before at most `upto` minus the
    interval, last kept `exit`. Chains that meet share an entry. A piece holds its times and ids
    as arrays.
    """

    def __init__(self, key: tuple, interval_us: int, piece_us: int):
        super().__init__(key)
        self.interval_us = interval_us
        self.begin = key[-2] + key[-1] * piece_us
        self.parts: list[pa.RecordBatch] = []

    def step(self, rows: pa.RecordBatch) -> list[tuple]:
        self.parts.append(rows.select(rows.schema.names[-2:]))
        return []

    def finish(self) -> list[tuple]:
        whole = pa.Table.from_batches(self.parts)
        self.parts.clear()
        times = whole.column(0).to_numpy().astype(np.int64)
        n = len(times)
        after = np.searchsorted(times, times + self.interval_us)
        if self.key[-1] == 0:
            kept, at = [], 0
            while at < n:
                kept.append(at)
                at = int(after[at])
            table = ([_ALWAYS], [int(times[kept[-1]])])
            chosen = whole.take(pa.array(kept))
            out = [self.row("kept", *r) for r in zip(chosen.column(0).to_pylist(), chosen.column(1).to_pylist(), strict=True)]
        else:
            entries = min(int(np.searchsorted(times, self.begin + self.interval_us)), n - 1) + 1
            # Follow the chains of all possible entries together, by doubling, to where they end.
            ends, jump = np.arange(n), np.where(after < n, after, np.arange(n))
            while True:
                further = jump[ends[:entries]]
                if (further == ends[:entries]).all():
                    break
                ends[:entries], jump = further, jump[jump]
            first, last = times[:entries], times[ends[:entries]]
            differ = np.append(last[1:] != last[:-1], True)
            table = (first[differ].tolist(), last[differ].tolist())
            out = [self.row("open", *r) for r in zip(whole.column(0).to_pylist(), whole.column(1).to_pylist(), strict=True)]
        return [*out, self.row("map", uptos=table[0], exits=table[1])]

    def row(self, kind, time=None, ident=None, uptos=None, exits=None) -> tuple:
        return (*self.key, kind, time, ident, uptos, exits)


_ALWAYS = (1 << 63) - 1


class EntryFold(Fold):
    """Last kept time before each piece of one run, from the pieces' tables."""

    def __init__(self, key: tuple, interval_us: int):
        super().__init__(key)
        self.interval_us = interval_us
        self.last: int | None = None

    def step(self, rows: pa.RecordBatch) -> list[tuple]:
        out = []
        for piece, uptos, exits in columns_of(rows, ["_piece", "uptos", "exits"]):
            if self.last is None:
                self.last = exits[0]
                continue
            out.append((*self.key, piece, self.last))
            at = bisect_left(uptos, self.last + self.interval_us)
            if at < len(uptos):
                self.last = exits[at]
        return out


class RestFold(ThrottleFold):
    """Greedy pass over one piece whose entry is known."""

    def step(self, rows: pa.RecordBatch) -> list[tuple]:
        if self.last is None:
            self.last = rows.column("_entry")[0].as_py()
        return super().step(rows)


def throttle(
    rows: DataFrame,
    keys: Sequence[str],
    time_us: str,
    id_col: str,
    interval_us: int,
    chunk_us: int | None = None,
) -> DataFrame:
    """Keep a row only when `interval_us` have passed since the last kept one of its key.

    A silence of at least the interval restarts the rule, so each key falls into
    independent runs. A run that is longer than a chunk is cut into pieces as well: each
    piece is summed up as a small table from entry to exit, the tables are followed along
    the run, and then every piece is passed over on its own. No key, however busy, is
    folded in one task. The folds see (time, id) alone. A piece is a thousand intervals long, if
    `chunk_us` doesn't say otherwise, so at most a thousand of its rows are kept.
    """
    chunk_us = chunk_us or max(1, 1000 * interval_us)
    slim = rows.select(*keys, time_us, id_col)
    order = [time_us, id_col]
    runs = with_run_start(
        slim,
        keys,
        order,
        [time_us],
        lambda here, before: before(time_us).isNull()
        | (here(time_us) - before(time_us) >= interval_us),
        number_chunk(time_us, chunk_us),
        time_us,
        "_run",
    )
    pieces = runs.select(
        *keys,
        "_run",
        F.floor((F.col(time_us) - F.col("_run")) / chunk_us).alias("_piece"),
        time_us,
        id_col,
    )
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    ddl = lambda names: ", ".join(f"`{n}` {kinds[n]}" for n in names)
    place = [*keys, "_run", "_piece"]
    summed = cut_lineage(
        fold_sorted(
            pieces,
            place,
            order,
            lambda key: PieceFold(key, interval_us, chunk_us),
            f"{ddl(place)}, kind STRING, {ddl(order)}, uptos ARRAY<BIGINT>, exits ARRAY<BIGINT>",
        )
    )
    entries = fold_sorted(
        summed.filter("kind = 'map'").select(*place, "uptos", "exits"),
        [*keys, "_run"],
        ["_piece"],
        lambda key: EntryFold(key, interval_us),
        f"{ddl(place)}, _entry BIGINT",
    )
    names = [*keys, time_us, id_col]
    rest = fold_sorted(
        attach(
            summed.filter("kind = 'open'").select(*place, *order), entries, place, how="inner"
        ),
        place,
        order,
        lambda key: RestFold(key, names, interval_us),
        ddl(names),
    )
    kept = summed.filter("kind = 'kept'").select(*names).unionByName(rest)
    return attach(rows, kept, names, how="left_semi")


class CaptureFold(Fold):
    """Pending capture of one gap-free segment."""

    def __init__(self, key: tuple, pre_s: float, post_s: float, max_s: float):
        super().__init__(key)
        self.pre, self.post, self.most = (
            max(1, int(key[2] * seconds)) for seconds in (pre_s, post_s, max_s)
        )
        self.pending: dict | None = None

    def step(self, rows: pa.RecordBatch) -> list[tuple]:
        done = []
        for start, end, trigger in columns_of(rows, ["block_start", "block_end", "trigger_id"]):
            if self.pending is not None and start >= self.pending["deadline"]:
                done += self.finish()
            if self.pending is None:
                first = max(self.key[1], end - self.pre)
                self.pending = {
                    "start": first,
                    "deadline": end + self.post,
                    "max_end": first + self.most,
                    "triggers": [trigger],
                }
            else:
                self.pending["deadline"] = min(self.pending["max_end"], end + self.post)
                self.pending["triggers"].append(trigger)
        return done

    def finish(self) -> list[tuple]:
        if self.pending is None:
            return []
        p, self.pending = self.pending, None
        return [(*self.key[:3], p["start"], p["deadline"], p["max_end"], p["triggers"])]


def capture_windows(
    triggers: DataFrame,
    pre_s: float = P.PRE_TRIGGER_S,
    post_s: float = P.POST_TRIGGER_S,
    max_s: float = P.MAX_CAPTURE_S,
    chunk_samples: int = 1 << 33,
) -> DataFrame:
    """Coalesce triggers into capture windows.

    `triggers` has session_id, segment_start, sample_rate, trigger_id and the bounds
    (block_start, block_end) of the block in which each trigger fired. A trigger joins
    the pending capture unless an earlier block already passed its deadline. Triggers
    further apart than the longest possible wait start anew, so they are cut there.
    """
    schema = (
        "session_id BIGINT, segment_start BIGINT, sample_rate INT, capture_start BIGINT, "
        "deadline BIGINT, max_end BIGINT, triggers ARRAY<BIGINT>"
    )
    keys = ["session_id", "segment_start"]
    order = ["block_end", "trigger_id"]
    chunk = number_chunk("block_end", chunk_samples)
    wait = max(max_s, post_s)
    runs = with_run_start(
        triggers,
        keys,
        order,
        ["block_start", "block_end", "sample_rate"],
        lambda here, before: before("block_end").isNull()
        | (here("block_start") - before("block_end") > here("sample_rate") * F.lit(wait)),
        chunk,
        "block_end",
        "_run",
    )
    return fold_sorted(
        runs,
        ["session_id", "segment_start", "sample_rate", "_run"],
        order,
        lambda key: CaptureFold(key, pre_s, post_s, max_s),
        schema,
    )


def finished_captures(
    windows: DataFrame, gaps: DataFrame, bucket_samples: int = 1 << 20
) -> DataFrame:
    """Add `capture_end`: the end of the first block that reaches the deadline, cut at the
    longest length. Null where the segment ended first, which aborts the capture.

    `gaps` is block metadata with segment_start. `windows` is read twice.
    """
    key = ["session_id", "segment_start", "capture_start"]
    ends = block_at(
        windows.select(*key, "deadline"), gaps, "deadline", bucket_samples
    ).select(*key, "end_sample")
    return (
        attach(windows, ends, key)
        .withColumn(
            "capture_end",
            F.when(F.col("end_sample").isNotNull(), F.least("end_sample", "max_end")),
        )
        .drop("end_sample")
    )


def trigger_capture_join(
    captures: DataFrame, blocks: DataFrame, bucket_samples: int = 1 << 20
) -> DataFrame:
    """Attach IQ to finished captures: overlap join on sample buckets, slice, put together.

    `blocks` carry segment_start. A capture has a longest length, so its group is bounded.
    """
    wanted = captures.filter("capture_end is not null").withColumn(
        "_bucket",
        F.explode(
            F.sequence(
                F.floor(F.col("capture_start") / bucket_samples),
                F.floor((F.col("capture_end") - 1) / bucket_samples),
            )
        ),
    )
    sized = blocks.select(
        "session_id",
        "segment_start",
        "center_hz",
        F.col("start_sample").alias("_from"),
        (F.col("start_sample") + F.size("iq") / 2).cast("bigint").alias("_to"),
        "iq",
    ).filter(F.col("_to") > F.col("_from"))
    spread = sized.withColumn(
        "_bucket",
        F.explode(
            F.sequence(
                F.floor(F.col("_from") / bucket_samples),
                F.floor((F.col("_to") - 1) / bucket_samples),
            )
        ),
    )
    pairs = attach(wanted, spread, ["session_id", "segment_start", "_bucket"], how="inner")
    low = F.greatest("capture_start", "_from", F.col("_bucket") * bucket_samples)
    high = F.least("capture_end", "_to", (F.col("_bucket") + 1) * bucket_samples)
    parts = (
        pairs.withColumn("_low", low)
        .withColumn("_high", high)
        .filter(F.col("_low") < F.col("_high"))
        .withColumn(
            "_part",
            F.struct(
                "_low",
                F.slice(
                    "iq",
                    ((F.col("_low") - F.col("_from")) * 2 + 1).cast("int"),
                    ((F.col("_high") - F.col("_low")) * 2).cast("int"),
                ).alias("iq"),
            ),
        )
    )
    keys = ["session_id", "segment_start", "capture_start", "capture_end", "sample_rate"]
    return (
        parts.groupBy(*keys)
        .agg(
            F.max("center_hz").alias("center_hz"),
            F.first("triggers").alias("triggers"),
            F.sort_array(F.collect_list("_part")).alias("_parts"),
        )
        .select(
            *keys,
            "center_hz",
            "triggers",
            F.flatten(F.transform("_parts", lambda p: p["iq"])).alias("iq"),
        )
    )


def capture_stats(
    captures: DataFrame, gaps: DataFrame, pre_s: float = P.PRE_TRIGGER_S
) -> DataFrame:
    """State of the capture of every session: completed, aborted and pending captures, what they hold,
    and the seconds that are buffered for the next one.

    `gaps` is block metadata with segment_start. A capture without an end is pending if its segment
    is the session's last, else a gap has aborted it.
    """
    last = gaps.groupBy("session_id").agg(
        F.max_by(F.struct("segment_start", "sample_rate", "end_sample"), "end_sample").alias("_l")
    )
    open_ = F.col("capture_start").isNotNull() & F.col("capture_end").isNull()
    pending = open_ & (F.col("segment_start") == F.col("_l.segment_start"))
    seconds = (F.col("capture_end") - F.col("capture_start")) / F.col("sample_rate")
    zero = F.lit(0).cast("bigint")
    found = (
        last.join(captures, "session_id", "left")
        .groupBy("session_id", "_l")
        .agg(
            F.count("capture_end").alias("captures_completed"),
            F.count_if(open_ & ~pending).alias("captures_aborted_discontinuity"),
            F.coalesce(F.sum(F.size("triggers")), zero).alias("triggers"),
            F.coalesce(F.round(F.sum(seconds), 3), F.lit(0.0)).alias("captured_seconds"),
            (F.count_if(pending) > 0).alias("capture_pending"),
            F.coalesce(F.sum(F.when(pending, F.size("triggers"))), zero).alias("pending_triggers"),
        )
    )
    rate = F.col("_l.sample_rate")
    held = F.least(
        F.col("_l.end_sample") - F.col("_l.segment_start"),
        F.greatest(F.lit(1).cast("bigint"), F.floor(rate * F.lit(pre_s)).cast("bigint")),
    )
    return found.withColumn("buffered_seconds", F.round(held / rate, 6)).drop("_l")


def recent_iq(
    blocks: DataFrame, duration_ms: int, history_s: float = P.PRE_TRIGGER_S
) -> DataFrame:
    """Newest `duration_ms` of contiguous IQ per session; no row where there is not enough.

    Only the blocks of the wanted interval are touched. `blocks` carry segment_start.
    """
    meta = blocks.select(
        "session_id",
        "segment_start",
        "sample_rate",
        (F.col("start_sample") + F.size("iq") / 2).cast("bigint").alias("_to"),
    )
    last = (
        meta.groupBy("session_id")
        .agg(
            F.max_by(F.struct("segment_start", "sample_rate", "_to"), F.col("_to")).alias("l")
        )
        .select("session_id", "l.*")
    )
    wanted = F.greatest(
        F.floor(F.col("sample_rate") * (duration_ms / 1000.0)), F.lit(1).cast("bigint")
    )
    held = F.least(
        F.col("_to") - F.col("segment_start"), F.floor(F.col("sample_rate") * history_s)
    )
    windows = (
        last.withColumn("_wanted", wanted)
        .filter(held >= F.col("_wanted"))
        .select(
            "session_id",
            "segment_start",
            "sample_rate",
            (F.col("_to") - F.col("_wanted")).alias("capture_start"),
            F.col("_to").alias("capture_end"),
            F.expr("cast(array() as array<bigint>)").alias("triggers"),
        )
    )
    return trigger_capture_join(windows, blocks).drop("triggers")

