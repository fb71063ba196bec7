"""Sequential operators as keyed state: the same folds as in batch, kept between batches.

All of them stand behind the ordered buffer: results equal those of the batch form whatever way rows
are cut into micro-batches, and rows that come too late are put out beside them (`late_us`).
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandsift import params as P
from bandsift.functions.arrays import frame_floor_of
from bandsift.operators.capture import ThrottleFold
from bandsift.operators.cluster import (
    _REGION_COLUMNS,
    ASSIGNED_SCHEMA,
    ChannelFold,
)
from bandsift.operators.noise import check_alpha
from bandsift.operators.ordered import columns_of
from bandsift.operators.tracks import _TRACKED_COLUMNS, TRACK_SCHEMA, RunningMedian, TrackFold
from bandsift.streaming.buffer import LATENESS, LiveFold, in_order


def sample_time(position: str = "start_sample", rate: Column | None = None) -> Column:
    """Event time by position: seconds of samples since the start of the session."""
    rate = F.col("sample_rate") if rate is None else rate
    return F.timestamp_micros((F.col(position) / rate * 1e6).cast("bigint"))


class EmaFold(LiveFold):
    """Smoothed floor of one session."""

    STATE = "floor DOUBLE"

    def __init__(self, key: tuple, alpha: float):
        super().__init__(key)
        self.alpha = alpha
        self.floor: float | None = None

    def saved(self) -> tuple:
        return (self.floor,)

    def restore(self, state: tuple) -> None:
        (self.floor,) = state

    def step(self, rows: pa.RecordBatch) -> list[tuple]:
        out = []
        for seq, x in columns_of(rows, ["frame_seq", "x"]):
            self.floor = (
                x if self.floor is None else (1.0 - self.alpha) * self.floor + self.alpha * x
            )
            out.append((self.key[0], seq, self.floor))
        return out


def live_ema(
    frames: DataFrame,
    alpha: float = P.FLOOR_ALPHA,
    closing: DataFrame | None = None,
    lateness: str = LATENESS,
) -> DataFrame:
    """Streaming `ema_floor`; `ts` is the event time."""
    alpha = check_alpha(alpha)
    floors = frames.select(
        "session_id", "frame_seq", "ts", frame_floor_of(F.col("power_db")).alias("x")
    )
    return in_order(
        floors,
        ["session_id"],
        ["frame_seq"],
        F.col("ts"),
        lambda key: EmaFold(key, alpha),
        "session_id BIGINT, frame_seq BIGINT, floor_db DOUBLE",
        closing,
        lateness,
    )


class LiveChannelFold(ChannelFold, LiveFold):
    """Channels as rows of the state."""

    STATE = (
        "channels ARRAY<STRUCT<born_seq BIGINT, born_hz BIGINT, first_us BIGINT, center BIGINT, "
        "width BIGINT, current DOUBLE, peak DOUBLE, avg DOUBLE, snr DOUBLE, n BIGINT>>"
    )

    def saved(self) -> tuple:
        return ([(*s[self.BORN], *s[self.FIRST :]) for s in self.channels],)

    def restore(self, state: tuple) -> None:
        self.channels = [[(seq, hz), *rest] for seq, hz, *rest in state[0]]


def live_clusters(
    regions: DataFrame,
    proximity_hz: int = P.PROXIMITY_HZ,
    closing: DataFrame | None = None,
    lateness: str = LATENESS,
) -> DataFrame:
    """Streaming `cluster_regions`: each region with its channel's state after it."""
    slim = regions.withColumn("ts_us", F.unix_micros("ts")).select(
        "session_id", *_REGION_COLUMNS
    )
    out = in_order(
        slim,
        ["session_id"],
        ["frame_seq", "center_hz"],
        F.timestamp_micros("ts_us"),
        lambda key: LiveChannelFold(key, proximity_hz),
        ASSIGNED_SCHEMA,
        closing,
        lateness,
    )
    return (
        out.withColumn("ts", F.timestamp_micros("ts_us"))
        .withColumn("first_ts", F.timestamp_micros("first_us"))
        .drop("ts_us", "first_us")
    )


class LiveTrackFold(TrackFold, LiveFold):
    """As in batch, but the frame at hand may go on with the next rows."""

    TRACK = (
        "start_frame", "start_sample", "first_hz", "peak_db", "peak_snr_db", "above_frames", "centers",
        "widths", "center_hz", "last_frame", "last_frame_start",
    )
    STATE = (
        "tracks ARRAY<STRUCT<start_frame BIGINT, start_sample BIGINT, first_hz DOUBLE, peak_db DOUBLE, "
        "peak_snr_db DOUBLE, above_frames BIGINT, centers ARRAY<DOUBLE>, widths ARRAY<DOUBLE>, "
        "center_hz DOUBLE, last_frame BIGINT, last_frame_start BIGINT>>, "
        "frame STRUCT<id BIGINT, start BIGINT>, "
        "pending ARRAY<STRUCT<center DOUBLE, peak DOUBLE, snr DOUBLE, width DOUBLE>>"
    )

    def saved(self) -> tuple:
        whole = [{**t, "centers": list(t["centers"]), "widths": list(t["widths"])} for t in self.tracks]
        return [tuple(t[c] for c in self.TRACK) for t in whole], self.frame, self.pending

    def restore(self, state: tuple) -> None:
        tracks, self.frame, self.pending = state
        self.tracks = [dict(zip(self.TRACK, t, strict=True)) for t in tracks]
        for track in self.tracks:
            track |= {c: RunningMedian(track[c]) for c in ("centers", "widths")}

    def finish(self) -> list[tuple]:
        out = super().finish()
        self.tracks, self.frame = [], None
        return out


def live_tracks(
    regions: DataFrame,
    association_hz: int = P.ASSOCIATION_HZ,
    holdoff: int = P.HOLDOFF_FRAMES,
    sample_rate: int = 2_400_000,
    closing: DataFrame | None = None,
    lateness: str = LATENESS,
) -> DataFrame:
    """Streaming `track_regions`. A track is emitted once a later frame shows that it has
    closed, or when its segment is over."""
    return in_order(
        regions.select("session_id", "segment_start", *_TRACKED_COLUMNS),
        ["session_id", "segment_start"],
        ["frame_id", "center_hz"],
        sample_time("frame_start", F.lit(sample_rate)),
        lambda key: LiveTrackFold(key, association_hz, holdoff),
        TRACK_SCHEMA,
        closing,
        lateness,
    )


class LiveThrottleFold(ThrottleFold, LiveFold):
    STATE = "last BIGINT"

    def saved(self) -> tuple:
        return (self.last,)

    def restore(self, state: tuple) -> None:
        (self.last,) = state

    def step(self, rows: pa.RecordBatch) -> list[tuple]:
        return [(*self.key, *row) for row in super().step(rows)]


def live_throttle(
    rows: DataFrame,
    keys: Sequence[str],
    time_us: str,
    id_col: str,
    interval_us: int,
    closing: DataFrame | None = None,
    lateness: str = LATENESS,
) -> DataFrame:
    """Streaming `throttle`: keys, time and id of the kept rows."""
    slim = rows.select(*keys, time_us, id_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)
    return in_order(
        slim,
        keys,
        [time_us, id_col],
        F.timestamp_micros(time_us),
        lambda key: LiveThrottleFold(key, [time_us, id_col], interval_us),
        schema,
        closing,
        lateness,
    )


class GapFold(LiveFold):
    """End of the last block and start of the gap-free segment of one session."""

    STATE = "end BIGINT, segment BIGINT"

    def __init__(self, key: tuple):
        super().__init__(key)
        self.end: int | None = None
        self.segment: int | None = None

    def saved(self) -> tuple:
        return self.end, self.segment

    def restore(self, state: tuple) -> None:
        self.end, self.segment = state

    def step(self, rows: pa.RecordBatch) -> list[tuple]:
        out = []
        for start, end, rate in columns_of(rows, ["start_sample", "end_sample", "sample_rate"]):
            gap = self.end is not None and start != self.end
            missing = max(0, start - self.end) if gap else 0
            if self.end is None or gap:
                self.segment = start
            self.end = end
            out.append((self.key[0], start, end, rate, self.segment, gap, missing))
        return out


def live_gaps(
    meta: DataFrame, closing: DataFrame | None = None, lateness: str = LATENESS
) -> DataFrame:
    """Streaming `gap_detect` over block metadata."""
    return in_order(
        meta.select("session_id", "start_sample", "end_sample", "sample_rate"),
        ["session_id"],
        ["start_sample"],
        sample_time(),
        GapFold,
        "session_id BIGINT, start_sample BIGINT, end_sample BIGINT, sample_rate INT, "
        "segment_start BIGINT, is_gap BOOLEAN, missing_samples BIGINT",
        closing,
        lateness,
    )


#: What a block of samples does to the capture at hand; `finished`, `aborted` and `ended` close it.
CAPTURE_SCHEMA = (
    "session_id BIGINT, segment_start BIGINT, sample_rate INT, capture_start BIGINT, "
    "deadline BIGINT, max_end BIGINT, triggers ARRAY<BIGINT>, capture_end BIGINT, kind STRING, "
    "at_sample BIGINT, pending_triggers INT, captures_completed BIGINT, captures_aborted BIGINT, "
    "buffered_samples BIGINT"
)


class LiveCaptureFold(LiveFold):
    """The capture state of one session: what is buffered, what is pending, what has ended.

    Blocks carry the ids of the triggers that fired in them. A trigger opens a capture that reaches
    back `pre_s` within the segment, or moves the deadline of the pending one, at most to `max_s`. The
    first block that reaches the deadline finishes it; a gap or a retune aborts it. With `every`, a block that
    changes nothing reports the state as well.
    """

    STATE = (
        "pending STRUCT<segment BIGINT, rate INT, start BIGINT, deadline BIGINT, max_end BIGINT, triggers ARRAY<BIGINT>>, "
        "segment BIGINT, end BIGINT, center BIGINT, rate INT, completed BIGINT, aborted BIGINT"
    )
    PENDING = ("segment", "rate", "start", "deadline", "max_end", "triggers")

    def __init__(self, key: tuple, pre_s: float, post_s: float, max_s: float, every: bool = False):
        super().__init__(key)
        self.seconds = (pre_s, post_s, max_s)
        self.every = every
        self.pending: dict | None = None
        self.segment = self.end = self.center = self.rate = None
        self.completed = self.aborted = 0

    def saved(self) -> tuple:
        pending = self.pending and tuple(self.pending[c] for c in self.PENDING)
        return pending, self.segment, self.end, self.center, self.rate, self.completed, self.aborted

    def restore(self, state: tuple) -> None:
        pending, self.segment, self.end, self.center, self.rate, self.completed, self.aborted = state
        self.pending = pending and dict(zip(self.PENDING, pending, strict=True))

    def samples(self, rate: int) -> tuple[int, ...]:
        return tuple(max(1, int(rate * s)) for s in self.seconds)

    def step(self, rows: pa.RecordBatch) -> list[tuple]:
        out = []
        names = ["start_sample", "end_sample", "center_hz", "sample_rate", "triggers"]
        for start, end, center, rate, triggers in columns_of(rows, names):
            if (start, center, rate) != (self.end, self.center, self.rate):
                if self.pending:
                    out.append(self.closed("aborted", None))
                self.segment = start
            self.end, self.center, self.rate = end, center, rate
            pre, post, most = self.samples(rate)
            for trigger in triggers or []:
                if self.pending is None:
                    first = max(self.segment, end - pre)
                    found = (self.segment, rate, first, end + post, first + most, [])
                    self.pending = dict(zip(self.PENDING, found, strict=True))
                else:
                    self.pending["deadline"] = min(self.pending["max_end"], end + post)
                self.pending["triggers"].append(trigger)
            if self.pending and end >= self.pending["deadline"]:
                out.append(self.closed("finished", min(end, self.pending["max_end"])))
            elif self.every:
                out.append(self.report("block"))
        return out

    def finish(self) -> list[tuple]:
        """The session is over: what is still pending will never reach its deadline."""
        return [self.closed("ended", None)] if self.pending else []

    def closed(self, kind: str, end: int | None) -> tuple:
        p, self.pending = self.pending, None
        self.completed += kind == "finished"
        self.aborted += kind == "aborted"
        own = (p["segment"], p["rate"], p["start"], p["deadline"], p["max_end"], p["triggers"], end)
        return (self.key[0], *own, kind, *self.state())

    def report(self, kind: str) -> tuple:
        return (self.key[0], self.segment, self.rate, None, None, None, None, None, kind, *self.state())

    def state(self) -> tuple:
        pending = len(self.pending["triggers"]) if self.pending else 0
        buffered = min(self.end - self.segment, self.samples(self.rate)[0])
        return self.end, pending, self.completed, self.aborted, buffered


def live_captures(
    blocks: DataFrame,
    pre_s: float = P.PRE_TRIGGER_S,
    post_s: float = P.POST_TRIGGER_S,
    max_s: float = P.MAX_CAPTURE_S,
    every: bool = False,
    closing: DataFrame | None = None,
    lateness: str = LATENESS,
) -> DataFrame:
    """Streaming capture windows: finished ones, and aborted ones with a null end.

    `blocks` is block metadata with the ids of the triggers that fired in each block; gaps are found
    from the positions. Samples are joined to finished windows from the stored blocks, so state holds
    positions only.
    """
    return in_order(
        blocks.select(
            "session_id", "start_sample", "end_sample", "center_hz", "sample_rate", "triggers"
        ),
        ["session_id"],
        ["start_sample"],
        sample_time(),
        lambda key: LiveCaptureFold(key, pre_s, post_s, max_s, every),
        CAPTURE_SCHEMA,
        closing,
        lateness,
    )


class AcquisitionFold(LiveFold):
    """Counters of one source: blocks, samples, losses, retunes, late blocks."""

    COUNTERS = (
        "blocks_acquired", "samples_acquired", "sample_cursor", "dropped_runs", "dropped_samples",
        "retunes", "timing_gaps", "estimated_gap_samples",
    )
    STATE = "end BIGINT, center BIGINT, rate INT, captured DOUBLE, n BIGINT, counted ARRAY<BIGINT>"
    SCHEMA = "session_id BIGINT, " + ", ".join(f"{c} BIGINT" for c in COUNTERS)

    def __init__(self, key: tuple):
        super().__init__(key)
        self.end = self.center = self.rate = self.captured = self.n = None
        self.counted = dict.fromkeys(self.COUNTERS, 0)

    def saved(self) -> tuple:
        return self.end, self.center, self.rate, self.captured, self.n, list(self.counted.values())

    def restore(self, state: tuple) -> None:
        self.end, self.center, self.rate, self.captured, self.n, counted = state
        self.counted = dict(zip(self.COUNTERS, counted, strict=True))

    def step(self, rows: pa.RecordBatch) -> list[tuple]:
        out, own = [], self.counted
        names = ["start_sample", "end_sample", "center_hz", "sample_rate", "captured_at"]
        for start, end, center, rate, captured in columns_of(rows, names):
            own["blocks_acquired"] += 1
            own["samples_acquired"] += end - start
            own["sample_cursor"] = max(own["sample_cursor"], end)
            if self.end is not None:
                own["dropped_runs"] += start != self.end
                own["dropped_samples"] += max(0, start - self.end)
                own["retunes"] += (center, rate) != (self.center, self.rate)
                expected = self.n / rate
                excess = captured - self.captured - expected
                if self.n > 0 and excess > max(0.005, expected * 0.5):
                    own["timing_gaps"] += 1
                    own["estimated_gap_samples"] += max(0, round(excess * rate))
            self.end, self.center, self.rate, self.captured, self.n = end, center, rate, captured, end - start
            out.append((self.key[0], *own.values()))
        return out


def live_acquisition(
    meta: DataFrame,
    time: Column | None = None,
    closing: DataFrame | None = None,
    lateness: str = LATENESS,
) -> DataFrame:
    """Streaming `acquisition_stats`: the counters of each source after each of its blocks."""
    return in_order(
        meta.select("session_id", "start_sample", "end_sample", "center_hz", "sample_rate", "captured_at"),
        ["session_id"],
        ["start_sample"],
        sample_time() if time is None else time,
        AcquisitionFold,
        AcquisitionFold.SCHEMA,
        closing,
        lateness,
    )
