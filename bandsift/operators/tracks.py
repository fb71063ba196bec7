"""Bursts: regions followed across frames, then measured, scored and tallied."""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandsift import params as P
from bandsift.functions.arrays import rint_long
from bandsift.functions.channels import grid_frequency, nearest_grid_index
from bandsift.operators.islands import track_islands
from bandsift.operators.ordered import (
    Fold,
    attach,
    columns_of,
    dense_chunk,
    density,
    fold_sorted,
    number_chunk,
    with_position,
    with_running_sum,
)

TRACK_SCHEMA = (
    "session_id BIGINT, segment_start BIGINT, start_frame BIGINT, last_frame BIGINT, "
    "close_frame BIGINT, start_sample BIGINT, last_frame_start BIGINT, first_hz DOUBLE, "
    "center_hz DOUBLE, width_hz DOUBLE, peak_db DOUBLE, peak_snr_db DOUBLE, above_frames BIGINT"
)
_TRACK_COLUMNS = [part.split()[0] for part in TRACK_SCHEMA.split(", ")]


class SortedBlocks:
    """Sorted numbers in arrays of bounded length, eight bytes each."""

    MOST = 2048

    def __init__(self):
        self.blocks: list[array] = []
        self.tops: list[float] = []
        self.n = 0

    def add(self, value: float) -> None:
        self.n += 1
        if not self.blocks:
            self.blocks.append(array("d", [value]))
            self.tops.append(value)
            return
        k = min(bisect_left(self.tops, value), len(self.tops) - 1)
        own = self.blocks[k]
        insort(own, value)
        if len(own) > self.MOST:
            half = len(own) // 2
            self.blocks[k : k + 1] = [own[:half], own[half:]]
            self.tops.insert(k, own[half - 1])
            own = self.blocks[k + 1]
            k += 1
        self.tops[k] = own[-1]

    def pop(self, last: bool) -> float:
        """Take out the largest or the smallest."""
        self.n -= 1
        k = -1 if last else 0
        value = self.blocks[k].pop(k)
        if not self.blocks[k]:
            del self.blocks[k], self.tops[k]
        elif last:
            self.tops[-1] = self.blocks[-1][-1]
        return value


class RunningMedian:
    """The exact median of numbers as they come: a lower and an upper half, each sorted in blocks.

    Holds eight bytes a number (and little more), and takes one in without moving more than a block.
    """

    def __init__(self, values: Iterable[float] = ()):
        self.low, self.high = SortedBlocks(), SortedBlocks()
        for value in values:
            self.add(value)

    def __iter__(self) -> Iterator[float]:
        for half in (self.low, self.high):
            for block in half.blocks:
                yield from block

    def add(self, value: float) -> None:
        (self.low if self.low.n and value < self.low.tops[-1] else self.high).add(value)
        if self.high.n > self.low.n:
            self.low.add(self.high.pop(last=False))
        elif self.low.n > self.high.n + 1:
            self.high.add(self.low.pop(last=True))

    def value(self) -> float:
        top = self.low.tops[-1]
        return top if self.low.n > self.high.n else (top + self.high.blocks[0][0]) / 2


class TrackFold(Fold):
    """Open tracks of one island. Regions of a frame come in ascending centre."""

    def __init__(
        self, key: tuple, association_hz: float, holdoff: int, tracks: list[dict] | None = None
    ):
        super().__init__(key)
        self.association_hz = association_hz
        self.holdoff = holdoff
        self.tracks = tracks or []
        self.frame: tuple | None = None
        self.pending: list[tuple] = []

    def step(self, rows: pa.RecordBatch) -> list[tuple]:
        done: list[dict] = []
        for frame, frame_start, *region in columns_of(rows, _TRACKED_COLUMNS):
            if self.frame != (frame, frame_start):
                self.flush()
                done += self.closed_before(frame)
                self.frame = (frame, frame_start)
            self.pending.append(tuple(region))
        return [self.row(t) for t in done]

    def finish(self) -> list[tuple]:
        self.flush()
        return [self.row(t) for t in self.tracks]

    def flush(self) -> None:
        if self.pending:
            self.follow(*self.frame, self.pending)
            self.pending = []

    def row(self, track: dict) -> tuple:
        whole = {
            **track,
            "session_id": self.key[0],
            "segment_start": self.key[1],
            "close_frame": track["last_frame"] + self.holdoff,
            "width_hz": track["widths"].value(),
        }
        return tuple(whole[c] for c in _TRACK_COLUMNS)

    def closed_before(self, frame: int) -> list[dict]:
        """Take out the tracks that had missed enough frames before `frame`."""
        done = [t for t in self.tracks if t["last_frame"] + self.holdoff < frame]
        self.tracks = [t for t in self.tracks if t["last_frame"] + self.holdoff >= frame]
        return done

    def follow(self, frame: int, frame_start: int, regions: list[tuple]) -> None:
        for center, peak, snr, width in regions:
            free = [t for t in self.tracks if t["last_frame"] < frame]
            best, best_distance = None, self.association_hz
            for track in free:
                distance = abs(track["center_hz"] - center)
                if distance <= best_distance:
                    best, best_distance = track, distance
            if best is None:
                best = {
                    "start_frame": frame,
                    "start_sample": frame_start,
                    "first_hz": center,
                    "peak_db": peak,
                    "peak_snr_db": snr,
                    "above_frames": 0,
                    "centers": RunningMedian(),
                    "widths": RunningMedian(),
                }
                self.tracks.append(best)
            best["centers"].add(center)
            best["widths"].add(width)
            best["center_hz"] = best["centers"].value()
            best["peak_db"] = max(best["peak_db"], peak)
            best["peak_snr_db"] = max(best["peak_snr_db"], snr)
            best["above_frames"] += 1
            best["last_frame"] = frame
            best["last_frame_start"] = frame_start


_TRACKED_COLUMNS = [
    "frame_id", "frame_start", "center_hz", "peak_db", "peak_snr_db", "width_hz",
]


def track_regions(
    regions: DataFrame,
    association_hz: int = P.ASSOCIATION_HZ,
    holdoff: int = P.HOLDOFF_FRAMES,
) -> DataFrame:
    """Tracks of single-frame regions, each with the frame at which it closes."""

    placed = track_islands(regions, association_hz, holdoff)
    return fold_sorted(
        placed,
        ["session_id", "segment_start", "island", "time_island"],
        ["frame_id", "center_hz"],
        lambda key: TrackFold(key, association_hz, holdoff),
        TRACK_SCHEMA,
    )


def track_bursts(
    regions: DataFrame,
    segment_frames: DataFrame,
    association_hz: int = P.ASSOCIATION_HZ,
    holdoff: int = P.HOLDOFF_FRAMES,
) -> DataFrame:
    """Tracks that closed before their segment ended.

    `segment_frames` has one row per (session, segment) with its number of complete
    frames; a track still open there is not a burst.
    """
    tracks = track_regions(regions, association_hz, holdoff)
    ended = attach(
        tracks,
        segment_frames.select("session_id", "segment_start", "n_frames"),
        ["session_id", "segment_start"],
        how="inner",
    )
    return ended.filter(F.col("close_frame") < F.col("n_frames")).drop("n_frames")


def finish_burst(
    tracks: DataFrame,
    bin_noise: DataFrame,
    axis: DataFrame,
    frame_samples: int = P.FRAME_SAMPLES,
    min_frames: int = P.MIN_QUALIFIED_FRAMES,
    block_bins: int = 32,
) -> DataFrame:
    """Measured bursts, with the floor of the nearest bin at closing.

    `axis` gives sample_rate, f0_hz, bin_hz and n_bins per (session, segment).
    """
    duration = (F.col("last_frame_start") + frame_samples - F.col("start_sample")) / F.col(
        "sample_rate"
    )
    place = (F.col("center_hz") - F.col("f0_hz")) / F.col("bin_hz")
    low = F.floor(place)
    nearest = F.when(place - low > 0.5, low + 1).otherwise(low)
    measured = (
        attach(tracks, axis, ["session_id", "segment_start"], how="inner")
        .withColumn("_bin", F.least(F.greatest(nearest, F.lit(0)), F.col("n_bins") - 1))
        .withColumn("bin_block", F.floor(F.col("_bin") / block_bins).cast("int"))
    )
    floors = bin_noise.select(
        "session_id",
        "segment_start",
        F.col("frame_id").alias("close_frame"),
        "bin_block",
        "first_bin",
        "noise_db",
    )
    looked_up = attach(
        measured, floors, ["session_id", "segment_start", "close_frame", "bin_block"]
    )
    index = nearest_grid_index(F.col("center_hz"))
    return looked_up.select(
        "session_id",
        "segment_start",
        "start_frame",
        "close_frame",
        "first_hz",
        "start_sample",
        index.alias("channel_index"),
        rint_long(F.col("center_hz")).alias("freq_hz"),
        F.col("center_hz").alias("measured_hz"),
        (F.col("start_sample") / F.col("sample_rate")).alias("start_s"),
        (F.greatest(F.lit(0.0), duration) * 1000.0).alias("raw_duration_ms"),
        F.round(F.greatest(F.lit(0.0), duration) * 1000.0, 3).alias("duration_ms"),
        rint_long(F.col("width_hz")).alias("bandwidth_hz"),
        F.round("peak_snr_db", 3).alias("peak_snr_db"),
        F.round(F.get("noise_db", (F.col("_bin") - F.col("first_bin")).cast("int")), 3).alias(
            "noise_db"
        ),
        "above_frames",
        (F.col("above_frames") >= min_frames).alias("qualified"),
        F.round(F.col("center_hz") - grid_frequency(index), 1).alias("freq_offset_hz"),
        (F.col("segment_start") + F.col("close_frame") * frame_samples).alias("close_sample"),
    )


def in_sequence(bursts: DataFrame, chunk_bursts: int = P.CHUNK_FRAMES) -> DataFrame:
    """Number the bursts of each session in the order in which they closed."""
    apart = density(bursts, ["session_id"], "close_sample")
    return with_position(
        attach(bursts, apart, ["session_id"]),
        ["session_id"],
        ["close_sample", "start_frame", "first_hz"],
        dense_chunk("close_sample", chunk_bursts),
        "sequence",
    ).drop("_low", "_spacing")


def classify_burst(bursts: DataFrame, duration: str = "raw_duration_ms") -> DataFrame:
    """Add `candidate_reasons` and `candidate_score`."""
    ms, width = F.col(duration), F.col("bandwidth_hz")
    long = ms.between(*P.LONG_WAKEUP_MS)
    short = ms.between(*P.SHORT_WAKEUP_MS)
    wide = (ms >= P.WIDEBAND_MIN_MS) & (width >= P.WIDEBAND_MIN_HZ)
    reasons = F.array_compact(
        F.array(
            F.when(long, F.lit("long_wakeup")),
            F.when(short, F.lit("short_wakeup")),
            F.when(wide, F.lit("wideband")),
        )
    )
    score = (
        F.when(long, F.lit(3.0)).otherwise(0.0)
        + F.when(short, F.lit(1.0)).otherwise(0.0)
        + F.when(wide, F.lit(2.0)).otherwise(0.0)
    )
    return bursts.withColumn("candidate_reasons", reasons).withColumn("candidate_score", score)


def candidate_bucket(freq: str = "measured_hz"):
    return rint_long(F.col(freq) / F.lit(P.CANDIDATE_BUCKET_HZ))


def novelty_filter(
    bursts: DataFrame,
    freq: str = "measured_hz",
    cap: int = P.CANDIDATE_CAP,
    min_score: float = P.CANDIDATE_MIN_SCORE,
    chunk_bursts: int = 100_000,
) -> DataFrame:
    """Add `is_candidate` and `is_suppressed`: a bucket flags its first few bursts only.

    Eligible bursts are counted along the sequence in chunks, so a bucket that holds a
    third of them is not ranked in one task.
    """
    eligible = F.col("qualified") & (F.col("candidate_score") >= min_score)
    counted = with_running_sum(
        bursts.withColumn("bucket", candidate_bucket(freq)),
        ["session_id", "bucket"],
        ["sequence"],
        {"_seen": F.when(eligible, F.lit(1)).otherwise(F.lit(0)).cast("bigint")},
        number_chunk("sequence", chunk_bursts),
    )
    return (
        counted.withColumn("is_candidate", eligible & (F.col("_seen") <= cap))
        .withColumn("is_suppressed", eligible & (F.col("_seen") > cap))
        .drop("_seen")
    )


def recurring_emitters(bursts: DataFrame, cap: int = P.CANDIDATE_CAP) -> DataFrame:
    """Frequency buckets that used up their flags."""
    return (
        bursts.filter("is_candidate")
        .groupBy("session_id", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= cap)
        .select("session_id", (F.col("bucket") * P.CANDIDATE_BUCKET_HZ).alias("freq_hz"))
    )


def grid_tally(bursts: DataFrame) -> DataFrame:
    """Per session and grid channel: counts and last values; fifteen rows always."""
    tally = bursts.groupBy("session_id", "channel_index").agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if("qualified").alias("qualified_observations"),
        F.max_by("start_s", "sequence").alias("last_seen_s"),
        F.max("peak_snr_db").alias("peak_snr_db"),
        F.max_by("noise_db", "sequence").alias("noise_db"),
    )
    grid = (
        bursts.select("session_id")
        .distinct()
        .withColumn(
            "channel_index", F.explode(F.sequence(F.lit(0), F.lit(P.GRID_CHANNELS - 1)))
        )
    )
    return attach(grid, tally, ["session_id", "channel_index"]).select(
        "session_id",
        "channel_index",
        grid_frequency(F.col("channel_index")).alias("freq_hz"),
        F.coalesce("observations", F.lit(0)).alias("observations"),
        F.coalesce("qualified_observations", F.lit(0)).alias("qualified_observations"),
        "last_seen_s",
        F.greatest(F.coalesce("peak_snr_db", F.lit(0.0)), F.lit(0.0)).alias("peak_snr_db"),
        "noise_db",
    )


def active_grid_channels(tracks: DataFrame, as_of_frame: int) -> DataFrame:
    """Grid channels with a track open after the given frame."""
    return (
        tracks.filter(
            (F.col("start_frame") <= as_of_frame) & (F.col("close_frame") > as_of_frame)
        )
        .select("session_id", nearest_grid_index(F.col("center_hz")).alias("channel_index"))
        .distinct()
    )


def evidence_snapshot(
    bursts: DataFrame, segment_frames: DataFrame, frame_samples: int = P.FRAME_SAMPLES
) -> DataFrame:
    """Totals per session: frames, frame length, candidates flagged and suppressed."""
    frames = segment_frames.groupBy("session_id").agg(
        F.sum("n_frames").alias("frames_processed"),
        F.round(F.lit(frame_samples) / F.max("sample_rate") * 1000.0, 3).alias("frame_ms"),
    )
    flags = bursts.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("bursts"),
        F.count_if("qualified").alias("qualified_bursts"),
        F.count_if("is_candidate").alias("candidates_flagged"),
        F.count_if("is_suppressed").alias("suppressed_recurring"),
    )
    zero = F.lit(0).cast("bigint")
    return attach(frames, flags, ["session_id"]).select(
        "session_id",
        "frames_processed",
        "frame_ms",
        *[
            F.coalesce(c, zero).alias(c)
            for c in ("bursts", "qualified_bursts", "candidates_flagged", "suppressed_recurring")
        ],
    )


def recent_bursts(bursts: DataFrame, limit: int = P.RECENT_BURSTS) -> DataFrame:
    """The newest bursts of every session."""
    w = Window.partitionBy("session_id").orderBy(F.col("sequence").desc())
    return (
        bursts.withColumn("_rank", F.row_number().over(w))
        .filter(F.col("_rank") <= limit)
        .drop("_rank")
    )
