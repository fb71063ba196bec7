"""Parked receivers: IQ blocks to scored bursts and triggered captures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandsift import params as P
from bandsift.operators.acquisition import (
    block_at,
    block_meta,
    can_observe,
    gap_detect,
    segments_of,
)
from bandsift.operators.capture import (
    capture_windows,
    finished_captures,
    trigger_capture_join,
)
from bandsift.operators.detect import wideband_regions
from bandsift.operators.dsp import frame_blocks, seed_frames, short_time_psd, with_segments
from bandsift.operators.noise import bin_noise_floor
from bandsift.operators.ordered import attach
from bandsift.operators.tracks import (
    classify_burst,
    finish_burst,
    in_sequence,
    novelty_filter,
    track_bursts,
)
from bandsift.runtime import cut_lineage


@dataclass(frozen=True)
class Evidence:
    """Frame length, sub-segments, threshold and bin grouping of one analysis."""

    frame_samples: int = P.FRAME_SAMPLES
    welch_segments: int = P.WELCH_SEGMENTS
    threshold_db: float = P.EVIDENCE_THRESHOLD_DB
    block_bins: int = 32
    datatype: str | None = None


def observed(blocks: DataFrame) -> DataFrame:
    """Blocks from which the whole grid can be observed; those of another tuning stay out."""
    return blocks.filter(can_observe(F.col("center_hz"), F.col("sample_rate")))


def gaps_of(blocks: DataFrame) -> DataFrame:
    """Continuity of every session: metadata only, written once because each step needs it."""
    return cut_lineage(gap_detect(cut_lineage(block_meta(blocks))))


def spectra(
    blocks: DataFrame, gaps: DataFrame, how: Evidence = Evidence(), precise: bool = False
) -> DataFrame:
    """In-band short-time spectra with the number of frames that seed the floor."""
    framed = frame_blocks(with_segments(blocks, gaps), how.frame_samples, how.datatype)
    psd = short_time_psd(
        framed,
        how.frame_samples,
        how.welch_segments,
        precise=precise,
        datatype=how.datatype,
    )
    seeds = seed_frames(gaps, how.frame_samples)
    return attach(psd, seeds, ["session_id", "segment_start"], how="inner")


def noise_of(
    blocks: DataFrame, gaps: DataFrame, how: Evidence = Evidence(), precise: bool = False
) -> DataFrame:
    return bin_noise_floor(
        spectra(blocks, gaps, how, precise), how.threshold_db, block_bins=how.block_bins
    )


def segment_axis(bin_noise: DataFrame, segments: DataFrame) -> DataFrame:
    """Frequency axis and sample rate of every segment; a retune begins a segment."""
    key = ["session_id", "segment_start"]
    axis = bin_noise.groupBy(*key).agg(
        F.max("f0_hz").alias("f0_hz"),
        F.max("bin_hz").alias("bin_hz"),
        F.max(F.col("first_bin") + F.size("noise_db")).alias("n_bins"),
    )
    return attach(axis, segments.select(*key, "sample_rate"), key, how="inner")


def bursts_of(
    bin_noise: DataFrame, segments: DataFrame, how: Evidence = Evidence()
) -> DataFrame:
    """Scored bursts in sequence.

    `bin_noise` is read twice: hand in a written table. Regions and tracks are small next
    to it and read several times, so both go to the checkpoint folder.
    """
    regions = cut_lineage(wideband_regions(bin_noise, how.threshold_db))
    tracks = track_bursts(regions, segments)
    finished = cut_lineage(
        finish_burst(
            tracks,
            bin_noise,
            segment_axis(bin_noise, segments),
            how.frame_samples,
            block_bins=how.block_bins,
        )
    )
    return novelty_filter(classify_burst(in_sequence(finished)))


def wideband_bursts(blocks: DataFrame, how: Evidence = Evidence()) -> DataFrame:
    """The whole chain, from IQ blocks to flagged bursts.

    Blocks whose window doesn't cover the grid and its guard bands are left out: half a band would be
    scored as if it were the whole. Tuned away and back, a receiver begins a new segment.
    """
    blocks = observed(blocks)
    gaps = gaps_of(blocks)
    floors = cut_lineage(noise_of(blocks, gaps, how))
    return bursts_of(floors, segments_of(gaps, how.frame_samples), how)


def triggers_of(
    bursts: DataFrame, gaps: DataFrame, frame_samples: int = P.FRAME_SAMPLES
) -> DataFrame:
    """Candidate bursts placed in the block in which their closing frame was complete."""
    flagged = bursts.filter("is_candidate").select(
        "session_id",
        "segment_start",
        F.col("sequence").alias("trigger_id"),
        (F.col("close_sample") + frame_samples).alias("frame_end"),
    )
    placed = block_at(flagged, gaps, "frame_end")
    return placed.select(
        "session_id",
        "segment_start",
        "sample_rate",
        "trigger_id",
        F.col("start_sample").alias("block_start"),
        F.col("end_sample").alias("block_end"),
    )


def captures_of(
    bursts: DataFrame,
    blocks: DataFrame,
    gaps: DataFrame,
    how: Evidence = Evidence(),
    **window_s: float,
) -> DataFrame:
    """Triggered captures with their IQ."""
    triggers = cut_lineage(triggers_of(bursts, gaps, how.frame_samples))
    windows = finished_captures(capture_windows(triggers, **window_s), gaps)
    return trigger_capture_join(cut_lineage(windows), with_segments(blocks, gaps))
