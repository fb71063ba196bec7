"""Sweep scans: IQ blocks or spectra to candidate channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandsift import params as P
from bandsift.operators.channels import channel_model
from bandsift.operators.cluster import BORN, channels_of, cluster_regions, merge_overlapping
from bandsift.operators.detect import detect_regions, exclusion_mask, in_band_regions
from bandsift.operators.dsp import welch_psd
from bandsift.operators.noise import with_floor
from bandsift.operators.ordered import attach
from bandsift.operators.timing import burst_sessions, recurrence_of_bursts
from bandsift.runtime import cut_lineage


def frames_of(
    blocks: DataFrame, fft_size: int = P.FFT_SIZE, datatype: str | None = None
) -> DataFrame:
    """PSD frames of IQ blocks, numbered by sample position."""
    return welch_psd(blocks, fft_size, datatype=datatype).select(
        "session_id",
        F.col("start_sample").alias("frame_seq"),
        F.timestamp_micros(F.rint(F.col("captured_at") * 1e6).cast("bigint")).alias("ts"),
        "f0_hz",
        "bin_hz",
        "power_db",
    )


def regions_of(
    frames: DataFrame,
    threshold_db: float = P.THRESHOLD_DB,
    alpha: float = P.FLOOR_ALPHA,
    exclusions: Sequence[tuple[int, int]] = (),
    start_hz: int = P.BAND_START_HZ,
    end_hz: int = P.BAND_END_HZ,
) -> DataFrame:
    """Occupied regions inside the configured band, each with the floor of its frame.

    `frames` are read twice, for the floors and for the regions: hand in a written table.
    """
    floored = exclusion_mask(with_floor(frames, alpha), exclusions)
    return in_band_regions(detect_regions(floored, threshold_db), start_hz, end_hz)


def sweep_channels(
    frames: DataFrame,
    as_of: Column,
    threshold_db: float = P.THRESHOLD_DB,
    proximity_hz: int = P.PROXIMITY_HZ,
    gap_s: float = P.BURST_GAP_S,
) -> DataFrame:
    """Candidate channels with timing, confidence, status and fingerprint.

    Regions and their assignments are small next to the spectra and used several times,
    so both are written to the checkpoint folder once.
    """
    regions = cut_lineage(regions_of(frames, threshold_db))
    assigned = cut_lineage(cluster_regions(regions, proximity_hz))
    clustered = channels_of(assigned)
    states = merge_overlapping(clustered, proximity_hz)
    arrivals = assigned.select(*BORN, "ts", F.struct("frame_seq", "center_hz").alias("arrival"))
    timing = attach(
        recurrence_of_bursts(
            burst_sessions(arrivals, gap_s, keys=BORN, id_col="arrival"), BORN
        ),
        clustered.select("channel_id", *BORN),
        BORN,
        how="inner",
    ).drop("born_seq", "born_hz")
    floors = regions.groupBy("session_id").agg(
        F.max_by("floor_db", "frame_seq").alias("floor_db")
    )
    return channel_model(states, timing, floors, as_of)
