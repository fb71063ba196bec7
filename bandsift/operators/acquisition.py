"""Continuity of IQ acquisition: segments, gaps, counters. Works on block metadata only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandsift import params as P
from bandsift.operators.ordered import (
    attach,
    dense_chunk,
    density,
    number_chunk,
    with_last_known,
    with_position,
    with_previous,
    with_run_start,
)

CHUNK_SAMPLES = 1 << 33


def block_meta(blocks: DataFrame, bytes_per_sample: int = 2) -> DataFrame:
    """Positions of blocks without their samples.

    A stored `n_samples` column spares reading the samples at all; otherwise the length
    of `iq` or of the bytes in `raw` tells.
    """
    if "n_samples" in blocks.columns:
        n = F.col("n_samples")
    elif "raw" in blocks.columns:
        n = F.floor(F.octet_length("raw") / bytes_per_sample)
    else:
        n = F.size("iq") / 2
    return blocks.select(
        "session_id",
        "start_sample",
        (F.col("start_sample") + n).cast("bigint").alias("end_sample"),
        "center_hz",
        "sample_rate",
        "captured_at",
    )


def gap_detect(meta: DataFrame, chunk_samples: int = CHUNK_SAMPLES) -> DataFrame:
    """Add missing samples before each block and the start of its segment.

    A segment has no gap and one tuning: a new centre or sample rate begins another.
    """
    rows = with_run_start(
        meta,
        ["session_id"],
        ["start_sample"],
        ["start_sample", "end_sample", "center_hz", "sample_rate"],
        lambda here, before: before("end_sample").isNull()
        | (here("start_sample") != before("end_sample"))
        | (here("center_hz") != before("center_hz"))
        | (here("sample_rate") != before("sample_rate")),
        number_chunk("start_sample", chunk_samples),
        "start_sample",
        "segment_start",
    )
    before = F.col("prev_end_sample")
    return (
        rows.withColumn("is_gap", F.coalesce(before != F.col("start_sample"), F.lit(False)))
        .withColumn(
            "missing_samples",
            F.when(
                F.col("is_gap"), F.greatest(F.lit(0), F.col("start_sample") - before)
            ).otherwise(F.lit(0)),
        )
        .withColumn(
            "is_retune",
            F.coalesce(
                (F.col("prev_center_hz") != F.col("center_hz"))
                | (F.col("prev_sample_rate") != F.col("sample_rate")),
                F.lit(False),
            ),
        )
        .drop("prev_start_sample", "prev_end_sample", "prev_center_hz", "prev_sample_rate")
    )


def segments_of(gaps: DataFrame, frame_samples: int = P.FRAME_SAMPLES) -> DataFrame:
    """One row per gap-free segment, with its number of complete frames."""
    return (
        gaps.groupBy("session_id", "segment_start")
        .agg(
            F.max("end_sample").alias("segment_end"),
            F.max("sample_rate").alias("sample_rate"),
            F.max("center_hz").alias("center_hz"),
        )
        .withColumn(
            "n_frames",
            F.floor((F.col("segment_end") - F.col("segment_start")) / F.lit(frame_samples)),
        )
    )


def block_at(
    points: DataFrame, gaps: DataFrame, at: str, bucket_samples: int = 1 << 20
) -> DataFrame:
    """Find the block (start, end] that holds each point's sample position.

    `points` has session_id and segment_start. Blocks are spread over the sample buckets
    they touch, so this is an equi join however many blocks a segment has.
    """
    blocks = gaps.select(
        "session_id", "segment_start", "sample_rate", "start_sample", "end_sample"
    ).withColumn(
        "_bucket",
        F.explode(
            F.sequence(
                F.floor(F.col("start_sample") / bucket_samples),
                F.floor(F.col("end_sample") / bucket_samples),
            )
        ),
    )
    placed = points.withColumn("_bucket", F.floor(F.col(at) / bucket_samples))
    return (
        attach(placed, blocks, ["session_id", "segment_start", "_bucket"], how="inner")
        .filter((F.col("start_sample") < F.col(at)) & (F.col("end_sample") >= F.col(at)))
        .drop("_bucket")
    )


def timing_gaps(meta: DataFrame, chunk_samples: int = CHUNK_SAMPLES) -> DataFrame:
    """Flag blocks that arrived late by more than max(5 ms, half the previous block)."""
    rows = with_previous(
        meta.withColumn("n_samples", F.col("end_sample") - F.col("start_sample")),
        ["session_id"],
        ["start_sample"],
        ["captured_at", "n_samples"],
        number_chunk("start_sample", chunk_samples),
    )
    expected = F.col("prev_n_samples") / F.col("sample_rate")
    excess = F.col("captured_at") - F.col("prev_captured_at") - expected
    late = F.coalesce(
        (F.col("prev_n_samples") > 0) & (excess > F.greatest(F.lit(0.005), expected * 0.5)),
        F.lit(False),
    )
    return (
        rows.withColumn("is_late", late)
        .withColumn(
            "estimated_gap_samples",
            F.when(
                late, F.greatest(F.lit(0.0), F.rint(excess * F.col("sample_rate"))).cast("bigint")
            ).otherwise(F.lit(0)),
        )
        .drop("prev_captured_at", "prev_n_samples")
    )


def acquisition_stats(meta: DataFrame, chunk_samples: int = CHUNK_SAMPLES) -> DataFrame:
    """Per-session counters of blocks, samples, losses, late blocks and retunes."""
    gaps = gap_detect(meta, chunk_samples).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("blocks_acquired"),
        F.sum(F.col("end_sample") - F.col("start_sample")).alias("samples_acquired"),
        F.max("end_sample").alias("sample_cursor"),
        F.count_if("is_gap").alias("dropped_runs"),
        F.sum("missing_samples").alias("dropped_samples"),
        F.count_if("is_retune").alias("retunes"),
    )
    late = timing_gaps(meta, chunk_samples).groupBy("session_id").agg(
        F.count_if("is_late").alias("timing_gaps"),
        F.sum("estimated_gap_samples").alias("estimated_gap_samples"),
    )
    return attach(gaps, late, ["session_id"], how="inner")


def can_observe(center_hz: Column, sample_rate: Column) -> Column:
    """One window covers the whole grid and its guard bands."""
    half = F.floor(sample_rate / 2)
    return (center_hz - half <= P.GRID_FIRST_HZ - P.GRID_GUARD_HZ) & (
        center_hz + half >= P.GRID_LAST_HZ + P.GRID_GUARD_HZ
    )


def observable_blocks(blocks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Blocks of sessions whose band fits one window that covers the grid."""
    bands = sessions.filter(
        (F.col("start_hz") <= P.GRID_FIRST_HZ) & (F.col("end_hz") >= P.GRID_LAST_HZ)
    ).select("session_id", (F.col("end_hz") - F.col("start_hz")).alias("_band"))
    return (
        attach(
            blocks.filter(can_observe(F.col("center_hz"), F.col("sample_rate"))),
            bands,
            ["session_id"],
            how="inner",
        )
        .filter(F.col("_band") <= F.col("sample_rate"))
        .drop("_band")
    )


def frame_rate(
    frames: DataFrame, window: int = 64, chunk_frames: int = P.CHUNK_FRAMES
) -> DataFrame:
    """Frames per second over each frame and up to `window - 1` before it.

    The window's first frame is found by position, so no history is sorted whole.
    """
    slim = frames.select("session_id", "frame_seq", F.unix_micros("ts").alias("_t"))
    placed = with_position(
        attach(slim, density(slim, ["session_id"], "frame_seq"), ["session_id"]),
        ["session_id"],
        ["frame_seq"],
        dense_chunk("frame_seq", chunk_frames),
    ).drop("_low", "_spacing")
    firsts = placed.select(
        "session_id", F.col("position").alias("_at"), F.col("_t").alias("_first")
    )
    rows = placed.withColumn(
        "_at", F.greatest(F.col("position") - (window - 1), F.lit(1).cast("bigint"))
    )
    span = (F.col("_t") - F.col("_first")) / F.lit(1e6)
    return attach(rows, firsts, ["session_id", "_at"], how="inner").select(
        "session_id",
        "frame_seq",
        F.when(
            (F.col("position") > F.col("_at")) & (span > 0),
            F.round((F.col("position") - F.col("_at")) / span, 3),
        )
        .otherwise(F.lit(0.0))
        .alias("frame_rate_hz"),
    )


def sticky_modulation(
    hints: DataFrame, chunk: Column, order: str = "frame_seq"
) -> DataFrame:
    """Last known modulation per session, forgotten on every retune."""
    rows = with_run_start(
        hints,
        ["session_id"],
        [order],
        [order, "center_hz"],
        lambda here, before: before("center_hz").isNull()
        | (here("center_hz") != before("center_hz")),
        chunk,
        order,
        "tuning_run",
    ).drop("prev_center_hz", f"prev_{order}")
    known = rows.withColumn(
        "_known", F.when(F.col("modulation") != "unknown", F.col("modulation"))
    )
    return with_last_known(
        known, ["session_id", "tuning_run"], [order], {"_known": "sticky_modulation"}, chunk
    ).drop("_known")
