"""Occupancy over time and frequency, stitched spectra, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandsift import params as P
from bandsift.functions.arrays import reduce_bins
from bandsift.operators.capture import throttle
from bandsift.operators.ordered import attach, dense_chunk, density, with_last_known, with_position


def _check(**least: tuple[int, int]) -> None:
    """Arguments below what they can mean are errors; none is changed silently."""
    for name, (value, low) in least.items():
        if value < low:
            raise ValueError(f"{name} must be {low} or more, not {value}")


def occupancy_cells(
    detections: DataFrame,
    as_of: str,
    minutes: int = 30,
    bucket_seconds: int = 30,
    freq_bins: int = 96,
    start_hz: int = P.BAND_START_HZ,
    end_hz: int = P.BAND_END_HZ,
) -> DataFrame:
    """Detections per (time bucket, frequency bin); empty cells are absent.

    A centre less than one bin under the band counts in bin 0, because the bin number is
    cut towards zero.
    """
    _check(freq_bins=(freq_bins, 1), minutes=(minutes, 1), bucket_seconds=(bucket_seconds, 1))
    buckets = max(1, minutes * 60 // bucket_seconds)
    span = max(1, end_hz - start_hz)
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES")
    after = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(since)
    return (
        detections.filter(F.col("ts") >= since)
        .select(
            F.floor(after / F.lit(bucket_seconds * 1_000_000)).alias("bucket"),
            ((F.col("center_hz") - start_hz) / F.lit(span) * freq_bins)
            .cast("int")
            .alias("freq_bin"),
        )
        .filter(F.col("bucket").between(0, buckets - 1))
        .filter(F.col("freq_bin").between(0, freq_bins - 1))
        .groupBy("bucket", "freq_bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def occupancy_grid(
    detections: DataFrame,
    as_of: str,
    minutes: int = 30,
    bucket_seconds: int = 30,
    freq_bins: int = 96,
    start_hz: int = P.BAND_START_HZ,
    end_hz: int = P.BAND_END_HZ,
) -> DataFrame:
    """Dense grid, oldest bucket first: bucket, bucket_start, freq_bin, n."""
    _check(freq_bins=(freq_bins, 1), minutes=(minutes, 1), bucket_seconds=(bucket_seconds, 1))
    buckets = max(1, minutes * 60 // bucket_seconds)
    cells = occupancy_cells(
        detections, as_of, minutes, bucket_seconds, freq_bins, start_hz, end_hz
    )
    grid = detections.sparkSession.range(buckets * freq_bins).select(
        F.floor(F.col("id") / freq_bins).alias("bucket"),
        (F.col("id") % freq_bins).cast("int").alias("freq_bin"),
    )
    start = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.lit(minutes * 60_000_000)
    return attach(grid, cells, ["bucket", "freq_bin"]).select(
        "bucket",
        F.timestamp_micros(start + F.col("bucket") * bucket_seconds * 1_000_000).alias(
            "bucket_start"
        ),
        "freq_bin",
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def occupancy_intensity(grid: DataFrame) -> DataFrame:
    """Cell counts as shares of the fullest cell; 0 everywhere in an empty grid."""
    most = grid.agg(F.max("n").alias("_max"))
    return (
        grid.join(F.broadcast(most))
        .withColumn(
            "intensity", F.when(F.col("_max") > 0, F.col("n") / F.col("_max")).otherwise(0.0)
        )
        .drop("_max")
    )


def _band_freq(bins: int, start_hz: int, end_hz: int) -> Column:
    step = (end_hz - start_hz) / (bins - 1)
    return F.when(F.col("band_bin") == bins - 1, F.lit(float(end_hz))).otherwise(
        start_hz + F.col("band_bin") * step
    )


def band_cells(
    frames: DataFrame,
    bins: int = P.SPECTRUM_BINS,
    start_hz: int = P.BAND_START_HZ,
    end_hz: int = P.BAND_END_HZ,
) -> DataFrame:
    """Each frame interpolated onto the band bins it covers: session, bin, frame, v.

    Row by row, so it serves streams as well.
    """
    step = (end_hz - start_hz) / (bins - 1)
    low = F.col("f0_hz")
    high = F.col("f0_hz") + F.col("bin_hz") * (F.size("power_db") - 1)
    first = F.greatest(F.ceil((low - start_hz) / F.lit(step)) - 1, F.lit(0))
    last = F.least(F.floor((high - start_hz) / F.lit(step)) + 1, F.lit(bins - 1))
    touched = (
        frames.filter(F.size("power_db") > 0)
        .withColumn("_low", low)
        .withColumn("_high", high)
        .withColumn("_first", first)
        .withColumn("_last", last)
        .filter(F.col("_first") <= F.col("_last"))
        .withColumn("band_bin", F.explode(F.sequence("_first", "_last").cast("array<int>")))
        .withColumn("_freq", _band_freq(bins, start_hz, end_hz))
        .filter((F.col("_freq") >= F.col("_low")) & (F.col("_freq") <= F.col("_high")))
    )
    place = F.when(F.col("bin_hz") > 0, (F.col("_freq") - F.col("_low")) / F.col("bin_hz"))
    at = F.least(F.floor(F.coalesce(place, F.lit(0.0))), F.size("power_db") - 1).cast("int")
    left = F.get("power_db", at)
    right = F.coalesce(F.get("power_db", at + 1), left)
    value = left + (right - left) * (F.coalesce(place, F.lit(0.0)) - at)
    return touched.select("session_id", "band_bin", "frame_seq", value.alias("v"))


def stitch_band(
    frames: DataFrame,
    bins: int = P.SPECTRUM_BINS,
    start_hz: int = P.BAND_START_HZ,
    end_hz: int = P.BAND_END_HZ,
) -> DataFrame:
    """Full-band spectrum per session: the latest window covering a band bin wins.

    Windows of equal shape cover equal bins, so only the newest of each shape is taken apart
    into bins. Uncovered bins read -140.
    """
    _check(bins=(bins, 2))
    shape = ["session_id", "f0_hz", "bin_hz", F.size("power_db").alias("_n")]
    newest = frames.groupBy(*shape).agg(
        F.max("frame_seq").alias("frame_seq"), F.max_by("power_db", "frame_seq").alias("power_db")
    )
    seen = (
        band_cells(newest.drop("_n"), bins, start_hz, end_hz)
        .groupBy("session_id", "band_bin")
        .agg(F.max_by("v", "frame_seq").alias("power_db"))
    )
    band = (
        frames.select("session_id")
        .distinct()
        .withColumn("band_bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    )
    return attach(band, seen, ["session_id", "band_bin"]).select(
        "session_id",
        "band_bin",
        _band_freq(bins, start_hz, end_hz).alias("freq_hz"),
        F.coalesce("power_db", F.lit(P.UNSEEN_DB)).alias("power_db"),
    )


def spectrum_frames_out(
    frames: DataFrame,
    fps: int = P.SPECTRUM_FPS,
    bins: int = P.SPECTRUM_BINS,
    start_hz: int = P.BAND_START_HZ,
    end_hz: int = P.BAND_END_HZ,
    chunk_frames: int = P.CHUNK_FRAMES,
) -> DataFrame:
    """The stitched band as it stood at every frame the throttle lets out, one row per bin.

    Between two outputs only the newest value of a bin counts, so cells are reduced to
    one per (session, bin, output) before values are carried forward.
    """
    _check(bins=(bins, 2))
    timed = frames.select("session_id", "frame_seq", F.unix_micros("ts").alias("ts_us"))
    interval = int(1_000_000 / max(1, fps))
    outs = throttle(timed, ["session_id"], "ts_us", "frame_seq", interval).select(
        "session_id", F.col("frame_seq").alias("out_seq")
    )
    marked = timed.select("session_id", "frame_seq").join(
        outs.withColumn("frame_seq", F.col("out_seq")), ["session_id", "frame_seq"], "left"
    )
    marked = marked.withColumn("_back", -F.col("frame_seq"))
    served = with_last_known(
        attach(marked, density(marked, ["session_id"], "_back"), ["session_id"]),
        ["session_id"],
        ["_back"],
        {"out_seq": "_out"},
        dense_chunk("_back", chunk_frames),
    ).select("session_id", "frame_seq", F.col("_out").alias("out_seq"))
    cells = (
        attach(
            band_cells(frames, bins, start_hz, end_hz), served, ["session_id", "frame_seq"], "inner"
        )
        .filter("out_seq is not null")
        .groupBy("session_id", "band_bin", "out_seq")
        .agg(F.max_by("v", "frame_seq").alias("v"))
    )
    grid = outs.withColumn("band_bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    # Outputs of a session are as far apart for each of its bins.
    apart = density(outs, ["session_id"], "out_seq")
    filled = with_last_known(
        attach(attach(grid, cells, ["session_id", "band_bin", "out_seq"]), apart, ["session_id"]),
        ["session_id", "band_bin"],
        ["out_seq"],
        {"v": "_known"},
        dense_chunk("out_seq", chunk_frames),
    )
    return filled.select(
        "session_id",
        F.col("out_seq").alias("frame_seq"),
        "band_bin",
        F.coalesce("_known", F.lit(P.UNSEEN_DB)).alias("power_db"),
    )


def scope_frames_out(
    frames: DataFrame,
    fps: int = P.SCOPE_FPS,
    bins: int = P.SCOPE_BINS,
    chunk_frames: int = P.CHUNK_FRAMES,
) -> DataFrame:
    """Throttled, max-pooled frames with a running number per session.

    Other columns of `frames` (envelope, floor, modulation hint) pass through.
    """
    timed = frames.withColumn("ts_us", F.unix_micros("ts"))
    kept = throttle(
        timed, ["session_id"], "ts_us", "frame_seq", int(1_000_000 / max(1, fps))
    ).drop("ts_us")
    reduced = kept.withColumn("power_db", reduce_bins(F.col("power_db"), bins))
    apart = density(kept, ["session_id"], "frame_seq")
    return with_position(
        attach(reduced, apart, ["session_id"]), ["session_id"], ["frame_seq"], dense_chunk("frame_seq", chunk_frames), "seq"
    ).drop("_low", "_spacing")


def coverage_gaps(windows: DataFrame) -> DataFrame:
    """Parts of each session's band that no observed window covers.

    `windows` has session_id, start_hz, end_hz (the band) and lo_hz, hi_hz. A sweep
    repeats its windows, so they are made distinct before they are put in order.
    """
    band = ["session_id", "start_hz", "end_hz"]
    ends = windows.select(*band, "lo_hz", "hi_hz").distinct()
    sentinel = ends.select(
        *band, F.col("end_hz").alias("lo_hz"), F.col("end_hz").alias("hi_hz")
    ).distinct()
    rows = ends.unionByName(sentinel)
    w = (
        Window.partitionBy(*band)
        .orderBy("lo_hz", "hi_hz")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    reached = F.greatest(F.coalesce(F.max("hi_hz").over(w), F.col("start_hz")), F.col("start_hz"))
    return (
        rows.withColumn("gap_lo_hz", reached)
        .withColumn("gap_hi_hz", F.least("lo_hz", "end_hz"))
        .filter(F.col("gap_lo_hz") < F.col("gap_hi_hz"))
        .select("session_id", "gap_lo_hz", "gap_hi_hz")
        .distinct()
    )
