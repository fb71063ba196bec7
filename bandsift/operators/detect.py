"""Occupied regions of a spectrum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandsift import params as P
from bandsift.functions.arrays import indices, rint_long


def runs_of(above: Column, max_gap: Column) -> Column:
    """Inclusive runs of ascending indices, joined over gaps of at most `max_gap`."""
    last = F.size(above) - 1
    starts = F.filter(
        above, lambda x, j: (j == 0) | (x - F.get(above, j - 1) - 1 > max_gap)
    )
    stops = F.filter(
        above, lambda x, j: (j == last) | (F.get(above, j + 1) - x - 1 > max_gap)
    )
    return F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop")))


def contiguous_runs(rows: DataFrame, mask: str, max_gap: int = 0) -> DataFrame:
    """Runs of true values in an array<boolean> column, one row per run."""
    above = F.filter(indices(F.size(mask)), lambda i: F.get(F.col(mask), i))
    runs = rows.withColumn("_above", above)
    return (
        runs.withColumn("_run", F.explode(runs_of(F.col("_above"), F.lit(max_gap))))
        .withColumn("run_start", F.col("_run.start"))
        .withColumn("run_stop", F.col("_run.stop"))
        .drop("_above", "_run")
    )


def merge_runs(
    runs: DataFrame, keys: Sequence[str], start: str, stop: str, max_gap: int = 0
) -> DataFrame:
    """Merge inclusive runs held as rows, when at most `max_gap` positions lie between."""
    ordered = Window.partitionBy(*keys).orderBy(start, stop)
    seen = F.max(stop).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    is_new = seen.isNull() | (F.col(start) - seen - 1 > max_gap)
    return (
        runs.withColumn("_new", is_new.cast("int"))
        .withColumn("_run", F.sum("_new").over(ordered))
        .groupBy(*keys, "_run")
        .agg(F.min(start).alias(start), F.max(stop).alias(stop))
        .drop("_run")
    )


def exclusion_mask(frames: DataFrame, exclusions: Sequence[tuple[int, int]]) -> DataFrame:
    """Bins inside an excluded band read one dB under the floor."""
    if not exclusions:
        return frames

    def masked(p: Column, i: Column) -> Column:
        freq = F.col("f0_hz") + F.col("bin_hz") * i
        hit = F.lit(False)
        for low, high in exclusions:
            hit = hit | ((freq >= low) & (freq <= high))
        return F.when(hit, F.col("floor_db") - 1.0).otherwise(p)

    return frames.withColumn("power_db", F.transform("power_db", masked))


def detect_regions(
    frames: DataFrame,
    threshold_db: float = P.THRESHOLD_DB,
    merge_gap_hz: Column | float | None = None,
    min_bandwidth_hz: float = 0.0,
) -> DataFrame:
    """Runs of bins at or above floor + threshold, one row per merged run.

    Works on each frame's array in place: no shuffle, and only the bins above the
    threshold are looked at after the first pass. The default gap is three bins.
    """
    power, step = F.col("power_db"), F.col("_bin")
    if merge_gap_hz is None:
        gap = F.lit(P.MERGE_GAP_BINS)
    else:
        hz = merge_gap_hz if isinstance(merge_gap_hz, Column) else F.lit(float(merge_gap_hz))
        gap = F.greatest(F.lit(0), rint_long(hz / step))
    level = F.col("floor_db") + F.lit(threshold_db)
    carried = [c for c in frames.columns if c != "power_db"]
    above = frames.withColumn(
        "_bin", F.when(F.abs("bin_hz") > 0, F.abs("bin_hz")).otherwise(F.lit(1.0))
    ).withColumn(
        "_above", F.filter(indices(F.size(power)), lambda i: F.get(power, i) >= level)
    )
    runs = above.filter(F.size("_above") > 0).withColumn(
        "_run", F.explode(runs_of(F.col("_above"), gap))
    )
    first, last = F.col("_run.start"), F.col("_run.stop")
    parts = runs.select(
        *carried,
        "_bin",
        first.alias("bin_start"),
        last.alias("bin_stop"),
        F.slice(power, first + 1, last - first + 1).alias("_part"),
    )
    peak = F.array_max("_part")
    linear = F.aggregate(
        "_part", F.lit(0.0), lambda acc, p: acc + F.pow(F.lit(10.0), p / 10.0)
    ) / F.size("_part")
    at = F.col("bin_start") + F.array_position("_part", peak).cast("int") - 1
    low = F.col("f0_hz") + F.col("bin_hz") * F.col("bin_start") - F.col("_bin") / 2
    high = F.col("f0_hz") + F.col("bin_hz") * F.col("bin_stop") + F.col("_bin") / 2
    kept = parts if min_bandwidth_hz <= 0 else parts.filter(high - low >= min_bandwidth_hz)
    return kept.select(
        *carried,
        rint_long(F.col("f0_hz") + F.col("bin_hz") * at).alias("center_hz"),
        rint_long(high - low).alias("bandwidth_hz"),
        F.round(peak, 3).alias("peak_power_db"),
        F.round(10.0 * F.log10(linear), 3).alias("avg_power_db"),
        F.round(peak - F.col("floor_db"), 3).alias("snr_db"),
        rint_long(low).alias("start_hz"),
        rint_long(high).alias("stop_hz"),
        "bin_start",
        "bin_stop",
    )


def in_band_regions(
    regions: DataFrame, start_hz: int = P.BAND_START_HZ, end_hz: int = P.BAND_END_HZ
) -> DataFrame:
    return regions.filter(F.col("center_hz").between(start_hz, end_hz))


WIDEBAND_REGION_COLUMNS = [
    "session_id",
    "segment_start",
    "frame_id",
    "frame_start",
    "center_hz",
    "peak_db",
    "peak_snr_db",
    "width_hz",
]


def occupied_bins(
    bin_noise: DataFrame, threshold_db: float = P.EVIDENCE_THRESHOLD_DB
) -> DataFrame:
    """Bins at or above their own floor + threshold; all others stay in their arrays."""
    hits = F.filter(
        F.transform(
            F.arrays_zip("power_db", "noise_db"),
            lambda z, i: F.struct(
                (F.col("first_bin") + i).alias("bin"),
                z["power_db"].alias("power_db"),
                z["noise_db"].alias("noise_db"),
            ),
        ),
        lambda b: b["power_db"] >= b["noise_db"] + F.lit(threshold_db),
    )
    return (
        bin_noise.withColumn("_hits", hits)
        .filter(F.size("_hits") > 0)
        .select(
            "session_id",
            "segment_start",
            "frame_id",
            "frame_start",
            "f0_hz",
            "bin_hz",
            F.explode("_hits").alias("_hit"),
        )
        .select(
            "session_id", "segment_start", "frame_id", "frame_start", "f0_hz", "bin_hz", "_hit.*"
        )
    )


def wideband_regions(
    bin_noise: DataFrame, threshold_db: float = P.EVIDENCE_THRESHOLD_DB
) -> DataFrame:
    """Contiguous occupied bins of one frame as measured regions.

    A frame's occupied bins meet in one small group, whose runs are cut with array
    functions: power-weighted centroid, SNR over the peak bin's own floor, and the
    width of the bins within 10 dB of the peak.
    """
    frame_keys = ["session_id", "segment_start", "frame_id", "frame_start", "f0_hz", "bin_hz"]
    frames = (
        occupied_bins(bin_noise, threshold_db)
        .groupBy(*frame_keys)
        .agg(
            F.sort_array(F.collect_list(F.struct("bin", "power_db", "noise_db"))).alias("_b"),
            F.sort_array(F.collect_list("bin")).alias("_places"),
        )
    )
    runs = frames.withColumn("_run", F.explode(runs_of(F.col("_places"), F.lit(0))))
    # Occupied bins are in order, so a run is a slice from the place of its first bin.
    first = F.array_position("_places", F.col("_run.start")).cast("int")
    size = (F.col("_run.stop") - F.col("_run.start") + 1).cast("int")
    parts = runs.select(*frame_keys, F.slice("_b", first, size).alias("_part"))
    peak = F.array_max(F.transform("_part", lambda b: b["power_db"]))
    lin = lambda b: F.pow(F.lit(10.0), b["power_db"] / 10.0)
    total = F.aggregate("_part", F.lit(0.0), lambda acc, b: acc + lin(b))
    weighted = F.aggregate(
        "_part",
        F.lit(0.0),
        lambda acc, b: acc + lin(b) * (F.col("f0_hz") + F.col("bin_hz") * b["bin"]),
    )
    measured = parts.withColumn("peak_db", peak)
    floor_at_peak = F.get(
        F.filter("_part", lambda b: b["power_db"] == F.col("peak_db")), F.lit(0)
    )["noise_db"]
    near = F.size(
        F.filter("_part", lambda b: b["power_db"] >= F.col("peak_db") - P.OCCUPIED_BW_DB)
    )
    return measured.select(
        "session_id",
        "segment_start",
        "frame_id",
        "frame_start",
        (weighted / total).alias("center_hz"),
        "peak_db",
        (F.col("peak_db") - floor_at_peak).alias("peak_snr_db"),
        (near * F.col("bin_hz")).alias("width_hz"),
    )
