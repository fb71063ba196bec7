"""Per-channel scores and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bandsift import params as P
from bandsift.functions.time import age_s


def confidence(observations: Column, interval_s: Column, jitter_s: Column) -> Column:
    """Observation count and cadence regularity blended into 0..1."""
    seen = F.least(F.lit(1.0), observations / F.lit(20.0))
    ratio = F.least(F.lit(1.0), jitter_s / F.greatest(interval_s, F.lit(1e-6)))
    regular = F.when(
        interval_s.isNotNull() & (interval_s != 0) & jitter_s.isNotNull(),
        F.greatest(F.lit(0.0), F.lit(1.0) - ratio),
    ).otherwise(F.lit(0.0))
    return F.round(F.least(F.lit(1.0), seen * 0.6 + regular * 0.4 + F.lit(0.05)), 4)


def status(last_seen: Column, as_of: Column) -> Column:
    age = age_s(last_seen, as_of)
    return (
        F.when(last_seen.isNull(), F.lit("inactive"))
        .when(age <= P.ACTIVE_AGE_S, F.lit("active"))
        .when(age <= P.RECENT_AGE_S, F.lit("recently_active"))
        .otherwise(F.lit("inactive"))
    )


def fingerprint(
    center_hz: Column,
    bandwidth_hz: Column,
    burst_ms: Column,
    peak_db: Column,
    floor_db: Column,
    interval_s: Column,
    envelope: Column | None = None,
    dwell_ms: int = P.DWELL_MS,
) -> Column:
    """Non-identifying shape descriptor; a flat envelope without samples."""
    duration = F.when(burst_ms.isNull() | (burst_ms == 0), F.lit(float(dwell_ms))).otherwise(
        burst_ms
    )
    return F.struct(
        center_hz.cast("bigint").alias("center_hz"),
        bandwidth_hz.cast("bigint").alias("bandwidth_hz"),
        F.round(duration, 3).alias("duration_ms"),
        F.round(peak_db - floor_db, 3).alias("rel_strength_db"),
        interval_s.cast("double").alias("repetition_interval_s"),
        (envelope if envelope is not None else F.array_repeat(F.lit(1.0), 16)).alias("envelope"),
    )


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def _cadence(interval_s: Column) -> Column:
    return _finite(interval_s.cast("double"))


def _narrow(bandwidth_hz: Column) -> Column:
    return (bandwidth_hz > 0) & (bandwidth_hz < P.NARROWBAND_MAX_HZ)


def _short(burst_ms: Column) -> Column:
    return _finite(burst_ms.cast("double")) & (burst_ms < P.SHORT_BURST_MAX_MS)


def pattern_score(
    interval_s: Column, bandwidth_hz: Column, burst_ms: Column, observations: Column
) -> Column:
    """How much a channel looks like short, narrow, regular, repeated transmissions."""
    zero = F.lit(0.0)
    return (
        F.when(_cadence(interval_s), F.lit(0.35)).otherwise(zero)
        + F.when(_narrow(bandwidth_hz), F.lit(0.25)).otherwise(zero)
        + F.when(_short(burst_ms), F.lit(0.2)).otherwise(zero)
        + F.when(observations >= P.REPEAT_MIN_OBS, F.lit(0.2)).otherwise(zero)
    )


def pattern_label(score: Column) -> Column:
    return (
        F.when(score >= 0.7, F.lit("strong"))
        .when(score >= 0.4, F.lit("moderate"))
        .otherwise(F.lit("weak"))
    )


def pattern_reasons(
    interval_s: Column, bandwidth_hz: Column, burst_ms: Column, observations: Column
) -> Column:
    return F.array_compact(
        F.array(
            F.when(_cadence(interval_s), F.lit("regular cadence")),
            F.when(_narrow(bandwidth_hz), F.lit("narrowband")),
            F.when(_short(burst_ms), F.lit("short bursts")),
            F.when(observations >= P.REPEAT_MIN_OBS, F.lit("repeatedly seen")),
        )
    )


def cadence_verdict(interval_s: Column, observations: Column) -> Column:
    return (
        F.when(interval_s.isNotNull() & (observations >= 4), F.lit("regular"))
        .when(interval_s.isNotNull() & (observations >= 2), F.lit("emerging"))
        .otherwise(F.lit("irregular"))
    )


def relative_difference(x: Column, y: Column) -> Column:
    """0..1; one missing value is the largest difference, two missing are no evidence."""
    scale = F.greatest(F.abs(x), F.abs(y))
    diff = F.when(scale == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.abs(x - y) / F.nullif(scale.cast("double"), F.lit(0.0)))
    )
    return (
        F.when(x.isNull() & y.isNull(), F.lit(None).cast("double"))
        .when(x.isNull() | y.isNull(), F.lit(1.0))
        .otherwise(diff)
    )


def similarity(pairs: list[tuple[Column, Column]]) -> Column:
    """1 minus the mean relative difference over the features either side has."""
    diffs = F.array_compact(F.array(*[relative_difference(x, y) for x, y in pairs]))
    total = F.aggregate(diffs, F.lit(0.0), lambda acc, d: acc + d)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - total / F.size(diffs)))


def next_expected(last_seen: Column, interval_s: Column, as_of: Column) -> list[Column]:
    """State and seconds of the next expected transmission; halves round up."""
    half_up = lambda v: F.floor(v + 0.5).cast("bigint")
    silent_s = age_s(last_seen, as_of)
    due_in = half_up(interval_s - silent_s)
    known = interval_s.isNotNull() & last_seen.isNotNull()
    state = (
        F.when(~known, F.lit("unknown"))
        .when(due_in >= 0, F.lit("due"))
        .when(silent_s > F.greatest(F.lit(60.0), interval_s * 3), F.lit("silent"))
        .otherwise(F.lit("overdue"))
    )
    seconds = (
        F.when(state == "due", due_in)
        .when(state == "silent", half_up(silent_s))
        .when(state == "overdue", -due_in)
    )
    return [state.alias("state"), seconds.alias("seconds")]


def nearest_grid_index(freq_hz: Column) -> Column:
    """Nearest of the fifteen grid channels; the lower one on a tie."""
    place = (freq_hz - F.lit(P.GRID_FIRST_HZ)) / F.lit(P.GRID_STEP_HZ)
    low = F.floor(place)
    nearest = F.when(place - low > 0.5, low + 1).otherwise(low)
    return F.least(F.greatest(nearest, F.lit(0)), F.lit(P.GRID_CHANNELS - 1)).cast("int")


def grid_frequency(index: Column) -> Column:
    return F.lit(P.GRID_FIRST_HZ) + index.cast("bigint") * P.GRID_STEP_HZ
