"""Candidate-channel tables: models, filters, ranking, summaries, comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandsift import params as P
from bandsift.functions import channels as C
from bandsift.operators.ordered import attach


def channel_model(
    states: DataFrame,
    recurrence: DataFrame,
    floors: DataFrame,
    as_of: Column,
    dwell_ms: int = P.DWELL_MS,
) -> DataFrame:
    """Cluster state, recurrence and current floor joined into channel rows.

    `floors` has one row per session: session_id, floor_db.
    """
    joined = attach(
        attach(states, recurrence, ["session_id", "channel_id"]), floors, ["session_id"]
    )
    return joined.select(
        *states.columns,
        "typical_burst_ms",
        "recurrence_interval_s",
        C.confidence(
            F.col("observation_count"), F.col("recurrence_interval_s"), F.col("interval_jitter_s")
        ).alias("confidence"),
        C.status(F.col("last_seen"), as_of).alias("status"),
        C.fingerprint(
            F.col("center_hz"),
            F.col("bandwidth_hz"),
            F.col("typical_burst_ms"),
            F.col("peak_power_db"),
            F.col("floor_db"),
            F.col("recurrence_interval_s"),
            dwell_ms=dwell_ms,
        ).alias("fingerprint"),
    )


def channel_filter(
    channels: DataFrame,
    freq_lo_mhz: float | None = None,
    freq_hi_mhz: float | None = None,
    min_snr: float | None = None,
    min_confidence: float | None = None,
    status: str | None = None,
) -> DataFrame:
    """Inclusive bounds; an absent one does not filter."""
    out = channels
    if freq_lo_mhz is not None:
        out = out.filter(F.col("center_hz") >= freq_lo_mhz * 1e6)
    if freq_hi_mhz is not None:
        out = out.filter(F.col("center_hz") <= freq_hi_mhz * 1e6)
    if min_snr is not None:
        out = out.filter(F.col("snr_db") >= min_snr)
    if min_confidence is not None:
        out = out.filter(F.col("confidence") >= min_confidence)
    if status:
        out = out.filter(F.col("status") == status)
    return out


def _pattern_args() -> list[Column]:
    return [
        F.col(c)
        for c in ("recurrence_interval_s", "bandwidth_hz", "typical_burst_ms", "observation_count")
    ]


def pattern_score(channels: DataFrame) -> DataFrame:
    """Add `pattern_score`, `pattern_label` and `pattern_reasons`."""
    scored = channels.withColumn("pattern_score", C.pattern_score(*_pattern_args()))
    return scored.withColumn(
        "pattern_label", C.pattern_label(F.col("pattern_score"))
    ).withColumn("pattern_reasons", C.pattern_reasons(*_pattern_args()))


def rank_by_pattern(channels: DataFrame) -> DataFrame:
    return pattern_score(channels).orderBy(F.col("pattern_score").desc(), "channel_id")


def top_candidates(channels: DataFrame, n: int = 3) -> DataFrame:
    return rank_by_pattern(channels).limit(n)


def channels_list(channels: DataFrame, limit: int = 500) -> DataFrame:
    return channels.orderBy("center_hz", "channel_id").limit(limit)


SORT_KEYS = (
    "channel_id", "center_hz", "bandwidth_hz", "current_power_db", "peak_power_db",
    "avg_power_db", "snr_db", "observation_count", "first_seen", "last_seen",
    "typical_burst_ms", "recurrence_interval_s", "confidence", "status",
)


def _sort_order(key: str, ascending: bool) -> Column:
    if key not in SORT_KEYS:
        raise ValueError(f"cannot sort channels by {key!r}")
    return F.col(key).asc_nulls_first() if ascending else F.col(key).desc_nulls_last()


def sort_channels(channels: DataFrame, key: str, ascending: bool = True) -> DataFrame:
    """Missing values lead an ascending sort and end a descending one."""
    return channels.orderBy(_sort_order(key, ascending), "channel_id")


def pins_join(channels: DataFrame, pins: DataFrame) -> DataFrame:
    """Channels with their pin and label; pins that say nothing are dropped."""
    key = ["session_id", "channel_id"]
    said = pins.filter(F.col("pinned") | (F.col("label") != "")).select(*key, "pinned", "label")
    return attach(channels, said, key).withColumn(
        "pinned", F.coalesce("pinned", F.lit(False))
    ).withColumn("label", F.coalesce("label", F.lit("")))


def pinned_first(pinned: DataFrame, key: str, ascending: bool = True) -> DataFrame:
    """Pinned channels on top, the chosen sort inside both groups."""
    return pinned.orderBy(
        F.col("pinned").desc(), _sort_order(key, ascending), "channel_id"
    )


def avg_power_norm(channels: DataFrame) -> DataFrame:
    """Average power scaled to 0..1 over the whole set; 0.5 when flat."""
    bounds = channels.agg(
        F.min("avg_power_db").alias("_min"), F.max("avg_power_db").alias("_max")
    )
    span = F.col("_max") - F.col("_min")
    scaled = F.when(span > 0, (F.col("avg_power_db") - F.col("_min")) / span).otherwise(0.5)
    return (
        channels.join(F.broadcast(bounds))
        .withColumn("avg_norm", F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)))
        .drop("_min", "_max")
    )


def channel_summary(channels: DataFrame) -> DataFrame:
    """Total, active and the strongest channel by peak; the lowest id on a tie."""
    best = F.max_by("channel_id", F.struct("peak_power_db", -F.col("channel_id")))
    return channels.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "active").alias("active"),
        best.alias("strongest_channel_id"),
        F.max("peak_power_db").alias("strongest_peak_db"),
    )


def status_summary(channels: DataFrame) -> DataFrame:
    """Total, active, the strongest channel by current power, and the latest sighting."""
    power = F.coalesce("current_power_db", F.lit(-999.0))
    rank = F.struct(power, -F.col("channel_id"))
    return channels.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.max_by("center_hz", rank).alias("strongest_hz"),
        F.max(power).alias("strongest_power_db"),
        F.max_by("snr_db", rank).alias("strongest_snr_db"),
        F.max("last_seen").alias("last_detection"),
    )


_FEATURES = ("bandwidth_hz", "snr_db", "typical_burst_ms", "recurrence_interval_s")


def channel_similarity(channels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Similarity of chosen pairs (session_id, channel_a, channel_b) of a session; never all pairs."""
    side = lambda s: channels.select(
        "session_id",
        F.col("channel_id").alias(f"channel_{s}"),
        *[F.col(f).alias(f"{f}_{s}") for f in _FEATURES],
    )
    both = pairs.select("session_id", "channel_a", "channel_b")
    for s in "ab":
        both = attach(both, side(s), ["session_id", f"channel_{s}"], how="inner")
    score = C.similarity([(F.col(f"{f}_a"), F.col(f"{f}_b")) for f in _FEATURES])
    return both.select("session_id", "channel_a", "channel_b", score.alias("score")).withColumn(
        "verdict", F.when(F.col("score") >= 0.8, F.lit("similar")).otherwise(F.lit("different"))
    )


def rows_by_id(table: DataFrame, column: str, ids: Sequence[int] | DataFrame) -> DataFrame:
    """Rows with the given ids; a table of ids is matched by a semi join."""
    if isinstance(ids, DataFrame):
        return table.join(ids.select(column).distinct(), column, "left_semi")
    return table.filter(F.col(column).isin(list(ids)))


def status_at(channels: DataFrame, as_of: Column) -> DataFrame:
    return channels.withColumn("status", C.status(F.col("last_seen"), as_of))
