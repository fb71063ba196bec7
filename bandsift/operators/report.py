"""Survey reports, exports and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandsift.functions.time import iso_ts
from bandsift.operators.channels import pattern_score
from bandsift.operators.maintenance import protocol_counts


def survey_report(channels: DataFrame, sessions: DataFrame, decodes: DataFrame) -> DataFrame:
    """Report rows: section, item, channel columns where they apply, and a count."""
    nothing = [
        F.lit(None).cast(t).alias(c)
        for c, t in (
            ("center_hz", "bigint"),
            ("snr_db", "double"),
            ("score", "double"),
            ("label", "string"),
        )
    ]

    def total(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("summary").alias("section"), F.lit(name).alias("item"), *nothing, "n"
        )

    scored = pattern_score(channels).select(
        F.lit("channel").alias("section"),
        F.col("channel_id").cast("string").alias("item"),
        "center_hz",
        "snr_db",
        F.round("pattern_score", 6).alias("score"),
        F.col("pattern_label").alias("label"),
        F.col("observation_count").cast("bigint").alias("n"),
    )
    protocols = protocol_counts(decodes).select(
        F.lit("protocol").alias("section"),
        F.col("protocol").alias("item"),
        *nothing,
        F.col("decodes").alias("n"),
    )
    return (
        total(channels, "channels")
        .unionByName(total(channels.filter("status = 'active'"), "active"))
        .unionByName(total(sessions, "sessions"))
        .unionByName(scored)
        .unionByName(protocols)
    )


def ordered_report(report: DataFrame) -> DataFrame:
    """Sections in order; channels by score, strongest first."""
    place = (
        F.when(F.col("section") == "summary", 0)
        .when(F.col("section") == "channel", 1)
        .otherwise(2)
    )
    return report.orderBy(place, F.col("score").desc_nulls_last(), "item")


#: Row limits for interactive use; an export has none unless it is given.
EXPORT_LIMITS = {"channels": 10_000, "detections": 50_000, "events": 50_000}


def flatten_nested(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, timestamps as ISO text; other columns as they are."""
    out = []
    for field in rows.schema.fields:
        kind = field.dataType
        col = F.col(field.name)
        if isinstance(kind, T.StructType | T.ArrayType | T.MapType):
            col = F.to_json(col)
        elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
            col = iso_ts(col)
        out.append(col.alias(field.name))
    return rows.select(*out)


def export_rows(rows: DataFrame, kind: str, order: list[str], limit: int | None = None) -> DataFrame:
    """Rows of an export: all of them, or the first `limit` in the order of the kind."""
    if kind not in EXPORT_LIMITS:
        raise ValueError("kind must be one of: " + ", ".join(EXPORT_LIMITS))
    ordered = order and [F.col(c).desc() for c in order]
    if kind == "channels":
        ordered = [F.col(c) for c in order]
    chosen = rows.orderBy(*ordered).limit(limit) if limit is not None else rows
    return flatten_nested(chosen)


def event_log(
    candidates: DataFrame, captures: DataFrame, removed_channels: DataFrame
) -> DataFrame:
    """Events the pipeline reports: candidates, captures, merges (session, kind, data)."""

    def events(df: DataFrame, kind: str, message) -> DataFrame:
        return df.select(
            "session_id",
            F.lit(kind).alias("kind"),
            message.alias("message"),
            F.to_json(F.struct(*df.columns)).alias("data"),
        )

    found = events(
        candidates.select(
            "session_id", "freq_hz", "bandwidth_hz", "duration_ms", "peak_snr_db",
            "candidate_reasons",
        ),
        "candidate",
        F.format_string("candidate f=%d bw=%dHz", F.col("freq_hz"), F.col("bandwidth_hz")),
    )
    saved = events(
        captures.filter("capture_end is not null").select(
            "session_id", "capture_start", "capture_end", "triggers"
        ),
        "capture",
        F.format_string("%d candidate burst(s)", F.size("triggers")),
    )
    merged = events(
        removed_channels.select("session_id", "channel_id", "merged_into"),
        "channel_merged",
        F.format_string("channel %d joined %d", F.col("channel_id"), F.col("merged_into")),
    )
    return found.unionByName(saved).unionByName(merged)
