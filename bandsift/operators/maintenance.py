"""Table upkeep, newest-first lists, alerts on change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandsift import params as P
from bandsift.operators.ordered import (
    attach,
    newest_per_key,
    number_chunk,
    time_chunk,
    with_running_sum,
)
from bandsift.runtime import cut_lineage


def newest_rows(table: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """Newest first, at most `limit` rows; a distributed top-k."""
    return table.orderBy(*[F.col(c).desc() for c in order]).limit(limit)


def events_since(events: DataFrame, since: str, limit: int = 200) -> DataFrame:
    start = F.lit(since).cast("timestamp")
    later = events.filter(F.col("ts") > start)
    if "date" in events.columns:
        later = later.filter(F.col("date") >= F.to_date(start))
    return newest_rows(later, ["event_id"], limit)


def recent_events(events: DataFrame, limit: int = 500) -> DataFrame:
    return newest_rows(events, ["ts", "event_id"], limit)


def channel_observations(
    detections: DataFrame,
    n: int = 200,
    keys: Sequence[str] = ("session_id", "channel_id"),
    chunk_s: int = P.CHUNK_S,
) -> DataFrame:
    """The n newest detections of every channel."""
    if n < 1:
        raise ValueError(f"n must be 1 or more, not {n}")
    return newest_per_key(
        detections, list(keys), ["detection_id"], n, time_chunk("ts", chunk_s)
    )


def metrics_history(
    metrics: DataFrame,
    n: int = 120,
    id_col: str = "sample_id",
    chunk_rows: int = 100_000,
) -> DataFrame:
    """Newest samples of every metric (metric, sample_id, value)."""
    return newest_per_key(metrics, ["metric"], [id_col], n, number_chunk(id_col, chunk_rows))


def timeline(
    channels: DataFrame,
    detections: DataFrame,
    as_of: str,
    window_s: int,
    max_channels: int = 16,
    per_channel: int = 300,
    chunk_s: int = P.CHUNK_S,
) -> DataFrame:
    """Newest detections of the most recently seen channels, placed in a time window."""
    key = ["session_id", "channel_id"]
    top = newest_rows(channels, ["last_seen", *key], max_channels).select(*key)
    newest = channel_observations(
        detections.join(top, key, "left_semi"), per_channel, chunk_s=chunk_s
    )
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    start = F.unix_millis(F.lit(as_of).cast("timestamp")) - window_s * 1000
    left = (at - start) / F.lit(window_s * 1000) * 100.0
    width = F.coalesce("duration_ms", F.lit(50.0)) / F.lit(window_s * 1000) * 100.0
    return (
        newest.filter(at >= start)
        .select(
            *key,
            "detection_id",
            left.alias("left_pct"),
            F.greatest(width, F.lit(0.4)).alias("width_pct"),
        )
        .filter(F.col("left_pct").between(0, 100))
    )


def merge_decodes(existing: DataFrame, fresh: DataFrame, limit: int | None = None) -> DataFrame:
    """Fresh decodes not yet present, with all existing ones; with `limit`, the newest of them."""
    new = fresh.join(existing.select("decode_id"), "decode_id", "left_anti")
    both = new.unionByName(existing)
    return both if limit is None else newest_rows(both, ["ts", "decode_id"], limit)


def channel_upsert(existing: DataFrame, updates: DataFrame, version: str) -> DataFrame:
    """Snapshot after updates: the newest row of each channel, old rows where untouched.

    Both sides are pre-aggregated to one row per channel before the shuffle.
    """
    key = ["session_id", "channel_id"]
    old = existing.withColumn("_new", F.lit(0)).withColumn(
        "_version", F.lit(None).cast(updates.schema[version].dataType)
    )
    new = updates.withColumn("_new", F.lit(1)).withColumn("_version", F.col(version))
    columns = [c for c in existing.columns if c not in key]
    both = old.unionByName(new.select(old.columns))
    row = F.max_by(F.struct(*columns), F.struct("_new", "_version")).alias("_row")
    return both.groupBy(*key).agg(row).select(*key, "_row.*").select(existing.columns)


def drop_merged_channels(channels: DataFrame, removed: DataFrame) -> DataFrame:
    return channels.join(
        removed.select("session_id", "channel_id"), ["session_id", "channel_id"], "left_anti"
    )


def retention_prune(table: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rows not older than the cutoff; of a table with dated folders, older ones aren't read."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    kept = table.filter(F.col("ts") >= cutoff)
    return kept.filter(F.col("date") >= F.to_date(cutoff)) if "date" in table.columns else kept


def retention_counts(tables: dict[str, DataFrame], as_of: str, days: int) -> DataFrame:
    """How many rows a prune removes from each table."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    counts = [
        df.agg(F.count_if(F.col("ts") < cutoff).alias("deleted")).select(
            F.lit(name).alias("table_name"), "deleted"
        )
        for name, df in tables.items()
    ]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def storage_cap_evict(
    recordings: DataFrame, cap_bytes: int, incoming_bytes: int, chunk_s: int = P.CHUNK_S
) -> DataFrame:
    """Captures kept when the oldest are deleted until the incoming one fits the cap.

    The size of everything from a capture onwards is a total minus a running sum, which
    is taken over time chunks.
    """
    total = recordings.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("_total"))
    running = with_running_sum(
        recordings.withColumn("_all", F.lit(0)),
        ["_all"],
        ["ts", "recording_id"],
        {"_through": F.col("bytes")},
        time_chunk("ts", chunk_s),
    )
    onwards = F.col("_total") - F.col("_through") + F.col("bytes")
    return (
        running.join(F.broadcast(total))
        .filter(onwards + incoming_bytes <= cap_bytes)
        .drop("_all", "_through", "_total")
    )


def recording_delete(recordings: DataFrame, ids: DataFrame) -> DataFrame:
    return recordings.join(ids.select("recording_id"), "recording_id", "left_anti")


def recording_bytes(recordings: DataFrame) -> DataFrame:
    return recordings.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))


def known_decodes(decodes: DataFrame) -> DataFrame:
    return decodes.filter("known")


def protocol_counts(decodes: DataFrame) -> DataFrame:
    return known_decodes(decodes).groupBy("protocol").agg(F.count(F.lit(1)).alias("decodes"))


def latest_only(
    messages: DataFrame,
    consumer: Sequence[str] = ("consumer",),
    droppable: Sequence[str] = ("spectrum", "scope"),
) -> DataFrame:
    """Keep the newest message of each droppable type per consumer, and all others."""
    stale = F.col("type").isin(list(droppable))
    rest = [c for c in messages.columns if c not in (*consumer, "type")]
    newest = (
        messages.filter(stale)
        .groupBy(*consumer, "type")
        .agg(F.max_by(F.struct(*rest), "seq").alias("_m"))
        .select(*consumer, "type", "_m.*")
        .select(messages.columns)
    )
    return messages.filter(~stale).unionByName(newest)


def activations(snapshots: DataFrame, chunk: Column) -> DataFrame:
    """Rows at which a channel turned active.

    `snapshots` has session_id, snapshot_seq, ts, channel_id, status and what rules need.
    A session's first snapshot only sets the baseline. A channel counts as new when it
    was missing from the preceding snapshot.
    """
    from bandsift.operators.ordered import with_previous

    seqs = snapshots.select("session_id", "snapshot_seq").distinct()
    order = ["snapshot_seq"]
    steps = with_previous(seqs, ["session_id"], order, ["snapshot_seq"], chunk).withColumnRenamed(
        "prev_snapshot_seq", "_step_before"
    )
    rows = with_previous(
        snapshots, ["session_id", "channel_id"], order, ["snapshot_seq", "status"], chunk
    )
    placed = attach(rows, steps, ["session_id", "snapshot_seq"], how="inner")
    was_active = F.coalesce(
        (F.col("prev_snapshot_seq") == F.col("_step_before"))
        & (F.col("prev_status") == "active"),
        F.lit(False),
    )
    return placed.filter(
        F.col("_step_before").isNotNull() & (F.col("status") == "active") & ~was_active
    ).drop("prev_snapshot_seq", "prev_status", "_step_before")


def activation_alerts(
    snapshots: DataFrame,
    rules: DataFrame,
    chunk: Column,
    debounce_s: int = 60,
) -> DataFrame:
    """Alerts for channels that turned active and match a rule, at most one per minute.

    Activations and matches are few next to the snapshots and used several times, so both
    are written to the shared folder.
    """
    from bandsift.operators.capture import throttle
    from bandsift.operators.ranges import alert_rule_match

    key = ["session_id", "channel_id", "snapshot_seq"]
    turned = cut_lineage(activations(snapshots, chunk))
    matched = alert_rule_match(turned, rules, keys=key)
    hits = attach(
        turned.select(*key, F.unix_micros("ts").alias("ts_us")),
        matched,
        key,
        how="inner",
    )
    return throttle(
        cut_lineage(hits),
        ["session_id", "channel_id"],
        "ts_us",
        "snapshot_seq",
        debounce_s * 1_000_000,
    )
