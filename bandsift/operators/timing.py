"""Burst timing per channel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandsift import params as P
from bandsift.operators.ordered import (
    attach,
    newest_per_key,
    time_chunk,
    with_neighbours,
    with_previous,
)

KEYS = ["session_id", "channel_id"]


def burst_sessions(
    arrivals: DataFrame,
    gap_s: float = P.BURST_GAP_S,
    max_arrivals: int = P.MAX_ARRIVALS,
    keys: Sequence[str] = KEYS,
    chunk_s: int = P.CHUNK_S,
    id_col: str = "detection_id",
) -> DataFrame:
    """Bursts among the newest arrivals of each channel; a longer gap starts a new one.

    One sort, the newest first, serves all windows: rows that start a burst stand for it, and nothing
    is grouped. Spark limits the rows of a channel before it shuffles them. `chunk_s` matters only
    where more arrivals are kept than Spark limits so.
    """
    # Rows without a key or time belong to no channel's history.
    rows = arrivals.select(*keys, "ts", id_col).dropna(subset=[*keys, "ts"])
    limit = int(arrivals.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if max_arrivals > limit:
        rows = newest_per_key(rows, keys, ["ts", id_col], max_arrivals, time_chunk("ts", chunk_s))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = rows.select(*keys, us.alias("_us"), F.col(id_col).alias("_id"))
    w = Window.partitionBy(*keys).orderBy(F.col("_us").desc(), F.col("_id").desc())
    kept = rows.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= max_arrivals)
    gap, whole = int(round(gap_s * 1e6)), Window.partitionBy(*keys)
    older, newer = F.lead("_us").over(w), F.lag("_us").over(w)
    edges = (
        kept.withColumn("_first", older.isNull() | (F.col("_us") - older > gap))
        .withColumn("_last", newer.isNull() | (newer - F.col("_us") > gap))
    )
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        edges.withColumn("_end_us", F.last(F.when(F.col("_last"), F.col("_us")), ignorenulls=True).over(so_far))
        .withColumn("_end_place", F.last(F.when(F.col("_last"), F.col("_place")), ignorenulls=True).over(so_far))
        .withColumn("_later", F.sum(F.col("_first").cast("int")).over(so_far))
        .withColumn("_all", F.sum(F.col("_first").cast("int")).over(whole))
    )
    return placed.filter("_first").select(
        *keys,
        (F.col("_all") - F.col("_later") + 1).alias("burst_seq"),
        F.col("_us").alias("start_us"),
        F.col("_end_us").alias("end_us"),
        (F.col("_place") - F.col("_end_place") + 1).cast("long").alias("arrivals"),
        ((F.col("_end_us") - F.col("_us")) / 1000.0).alias("duration_ms"),
    )


def recurrence_of_bursts(bursts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Median duration, median start-to-start interval and its spread.

    Windows in the order in which `burst_sessions` leaves its rows need no further sort, where an
    aggregate of medians would sort all bursts twice.
    """
    w, whole = Window.partitionBy(*keys).orderBy(F.col("start_us").desc()), Window.partitionBy(*keys)
    gaps = bursts.withColumn("_gap", (F.col("start_us") - F.lead("start_us").over(w)) / 1e6)
    found = gaps.select(
        *keys,
        F.row_number().over(w).alias("_place"),
        F.round(F.median("_gap").over(whole), 3).alias("recurrence_interval_s"),
        F.round(F.median("duration_ms").over(whole), 3).alias("typical_burst_ms"),
        F.count(F.lit(1)).over(whole).alias("burst_count"),
        F.when(F.count("_gap").over(whole) >= 2, F.round(F.stddev_pop("_gap").over(whole), 3)).alias(
            "interval_jitter_s"
        ),
    )
    return found.filter("_place = 1").drop("_place")


def recurrence_stats(
    arrivals: DataFrame,
    gap_s: float = P.BURST_GAP_S,
    max_arrivals: int = P.MAX_ARRIVALS,
    keys: Sequence[str] = KEYS,
    chunk_s: int = P.CHUNK_S,
) -> DataFrame:
    return recurrence_of_bursts(
        burst_sessions(arrivals, gap_s, max_arrivals, keys, chunk_s), keys
    )


def inter_arrival_gaps(
    detections: DataFrame, keys: Sequence[str] = KEYS, chunk_s: int = P.CHUNK_S
) -> DataFrame:
    """Seconds between consecutive detections of a channel."""
    rows = detections.select(
        *keys,
        "detection_id",
        "ts",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("_ms"),
    )
    before = with_previous(
        rows, keys, ["_ms", "detection_id"], ["_ms"], time_chunk("ts", chunk_s)
    )
    return before.filter("prev__ms is not null").select(
        *keys, "detection_id", "ts", ((F.col("_ms") - F.col("prev__ms")) / 1000.0).alias("gap_s")
    )


def gap_histogram(gaps: DataFrame, keys: Sequence[str] = KEYS, buckets: int = 10) -> DataFrame:
    """Equal-width gap counts per channel, as shares of the fullest bucket."""
    bounds = gaps.groupBy(*keys).agg(
        F.min("gap_s").alias("_min"),
        F.max("gap_s").alias("_max"),
        F.least(F.lit(buckets), F.count(F.lit(1))).cast("int").alias("_buckets"),
    )
    width = F.when(F.col("_max") > F.col("_min"), F.col("_max") - F.col("_min")).otherwise(1.0)
    place = F.floor((F.col("gap_s") - F.col("_min")) / width * F.col("_buckets")).cast("int")
    counts = (
        attach(gaps, bounds, keys, how="inner")
        .withColumn("bucket", F.least(place, F.col("_buckets") - 1))
        .groupBy(*keys, "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    dense = bounds.select(
        *keys, F.explode(F.sequence(F.lit(0), F.col("_buckets") - 1)).alias("bucket")
    )
    filled = attach(dense, counts, [*keys, "bucket"]).withColumn(
        "n", F.coalesce("n", F.lit(0).cast("bigint"))
    )
    peak = F.max("n").over(Window.partitionBy(*keys))
    return filled.withColumn("share", F.col("n") / peak)


def power_trend(
    detections: DataFrame, keys: Sequence[str] = KEYS, chunk_s: int = P.CHUNK_S
) -> DataFrame:
    """Peak power over time, scaled per channel: x in 0..100 by order, y in 0..1."""
    from bandsift.operators.ordered import with_position

    rows = detections.select(*keys, "detection_id", "ts", "peak_power_db")
    bounds = rows.groupBy(*keys).agg(
        F.min("peak_power_db").alias("_min"),
        F.max("peak_power_db").alias("_max"),
        F.count(F.lit(1)).alias("_n"),
    )
    placed = with_position(
        attach(rows, bounds, keys, how="inner"),
        keys,
        ["ts", "detection_id"],
        time_chunk("ts", chunk_s),
        "_i",
    )
    span = F.when(F.col("_max") > F.col("_min"), F.col("_max") - F.col("_min")).otherwise(1.0)
    return placed.select(
        *keys,
        "detection_id",
        F.when(F.col("_n") <= 1, F.lit(100.0))
        .otherwise((F.col("_i") - 1) / (F.col("_n") - 1) * 100.0)
        .alias("x_pct"),
        ((F.col("peak_power_db") - F.col("_min")) / span).alias("y_scaled"),
    )


def next_expected(channels: DataFrame, as_of: Column) -> DataFrame:
    """When each channel should transmit next, or for how long it has been missing."""
    from bandsift.functions.channels import next_expected as expected

    return channels.select(
        *KEYS, *expected(F.col("last_seen"), F.col("recurrence_interval_s"), as_of)
    )


def status_decay(
    sightings: DataFrame,
    as_of: Column,
    keys: Sequence[str] = KEYS,
    chunk_s: int = P.CHUNK_S,
    id_col: str = "detection_id",
) -> DataFrame:
    """Status changes of every channel as time passes, up to `as_of`.

    A sighting activates a channel that was not active; it stops being active after three
    seconds without another and recent after thirty.
    """
    us = "_us"
    rows = sightings.select(*keys, id_col, "ts", F.unix_micros("ts").alias(us))
    chunk = time_chunk("ts", chunk_s)
    order = [us, id_col]
    near = with_neighbours(rows, keys, order, [us], chunk)
    active, recent = int(P.ACTIVE_AGE_S * 1e6), int(P.RECENT_AGE_S * 1e6)
    until = F.coalesce(F.col(f"next_{us}"), F.unix_micros(as_of))
    silent = until - F.col(us)

    def change(when: Column, at: Column, status: str) -> Column:
        return F.when(when, F.struct(at.alias("at"), F.lit(status).alias("status")))

    before = F.col(f"prev_{us}")
    changes = F.array_compact(
        F.array(
            change(before.isNull() | (F.col(us) - before > active), F.col(us), "active"),
            change(silent > active, F.col(us) + active, "recently_active"),
            change(silent > recent, F.col(us) + recent, "inactive"),
        )
    )
    return near.select(*keys, F.explode(changes).alias("_c")).select(
        *keys, F.timestamp_micros("_c.at").alias("ts"), F.col("_c.status").alias("status")
    )
