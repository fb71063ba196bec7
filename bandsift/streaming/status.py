"""Channel status over time, alerts, and streaming aggregates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandsift import params as P
from bandsift.operators.maintenance import latest_only
from bandsift.operators.occupancy import band_cells
from bandsift.operators.ordered import columns_of
from bandsift.operators.ranges import rule_holds
from bandsift.streaming.buffer import LATENESS, LiveFold, in_order

STATUS_SCHEMA = "session_id BIGINT, channel_id BIGINT, at_us BIGINT, status STRING"

#: What follows a sighting, and after how long (us).
DECAY = [("recently_active", int(P.ACTIVE_AGE_S * 1e6)), ("inactive", int(P.RECENT_AGE_S * 1e6))]


class StatusFold(LiveFold):
    """Last sighting of a channel, and how many steps of decay it has gone through since."""

    STATE = "last BIGINT, steps INT"

    def __init__(self, key: tuple):
        super().__init__(key)
        self.last: int | None = None
        self.steps = 0

    def saved(self) -> tuple:
        return self.last, self.steps

    def restore(self, state: tuple) -> None:
        self.last, self.steps = state

    def due(self) -> int | None:
        left = DECAY[self.steps :] if self.last is not None else []
        return self.last + left[0][1] if left else None

    def advance(self, now_us: int) -> list[tuple]:
        out = []
        while (due := self.due()) is not None and due < now_us:
            out.append((*self.key, due, DECAY[self.steps][0]))
            self.steps += 1
        return out

    def step(self, rows: pa.RecordBatch) -> list[tuple]:
        out = []
        for (at,) in columns_of(rows, ["us"]):
            out += self.advance(at)
            if self.last is None or self.steps:
                out.append((*self.key, at, "active"))
            self.last, self.steps = at, 0
        return out


def live_status(
    sightings: DataFrame, closing: DataFrame | None = None, lateness: str = LATENESS
) -> DataFrame:
    """Streaming `status_decay` of sightings (session_id, channel_id, detection_id, ts).

    A channel that falls silent decays by timers; `closing` gives the time up to which it does.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    out = in_order(
        sightings.select("session_id", "channel_id", us.alias("us"), "detection_id"),
        ["session_id", "channel_id"],
        ["us", "detection_id"],
        F.timestamp_micros("us"),
        StatusFold,
        STATUS_SCHEMA,
        closing,
        lateness,
    )
    return out.withColumn("ts", F.timestamp_micros("at_us")).drop("at_us")


#: Stands for no rule, behind all others.
_LAST = (1 << 63) - 1

ALERT_SCHEMA = "session_id BIGINT, channel_id BIGINT, ts_us BIGINT, snapshot_seq BIGINT, rule_id BIGINT"


class AlertFold(LiveFold):
    """Status of the channels of one session in its last snapshot, and when each last gave an alert.

    Rows come in order of snapshots. The first snapshot sets the baseline. A channel that the snapshot
    before didn't have counts as new, whatever it was earlier; so channels that are absent are forgotten
    with the next snapshot, and an alert is forgotten once it can't hold back another.
    """

    STATE = (
        "seq BIGINT, before BIGINT, active ARRAY<BIGINT>, was_active ARRAY<BIGINT>, "
        "alerts ARRAY<STRUCT<channel_id BIGINT, ts_us BIGINT>>, place STRUCT<seq BIGINT, channel_id BIGINT>"
    )

    def __init__(self, key: tuple, interval_us: int):
        super().__init__(key)
        self.interval_us = interval_us
        self.seq: int | None = None
        self.before: int | None = None
        self.active: set[int] = set()
        self.was_active: set[int] = set()
        self.alerts: dict[int, int] = {}
        self.place: tuple | None = None

    def saved(self) -> tuple:
        return self.seq, self.before, sorted(self.active), sorted(self.was_active), sorted(self.alerts.items()), self.place

    def restore(self, state: tuple) -> None:
        self.seq, self.before, active, was_active, alerts, self.place = state
        self.active, self.was_active, self.alerts = set(active), set(was_active), dict(alerts)

    def step(self, rows: pa.RecordBatch) -> list[tuple]:
        out = []
        names = ["snapshot_seq", "channel_id", "ts_us", "status", "rule_id"]
        for seq, channel, now, status, rule in columns_of(rows, names):
            if (seq, channel) == self.place:
                continue  # only the first rule counts
            self.place = (seq, channel)
            if seq != self.seq:
                self.before, self.seq = self.seq, seq
                self.was_active, self.active = self.active, set()
                self.alerts = {c: t for c, t in self.alerts.items() if now - t < self.interval_us}
            if status != "active":
                continue
            self.active.add(channel)
            fresh = self.before is not None and channel not in self.was_active
            due = self.alerts.get(channel, now - self.interval_us) + self.interval_us
            if fresh and rule != _LAST and now >= due:
                self.alerts[channel] = now
                out.append((self.key[0], channel, now, seq, rule))
        return out


def with_rules(rows: DataFrame, rules: DataFrame, bucket_hz: int = 100_000, most_buckets: int = 64) -> DataFrame:
    """Each row (of a stream or not) with every enabled rule that it satisfies, at least once without.

    Rules meet rows by buckets of frequency, and those without both bounds, or wide ones, in one bucket
    for all; a row looks into both. So this is an equi join whatever the number of rules.
    """
    everywhere = F.lit(-1).cast("bigint")
    low, high = (F.floor(F.col(c) * 1e6 / bucket_hz) for c in ("freq_lo_mhz", "freq_hi_mhz"))
    bounded = F.col("freq_lo_mhz").isNotNull() & F.col("freq_hi_mhz").isNotNull()
    buckets = (
        F.when(bounded & (high < low), F.array().cast("array<bigint>"))
        .when(bounded & (high - low < most_buckets), F.sequence(low, high))
        .otherwise(F.array(everywhere))
    )
    spread = rules.filter("enabled").withColumn("_at", F.explode(buckets)).drop("enabled")
    own = rows.withColumn("_bucket", F.explode(F.array(F.floor(F.col("center_hz") / bucket_hz), everywhere)))
    return own.join(spread, (F.col("_bucket") == F.col("_at")) & rule_holds(), "left").drop("_bucket", "_at")


def live_alerts(
    snapshots: DataFrame,
    rules: DataFrame,
    debounce_s: int = 60,
    closing: DataFrame | None = None,
    lateness: str = LATENESS,
) -> DataFrame:
    """Streaming `activation_alerts`: channels that turned active and satisfy a rule, with the rule.

    `snapshots` has a row for each channel of a snapshot. Rules are tested on each row by a join with
    no state; baseline, transitions and the debounce are state.
    """
    slim = with_rules(snapshots, rules).select(
        "session_id",
        "snapshot_seq",
        "channel_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        "status",
        F.coalesce("rule_order", F.lit(_LAST)).alias("rule_order"),
        F.coalesce("rule_id", F.lit(_LAST)).alias("rule_id"),
    )
    return in_order(
        slim,
        ["session_id"],
        ["snapshot_seq", "channel_id", "rule_order", "rule_id"],
        F.timestamp_micros("ts_us"),
        lambda key: AlertFold(key, debounce_s * 1_000_000),
        ALERT_SCHEMA,
        closing,
        lateness,
    )


def live_occupancy(
    detections: DataFrame,
    bucket_seconds: int = 30,
    freq_bins: int = 96,
    start_hz: int = P.BAND_START_HZ,
    end_hz: int = P.BAND_END_HZ,
    lateness: str = "1 minute",
) -> DataFrame:
    """Detections per tumbling window and frequency bin."""
    place = ((F.col("center_hz") - start_hz) / F.lit(end_hz - start_hz) * freq_bins).cast("int")
    return (
        detections.withWatermark("ts", lateness)
        .withColumn("freq_bin", place)
        .filter(F.col("freq_bin").between(0, freq_bins - 1))
        .groupBy(F.window("ts", f"{bucket_seconds} seconds"), "freq_bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("bucket_start"), "freq_bin", "n")
    )


def live_band(
    frames: DataFrame,
    bins: int = P.SPECTRUM_BINS,
    start_hz: int = P.BAND_START_HZ,
    end_hz: int = P.BAND_END_HZ,
) -> DataFrame:
    """Stitched band as an update-mode aggregate: latest value per (session, bin)."""
    return (
        band_cells(frames, bins, start_hz, end_hz)
        .groupBy("session_id", "band_bin")
        .agg(F.max_by("v", "frame_seq").alias("power_db"))
    )


def send_latest(messages: DataFrame, send, checkpoint: str):
    """Per micro-batch, hand each consumer only the newest droppable messages."""
    return (
        messages.writeStream.foreachBatch(lambda df, batch: send(latest_only(df), batch))
        .option("checkpointLocation", checkpoint)
    )

