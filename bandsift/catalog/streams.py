"""Streaming forms, run over all files and compared with the batch result, and file sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandsift import params as P
from bandsift.catalog import folded
from bandsift.catalog.bindings import AS_OF
from bandsift.catalog.evidence import _ACQUIRED, _THROTTLE, META
from bandsift.catalog.registry import query
from bandsift.catalog.spectrum import FLOORS
from bandsift.operators import acquisition, cluster, occupancy, timing, tracks
from bandsift.plans import daily
from bandsift.runtime import shared_folder
from bandsift.sources import sigmf, tables, text
from bandsift.streaming import folds, status


def _ends(rows, keys, time):
    """When each key is over: with its last row."""
    return rows.groupBy(*keys).agg(F.max(time).alias("ts"))


@query(f"WITH {FLOORS} SELECT session_id, frame_seq, round(floor_db, 6) AS floor_db FROM floors")
def live_ema(t):
    frames, late = t.out_of_order("psd_frames", "unix_micros(ts)")
    ends = _ends(t.psd_frames, ["session_id"], F.col("ts"))
    return t.drained_to_end(
        lambda closing: folds.live_ema(frames, closing=closing, lateness=late), ends
    ).withColumn("floor_db", F.round("floor_db", 6))


_ASSIGNED = f"WITH RECURSIVE {folded.clusters('band_regions', P.PROXIMITY_HZ)} {folded.ASSIGNED}"
_TRACKED = f"WITH RECURSIVE {folded.tracks('frame_regions')} SELECT * FROM tracked"


def _plain_times(rows):
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "first_ts")})


@query(_ASSIGNED)
def cluster_regions(t):
    return _plain_times(cluster.cluster_regions(t.band_regions))


@query(_ASSIGNED)
def cluster_days(t):
    """Week by week, each from the state of the week before; the last week comes later."""
    rows = daily.cluster_rows(t.band_regions).withColumn("date", F.to_date(F.date_trunc("week", F.timestamp_micros("ts_us"))))
    fold = daily.daily_clusters(t.spark, shared_folder(t.spark, "clusters"))
    last = rows.agg(F.max("date")).first()[0]
    fold.update(rows.filter(F.col("date") < F.lit(last)))
    fold.update(rows)
    out = fold.results().withColumn("ts", F.timestamp_micros("ts_us")).withColumn("first_ts", F.timestamp_micros("first_us"))
    return _plain_times(out.drop("ts_us", "first_us"))


@query(_ASSIGNED)
def live_clusters(t):
    regions, late = t.out_of_order("band_regions", "unix_micros(ts)")
    ends = _ends(t.band_regions, ["session_id"], F.col("ts"))
    return _plain_times(
        t.drained_to_end(
            lambda closing: folds.live_clusters(regions, closing=closing, lateness=late), ends
        )
    )


@query(_TRACKED)
def track_regions(t):
    return tracks.track_regions(t.frame_regions)


@query(_TRACKED)
def live_tracks(t):
    """Frames of the given tables are 2048 samples at 2048 samples a second."""
    regions, late = t.out_of_order("frame_regions", "frame_id * 1000000")
    keys = ["session_id", "segment_start"]
    ends = _ends(t.frame_regions, keys, F.timestamp_seconds("frame_id"))
    return t.drained_to_end(
        lambda closing: folds.live_tracks(
            regions, sample_rate=2048, closing=closing, lateness=late
        ),
        ends,
    )


@query(_THROTTLE.format(gap=36_000_000_000))
def live_throttle(t):
    found, late = t.out_of_order("detections", "unix_micros(ts)")
    keys = ["session_id", "channel_id"]
    rows = found.withColumn("ts_us", F.unix_micros("ts"))
    kept = t.drained_to_end(
        lambda closing: folds.live_throttle(
            rows, keys, "ts_us", "detection_id", 36_000_000_000, closing, late
        ),
        _ends(t.detections, keys, F.col("ts")),
    )
    return kept.drop("ts_us")


@query(
    f"""WITH {META} SELECT session_id, start_sample, end_sample, segment_start, coalesce(before <> start_sample, false) AS is_gap,
      CASE WHEN before <> start_sample THEN greatest(0, start_sample - before) ELSE 0 END AS missing_samples FROM segs"""
)
def live_gaps(t):
    blocks, late = _slow(t)
    ends = _ends(t.iq_blocks, ["session_id"], F.timestamp_seconds(F.col("start_sample") / _SLOW))
    return t.drained_to_end(
        lambda closing: folds.live_gaps(blocks, closing, late), ends
    ).drop("sample_rate")


#: Blocks of the given tables last microseconds; at this rate they last about as long as slots.
_SLOW = 32


def _slow(t):
    blocks, late = t.out_of_order("iq_blocks", f"start_sample * 1000000 div {_SLOW}")
    return acquisition.block_meta(blocks).withColumn("sample_rate", F.lit(_SLOW)), late


@query(_ACQUIRED)
def live_acquisition_stats(t):
    """The counters after the last block of each source."""
    blocks, late = t.out_of_order("iq_blocks", f"start_sample * 1000000 div {_SLOW}")
    time = F.timestamp_seconds(F.col("start_sample") / _SLOW)
    rows = t.drained_to_end(
        lambda closing: folds.live_acquisition(acquisition.block_meta(blocks), time, closing, late),
        _ends(t.iq_blocks, ["session_id"], time),
    )
    names = list(folds.AcquisitionFold.COUNTERS)
    last = F.max_by(F.struct(*names), "blocks_acquired").alias("_c")
    return rows.groupBy("session_id").agg(last).select("session_id", "_c.*")


def _live_captures(t, every=False):
    """Every seventeenth block fires, as in the batch query."""
    blocks, late = _slow(t)
    fired = F.pmod(F.floor(F.col("start_sample") / 32), F.lit(17)) == 0
    marked = blocks.withColumn("triggers", F.when(fired, F.array("start_sample")))
    slower = 2_400_000 / _SLOW
    return t.drained_to_end(
        lambda closing: folds.live_captures(
            marked, 1e-4 * slower, 2e-4 * slower, 6e-4 * slower, every, closing, late
        ),
        _ends(t.iq_blocks, ["session_id"], F.timestamp_seconds(F.col("start_sample") / _SLOW)),
    )


_CAPTURED = f"WITH RECURSIVE {META}, {folded.CAPTURES}"


@query(
    f"""{_CAPTURED} SELECT session_id, segment_start, capture_start, deadline, max_end, array_to_string(triggers, ',') AS triggers, capture_end FROM captures"""
)
def live_captures(t):
    found = _live_captures(t).withColumn("triggers", F.array_join("triggers", ","))
    kept = ["session_id", "segment_start", "capture_start", "deadline", "max_end", "triggers", "capture_end"]
    return found.select(*kept)


@query(
    f"""{_CAPTURED} SELECT session_id, end_sample AS at_sample, CAST(coalesce(len(p.triggers), 0) AS INT) AS pending_triggers, count(done.start) OVER w AS captures_completed,
      count(lost.start) OVER w AS captures_aborted, least(end_sample - segment_start, {folded.PRE}) AS buffered_samples FROM state WHERE k > 0
      WINDOW w AS (PARTITION BY session_id ORDER BY k)"""
)
def live_capture_stats(t):
    """The state after each block."""
    found = _live_captures(t, every=True).filter("kind IN ('block', 'finished')")
    return found.select(
        "session_id", "at_sample", "pending_triggers", "captures_completed", "captures_aborted", "buffered_samples"
    )


_DECAY = """s AS (SELECT session_id, channel_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER w AS prev, coalesce(lead(epoch_us(ts)) OVER w, {until}) AS nxt
    FROM detections WINDOW w AS (PARTITION BY session_id, channel_id ORDER BY ts, detection_id))
  SELECT session_id, channel_id, make_timestamp(us) AS ts, 'active' AS status FROM s WHERE prev IS NULL OR us - prev > 3000000
  UNION ALL SELECT session_id, channel_id, make_timestamp(us + 3000000), 'recently_active' FROM s WHERE nxt - us > 3000000
  UNION ALL SELECT session_id, channel_id, make_timestamp(us + 30000000), 'inactive' FROM s WHERE nxt - us > 30000000"""


@query("WITH " + _DECAY.format(until="epoch_us(TIMESTAMP '2024-02-01 00:00:00')"))
def status_decay(t):
    until = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return timing.status_decay(t.detections, until).withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )


@query("WITH " + _DECAY.format(until="epoch_us(TIMESTAMP '2024-02-01 00:00:00')"))
def live_status(t):
    found, late = t.out_of_order("detections", "unix_micros(ts)")
    keys = ["session_id", "channel_id"]
    until = F.lit("2024-02-01 00:00:00").cast("timestamp")
    ends = t.detections.select(*keys).distinct().withColumn("ts", until)
    rows = t.drained_to_end(lambda closing: status.live_status(found, closing, late), ends)
    return rows.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    """WITH RECURSIVE seqs AS (SELECT session_id, snapshot_seq, lag(snapshot_seq) OVER (PARTITION BY session_id ORDER BY snapshot_seq) AS prior
        FROM (SELECT DISTINCT session_id, snapshot_seq FROM snapshots)),
      s AS (SELECT *, lag(status) OVER w AS was, lag(snapshot_seq) OVER w AS was_seq FROM snapshots
        WINDOW w AS (PARTITION BY session_id, channel_id ORDER BY snapshot_seq)),
      turned AS (SELECT s.* FROM s JOIN seqs USING (session_id, snapshot_seq) WHERE prior IS NOT NULL AND status = 'active'
        AND NOT coalesce(was_seq = prior AND was = 'active', false)),
      hit AS (SELECT t.session_id, t.channel_id, t.snapshot_seq, epoch_us(t.ts) AS us, arg_min(r.rule_id, r.rule_order * 1000 + r.rule_id) AS rule_id
        FROM turned t JOIN rules r ON r.enabled AND (freq_lo_mhz IS NULL OR t.center_hz / 1e6 >= freq_lo_mhz) AND (freq_hi_mhz IS NULL OR t.center_hz / 1e6 <= freq_hi_mhz)
        AND (min_snr IS NULL OR t.snr_db >= min_snr) AND (min_confidence IS NULL OR t.confidence >= min_confidence)
        AND (NOT require_regular_cadence OR (t.recurrence_interval_s IS NOT NULL AND t.observation_count >= 4)) GROUP BY ALL),
      k AS (SELECT session_id, channel_id, min(us) AS us FROM hit GROUP BY ALL UNION ALL
        SELECT k.session_id, k.channel_id, min(h.us) FROM k JOIN hit h ON h.session_id = k.session_id AND h.channel_id = k.channel_id
        AND h.us >= k.us + 86400000000 GROUP BY k.session_id, k.channel_id, k.us)
      SELECT session_id, channel_id, snapshot_seq, rule_id FROM hit JOIN k USING (session_id, channel_id, us)"""
)
def live_alerts(t):
    found, late = t.out_of_order("snapshots", "unix_micros(ts)")
    ends = _ends(t.snapshots, ["session_id"], F.col("ts"))
    rows = t.drained_to_end(
        lambda closing: status.live_alerts(found, t.rules, 86_400, closing, late), ends
    )
    return rows.drop("ts_us")


@query(
    """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket_start, CAST(trunc((center_hz - 867000000) / 3000000 * 96) AS INT) AS freq_bin, count(*) AS n FROM detections
       WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM detections) GROUP BY ALL"""
)
def live_occupancy(t):
    """Windows that the watermark has closed."""
    cells = t.drained(status.live_occupancy(t.stream("detections"), 3600, 96))
    return cells.withColumn("bucket_start", F.col("bucket_start").cast("timestamp_ntz"))


@query(
    """WITH g AS (SELECT CAST(range AS INT) AS band_bin, CASE WHEN range = 63 THEN 870000000.0::DOUBLE ELSE 867000000 + range * (3000000 / 63.0::DOUBLE) END AS f FROM range(64)),
      c AS (SELECT session_id, band_bin, frame_seq, power_db, (f - f0_hz) / bin_hz AS x FROM psd_frames JOIN g ON f BETWEEN f0_hz AND f0_hz + bin_hz * 63)
      SELECT session_id, band_bin, round(arg_max(power_db[CAST(floor(x) AS INT) + 1] + (coalesce(power_db[CAST(floor(x) AS INT) + 2], power_db[CAST(floor(x) AS INT) + 1])
        - power_db[CAST(floor(x) AS INT) + 1]) * (x - floor(x)), frame_seq), 6) AS power_db FROM c GROUP BY session_id, band_bin"""
)
def live_band(t):
    band = status.live_band(t.stream("psd_frames"), 64)
    return t.drained_updates(band, ["session_id", "band_bin"]).withColumn(
        "power_db", F.round("power_db", 6)
    )


_OUTS = """WITH RECURSIVE d AS (SELECT session_id, frame_seq, epoch_us(ts) AS us FROM psd_frames),
  k AS (SELECT session_id, min(us) AS us FROM d GROUP BY ALL UNION ALL
    SELECT k.session_id, min(d.us) FROM k JOIN d ON d.session_id = k.session_id AND d.us >= k.us + {gap} GROUP BY k.session_id, k.us),
  o AS (SELECT session_id, frame_seq FROM d JOIN k USING (session_id, us))"""


@query(
    _OUTS.format(gap=2_000_000)
    + """, g AS (SELECT CAST(range AS INT) AS band_bin, CASE WHEN range = 31 THEN 870000000.0::DOUBLE ELSE 867000000 + range * (3000000 / 31.0::DOUBLE) END AS f FROM range(32)),
      c AS (SELECT session_id, band_bin, frame_seq, power_db, (f - f0_hz) / bin_hz AS x FROM psd_frames JOIN g ON f BETWEEN f0_hz AND f0_hz + bin_hz * 63),
      v AS (SELECT session_id, band_bin, frame_seq, power_db[CAST(floor(x) AS INT) + 1] + (coalesce(power_db[CAST(floor(x) AS INT) + 2], power_db[CAST(floor(x) AS INT) + 1])
        - power_db[CAST(floor(x) AS INT) + 1]) * (x - floor(x)) AS v FROM c)
      SELECT o.session_id, o.frame_seq, g.band_bin, round(coalesce(arg_max(v.v, v.frame_seq), -140), 6) AS power_db FROM o CROSS JOIN g
      LEFT JOIN v ON v.session_id = o.session_id AND v.band_bin = g.band_bin AND v.frame_seq <= o.frame_seq GROUP BY o.session_id, o.frame_seq, g.band_bin"""
)
def spectrum_frames_out(t):
    # fps of 0.5 needs an interval, so the frames' clock is slowed instead.
    slow = t.psd_frames.withColumn(
        "ts", F.timestamp_micros(F.floor(F.unix_micros("ts") / 2))
    )
    return occupancy.spectrum_frames_out(slow, 1, 32, chunk_frames=100).withColumn(
        "power_db", F.round("power_db", 6)
    )


@query(
    _OUTS.format(gap=1_000_000)
    + """ SELECT o.session_id, o.frame_seq, row_number() OVER (PARTITION BY o.session_id ORDER BY o.frame_seq) AS seq,
      CAST(list_max(power_db[1:8]) AS FLOAT) AS first_bin FROM o JOIN psd_frames USING (session_id, frame_seq)"""
)
def scope_frames_out(t):
    frames = occupancy.scope_frames_out(t.psd_frames, 1, 8, chunk_frames=100)
    return frames.select(
        "session_id", "frame_seq", "seq", F.get("power_db", F.lit(0)).alias("first_bin")
    )


def _as_captures(t):
    """Every block as a capture of its own."""
    return t.iq_blocks.select(
        "session_id",
        F.timestamp_micros(F.col("start_sample") * 1000).alias("captured_ts"),
        "center_hz",
        "sample_rate",
        "iq",
        F.lit(None).cast("string").alias("annotations"),
    )


@query(
    """SELECT session_id, center_hz, CAST(2400000 AS INT) AS sample_rate, 'cf32_le' AS format, CAST(256 AS BIGINT) AS bytes, count(*) AS files
       FROM iq_blocks GROUP BY session_id, center_hz"""
)
def write_sigmf(t):
    folder = shared_folder(t.spark, "sigmf")
    rows = sigmf.write_sigmf(_as_captures(t), folder, "cf32")
    return rows.groupBy("session_id", "center_hz", "sample_rate", "format", "bytes").agg(
        F.count(F.lit(1)).alias("files")
    )


@query(
    """SELECT center_hz, count(*) AS captures, CAST(sum(len(iq)) AS BIGINT) AS n_values,
       round(sum(list_sum(list_transform(iq, lambda x: CAST(x AS DOUBLE)))), 6) AS total FROM iq_blocks GROUP BY center_hz"""
)
def read_sigmf(t):
    folder = shared_folder(t.spark, "sigmf")
    sigmf.write_sigmf(_as_captures(t), folder, "cf32").agg(F.sum("bytes")).collect()
    rows = sigmf.read_sigmf(t.spark, folder)
    total = F.aggregate("iq", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return rows.groupBy("center_hz").agg(
        F.count_distinct("capture").alias("captures"),
        F.sum(F.size("iq")).alias("n_values"),
        F.round(F.sum(total), 6).alias("total"),
    )


@query(
    "SELECT session_id, count(*) AS blocks, CAST(sum(len(iq) // 2) AS BIGINT) AS samples FROM iq_blocks GROUP BY session_id"
)
def iq_block_stream(t):
    folder = shared_folder(t.spark, "blocks")
    t.iq_blocks.write.parquet(folder)
    rows = t.drained(tables.iq_block_stream(t.spark, folder))
    return rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum(F.floor(F.size("iq") / 2)).alias("samples")
    )


@query(
    "SELECT CAST(ts AS DATE) AS date, count(*) AS n, CAST(sum(detection_id) AS BIGINT) AS ids FROM detections GROUP BY CAST(ts AS DATE)"
)
def ingest_detections(t):
    """Sent twice, stored once."""
    root = shared_folder(t.spark, "tables")
    for _ in range(2):
        tables.ingest(t.detections, root, "detections", 7)
    stored = tables.read_table(t.spark, root, "detections")
    return stored.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("detection_id").alias("ids")
    )


@query(
    """SELECT session_id, sequence, freq_hz, bandwidth_hz, duration_ms FROM bursts WHERE qualified"""
)
def candidate_log_append(t):
    folder = shared_folder(t.spark, "log")
    flagged = t.bursts.filter("qualified").select(
        F.lit(AS_OF).alias("timestamp"),
        "session_id",
        F.lit(868_269_000).cast("bigint").alias("receiver_center_hz"),
        "sequence",
        "freq_hz",
        "bandwidth_hz",
        "duration_ms",
        "peak_snr_db",
        F.lit(2.0).alias("candidate_score"),
        F.array(F.lit("wideband")).alias("candidate_reasons"),
    )
    text.candidate_log_append(flagged, folder)
    return text.candidate_log_read(t.spark, folder).select(
        "session_id", "sequence", "freq_hz", "bandwidth_hz", "duration_ms"
    )
