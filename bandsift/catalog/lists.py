"""Queries over channel, detection, recording and decode tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandsift.catalog.bindings import AS_OF
from bandsift.catalog.registry import query
from bandsift.functions import channels as C
from bandsift.functions.time import iso_ts as iso
from bandsift.operators import channels as ch
from bandsift.operators import maintenance as M
from bandsift.operators import occupancy, ranges, timing
from bandsift.operators import report as R
from bandsift.operators.ordered import attach, with_place

GAP_S = 7200.0

_BURSTS = """a AS (SELECT session_id, channel_id, detection_id, epoch_us(ts) AS us FROM detections
    QUALIFY row_number() OVER (PARTITION BY session_id, channel_id ORDER BY ts DESC, detection_id DESC) <= 512),
  g AS (SELECT *, CASE WHEN us - lag(us) OVER w > 7200000000 OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM a
    WINDOW w AS (PARTITION BY session_id, channel_id ORDER BY us, detection_id)),
  q AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id, channel_id ORDER BY us, detection_id) AS burst_seq FROM g),
  bs AS (SELECT session_id, channel_id, CAST(burst_seq AS BIGINT) AS burst_seq, min(us) AS start_us, max(us) AS end_us, count(*) AS arrivals,
    (max(us) - min(us)) / 1000.0 AS duration_ms FROM q GROUP BY session_id, channel_id, burst_seq)"""

_RECUR = f"""{_BURSTS},
  gp AS (SELECT *, (start_us - lag(start_us) OVER (PARTITION BY session_id, channel_id ORDER BY burst_seq)) / 1e6 AS gap FROM bs),
  rc AS (SELECT session_id, channel_id, round(median(gap), 3) AS recurrence_interval_s, round(median(duration_ms), 3) AS typical_burst_ms,
    count(*) AS burst_count, CASE WHEN count(gap) >= 2 THEN round(stddev_pop(gap), 3) END AS interval_jitter_s FROM gp GROUP BY ALL)"""


@query(f"WITH {_BURSTS} SELECT * FROM bs")
def burst_sessions(t):
    return timing.burst_sessions(t.detections, GAP_S)


@query(f"WITH {_RECUR} SELECT * FROM rc")
def recurrence_stats(t):
    return timing.recurrence_stats(t.detections, GAP_S)


@query(f"WITH {_RECUR.replace('FROM detections', 'FROM arrivals_by_part')} SELECT * FROM rc")
def recurrence_by_part(t):
    return timing.recurrence_stats(t.arrivals_by_part, GAP_S, chunk_s=30 * 86_400)


@query(
    f"""WITH {_RECUR}, o AS (SELECT session_id, channel_id, count(*) AS n FROM detections GROUP BY ALL)
      SELECT session_id, channel_id, round(least(1.0, 0.6 * least(1.0, n / 20.0) + 0.4 *
        CASE WHEN recurrence_interval_s <> 0 AND interval_jitter_s IS NOT NULL
          THEN greatest(0, 1 - least(1, interval_jitter_s / greatest(recurrence_interval_s, 1e-6))) ELSE 0 END + 0.05), 4) AS confidence
      FROM rc JOIN o USING (session_id, channel_id)"""
)
def confidence(t):
    seen = t.detections.groupBy("session_id", "channel_id").agg(F.count(F.lit(1)).alias("n"))
    both = attach(
        timing.recurrence_stats(t.detections, GAP_S), seen, ["session_id", "channel_id"], how="inner"
    )
    score = C.confidence(F.col("n"), F.col("recurrence_interval_s"), F.col("interval_jitter_s"))
    return both.select("session_id", "channel_id", score.alias("confidence"))


@query(
    """SELECT channel_id, CASE WHEN last_seen IS NULL THEN 'inactive' WHEN age <= 3 THEN 'active' WHEN age <= 30 THEN 'recently_active'
       ELSE 'inactive' END AS status FROM (SELECT channel_id, last_seen, epoch_us(TIMESTAMP '2024-01-15 00:00:00') / 1e6 - epoch_us(last_seen) / 1e6 AS age
       FROM channels)"""
)
def channel_status(t):
    return ch.status_at(t.channels, t.as_of).select("channel_id", "status")


_SCORE = """CASE WHEN recurrence_interval_s IS NOT NULL THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN bandwidth_hz > 0 AND bandwidth_hz < 40000 THEN 0.25::DOUBLE
  ELSE 0 END + CASE WHEN typical_burst_ms < 500 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN observation_count >= 4 THEN 0.2::DOUBLE ELSE 0 END"""
_SCORED = f"""sc AS (SELECT *, {_SCORE} AS score FROM channels)"""
_LABEL = "CASE WHEN score >= 0.7::DOUBLE THEN 'strong' WHEN score >= 0.4::DOUBLE THEN 'moderate' ELSE 'weak' END"


@query(
    f"""WITH {_SCORED} SELECT channel_id, round(score, 6) AS pattern_score, {_LABEL} AS pattern_label,
      array_to_string(list_filter([CASE WHEN recurrence_interval_s IS NOT NULL THEN 'regular cadence' END,
        CASE WHEN bandwidth_hz > 0 AND bandwidth_hz < 40000 THEN 'narrowband' END, CASE WHEN typical_burst_ms < 500 THEN 'short bursts' END,
        CASE WHEN observation_count >= 4 THEN 'repeatedly seen' END], lambda x: x IS NOT NULL), ',') AS reasons FROM sc"""
)
def pattern_score(t):
    return ch.pattern_score(t.channels).select(
        "channel_id",
        F.round("pattern_score", 6).alias("pattern_score"),
        "pattern_label",
        F.array_join("pattern_reasons", ",").alias("reasons"),
    )


@query(
    """SELECT channel_id, CASE WHEN recurrence_interval_s IS NOT NULL AND observation_count >= 4 THEN 'regular'
       WHEN recurrence_interval_s IS NOT NULL AND observation_count >= 2 THEN 'emerging' ELSE 'irregular' END AS verdict FROM channels"""
)
def cadence_verdict(t):
    verdict = C.cadence_verdict(F.col("recurrence_interval_s"), F.col("observation_count"))
    return t.channels.select("channel_id", verdict.alias("verdict"))


def _diff(f: str) -> str:
    return (
        f"CASE WHEN a.{f} IS NULL AND b.{f} IS NULL THEN NULL WHEN a.{f} IS NULL OR b.{f} IS NULL THEN 1.0::DOUBLE "
        f"WHEN greatest(abs(a.{f}), abs(b.{f})) = 0 THEN 0.0::DOUBLE "
        f"ELSE least(1.0::DOUBLE, abs(a.{f} - b.{f}) / greatest(abs(a.{f}), abs(b.{f}))) END"
    )


@query(
    f"""WITH d AS (SELECT p.session_id, channel_a, channel_b, [{_diff('bandwidth_hz')}, {_diff('snr_db')}, {_diff('typical_burst_ms')},
         {_diff('recurrence_interval_s')}] AS ds FROM channel_pairs p JOIN channels a ON a.session_id = p.session_id AND a.channel_id = channel_a JOIN channels b ON b.session_id = p.session_id AND b.channel_id = channel_b)
      SELECT session_id, channel_a, channel_b, round(1 - list_avg(ds), 6) AS score,
        CASE WHEN 1 - list_avg(ds) >= 0.8 THEN 'similar' ELSE 'different' END AS verdict FROM d"""
)
def channel_similarity(t):
    return ch.channel_similarity(t.channels, t.channel_pairs).withColumn(
        "score", F.round("score", 6)
    )


@query(
    """WITH x AS (SELECT session_id, channel_id, recurrence_interval_s AS i, epoch_us(TIMESTAMP '2024-01-15 00:00:00') / 1e6 - epoch_us(last_seen) / 1e6 AS age FROM channels),
       y AS (SELECT *, CAST(floor(i - age + 0.5) AS BIGINT) AS due FROM x)
       SELECT session_id, channel_id, CASE WHEN i IS NULL THEN 'unknown' WHEN due >= 0 THEN 'due' WHEN age > greatest(60, 3 * i) THEN 'silent' ELSE 'overdue' END AS state,
         CAST(CASE WHEN i IS NULL THEN -1 WHEN due >= 0 THEN due WHEN age > greatest(60, 3 * i) THEN floor(age + 0.5) ELSE -due END AS BIGINT) AS seconds FROM y"""
)
def next_expected(t):
    return timing.next_expected(t.channels, t.as_of).withColumn(
        "seconds", F.coalesce("seconds", F.lit(-1))
    )


_GAPS = """ms AS (SELECT session_id, channel_id, detection_id, ts, epoch_us(ts) // 1000 AS ms FROM detections),
  gp AS (SELECT *, (ms - lag(ms) OVER (PARTITION BY session_id, channel_id ORDER BY ms, detection_id)) / 1000.0 AS gap_s FROM ms)"""


@query(f"WITH {_GAPS} SELECT session_id, channel_id, detection_id, ts, gap_s FROM gp WHERE gap_s IS NOT NULL")
def inter_arrival_gaps(t):
    return timing.inter_arrival_gaps(t.detections)


@query(
    f"""WITH {_GAPS}, b AS (SELECT session_id, channel_id, min(gap_s) AS lo, max(gap_s) AS hi, CAST(least(10, count(*)) AS INT) AS nb FROM gp
        WHERE gap_s IS NOT NULL GROUP BY ALL),
      c AS (SELECT session_id, channel_id, least(CAST(floor((gap_s - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * nb) AS INT), nb - 1) AS bucket, count(*) AS n
        FROM gp JOIN b USING (session_id, channel_id) WHERE gap_s IS NOT NULL GROUP BY ALL),
      d AS (SELECT session_id, channel_id, CAST(unnest(range(nb)) AS INT) AS bucket FROM b)
      SELECT session_id, channel_id, bucket, coalesce(n, 0) AS n,
        round(coalesce(n, 0) / max(coalesce(n, 0)) OVER (PARTITION BY session_id, channel_id), 6) AS share
      FROM d LEFT JOIN c USING (session_id, channel_id, bucket)"""
)
def gap_histogram(t):
    return timing.gap_histogram(timing.inter_arrival_gaps(t.detections)).withColumn(
        "share", F.round("share", 6)
    )


@query(
    """WITH d AS (SELECT session_id, channel_id, detection_id, peak_power_db AS v, min(peak_power_db) OVER w AS lo, max(peak_power_db) OVER w AS hi,
         count(*) OVER w AS n, row_number() OVER (PARTITION BY session_id, channel_id ORDER BY ts, detection_id) AS i FROM detections
         WINDOW w AS (PARTITION BY session_id, channel_id))
       SELECT session_id, channel_id, detection_id, round(CASE WHEN n <= 1 THEN 100 ELSE (i - 1) / (n - 1) * 100 END, 6) AS x_pct,
         round((v - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 6) AS y_scaled FROM d"""
)
def power_trend(t):
    return timing.power_trend(t.detections).select(
        "session_id", "channel_id", "detection_id", F.round("x_pct", 6).alias("x_pct"), F.round("y_scaled", 6).alias("y_scaled")
    )


@query(
    """SELECT channel_id, round((avg_power_db - min(avg_power_db) OVER ()) / (max(avg_power_db) OVER () - min(avg_power_db) OVER ()), 6) AS avg_norm FROM channels
       WHERE snr_db >= 5 QUALIFY true"""
)
def avg_power_norm(t):
    return ch.avg_power_norm(ch.channel_filter(t.channels, min_snr=5.0)).select(
        "channel_id", F.round("avg_norm", 6).alias("avg_norm")
    )


@query(
    """SELECT channel_id FROM channels WHERE center_hz >= 868000000 AND center_hz <= 869500000 AND snr_db >= 8 AND confidence >= 0.25 AND status = 'inactive'"""
)
def channel_filter(t):
    return ch.channel_filter(t.channels, 868.0, 869.5, 8.0, 0.25, "inactive").select("channel_id")


@query(
    """SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active,
       (SELECT channel_id FROM channels ORDER BY peak_power_db DESC, channel_id LIMIT 1) AS strongest_channel_id, max(peak_power_db) AS strongest_peak_db FROM channels"""
)
def channel_summary(t):
    return ch.channel_summary(t.channels)


@query(
    """SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active,
       (SELECT center_hz FROM channels ORDER BY current_power_db DESC, channel_id LIMIT 1) AS strongest_hz, max(current_power_db) AS strongest_power_db,
       (SELECT snr_db FROM channels ORDER BY current_power_db DESC, channel_id LIMIT 1) AS strongest_snr_db, max(last_seen) AS last_detection FROM channels"""
)
def status_summary(t):
    return ch.status_summary(t.channels)


@query("SELECT channel_id, center_hz FROM channels ORDER BY center_hz, channel_id LIMIT 500")
def channels_list(t):
    return ch.channels_list(t.channels).select("channel_id", "center_hz")


_PLACED = "row_number() OVER (ORDER BY {order}) AS place"


@query(
    f"""SELECT channel_id, {_PLACED.format(order='recurrence_interval_s ASC NULLS FIRST, channel_id')} FROM channels"""
)
def sort_channels(t):
    return with_place(
        ch.sort_channels(t.channels, "recurrence_interval_s").select("channel_id")
    )


_PINS = """pj AS (SELECT c.*, coalesce(p.pinned, false) AS pinned, coalesce(p.label, '') AS label FROM channels c
    LEFT JOIN (SELECT * FROM pins WHERE pinned OR label <> '') p USING (session_id, channel_id))"""


@query(f"WITH {_PINS} SELECT session_id, channel_id, pinned, label FROM pj")
def pins_join(t):
    return ch.pins_join(t.channels, t.pins).select("session_id", "channel_id", "pinned", "label")


@query(
    f"""WITH {_PINS} SELECT channel_id, {_PLACED.format(order='pinned DESC, typical_burst_ms DESC NULLS LAST, channel_id')} FROM pj"""
)
def pinned_first(t):
    ordered = ch.pinned_first(ch.pins_join(t.channels, t.pins), "typical_burst_ms", False)
    return with_place(ordered.select("channel_id"))


@query(f"WITH {_SCORED} SELECT channel_id, round(score, 6) AS pattern_score FROM sc ORDER BY score DESC, channel_id LIMIT 3")
def top_candidates(t):
    return ch.top_candidates(t.channels).select("channel_id", F.round("pattern_score", 6).alias("pattern_score"))


@query(
    f"""WITH {_SCORED} SELECT channel_id, {_PLACED.format(order='score DESC, channel_id')} FROM sc"""
)
def rank_by_pattern(t):
    return with_place(ch.rank_by_pattern(t.channels).select("channel_id"))


@query(
    """WITH d AS (SELECT epoch_us(ts) - (1705276800000000 - 86400000000) AS after, CAST(trunc((center_hz - 867000000) / 3000000 * 96) AS INT) AS freq_bin FROM detections
         WHERE ts >= TIMESTAMP '2024-01-14 00:00:00'),
       c AS (SELECT after // 3600000000 AS bucket, freq_bin, count(*) AS n FROM d WHERE after // 3600000000 BETWEEN 0 AND 23 AND freq_bin BETWEEN 0 AND 95 GROUP BY ALL)
       SELECT b.bucket AS bucket, make_timestamp(1705276800000000 - 86400000000 + b.bucket * 3600000000) AS bucket_start, f.freq_bin AS freq_bin, coalesce(n, 0) AS n
       FROM (SELECT range AS bucket FROM range(24)) b CROSS JOIN (SELECT CAST(range AS INT) AS freq_bin FROM range(96)) f LEFT JOIN c ON c.bucket = b.bucket AND c.freq_bin = f.freq_bin"""
)
def occupancy_grid(t):
    return occupancy.occupancy_grid(t.detections, AS_OF, 1440, 3600, 96).withColumn(
        "bucket_start", F.col("bucket_start").cast("timestamp_ntz")
    )


@query(
    """WITH c AS (SELECT (epoch_us(ts) - (1705276800000000 - 86400000000)) // 7200000000 AS bucket, CAST(trunc((center_hz - 867000000) / 3000000 * 32) AS INT) AS freq_bin, count(*) AS n
         FROM detections WHERE ts >= TIMESTAMP '2024-01-14 00:00:00' AND ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY ALL),
       g AS (SELECT b.range AS bucket, CAST(f.range AS INT) AS freq_bin FROM range(12) b CROSS JOIN range(32) f)
       SELECT bucket, freq_bin, round(coalesce(n, 0) / (SELECT max(n) FROM c), 6) AS intensity FROM g LEFT JOIN c USING (bucket, freq_bin)"""
)
def occupancy_intensity(t):
    grid = occupancy.occupancy_grid(t.detections, AS_OF, 1440, 3600, 32)
    folded = grid.groupBy(F.floor(F.col("bucket") / 2).alias("bucket"), "freq_bin").agg(F.sum("n").alias("n"))
    return occupancy.occupancy_intensity(folded).select("bucket", "freq_bin", F.round("intensity", 6).alias("intensity"))


_COUNTS = """(SELECT protocol, count(*) AS n FROM decodes WHERE known GROUP BY protocol)"""


@query(
    f"""WITH {_SCORED} SELECT 'summary' AS section, 'channels' AS item, NULL::BIGINT AS center_hz, NULL::DOUBLE AS snr_db, NULL::DOUBLE AS score, NULL AS label, count(*) AS n FROM channels
      UNION ALL SELECT 'summary', 'active', NULL, NULL, NULL, NULL, count(*) FROM channels WHERE status = 'active'
      UNION ALL SELECT 'summary', 'sessions', NULL, NULL, NULL, NULL, count(*) FROM sessions
      UNION ALL SELECT 'channel', CAST(channel_id AS VARCHAR), center_hz, snr_db, round(score, 6), {_LABEL}, observation_count FROM sc
      UNION ALL SELECT 'protocol', protocol, NULL, NULL, NULL, NULL, n FROM {_COUNTS}"""
)
def survey_report(t):
    return R.ordered_report(R.survey_report(t.channels, t.sessions, t.decodes))


@query(f"SELECT protocol, n AS decodes FROM {_COUNTS}")
def protocol_counts(t):
    return M.protocol_counts(t.decodes)


@query("SELECT decode_id, protocol FROM decodes WHERE known")
def known_decodes(t):
    return M.known_decodes(t.decodes).select("decode_id", "protocol")


@query("SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes FROM recordings")
def recording_bytes(t):
    return M.recording_bytes(t.recordings)


@query(
    """SELECT recording_id, session_id, channel_id, abs(r.center_hz - c.center_hz) AS distance_hz FROM recordings r JOIN channels c
       ON abs(r.center_hz - c.center_hz) <= sample_rate / 2"""
)
def recordings_near_channel(t):
    return ranges.recordings_near_channel(t.recordings, t.channels)


@query(
    """SELECT recording_id FROM recordings r WHERE ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1999-06-30' AND center_hz >= 867500000 AND center_hz <= 869500000
       AND EXISTS (SELECT 1 FROM channels c WHERE c.status = 'active' AND abs(r.center_hz - c.center_hz) <= sample_rate / 2)"""
)
def recording_filter(t):
    near = ch.channel_filter(t.channels, status="active")
    return ranges.recording_filter(
        t.recordings, "1996-01-01", "1999-06-30", 867.5, 869.5, near
    ).select("recording_id")


_MARKERS = """mk(marker_hz, marker_label, marker_kind) AS (VALUES (868300000, 'wM-Bus S', 'wmbus'), (868950000, 'wM-Bus T/C', 'wmbus'),
  (869525000, 'wM-Bus N', 'wmbus'), (868100000, 'LoRa 1', 'lora'), (868300000, 'LoRa 2', 'lora'), (868500000, 'LoRa 3', 'lora'))"""


@query(
    f"""WITH {_MARKERS} SELECT session_id, channel_id, CAST(marker_hz AS BIGINT) AS marker_hz, marker_label, marker_kind FROM channels JOIN mk
      ON marker_hz BETWEEN center_hz - bandwidth_hz // 2 AND center_hz + bandwidth_hz // 2"""
)
def reference_markers(t):
    return ranges.reference_markers(t.channels, ranges.reference_marker_table(t.spark))


@query(
    f"""WITH {_MARKERS}, d AS (SELECT session_id, channel_id, abs(marker_hz - center_hz) AS d, marker_label FROM channels CROSS JOIN mk WHERE abs(marker_hz - center_hz) <= 1000000)
      SELECT session_id, channel_id, arg_min(marker_label, (d, marker_label)) AS marker_label, min(d) AS distance_hz FROM d GROUP BY session_id, channel_id"""
)
def nearest_marker(t):
    return ranges.nearest_marker(t.channels, ranges.reference_marker_table(t.spark))


@query(
    """WITH rg(lo_hz, hi_hz, range_label) AS (VALUES (868000000, 868600000, 'g (868.0–868.6)'), (868700000, 869200000, 'g1 (868.7–869.2)'),
         (869400000, 869650000, 'g3 (869.4–869.65)'), (869700000, 870000000, 'g4 (869.7–870.0)'))
       SELECT session_id, channel_id, CAST(lo_hz AS BIGINT) AS lo_hz, CAST(hi_hz AS BIGINT) AS hi_hz, range_label FROM channels JOIN rg
       ON hi_hz >= center_hz - bandwidth_hz // 2 AND lo_hz <= center_hz + bandwidth_hz // 2"""
)
def reference_ranges(t):
    return ranges.reference_ranges(t.channels, ranges.reference_range_table(t.spark))


@query(
    """SELECT focus_id, session_id, channel_id FROM focuses f JOIN channels c ON abs(c.center_hz - focus_hz) <= sample_rate / 2
       QUALIFY row_number() OVER (PARTITION BY focus_id ORDER BY last_seen DESC, abs(center_hz - focus_hz), session_id, channel_id) = 1"""
)
def focus_channel(t):
    return ranges.focus_channel(t.focuses, t.channels)


@query(
    """SELECT session_id, channel_id, rule_id FROM channels c JOIN rules r ON r.enabled AND (freq_lo_mhz IS NULL OR c.center_hz / 1e6 >= freq_lo_mhz)
       AND (freq_hi_mhz IS NULL OR c.center_hz / 1e6 <= freq_hi_mhz) AND (min_snr IS NULL OR c.snr_db >= min_snr)
       AND (min_confidence IS NULL OR c.confidence >= min_confidence) AND (NOT require_regular_cadence OR (c.recurrence_interval_s IS NOT NULL AND c.observation_count >= 4))
       QUALIFY row_number() OVER (PARTITION BY session_id, channel_id ORDER BY rule_order, rule_id) = 1"""
)
def alert_rule_match(t):
    return ranges.alert_rule_match(t.channels, t.rules)


@query(
    """SELECT detection_id, d.session_id, c.channel_id IS NOT NULL AS has_channel, coalesce(c.center_hz, -1) AS channel_hz FROM detections d SEMI JOIN sessions s ON s.session_id = d.session_id
       LEFT JOIN (SELECT session_id, channel_id, center_hz FROM channels ANTI JOIN removed_channels USING (session_id, channel_id)) c ON c.session_id = d.session_id AND c.channel_id = d.channel_id"""
)
def detection_channel(t):
    """Detections of channels that were merged away keep a null one."""
    kept = M.drop_merged_channels(t.channels, t.removed_channels)
    return ranges.detection_channel(t.detections, kept, t.sessions).select(
        "detection_id",
        "session_id",
        F.col("channel_id").isNotNull().alias("has_channel"),
        F.coalesce("channel_hz", F.lit(-1)).alias("channel_hz"),
    )


@query(
    """SELECT session_id, channel_id, detection_id FROM detections QUALIFY row_number() OVER (PARTITION BY session_id, channel_id ORDER BY detection_id DESC) <= 50"""
)
def channel_observations(t):
    return M.channel_observations(t.detections, 50).select("session_id", "channel_id", "detection_id")


@query(
    """WITH d AS (SELECT session_id, channel_id, detection_id, ts, duration_ms FROM detections
           SEMI JOIN (SELECT session_id, channel_id FROM detections GROUP BY ALL ORDER BY max(ts) DESC, session_id DESC, channel_id DESC LIMIT 16) USING (session_id, channel_id)
         QUALIFY row_number() OVER (PARTITION BY session_id, channel_id ORDER BY detection_id DESC) <= 300),
       p AS (SELECT session_id, channel_id, detection_id, ((epoch_us(ts) // 1000) - (1706400000000 - 1209600000)) / 1209600000.0 * 100 AS l, coalesce(duration_ms, 50) / 1209600000.0 * 100 AS w FROM d)
       SELECT session_id, channel_id, detection_id, round(l, 6) AS left_pct, greatest(w, 0.4) AS width_pct FROM p WHERE l BETWEEN 0 AND 100"""
)
def timeline(t):
    seen = t.detections.groupBy("session_id", "channel_id").agg(F.max("ts").alias("last_seen"))
    return M.timeline(seen, t.detections, "2024-01-28 00:00:00", 14 * 86_400).withColumn(
        "left_pct", F.round("left_pct", 6)
    )


@query(
    """SELECT session_id, gap_lo_hz, gap_hi_hz FROM (
         SELECT session_id, greatest(coalesce(max(hi_hz) OVER (PARTITION BY session_id ORDER BY lo_hz, hi_hz ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 867000000), 867000000) AS gap_lo_hz,
           least(lo_hz, 870000000) AS gap_hi_hz
         FROM (SELECT session_id, lo_hz, hi_hz FROM observed_windows UNION SELECT DISTINCT session_id, 870000000, 870000000 FROM observed_windows))
       WHERE gap_lo_hz < gap_hi_hz"""
)
def coverage_gaps(t):
    return occupancy.coverage_gaps(t.observed_windows)


@query(
    """SELECT detection_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM detections"""
)
def iso_ts(t):
    return t.detections.select("detection_id", iso(F.col("ts")).alias("iso"))


@query(
    f"""WITH {_RECUR},
      st AS (SELECT session_id, channel_id, max(center_hz) AS center_hz, max(bandwidth_hz) AS bandwidth_hz, max(peak_power_db) AS peak_power_db,
        count(*) AS observation_count, max(ts) AS last_seen FROM detections GROUP BY ALL),
      fl AS (SELECT session_id, min(peak_power_db) AS floor_db FROM detections GROUP BY session_id)
      SELECT session_id, channel_id, center_hz, observation_count, typical_burst_ms, recurrence_interval_s,
        round(least(1.0, 0.6 * least(1.0, observation_count / 20.0) + 0.4 * CASE WHEN recurrence_interval_s <> 0 AND interval_jitter_s IS NOT NULL
          THEN greatest(0, 1 - least(1, interval_jitter_s / greatest(recurrence_interval_s, 1e-6))) ELSE 0 END + 0.05), 4) AS confidence,
        CASE WHEN epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(last_seen) <= 3000000 THEN 'active'
          WHEN epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(last_seen) <= 30000000 THEN 'recently_active' ELSE 'inactive' END AS status,
        CASE WHEN coalesce(typical_burst_ms, 0) = 0 THEN 120 ELSE typical_burst_ms END AS duration_ms, round(peak_power_db - floor_db, 3) AS rel_strength_db
      FROM st JOIN rc USING (session_id, channel_id) JOIN fl USING (session_id)"""
)
def channel_model(t):
    keys = ["session_id", "channel_id"]
    states = t.detections.groupBy(*keys).agg(
        F.max("center_hz").alias("center_hz"),
        F.max("bandwidth_hz").alias("bandwidth_hz"),
        F.max("peak_power_db").alias("peak_power_db"),
        F.count(F.lit(1)).alias("observation_count"),
        F.max("ts").alias("last_seen"),
    )
    floors = t.detections.groupBy("session_id").agg(F.min("peak_power_db").alias("floor_db"))
    at = F.lit("2024-01-30 12:00:00").cast("timestamp")
    model = ch.channel_model(states, timing.recurrence_stats(t.detections, GAP_S), floors, at)
    return model.select(
        *keys, "center_hz", "observation_count", "typical_burst_ms", "recurrence_interval_s",
        "confidence", "status", "fingerprint.duration_ms", "fingerprint.rel_strength_db",
    )
