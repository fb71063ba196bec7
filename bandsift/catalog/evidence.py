"""Queries over IQ continuity, short-time spectra, bursts and captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandsift.catalog import folded
from bandsift.catalog.registry import query
from bandsift.functions import channels as C
from bandsift.operators import acquisition, capture, detect, dsp, noise, tracks
from bandsift.operators import maintenance as M
from bandsift.operators.ordered import number_chunk
from bandsift.plans import wideband
from bandsift.plans.wideband import Evidence
from bandsift.runtime import cut_lineage

# Blocks of the given tables are short, so frames are short as well.
HOW = Evidence(frame_samples=64, welch_segments=4, threshold_db=3.0, block_bins=4)

META = """meta AS (SELECT session_id, start_sample, start_sample + len(iq) // 2 AS end_sample, center_hz, sample_rate,
    captured_at, len(iq) // 2 AS n FROM iq_blocks),
  gaps AS (SELECT *, lag(end_sample) OVER w AS before, lag(center_hz) OVER w AS center_before,
    lag(captured_at) OVER w AS at_before, lag(n) OVER w AS n_before
    FROM meta WINDOW w AS (PARTITION BY session_id ORDER BY start_sample)),
  segs AS (SELECT *, max(CASE WHEN before IS NULL OR before <> start_sample THEN start_sample END)
    OVER (PARTITION BY session_id ORDER BY start_sample) AS segment_start FROM gaps)"""


@query(
    f"""WITH {META} SELECT session_id, start_sample, end_sample, segment_start,
      coalesce(before <> start_sample, false) AS is_gap,
      CASE WHEN before <> start_sample THEN greatest(0, start_sample - before) ELSE 0 END AS missing_samples FROM segs"""
)
def gap_detect(t):
    return acquisition.gap_detect(acquisition.block_meta(t.iq_blocks)).select(
        "session_id", "start_sample", "end_sample", "segment_start", "is_gap", "missing_samples"
    )


@query(
    """WITH m AS (SELECT session_id, start_sample, start_sample + len(iq) // 2 AS e, center_hz, sample_rate FROM tuned_blocks),
      g AS (SELECT *, lag(e) OVER w AS before, lag(center_hz) OVER w AS was_hz, lag(sample_rate) OVER w AS was_rate FROM m WINDOW w AS (PARTITION BY session_id ORDER BY start_sample)),
      f AS (SELECT *, before IS NULL OR before <> start_sample OR was_hz <> center_hz OR was_rate <> sample_rate AS fresh FROM g),
      s AS (SELECT *, max(CASE WHEN fresh THEN start_sample END) OVER (PARTITION BY session_id ORDER BY start_sample) AS segment_start FROM f)
      SELECT session_id, segment_start, max(e) AS segment_end, any_value(center_hz) AS center_hz, any_value(sample_rate) AS sample_rate,
        CAST((max(e) - segment_start) // 64 AS BIGINT) AS n_frames FROM s GROUP BY session_id, segment_start"""
)
def retune_segments(t):
    """Segments end at gaps and at retunes; each has one centre and one rate."""
    gaps = acquisition.gap_detect(acquisition.block_meta(t.tuned_blocks))
    return acquisition.segments_of(gaps, 64)


_LATE = """late AS (SELECT *, captured_at - at_before - n_before / sample_rate AS excess,
    greatest(0.005, n_before / sample_rate * 0.5) AS allowed FROM gaps)"""


@query(
    f"""WITH {META}, {_LATE} SELECT session_id, start_sample, coalesce(excess > allowed, false) AS is_late,
      CASE WHEN excess > allowed THEN greatest(0, CAST(round_even(excess * sample_rate, 0) AS BIGINT)) ELSE 0 END
        AS estimated_gap_samples FROM late"""
)
def timing_gaps(t):
    return acquisition.timing_gaps(acquisition.block_meta(t.iq_blocks)).select(
        "session_id", "start_sample", "is_late", "estimated_gap_samples"
    )


_ACQUIRED = f"""WITH {META}, {_LATE},
      a AS (SELECT session_id, count(*) AS blocks_acquired, CAST(sum(n) AS BIGINT) AS samples_acquired,
        max(end_sample) AS sample_cursor, count(*) FILTER (before <> start_sample) AS dropped_runs,
        CAST(sum(CASE WHEN before <> start_sample THEN greatest(0, start_sample - before) ELSE 0 END) AS BIGINT) AS dropped_samples,
        count(*) FILTER (center_before <> center_hz) AS retunes FROM gaps GROUP BY session_id),
      b AS (SELECT session_id, count(*) FILTER (excess > allowed) AS timing_gaps,
        CAST(sum(CASE WHEN excess > allowed THEN round_even(excess * sample_rate, 0) ELSE 0 END) AS BIGINT) AS estimated_gap_samples
        FROM late GROUP BY session_id)
      SELECT * FROM a JOIN b USING (session_id)"""


@query(_ACQUIRED)
def acquisition_stats(t):
    return acquisition.acquisition_stats(acquisition.block_meta(t.iq_blocks))


@query(
    """SELECT b.session_id, start_sample, center_hz FROM iq_blocks b JOIN sessions s USING (session_id)
       WHERE center_hz - sample_rate // 2 <= 867529000 AND center_hz + sample_rate // 2 >= 869009000
         AND s.start_hz <= 867569000 AND s.end_hz >= 868969000 AND s.end_hz - s.start_hz <= sample_rate"""
)
def observable_blocks(t):
    return acquisition.observable_blocks(t.iq_blocks, t.sessions).select(
        "session_id", "start_sample", "center_hz"
    )


_SAMPLES = """smp AS (SELECT s.session_id, s.segment_start, s.start_sample + range - s.segment_start AS pos, sample_rate, b.center_hz,
    CAST(iq[2 * range + 1] AS DOUBLE) AS re, CAST(iq[2 * range + 2] AS DOUBLE) AS im
    FROM segs s JOIN (SELECT session_id, start_sample, iq, center_hz FROM iq_blocks) b USING (session_id, start_sample), range(32))"""


@query(
    f"""WITH {META}, {_SAMPLES}
      SELECT session_id, segment_start, pos // 24 AS frame_id, round(sum(re * re + im * im), 6) AS energy
      FROM smp GROUP BY ALL HAVING count(*) = 24"""
)
def frame_blocks(t):
    framed = dsp.frame_blocks(dsp.with_segments(t.iq_blocks), 24)
    one = framed.select(
        "session_id",
        "segment_start",
        "first_frame",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.col("n_frames").cast("int") - 1),
                lambda i: F.slice("iq", i * 48 + 1, 48),
            )
        ).alias("i", "part"),
    )
    energy = F.aggregate(
        "part", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return one.select(
        "session_id",
        "segment_start",
        (F.col("first_frame") + F.col("i")).alias("frame_id"),
        F.round(energy, 6).alias("energy"),
    )


_SPECTRA = f"""{META}, {_SAMPLES},
  win AS (SELECT session_id, segment_start, pos // 64 AS frame_id, (pos % 64) // 16 AS sub, pos % 16 AS n, sample_rate, center_hz,
    re * (0.5 - 0.5 * cos(2 * pi() * (pos % 16) / 15)) AS re, im * (0.5 - 0.5 * cos(2 * pi() * (pos % 16) / 15)) AS im,
    count(*) OVER (PARTITION BY session_id, segment_start, pos // 64) AS c FROM smp),
  dft AS (SELECT session_id, segment_start, frame_id, sub, k, any_value(center_hz) AS center_hz,
    sum(re * cos(2 * pi() * k * n / 16) + im * sin(2 * pi() * k * n / 16)) AS xr,
    sum(im * cos(2 * pi() * k * n / 16) - re * sin(2 * pi() * k * n / 16)) AS xi
    FROM win, range(-4, 5) z(k) WHERE c = 64 GROUP BY ALL),
  stp AS (SELECT session_id, segment_start, frame_id, k + 4 AS bin, center_hz + k * 150000.0 AS freq_hz,
    10 * log10(avg(xr * xr + xi * xi) + 1e-20) AS p FROM dft GROUP BY session_id, segment_start, frame_id, k, center_hz)"""


@query(
    f"""WITH {_SPECTRA} SELECT session_id, segment_start, frame_id, CAST(bin AS INT) AS bin, CAST(freq_hz AS DOUBLE) AS freq_hz,
      round(p, 4) AS power_db FROM stp"""
)
def short_time_psd(t):
    framed = dsp.frame_blocks(dsp.with_segments(t.iq_blocks), HOW.frame_samples)
    psd = dsp.short_time_psd(framed, HOW.frame_samples, HOW.welch_segments, precise=True)
    return psd.select(
        "session_id", "segment_start", "frame_id", "f0_hz", "bin_hz",
        F.posexplode("power_db").alias("bin", "p"),
    ).select(
        "session_id", "segment_start", "frame_id", "bin",
        (F.col("f0_hz") + F.col("bin") * F.col("bin_hz")).alias("freq_hz"),
        F.round("p", 4).alias("power_db"),
    )


_NOISE = f"""{_SPECTRA},
  hist AS (SELECT session_id, bin, list(p ORDER BY segment_start, frame_id) AS ps,
    list(segment_start ORDER BY segment_start, frame_id) AS ss, list(frame_id ORDER BY segment_start, frame_id) AS fs
    FROM stp GROUP BY session_id, bin),
  nz AS (SELECT session_id, bin, unnest(ss) AS segment_start, unnest(fs) AS frame_id, unnest(ps) AS p,
    unnest(list_transform(range(1, len(ps) + 1), lambda i: list_reduce(ps[1:i - 1],
      lambda n, v: CASE WHEN v >= n + 3 THEN n ELSE n + 0.02 * least(greatest(v - n, -3), 0.25) END, ps[1]))) AS noise FROM hist)"""


@query(
    f"""WITH {_NOISE} SELECT session_id, segment_start, frame_id, CAST(bin AS INT) AS bin, round(noise, 4) AS noise_db FROM nz"""
)
def bin_noise_floor(t):
    floors = noise.bin_noise_floor(
        wideband.spectra(t.iq_blocks, wideband.gaps_of(t.iq_blocks), HOW, precise=True),
        HOW.threshold_db,
        block_bins=4,
    )
    return floors.select(
        "session_id", "segment_start", "frame_id", "first_bin",
        F.posexplode("noise_db").alias("i", "n"),
    ).select(
        "session_id", "segment_start", "frame_id",
        (F.col("first_bin") + F.col("i")).alias("bin"),
        F.round("n", 4).alias("noise_db"),
    )


@query(
    f"""WITH {_NOISE},
      hot AS (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY session_id, segment_start, frame_id ORDER BY bin) = 1
        THEN 0 ELSE 1 END AS fresh FROM nz WHERE p >= noise + 3),
      isl AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id, segment_start, frame_id ORDER BY bin) AS run FROM hot),
      pk AS (SELECT *, max(p) OVER (PARTITION BY session_id, segment_start, frame_id, run) AS peak FROM isl)
      SELECT session_id, segment_start, frame_id,
        round(sum(pow(10, p / 10) * (867669000.0 + bin * 150000.0)) / sum(pow(10, p / 10)), 1) AS center_hz,
        round(any_value(peak), 3) AS peak_db, round(any_value(peak) - arg_max(noise, p), 3) AS peak_snr_db,
        CAST(count(*) FILTER (p >= peak - 10) * 150000.0 AS DOUBLE) AS width_hz
      FROM pk GROUP BY session_id, segment_start, frame_id, run"""
)
def wideband_regions(t):
    blocks = t.iq_blocks
    floors = wideband.noise_of(blocks, wideband.gaps_of(blocks), HOW, precise=True)
    return detect.wideband_regions(floors, HOW.threshold_db).select(
        "session_id",
        "segment_start",
        "frame_id",
        F.round("center_hz", 1).alias("center_hz"),
        F.round("peak_db", 3).alias("peak_db"),
        F.round("peak_snr_db", 3).alias("peak_snr_db"),
        "width_hz",
    )


@query()
def track_bursts(t):
    gaps = wideband.gaps_of(t.iq_blocks)
    floors = wideband.noise_of(t.iq_blocks, gaps, HOW)
    regions = cut_lineage(detect.wideband_regions(floors, HOW.threshold_db))
    return tracks.track_bursts(regions, acquisition.segments_of(gaps, HOW.frame_samples))


@query()
def finish_burst(t):
    return wideband.wideband_bursts(t.iq_blocks, HOW)


@query()
def cu8_bursts(t):
    """The whole wideband chain on text read as samples; each text is a gap-free segment."""
    return wideband.wideband_bursts(t.cu8_blocks, Evidence(datatype="cu8"))


@query(
    """SELECT session_id, sequence,
       array_to_string(list_filter([CASE WHEN raw_duration_ms BETWEEN 900 AND 1400 THEN 'long_wakeup' END,
         CASE WHEN raw_duration_ms BETWEEN 35 AND 70 THEN 'short_wakeup' END,
         CASE WHEN raw_duration_ms >= 20 AND bandwidth_hz >= 30000 THEN 'wideband' END], lambda x: x IS NOT NULL), ',') AS reasons,
       CAST(CASE WHEN raw_duration_ms BETWEEN 900 AND 1400 THEN 3 ELSE 0 END + CASE WHEN raw_duration_ms BETWEEN 35 AND 70
         THEN 1 ELSE 0 END + CASE WHEN raw_duration_ms >= 20 AND bandwidth_hz >= 30000 THEN 2 ELSE 0 END AS DOUBLE) AS candidate_score
       FROM bursts"""
)
def classify_burst(t):
    return tracks.classify_burst(t.bursts).select(
        "session_id", "sequence", F.array_join("candidate_reasons", ",").alias("reasons"), "candidate_score"
    )


_NOVEL = """sc AS (SELECT *, CASE WHEN raw_duration_ms BETWEEN 900 AND 1400 THEN 3 ELSE 0 END + CASE WHEN raw_duration_ms BETWEEN 35 AND 70
    THEN 1 ELSE 0 END + CASE WHEN raw_duration_ms >= 20 AND bandwidth_hz >= 30000 THEN 2 ELSE 0 END AS score,
    CAST(round_even(measured_hz / 50000, 0) AS BIGINT) AS bucket FROM bursts),
  el AS (SELECT *, qualified AND score >= 2 AS ok, sum(CASE WHEN qualified AND score >= 2 THEN 1 ELSE 0 END)
    OVER (PARTITION BY session_id, bucket ORDER BY sequence) AS seen FROM sc),
  nov AS (SELECT *, ok AND seen <= 6 AS is_candidate, ok AND seen > 6 AS is_suppressed FROM el)"""


def _novel(t):
    return tracks.novelty_filter(tracks.classify_burst(t.bursts), chunk_bursts=2_000)


@query(f"WITH {_NOVEL} SELECT session_id, sequence, bucket, is_candidate, is_suppressed FROM nov")
def novelty_filter(t):
    return _novel(t).select("session_id", "sequence", "bucket", "is_candidate", "is_suppressed")


@query(
    f"WITH {_NOVEL} SELECT session_id, bucket * 50000 AS freq_hz FROM nov WHERE is_candidate "
    "GROUP BY session_id, bucket HAVING count(*) >= 6"
)
def recurring_emitters(t):
    return tracks.recurring_emitters(_novel(t))


_GRID = """least(greatest(CAST(ceil((measured_hz - 867569000) / 100000.0 - 0.5) AS INT), 0), 14)"""


@query(
    f"""WITH b AS (SELECT *, {_GRID} AS channel_index FROM bursts),
      g AS (SELECT session_id, channel_index, count(*) AS observations, count(*) FILTER (qualified) AS qualified_observations,
        arg_max(start_s, sequence) AS last_seen_s, max(peak_snr_db) AS peak_snr_db, arg_max(noise_db, sequence) AS noise_db FROM b GROUP BY ALL)
      SELECT session_id, channel_index, 867569000 + channel_index * 100000 AS freq_hz, coalesce(observations, 0) AS observations,
        coalesce(qualified_observations, 0) AS qualified_observations, last_seen_s, coalesce(peak_snr_db, 0) AS peak_snr_db, noise_db
      FROM (SELECT DISTINCT session_id FROM bursts) CROSS JOIN (SELECT CAST(range AS INT) AS channel_index FROM range(15))
        LEFT JOIN g USING (session_id, channel_index)"""
)
def grid_tally(t):
    placed = t.bursts.withColumn("channel_index", C.nearest_grid_index(F.col("measured_hz")))
    return tracks.grid_tally(placed)


@query(f"SELECT session_id, sequence, {_GRID} AS channel_index FROM bursts")
def nearest_grid_channel(t):
    return t.bursts.select(
        "session_id", "sequence", C.nearest_grid_index(F.col("measured_hz")).alias("channel_index")
    )


@query(
    f"""SELECT DISTINCT session_id, {_GRID.replace('measured_hz', 'center_hz')} AS channel_index FROM open_tracks
        WHERE start_frame <= 700 AND close_frame > 700"""
)
def active_grid_channels(t):
    return tracks.active_grid_channels(t.open_tracks, 700)


@query(
    f"""WITH {_NOVEL},
      f AS (SELECT session_id, CAST(sum(n_frames) AS BIGINT) AS frames_processed, round(64 / max(sample_rate) * 1000.0, 3) AS frame_ms
        FROM segment_totals GROUP BY session_id),
      g AS (SELECT session_id, count(*) AS bursts, count(*) FILTER (qualified) AS qualified_bursts,
        count(*) FILTER (is_candidate) AS candidates_flagged, count(*) FILTER (is_suppressed) AS suppressed_recurring FROM nov GROUP BY session_id)
      SELECT session_id, frames_processed, frame_ms, coalesce(bursts, 0) AS bursts, coalesce(qualified_bursts, 0) AS qualified_bursts,
        coalesce(candidates_flagged, 0) AS candidates_flagged, coalesce(suppressed_recurring, 0) AS suppressed_recurring
      FROM f LEFT JOIN g USING (session_id)"""
)
def evidence_snapshot(t):
    return tracks.evidence_snapshot(_novel(t), t.segment_totals, 64)


@query(
    """SELECT session_id, sequence FROM bursts QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY sequence DESC) <= 200"""
)
def recent_bursts(t):
    return tracks.recent_bursts(t.bursts).select("session_id", "sequence")


_THROTTLE = """WITH RECURSIVE d AS (SELECT session_id, channel_id, detection_id, epoch_us(ts) AS us FROM detections),
  k AS (SELECT session_id, channel_id, min(us) AS us FROM d GROUP BY ALL UNION ALL
    SELECT k.session_id, k.channel_id, min(d.us) FROM k JOIN d ON d.session_id = k.session_id AND d.channel_id = k.channel_id
      AND d.us >= k.us + {gap} GROUP BY k.session_id, k.channel_id, k.us)
  SELECT session_id, channel_id, detection_id FROM d JOIN k USING (session_id, channel_id, us)"""


@query(_THROTTLE.format(gap=36_000_000_000))
def throttle_detections(t):
    rows = t.detections.withColumn("ts_us", F.unix_micros("ts"))
    return capture.throttle(
        rows, ["session_id", "channel_id"], "ts_us", "detection_id", 36_000_000_000
    ).select("session_id", "channel_id", "detection_id")


@query(
    """WITH RECURSIVE d AS (SELECT session_id, frame_seq, epoch_us(ts) AS us FROM psd_frames),
      k AS (SELECT session_id, min(us) AS us FROM d GROUP BY ALL UNION ALL
        SELECT k.session_id, min(d.us) FROM k JOIN d ON d.session_id = k.session_id AND d.us >= k.us + 2000000 GROUP BY k.session_id, k.us)
      SELECT session_id, frame_seq FROM d JOIN k USING (session_id, us)"""
)
def throttle_frames(t):
    rows = t.psd_frames.select("session_id", "frame_seq", F.unix_micros("ts").alias("ts_us"))
    return capture.throttle(
        rows, ["session_id"], "ts_us", "frame_seq", 2_000_000, chunk_us=10_000_000
    ).select("session_id", "frame_seq")


@query(
    """WITH RECURSIVE seqs AS (SELECT session_id, snapshot_seq, lag(snapshot_seq) OVER (PARTITION BY session_id ORDER BY snapshot_seq) AS prior
        FROM (SELECT DISTINCT session_id, snapshot_seq FROM snapshots)),
      s AS (SELECT *, lag(status) OVER w AS was, lag(snapshot_seq) OVER w AS was_seq FROM snapshots
        WINDOW w AS (PARTITION BY session_id, channel_id ORDER BY snapshot_seq)),
      turned AS (SELECT s.* FROM s JOIN seqs USING (session_id, snapshot_seq) WHERE prior IS NOT NULL AND status = 'active'
        AND NOT coalesce(was_seq = prior AND was = 'active', false)),
      hit AS (SELECT t.session_id, t.channel_id, t.snapshot_seq, epoch_us(t.ts) AS us FROM turned t WHERE EXISTS (SELECT 1 FROM rules r
        WHERE r.enabled AND (freq_lo_mhz IS NULL OR t.center_hz / 1e6 >= freq_lo_mhz) AND (freq_hi_mhz IS NULL OR t.center_hz / 1e6 <= freq_hi_mhz)
        AND (min_snr IS NULL OR t.snr_db >= min_snr) AND (min_confidence IS NULL OR t.confidence >= min_confidence)
        AND (NOT require_regular_cadence OR (t.recurrence_interval_s IS NOT NULL AND t.observation_count >= 4)))),
      k AS (SELECT session_id, channel_id, min(us) AS us FROM hit GROUP BY ALL UNION ALL
        SELECT k.session_id, k.channel_id, min(h.us) FROM k JOIN hit h ON h.session_id = k.session_id AND h.channel_id = k.channel_id
        AND h.us >= k.us + 86400000000 GROUP BY k.session_id, k.channel_id, k.us)
      SELECT session_id, channel_id, snapshot_seq FROM hit JOIN k USING (session_id, channel_id, us)"""
)
def activation_alerts(t):
    return M.activation_alerts(
        t.snapshots, t.rules, number_chunk("snapshot_seq", 50), debounce_s=86_400
    ).select("session_id", "channel_id", "snapshot_seq")


def _captures(t):
    """Every seventeenth block fires."""
    gaps = wideband.gaps_of(t.iq_blocks)
    fired = F.pmod(F.floor(F.col("start_sample") / 32), F.lit(17)) == 0
    triggers = gaps.filter(fired).select(
        "session_id",
        "segment_start",
        "sample_rate",
        F.col("start_sample").alias("trigger_id"),
        F.col("start_sample").alias("block_start"),
        F.col("end_sample").alias("block_end"),
    )
    windows = cut_lineage(capture.capture_windows(triggers, 1e-4, 2e-4, 6e-4))
    return capture.finished_captures(windows, gaps, bucket_samples=256)


_CAPTURED = f"WITH RECURSIVE {META}, {folded.CAPTURES}"


@query(
    f"""{_CAPTURED} SELECT session_id, segment_start, sample_rate, capture_start, deadline, max_end, array_to_string(triggers, ',') AS triggers, capture_end FROM captures"""
)
def triggered_capture(t):
    return _captures(t).withColumn("triggers", F.array_join("triggers", ","))


@query(
    f"""{_CAPTURED}, parts AS (SELECT c.session_id, c.segment_start, capture_start, capture_end, len(triggers) AS n_triggers,
        iq[2 * (greatest(capture_start, b.start_sample) - b.start_sample) + 1 : 2 * (least(capture_end, b.start_sample + len(iq) // 2) - b.start_sample)] AS part
        FROM captures c JOIN iq_blocks b ON b.session_id = c.session_id AND b.start_sample < capture_end AND b.start_sample + len(iq) // 2 > capture_start)
      SELECT session_id, segment_start, capture_start, capture_end, n_triggers, CAST(sum(len(part)) AS BIGINT) AS n_values,
        round(sum(list_sum([CAST(x AS DOUBLE) FOR x IN part])), 6) AS total FROM parts GROUP BY ALL"""
)
def trigger_capture_join(t):
    found = capture.trigger_capture_join(
        cut_lineage(_captures(t)), dsp.with_segments(t.iq_blocks), bucket_samples=256
    )
    total = F.aggregate("iq", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return found.select(
        "session_id",
        "segment_start",
        "capture_start",
        "capture_end",
        F.size("triggers").cast("bigint").alias("n_triggers"),
        F.size("iq").cast("bigint").alias("n_values"),
        F.round(total, 6).alias("total"),
    )


@query(
    f"""{_CAPTURED}, l AS (SELECT session_id, max(segment_start) AS last_segment, max(end_sample) AS e, max(sample_rate) AS rate FROM segs GROUP BY session_id)
      SELECT session_id, count(capture_end) AS captures_completed, count(*) FILTER (capture_end IS NULL AND segment_start < last_segment) AS captures_aborted_discontinuity,
        coalesce(CAST(sum(len(triggers)) AS BIGINT), 0) AS triggers, coalesce(round(sum((capture_end - capture_start) / rate), 3), 0) AS captured_seconds,
        count(*) FILTER (capture_end IS NULL AND segment_start = last_segment) > 0 AS capture_pending,
        coalesce(CAST(sum(len(triggers)) FILTER (capture_end IS NULL AND segment_start = last_segment) AS BIGINT), 0) AS pending_triggers,
        round(least(e - last_segment, {folded.PRE}) / rate, 6) AS buffered_seconds
      FROM l LEFT JOIN captures USING (session_id) GROUP BY session_id, e, last_segment, rate"""
)
def capture_stats(t):
    return capture.capture_stats(_captures(t), wideband.gaps_of(t.iq_blocks), 1e-4)


@query(
    f"""WITH {META},
      l AS (SELECT session_id, max(segment_start) AS segment_start, max(end_sample) AS e FROM segs GROUP BY session_id)
      SELECT session_id, e - 1200 AS capture_start, e AS capture_end, CAST(2400 AS INT) AS n_values
      FROM l WHERE e - segment_start >= 1200"""
)
def recent_iq(t):
    return capture.recent_iq(dsp.with_segments(t.iq_blocks), 0.5).select(
        "session_id", "capture_start", "capture_end", F.size("iq").alias("n_values")
    )


@query(
    f"""{_CAPTURED}, {_NOVEL},
      e AS (SELECT session_id, 'candidate' AS kind, 'candidate f=' || freq_hz || ' bw=' || bandwidth_hz || 'Hz' AS message, CAST(freq_hz AS VARCHAR) AS about FROM nov WHERE is_candidate
        UNION ALL SELECT session_id, 'capture', len(triggers) || ' candidate burst(s)', CAST(capture_start AS VARCHAR) FROM captures WHERE capture_end IS NOT NULL
        UNION ALL SELECT session_id, 'channel_merged', 'channel ' || channel_id || ' joined ' || (channel_id - 1), CAST(channel_id AS VARCHAR) FROM removed_channels)
      SELECT session_id, kind, message, about, count(*) AS n FROM e GROUP BY ALL"""
)
def event_log(t):
    from bandsift.operators import report

    removed = t.removed_channels.withColumn("merged_into", F.col("channel_id") - 1)
    flagged = _novel(t).filter("is_candidate")
    found = report.event_log(flagged, _captures(t), removed)
    about = F.coalesce(*(F.get_json_object("data", f"$.{c}") for c in ("freq_hz", "capture_start", "channel_id")))
    return found.groupBy("session_id", "kind", "message", about.alias("about")).agg(F.count(F.lit(1)).alias("n"))
