"""Queries over spectra and IQ blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bandsift import params as P
from bandsift.catalog import folded
from bandsift.catalog.registry import query
from bandsift.functions import arrays as A
from bandsift.operators import acquisition, cluster, detect, dsp, noise, occupancy
from bandsift.operators.capture import throttle
from bandsift.operators.ordered import number_chunk
from bandsift.plans import sweep
from bandsift.runtime import cut_lineage

FLOORS = """
fl AS (SELECT session_id, frame_seq, list_aggregate(power_db, 'quantile_cont', 0.25) AS x
       FROM psd_frames),
fs AS (SELECT session_id, list(x ORDER BY frame_seq) AS xs, list(frame_seq ORDER BY frame_seq) AS q
       FROM fl GROUP BY session_id),
floors AS (SELECT session_id, unnest(q) AS frame_seq,
                  unnest(list_transform(range(1, len(xs) + 1),
                         lambda i: list_reduce(xs[1:i], lambda a, b: 0.95 * a + 0.05 * b)))
                  AS floor_db
           FROM fs)"""

REGIONS = (
    FLOORS
    + """,
bins AS (SELECT p.session_id, p.frame_seq, p.f0_hz, p.bin_hz, floor_db,
                generate_subscripts(power_db, 1) - 1 AS bin, unnest(power_db) AS v
         FROM psd_frames p JOIN floors USING (session_id, frame_seq)),
hot AS (SELECT *, CASE WHEN bin - lag(bin) OVER w - 1 <= 3 THEN 0 ELSE 1 END AS fresh
        FROM bins WHERE v >= floor_db + 12 WINDOW w AS (PARTITION BY session_id, frame_seq ORDER BY bin)),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id, frame_seq ORDER BY bin) AS run FROM hot),
runs AS (SELECT session_id, frame_seq, run, min(bin) AS bin_start, max(bin) AS bin_stop,
                max(v) AS peak, arg_max(bin, v) AS peak_bin, any_value(f0_hz) AS f0_hz,
                any_value(bin_hz) AS bin_hz, any_value(floor_db) AS floor_db
         FROM isl GROUP BY ALL),
avgs AS (SELECT r.session_id, r.frame_seq, r.run, 10 * log10(avg(pow(10, b.v / 10))) AS a
         FROM runs r JOIN bins b ON b.session_id = r.session_id AND b.frame_seq = r.frame_seq
              AND b.bin BETWEEN r.bin_start AND r.bin_stop GROUP BY ALL),
regions AS (SELECT session_id, frame_seq, CAST(f0_hz + bin_hz * peak_bin AS BIGINT) AS center_hz,
       CAST(bin_hz * (bin_stop - bin_start + 1) AS BIGINT) AS bandwidth_hz,
       round(peak, 3) AS peak_power_db, round(a, 3) AS avg_power_db,
       round(peak - floor_db, 3) AS snr_db,
       CAST(round_even(f0_hz + bin_hz * bin_start - bin_hz / 2, 0) AS BIGINT) AS start_hz,
       CAST(round_even(f0_hz + bin_hz * bin_stop + bin_hz / 2, 0) AS BIGINT) AS stop_hz,
       CAST(bin_start AS INT) AS bin_start, CAST(bin_stop AS INT) AS bin_stop
FROM runs JOIN avgs USING (session_id, frame_seq, run))"""
)

_REGION = (
    "session_id", "frame_seq", "center_hz", "bandwidth_hz", "peak_power_db", "avg_power_db",
    "snr_db", "start_hz", "stop_hz", "bin_start", "bin_stop",
)


@query(
    "SELECT session_id, frame_seq, round(list_aggregate(power_db, 'quantile_cont', 0.25), 6) "
    "AS frame_floor_db FROM psd_frames"
)
def frame_floor(t):
    return noise.frame_floor(t.psd_frames).select(
        "session_id", "frame_seq", F.round("frame_floor_db", 6).alias("frame_floor_db")
    )


@query(f"WITH {FLOORS} SELECT session_id, frame_seq, round(floor_db, 6) AS floor_db FROM floors")
def ema_floor(t):
    return noise.ema_floor(t.psd_frames).withColumn("floor_db", F.round("floor_db", 6))


@query(f"WITH {REGIONS} SELECT * FROM regions")
def detect_regions(t):
    return detect.detect_regions(noise.with_floor(t.psd_frames), 12.0).select(*_REGION)


@query(
    f"WITH {REGIONS} SELECT * FROM regions WHERE center_hz BETWEEN 867000000 AND 870000000"
)
def in_band_regions(t):
    return detect.in_band_regions(
        detect.detect_regions(noise.with_floor(t.psd_frames), 12.0)
    ).select(*_REGION)


@query(
    f"""WITH {FLOORS},
    bins AS (SELECT p.session_id, p.frame_seq, floor_db, f0_hz + bin_hz * (generate_subscripts(power_db, 1) - 1)
             AS f, generate_subscripts(power_db, 1) - 1 AS bin, unnest(power_db) AS v
             FROM psd_frames p JOIN floors USING (session_id, frame_seq))
    SELECT session_id, frame_seq, CAST(bin AS INT) AS bin, round(CASE WHEN f BETWEEN 867500000 AND 867700000
           OR f BETWEEN 869000000 AND 869100000 THEN floor_db - 1 ELSE v END, 6) AS power_db FROM bins"""
)
def exclusion_mask(t):
    masked = detect.exclusion_mask(
        noise.with_floor(t.psd_frames), [(867_500_000, 867_700_000), (869_000_000, 869_100_000)]
    )
    return masked.select("session_id", "frame_seq", F.posexplode("power_db").alias("bin", "v")).select(
        "session_id", "frame_seq", "bin", F.round("v", 6).alias("power_db")
    )


_RUNS = """bins AS (SELECT session_id, frame_seq, generate_subscripts(power_db, 1) - 1 AS bin,
                unnest(power_db) AS v FROM psd_frames),
hot AS (SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY session_id, frame_seq ORDER BY bin) - 1 <= {gap}
        THEN 0 ELSE 1 END AS fresh FROM bins WHERE v >= -55),
isl AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id, frame_seq ORDER BY bin) AS run FROM hot)
SELECT session_id, frame_seq, CAST(min(bin) AS INT) AS run_start, CAST(max(bin) AS INT) AS run_stop
FROM isl GROUP BY session_id, frame_seq, run"""


@query("WITH " + _RUNS.format(gap=0))
def contiguous_runs(t):
    mask = t.psd_frames.select(
        "session_id",
        "frame_seq",
        F.transform("power_db", lambda p: p >= F.lit(-55.0)).alias("mask"),
    )
    return detect.contiguous_runs(mask, "mask").drop("mask")


@query("WITH " + _RUNS.format(gap=2))
def merge_runs(t):
    return detect.merge_runs(
        contiguous_runs(t), ["session_id", "frame_seq"], "run_start", "run_stop", 2
    )


@query(
    """SELECT session_id, frame_seq, CAST(g AS INT) AS bin, CAST(list_max(power_db[CAST(trunc(g * (len(power_db) / 10.0)) AS INT) + 1
       : greatest(CAST(trunc((g + 1) * (len(power_db) / 10.0)) AS INT), 1)]) AS FLOAT) AS power_db
       FROM psd_frames, range(10) r(g)"""
)
def reduce_bins(t):
    return t.psd_frames.select(
        "session_id", "frame_seq", F.posexplode(A.reduce_bins(F.col("power_db"), 10)).alias("bin", "power_db")
    )


@query(
    """SELECT session_id, frame_seq, CAST(g AS INT) AS bin,
       round(f0_hz + (bin_hz * (len(power_db) - 1)) / 9 * g, 3) AS freq_hz FROM psd_frames, range(10) r(g)""",
)
def reduced_axis(t):
    axis = A.frequency_axis(F.col("f0_hz"), F.col("bin_hz"), F.size("power_db"), 10)
    return t.psd_frames.select(
        "session_id", "frame_seq", F.posexplode(axis).alias("bin", "f")
    ).select("session_id", "frame_seq", "bin", F.round("f", 3).alias("freq_hz"))


@query(
    """WITH m AS (SELECT session_id, start_sample, generate_series AS i,
         sqrt(CAST(iq[2 * generate_series + 1] AS DOUBLE) ** 2 + CAST(iq[2 * generate_series + 2] AS DOUBLE) ** 2) AS mag
         FROM iq_blocks, generate_series(0, 31))
       SELECT session_id, start_sample, CAST(i // 2 AS INT) AS point, round(20 * log10(avg(mag) + 1e-12), 6) AS envelope_db
       FROM m GROUP BY session_id, start_sample, i // 2"""
)
def envelope_db(t):
    return t.iq_blocks.select(
        "session_id", "start_sample", F.posexplode(A.envelope_db(F.col("iq"), 16)).alias("point", "e")
    ).select("session_id", "start_sample", "point", F.round("e", 6).alias("envelope_db"))


@query(
    """WITH b AS (SELECT session_id, frame_seq, g, list_avg(power_db[g * 4 + 1 : g * 4 + 4]) AS m
                  FROM psd_frames, range(16) r(g)),
       s AS (SELECT *, min(m) OVER w AS lo, max(m) OVER w AS hi FROM b WINDOW w AS (PARTITION BY session_id, frame_seq))
       SELECT session_id, frame_seq, CAST(g AS INT) AS point, round((m - lo) / (hi - lo), 4) AS level FROM s"""
)
def normalize_envelope(t):
    return t.psd_frames.select(
        "session_id",
        "frame_seq",
        F.posexplode(A.normalize_envelope(F.col("power_db"))).alias("point", "level"),
    )


@query(
    """WITH b AS (SELECT session_id, frame_seq, generate_subscripts(power_db, 1) - 1 AS bin,
         (f0_hz + bin_hz * (generate_subscripts(power_db, 1) - 1)) / 1e6 AS freq_mhz, unnest(power_db) AS v FROM psd_frames)
       SELECT session_id, frame_seq, CAST(bin AS INT) AS bin, round(freq_mhz, 6) AS freq_mhz,
         CASE WHEN bin % 7 <> 0 AND bin % 9 <> 4 THEN round(v, 6) END AS power_db FROM b"""
)
def finite_or_null(t):
    spoiled = F.transform(
        "power_db",
        lambda p, i: F.when(i % 7 == 0, F.lit(float("nan")))
        .when(i % 9 == 4, F.lit(float("-inf")))
        .otherwise(p),
    )
    rows = t.psd_frames.select(
        "session_id", "frame_seq", "f0_hz", "bin_hz",
        F.posexplode(A.finite_or_null(spoiled)).alias("bin", "v"),
    )
    return rows.select(
        "session_id",
        "frame_seq",
        "bin",
        F.round((F.col("f0_hz") + F.col("bin_hz") * F.col("bin")) / 1e6, 6).alias("freq_mhz"),
        F.round("v", 6).alias("power_db"),
    )


@query(
    """WITH b AS (SELECT p.session_id, frame_seq, reference_hz, current_ppm, list_median(power_db) AS med,
         generate_subscripts(power_db, 1) - 1 AS bin, f0_hz + bin_hz * (generate_subscripts(power_db, 1) - 1) AS f,
         unnest(power_db) AS v FROM psd_frames p JOIN references_hz r USING (session_id)),
       n AS (SELECT session_id, frame_seq, reference_hz, current_ppm, max(v) AS peak, any_value(med) AS med,
         arg_max(f, v) AS f FROM b WHERE abs(f - reference_hz) <= 200000 GROUP BY ALL),
       m AS (SELECT *, CAST(f AS BIGINT) AS measured_hz, round(peak - med, 1) AS snr FROM n),
       e AS (SELECT *, measured_hz - reference_hz AS offset_hz,
         round((measured_hz - reference_hz) / reference_hz * 1e6, 2) AS ppm_error FROM m WHERE snr >= 6)
       SELECT session_id, frame_seq, reference_hz, measured_hz, offset_hz, ppm_error, current_ppm,
         CAST(round_even(current_ppm - ppm_error, 0) AS BIGINT) AS suggested_ppm, snr AS peak_snr_db FROM e"""
)
def calibrate_ppm(t):
    return dsp.calibrate_ppm(t.psd_frames, t.references_hz, 200_000)


_STITCH_STEP = 3_000_000 / 255


@query(
    f"""WITH g AS (SELECT CAST(range AS INT) AS band_bin, CASE WHEN range = 255 THEN 870000000.0::DOUBLE
          ELSE 867000000 + range * {_STITCH_STEP!r}::DOUBLE END AS f FROM range(256)),
        c AS (SELECT session_id, band_bin, frame_seq, power_db, (f - f0_hz) / bin_hz AS x
              FROM psd_frames JOIN g ON f BETWEEN f0_hz AND f0_hz + bin_hz * 63),
        v AS (SELECT session_id, band_bin, arg_max(power_db[CAST(floor(x) AS INT) + 1] +
                (coalesce(power_db[CAST(floor(x) AS INT) + 2], power_db[CAST(floor(x) AS INT) + 1])
                 - power_db[CAST(floor(x) AS INT) + 1]) * (x - floor(x)), frame_seq) AS p FROM c GROUP BY ALL),
        s AS (SELECT DISTINCT session_id FROM psd_frames)
        SELECT session_id, band_bin, round(f, 3) AS freq_hz, round(coalesce(p, -140), 6) AS power_db
        FROM s CROSS JOIN g LEFT JOIN v USING (session_id, band_bin)"""
)
def stitch_band(t):
    return occupancy.stitch_band(t.psd_frames, 256).select(
        "session_id",
        "band_bin",
        F.round("freq_hz", 3).alias("freq_hz"),
        F.round("power_db", 6).alias("power_db"),
    )


@query(
    """WITH r AS (SELECT session_id, frame_seq, epoch_us(ts) AS us,
         min(epoch_us(ts)) OVER w AS first_us, count(*) OVER w AS n FROM psd_frames
         WINDOW w AS (PARTITION BY session_id ORDER BY frame_seq ROWS BETWEEN 63 PRECEDING AND CURRENT ROW))
       SELECT session_id, frame_seq, CASE WHEN n > 1 THEN round((n - 1) / ((us - first_us) / 1e6), 3) ELSE 0 END
         AS frame_rate_hz FROM r"""
)
def frame_rate(t):
    return acquisition.frame_rate(t.psd_frames)


_DFT = """s AS (SELECT session_id, start_sample, center_hz, sample_rate, n AS n,
    CAST(iq[2 * n + 1] AS DOUBLE) AS re, CAST(iq[2 * n + 2] AS DOUBLE) AS im FROM iq_blocks, range(32) r(n)),
  w AS (SELECT session_id, start_sample, center_hz, sample_rate, seg, n - seg * 8 AS n,
    re * (0.5 - 0.5 * cos(2 * pi() * (n - seg * 8) / 16)) AS re,
    im * (0.5 - 0.5 * cos(2 * pi() * (n - seg * 8) / 16)) AS im
    FROM s, range(3) q(seg) WHERE n >= seg * 8 AND n < seg * 8 + 16),
  f AS (SELECT session_id, start_sample, center_hz, sample_rate, seg, k,
    sum(re * cos(2 * pi() * k * n / 16) + im * sin(2 * pi() * k * n / 16)) AS xr,
    sum(im * cos(2 * pi() * k * n / 16) - re * sin(2 * pi() * k * n / 16)) AS xi
    FROM w, range(16) z(k) GROUP BY ALL)"""


@query(
    f"""WITH {_DFT}
      SELECT session_id, start_sample, CAST((k + 8) % 16 AS INT) AS bin,
        round(center_hz + (CASE WHEN k < 8 THEN k ELSE k - 16 END) * sample_rate / 16.0, 3) AS freq_hz,
        round(10 * log10(greatest(avg(xr * xr + xi * xi) / (sample_rate * 6.0), 1e-20)), 3) AS power_db
      FROM f GROUP BY session_id, start_sample, k, center_hz, sample_rate"""
)
def welch_psd(t):
    psd = dsp.welch_psd(t.iq_blocks, 16, precise=True)
    return psd.select(
        "session_id", "start_sample", "f0_hz", "bin_hz", F.posexplode("power_db").alias("bin", "p")
    ).select(
        "session_id",
        "start_sample",
        "bin",
        F.round(F.col("f0_hz") + F.col("bin") * F.col("bin_hz"), 3).alias("freq_hz"),
        F.round("p", 3).alias("power_db"),
    )


@query()
def isolate_decimate(t):
    return dsp.isolate_decimate(t.iq_blocks, 600_000.0)


@query()
def modulation_estimate(t):
    """Blocks of one embedding are short, so a session's samples are joined first."""
    return dsp.modulation_estimate(_long_blocks(t), 600_000.0)


def _long_blocks(t):
    """Runs of fifty blocks put together: 1600 samples each."""
    run = F.floor(F.col("captured_at") * 0 + F.col("start_sample") / 2600)
    return (
        t.iq_blocks.withColumn("_run", run)
        .groupBy("session_id", "_run", "center_hz", "sample_rate")
        .agg(
            F.sort_array(F.collect_list(F.struct("start_sample", "iq"))).alias("_b"),
            F.min("captured_at").alias("captured_at"),
        )
        .select(
            "session_id",
            F.get("_b", F.lit(0))["start_sample"].alias("start_sample"),
            "center_hz",
            "sample_rate",
            "captured_at",
            F.flatten(F.transform("_b", lambda b: b["iq"])).alias("iq"),
        )
    )


@query(
    """WITH r AS (SELECT *, CASE WHEN center_hz = lag(center_hz) OVER (PARTITION BY session_id ORDER BY frame_seq)
         THEN 0 ELSE 1 END AS moved FROM hints),
       q AS (SELECT *, sum(moved) OVER (PARTITION BY session_id ORDER BY frame_seq) AS run FROM r)
       SELECT session_id, frame_seq, last_value(CASE WHEN modulation <> 'unknown' THEN modulation END IGNORE NULLS)
         OVER (PARTITION BY session_id, run ORDER BY frame_seq ROWS UNBOUNDED PRECEDING) AS sticky_modulation FROM q"""
)
def sticky_modulation(t):
    return acquisition.sticky_modulation(t.hints, number_chunk("frame_seq", 1000)).select(
        "session_id", "frame_seq", "sticky_modulation"
    )


def _clustered(proximity_hz: int) -> str:
    """CTEs down to the channels of the regions in band."""
    return f"""WITH RECURSIVE {REGIONS.strip()}, inb AS (SELECT g.*, p.ts FROM regions g JOIN psd_frames p USING (session_id, frame_seq)
      WHERE g.center_hz BETWEEN 867000000 AND 870000000), {folded.clusters('inb', proximity_hz)}, {folded.CHANNELS}"""


def _with_plain_times(rows):
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen", "last_seen")})


@query(
    f"""{_clustered(P.PROXIMITY_HZ)} SELECT session_id, channel_id, center_hz, bandwidth_hz, current_power_db, peak_power_db, avg_power_db, snr_db, observation_count,
      make_timestamp(first_us) AS first_seen, make_timestamp(last_us) AS last_seen FROM chans"""
)
def cluster_channels(t):
    return _with_plain_times(
        cluster.cluster_channels(cut_lineage(sweep.regions_of(t.psd_frames, 12.0)))
    )


@query(
    f"""{_clustered(20_000)}, {folded.merged(20_000)} SELECT session_id, c.id AS channel_id, c.hz AS center_hz, c.width AS bandwidth_hz, c.current AS current_power_db,
      c.peak AS peak_power_db, c.avg AS avg_power_db, c.snr AS snr_db, c.n AS observation_count, make_timestamp(c.first_us) AS first_seen, make_timestamp(c.last_us) AS last_seen
      FROM survivors WHERE NOT c.gone"""
)
def merge_overlapping(t):
    regions = cut_lineage(sweep.regions_of(t.psd_frames, 12.0))
    channels = cut_lineage(cluster.cluster_channels(regions, 20_000))
    return _with_plain_times(cluster.merge_overlapping(channels, 20_000))


@query()
def merge_log(t):
    """Merges at snapshots, one a second of the frames' clock."""
    regions = cut_lineage(sweep.regions_of(t.psd_frames, 12.0))
    frames = t.psd_frames.select("session_id", "frame_seq", "ts").withColumn("ts_us", F.unix_micros("ts"))
    marks = throttle(frames, ["session_id"], "ts_us", "frame_seq", 1_000_000, chunk_us=10_000_000)
    return cluster.merge_log(regions, marks, 20_000)


@query()
def sweep_channels(t):
    return sweep.sweep_channels(t.psd_frames, t.as_of, 12.0)


@query(
    f"""WITH {REGIONS},
      strongest AS (SELECT *, row_number() OVER (PARTITION BY session_id, frame_seq ORDER BY snr_db DESC, center_hz) AS r
                    FROM regions)
      SELECT session_id, frame_seq, center_hz, bandwidth_hz, CASE WHEN frame_seq % 2 = 0 THEN 35.5::DOUBLE ELSE 120 END AS duration_ms,
        snr_db AS rel_strength_db, 16 AS envelope_points FROM strongest WHERE r = 1"""
)
def fingerprint(t):
    from bandsift.functions.channels import fingerprint as shape

    regions = detect.detect_regions(noise.with_floor(t.psd_frames), 12.0)
    w = Window.partitionBy("session_id", "frame_seq").orderBy(F.col("snr_db").desc(), "center_hz")
    best = regions.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    fp = shape(
        F.col("center_hz"),
        F.col("bandwidth_hz"),
        F.when(F.col("frame_seq") % 2 == 0, F.lit(35.5)),
        F.col("peak_power_db"),
        F.col("peak_power_db") - F.col("snr_db"),
        F.lit(None).cast("double"),
    )
    return best.select("session_id", "frame_seq", fp.alias("f")).select(
        "session_id",
        "frame_seq",
        *[F.col(f"f.{c}").alias(c) for c in ("center_hz", "bandwidth_hz", "duration_ms", "rel_strength_db")],
        F.size("f.envelope").alias("envelope_points"),
    )


@query(
    """WITH h AS (SELECT session_id, start_sample, hex(raw) AS x, octet_length(raw) // 2 AS n FROM cu8_blocks),
      v AS (SELECT session_id, start_sample, n, unnest(list_transform(range(2 * n), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS INT))) AS u FROM h)
      SELECT session_id, start_sample, n AS n_samples, CAST(sum(u) AS BIGINT) AS total FROM v GROUP BY session_id, start_sample, n"""
)
def decode_cu8(t):
    """Text read as 8-bit samples: whole texts, two bytes a sample."""
    blocks = dsp.decode_blocks(t.cu8_blocks)
    level = lambda x: F.rint(x * F.lit(127.5).cast("float") + F.lit(127.5).cast("float"))
    total = F.aggregate("iq", F.lit(0.0), lambda acc, x: acc + level(x))
    return blocks.select(
        "session_id",
        "start_sample",
        F.floor(F.size("iq") / 2).alias("n_samples"),
        total.cast("bigint").alias("total"),
    )


@query()
def cu8_regions(t):
    """Sweep detection on text read as samples."""
    return sweep.regions_of(cut_lineage(sweep.frames_of(t.cu8_blocks, 256, "cu8")), 6.0)
