"""Floors, regions, clustering."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandsift import schemas
from bandsift.functions import arrays as A
from bandsift.operators import cluster, detect, noise
from tests import models

BASE = 868_000_000.0


def frames(spark, rows, bin_hz=1000.0, floor=-60.0):
    data = [(1, i, None, BASE, bin_hz, [float(v) for v in row]) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, schemas.PSD_FRAMES).withColumn("floor_db", F.lit(floor))


def spectrum(n, base, **runs):
    out = [base] * n
    for level, spans in runs.values():
        for low, high in spans:
            out[low : high + 1] = [level] * (high - low + 1)
    return out


def test_runs_and_merge(spark):
    mask = [c == "1" for c in "0110010111"]
    rows = spark.createDataFrame([(mask,)], "mask array<boolean>")
    runs = detect.contiguous_runs(rows, "mask")
    assert [(r.run_start, r.run_stop) for r in runs.collect()] == [(1, 2), (5, 5), (7, 9)]
    held = spark.createDataFrame([(0, 1, 2), (0, 4, 5), (0, 10, 12)], "k int, a int, b int")
    merged = detect.merge_runs(held, ["k"], "a", "b", 1).orderBy("a")
    assert [(r.a, r.b) for r in merged.collect()] == [(1, 5), (10, 12)]


@pytest.mark.parametrize(
    ("row", "gap_hz", "bounds"),
    [
        (spectrum(512, -60, a=(-20, [(200, 209)])), 0.0, [(200, 209)]),
        (spectrum(512, -70, a=(-30, [(100, 104)]), b=(-25, [(300, 307)])), 0.0,
         [(100, 104), (300, 307)]),
        (spectrum(512, -60, a=(-20, [(100, 103), (106, 109)])), 3000.0, [(100, 109)]),
        (spectrum(256, -60), 0.0, []),
        ([], 0.0, []),
    ],
)
def test_regions(spark, row, gap_hz, bounds):
    found = detect.detect_regions(frames(spark, [row]), 6.0, gap_hz).orderBy("bin_start").collect()
    assert [(r.bin_start, r.bin_stop) for r in found] == bounds
    assert all(r.snr_db >= 30 for r in found)
    if found:
        assert found[0].start_hz == BASE + bounds[0][0] * 1000 - 500


def test_average_counts_gap_bins_and_first_peak_is_the_centre(spark):
    row = [-60.0] * 10 + [-20.0, -60.0, -20.0] + [-60.0] * 10
    (r,) = detect.detect_regions(frames(spark, [row]), 6.0, 1000.0).collect()
    assert r.center_hz == BASE + 10_000
    want = 10 * np.log10(np.mean([1e-2, 1e-6, 1e-2]))
    assert r.avg_power_db == pytest.approx(want, abs=1e-3)


def test_min_bandwidth_and_exclusions(spark):
    row = spectrum(64, -60, a=(-20, [(10, 11)]), b=(-20, [(30, 39)]))
    wide = detect.detect_regions(frames(spark, [row]), 6.0, 0.0, min_bandwidth_hz=5000.0)
    assert [r.bin_start for r in wide.collect()] == [30]
    masked = detect.exclusion_mask(frames(spark, [row]), [(int(BASE) + 30_000, int(BASE) + 39_000)])
    assert [r.bin_start for r in detect.detect_regions(masked, 6.0, 0.0).collect()] == [10]


def test_floor_ignores_signals_and_empty_frames(spark):
    got = noise.frame_floor(frames(spark, [[-60.0] * 1019 + [-10.0] * 5, []])).orderBy("frame_seq")
    assert [r.frame_floor_db for r in got.collect()] == [-60.0, -120.0]


@pytest.mark.parametrize("alpha", [0.0, -0.1, 1.5])
def test_bad_alpha(spark, alpha):
    with pytest.raises(ValueError):
        noise.ema_floor(frames(spark, [[-60.0]]), alpha)


@pytest.mark.parametrize(("width", "alpha"), [(2, 0.05), (3, 0.5), (512, 0.05), (4, 1.0)])
def test_ema_scan_equals_a_plain_loop(spark, width, alpha):
    rng = np.random.default_rng(1)
    values = rng.normal(-60, 5, (2, 40))
    seqs = sorted(rng.choice(200, 40, replace=False).tolist())
    data = [
        (s, q, None, BASE, 1000.0, [float(v)])
        for s in (0, 1)
        for q, v in zip(seqs, values[s], strict=True)
    ]
    df = spark.createDataFrame(data, schemas.PSD_FRAMES)
    got = noise.ema_floor(df, alpha, width).orderBy("session_id", "frame_seq").collect()
    want = [v for s in (0, 1) for v in models.ema(values[s], alpha)]
    assert [r.floor_db for r in got] == pytest.approx(want, abs=1e-9)


def test_reduce_and_normalize(spark):
    df = spark.createDataFrame([([1.0, 9.0, 3.0, 4.0, 5.0],), ([],)], "p array<double>")
    reduced = [r[0] for r in df.select(A.reduce_bins(F.col("p"), 2)).collect()]
    assert reduced == [[9.0, 5.0], []]
    flat = [r[0] for r in df.select(A.normalize_envelope(F.col("p") , 4)).collect()]
    assert flat[1] == [0.0] * 4 and min(flat[0]) == 0.0 and max(flat[0]) == 1.0


def regions(spark, rows):
    return spark.createDataFrame(
        [
            (s, seq, center, width, peak, avg, snr)
            for s, seq, center, width, peak, avg, snr in rows
        ],
        "session_id bigint, frame_seq bigint, center_hz bigint, bandwidth_hz bigint, "
        "peak_power_db double, avg_power_db double, snr_db double",
    ).withColumn("ts", F.timestamp_micros(F.col("frame_seq") * 100_000))


def test_cluster_cases(spark):
    near = [(1, i, c, 10_000, -20.0, -25.0, 30.0) for i, c in enumerate((868_000_000, 868_010_000, 868_005_000))]
    (one,) = cluster.cluster_channels(regions(spark, near), 25_000).collect()
    assert one.observation_count == 3
    far = [(1, 0, 868_000_000, 10_000, -20.0, -25.0, 30.0), (1, 1, 869_000_000, 10_000, -20.0, -25.0, 30.0)]
    assert cluster.cluster_channels(regions(spark, far), 25_000).count() == 2
    wide = [(1, 0, 868_000_000, 60_000, -20.0, -25.0, 30.0), (1, 1, 868_040_000, 60_000, -20.0, -25.0, 30.0)]
    channels = cluster.cluster_channels(regions(spark, wide), 25_000)
    assert [r.channel_id for r in cluster.merged_away(channels, 25_000).collect()] == [2]


@pytest.mark.parametrize("seed", range(3))
def test_islands_equal_one_sequential_pass(spark, seed):
    rng = random.Random(seed)
    rows = []
    for session in range(3):
        for seq in range(120):
            for _ in range(rng.randint(0, 3)):
                center = 868_000_000 + rng.choice([0, 30_000, 70_000, 200_000, 260_000]) + rng.randint(-15_000, 15_000)
                rows.append((session, seq, center, rng.randint(1, 60) * 1000, round(rng.uniform(-60, -20), 3),
                             round(rng.uniform(-70, -30), 3), round(rng.uniform(5, 40), 3)))
    rows = list({(r[0], r[1], r[2]): r for r in rows}.values())
    rng.shuffle(rows)
    channels = cluster.cluster_channels(regions(spark, rows), 25_000)
    survivors = cluster.merge_overlapping(channels, 25_000)

    def shown(df):
        return sorted(
            (r.session_id, r.channel_id, r.center_hz, r.bandwidth_hz, r.peak_power_db, r.avg_power_db,
             r.snr_db, r.observation_count) for r in df.collect()
        )

    want, kept = [], []
    for session in range(3):
        ordered = sorted(r[1:] for r in rows if r[0] == session)
        found = models.clusters(ordered, 25_000)
        row = lambda c: (session, c["id"], c["center"], c["width"], c["peak"], c["avg"], c["snr"], c["n"])  # noqa: B023,E731
        want += [row(c) for c in found]
        kept += [row(c) for c in models.merged(found, 25_000)[0]]
    assert shown(channels) == sorted(want)
    assert shown(survivors) == sorted(kept)
