"""Ordered primitives, timing, scores, filters, joins, upkeep."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from bandsift.operators import channels as ch
from bandsift.operators import config as G
from bandsift.operators import maintenance as M
from bandsift.operators import occupancy, ordered, ranges, timing

AS_OF = "2024-01-15 00:00:00"


def history(spark, n=400, seed=1):
    """One key holds most rows; values have holes."""
    rng = random.Random(seed)
    rows = [
        (0 if rng.random() < 0.7 else rng.randint(1, 3), i, rng.choice([None, rng.randint(0, 9)]))
        for i in rng.sample(range(2000), n)
    ]
    return rows, spark.createDataFrame(rows, "k bigint, i bigint, v bigint")


@pytest.mark.parametrize("width", [1, 13, 700, 10_000])
def test_chunks_do_not_change_results(spark, width):
    rows, df = history(spark)
    chunk = ordered.number_chunk("i", width)
    out = ordered.with_previous(df, ["k"], ["i"], ["v", "i"], chunk)
    out = ordered.with_next(out, ["k"], ["i"], ["i"], chunk)
    out = ordered.with_last_known(out, ["k"], ["i"], {"v": "known"}, chunk)
    out = ordered.with_running_sum(out, ["k"], ["i"], {"total": F.coalesce("v", F.lit(0))}, chunk)
    out = ordered.with_position(out, ["k"], ["i"], chunk)
    got = {(r.k, r.i): r for r in out.collect()}
    for k in range(4):
        mine = sorted(r for r in rows if r[0] == k)
        known, total = None, 0
        for n, (_, i, v) in enumerate(mine):
            known, total = v if v is not None else known, total + (v or 0)
            r = got[(k, i)]
            before = mine[n - 1] if n else (None, None, None)
            after = mine[n + 1] if n + 1 < len(mine) else (None, None, None)
            assert (r.prev_i, r.prev_v, r.next_i) == (before[1], before[2], after[1])
            assert (r.known, r.total, r.position) == (known, total, n + 1)
    newest = ordered.newest_per_key(df, ["k"], ["i"], 5, chunk).collect()
    want = {r for k in range(4) for r in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])[-5:]}
    assert {tuple(r) for r in newest} == want


def arrivals(spark, seconds):
    rows = [(1, 7, i, float(s)) for i, s in enumerate(seconds)]
    return spark.createDataFrame(
        rows, "session_id bigint, channel_id bigint, detection_id bigint, s double"
    ).withColumn("ts", F.timestamp_micros(F.round(F.col("s") * 1e6).cast("bigint")))


def test_recurrence_cases(spark):
    pairs = [t for s in (3, 9, 15, 21, 27) for t in (s, s + 0.08)]
    (r,) = timing.recurrence_stats(arrivals(spark, pairs)).collect()
    assert (r.burst_count, r.recurrence_interval_s, r.typical_burst_ms) == (5, 6.0, 80.0)
    assert r.interval_jitter_s == 0.0
    (r,) = timing.recurrence_stats(arrivals(spark, [5.0, 5.3, 5.9])).collect()
    assert (r.burst_count, r.recurrence_interval_s, r.interval_jitter_s) == (1, None, None)
    (r,) = timing.recurrence_stats(arrivals(spark, [2, 2.4, 2.7])).collect()
    assert r.typical_burst_ms == 700.0
    bursts = timing.burst_sessions(arrivals(spark, range(0, 300, 3)), max_arrivals=7)
    assert bursts.agg(F.min("start_us")).first()[0] == 279_000_000
    # A gap of exactly the limit does not split.
    assert timing.burst_sessions(arrivals(spark, [0, 1.0, 2.5])).count() == 2


def test_recurrence_sorts_once(spark):
    """One shuffle, and a sort on either side of it; every row of a task is held once."""
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), rng.randint(1, 3), rng.choice([None, *range(40)]), rng.choice([None, *range(0, 90, 3)])) for _ in range(300)]
    df = spark.createDataFrame(rows, "session_id bigint, channel_id bigint, detection_id bigint, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    df = df.repartition(3)
    found = timing.recurrence_stats(df, 4.0, max_arrivals=9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2 and plan.count("Exchange hashpartitioning") == 1
    assert "Aggregate" not in plan and "Join" not in plan
    want = {}
    for key in {r[:2] for r in rows if r[0] is not None}:
        own = sorted((r[3] for r in rows if r[:2] == key and r[3] is not None), reverse=True)[:9][::-1]
        starts = [i for i, x in enumerate(own) if not i or x - own[i - 1] > 4]
        ends = [*[i - 1 for i in starts[1:]], len(own) - 1]
        gaps = [own[b] - own[a] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        mean = sum(gaps) / len(gaps) if gaps else 0
        spread = round((sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5, 3) if len(gaps) > 1 else None
        want[key] = [
            round(median(gaps), 3) if gaps else None,
            round(median((own[b] - own[a]) * 1000.0 for a, b in zip(starts, ends, strict=True)), 3),
            len(starts),
            spread,
        ]
        bursts = [(n, own[a] * 10**6, own[b] * 10**6, b - a + 1) for n, (a, b) in enumerate(zip(starts, ends, strict=True), 1)]
        got = timing.burst_sessions(df, 4.0, max_arrivals=9).filter((F.col("session_id") == key[0]) & (F.col("channel_id") == key[1]))
        assert sorted((r.burst_seq, r.start_us, r.end_us, r.arrivals) for r in got.collect()) == bursts
    assert {(r[0], r[1]): list(r[2:]) for r in found.collect()} == want
    # More arrivals than Spark limits before a shuffle: the chunks do it.
    assert {r[0] for r in timing.burst_sessions(df, 4.0, max_arrivals=2000).groupBy().sum("arrivals").collect()} == {sum(r[0] is not None and r[3] is not None for r in rows)}


CHANNEL = {
    "session_id": 3, "channel_id": 1, "center_hz": 868_300_000, "bandwidth_hz": 31_000,
    "current_power_db": -17.5, "peak_power_db": -9.25, "avg_power_db": -21.0, "snr_db": 14.5,
    "observation_count": 17, "typical_burst_ms": 140.0, "recurrence_interval_s": 300.0,
    "confidence": 0.65, "status": "active",
}
KINDS = {int: "bigint", float: "double", str: "string"}
SCHEMA = ", ".join(f"{k} {KINDS[type(v)]}" for k, v in CHANNEL.items()) + ", last_seen string"


def channels(spark, *changes):
    rows = []
    for i, change in enumerate(changes or ({},)):
        row = {**CHANNEL, "channel_id": i + 1, "last_seen": AS_OF, **change}
        rows.append(tuple(row.values()))
    return spark.createDataFrame(rows, SCHEMA).withColumn("last_seen", F.col("last_seen").cast("timestamp"))


def test_pattern_scores(spark):
    df = channels(
        spark,
        {"bandwidth_hz": 17_000, "observation_count": 21},
        {"bandwidth_hz": 740_000, "observation_count": 2, "typical_burst_ms": None, "recurrence_interval_s": None},
        {"bandwidth_hz": 6_500, "observation_count": 6, "typical_burst_ms": 2600.0, "recurrence_interval_s": None},
    )
    a, b, c = ch.pattern_score(df).orderBy("channel_id").collect()
    assert a.pattern_score == pytest.approx(1) and a.pattern_label == "strong" and len(a.pattern_reasons) == 4
    assert (b.pattern_score, b.pattern_label, b.pattern_reasons) == (0, "weak", [])
    assert c.pattern_score == pytest.approx(0.45) and c.pattern_reasons == ["narrowband", "repeatedly seen"]


def test_similarity_and_sorting(spark):
    df = channels(spark, {}, {}, {"snr_db": 7.25, "typical_burst_ms": None, "recurrence_interval_s": None})
    pairs = df.select("session_id").distinct().join(spark.createDataFrame([(1, 2), (1, 3)], "channel_a bigint, channel_b bigint"))
    same, other = ch.channel_similarity(df, pairs).orderBy("channel_b").collect()
    assert (same.score, same.verdict) == (1.0, "similar")
    assert other.score == pytest.approx(1 - (0 + 0.5 + 1 + 1) / 4) and other.verdict == "different"
    up = [r.channel_id for r in ch.sort_channels(df, "typical_burst_ms").collect()]
    down = [r.channel_id for r in ch.sort_channels(df, "typical_burst_ms", False).collect()]
    assert (up, down) == ([3, 1, 2], [1, 2, 3])
    with pytest.raises(ValueError):
        ch.sort_channels(df, "fingerprint")


RULE = "rule_id bigint, rule_order bigint, enabled boolean, freq_lo_mhz double, freq_hi_mhz double, min_snr double, min_confidence double, require_regular_cadence boolean"


@pytest.mark.parametrize(
    ("rule", "hit"),
    [
        ((None, None, None, None, None), True),
        ((868.3, 868.3, None, None, None), True),
        ((868.31, None, None, None, None), False),
        ((None, 868.29, None, None, None), False),
        ((None, None, 14.5, 0.65, None), True),
        ((None, None, 14.6, None, None), False),
        ((None, None, None, 0.66, None), False),
        ((None, None, None, None, True), True),
    ],
)
def test_rules_are_inclusive(spark, rule, hit):
    rules = spark.createDataFrame([(1, 0, False, *[None] * 5), (2, 1, True, *rule), (3, 2, True, *rule)], RULE)
    got = ranges.alert_rule_match(channels(spark), rules).collect()
    assert [r.rule_id for r in got] == ([2] if hit else [])


def test_activations_need_a_baseline_and_debounce(spark):
    rows = [
        (1, seq, 10 * seq, c, s)
        for seq, states in enumerate([{1: "active"}, {1: "active", 2: "active"}, {1: "inactive"}, {1: "active", 2: "active"}, {1: "inactive"}, {1: "active"}])
        for c, s in states.items()
    ]
    snaps = spark.createDataFrame(rows, "session_id bigint, snapshot_seq bigint, t bigint, channel_id bigint, status string")
    snaps = snaps.withColumn("ts", F.timestamp_seconds("t"))
    for name, value in CHANNEL.items():
        if name not in snaps.columns:
            snaps = snaps.withColumn(name, F.lit(value))
    chunk = ordered.number_chunk("snapshot_seq", 2)
    turned = {(r.channel_id, r.snapshot_seq) for r in M.activations(snaps, chunk).collect()}
    assert turned == {(2, 1), (1, 3), (2, 3), (1, 5)}
    rules = spark.createDataFrame([(2, 1, True, *[None] * 5)], RULE)
    alerts = M.activation_alerts(snaps, rules, chunk, debounce_s=20).collect()
    assert {(r.channel_id, r.snapshot_seq) for r in alerts} == {(2, 1), (1, 3), (2, 3), (1, 5)}
    alerts = M.activation_alerts(snaps, rules, chunk, debounce_s=21).collect()
    assert {(r.channel_id, r.snapshot_seq) for r in alerts} == {(2, 1), (1, 3)}


def test_equal_ids_of_two_sessions_stay_apart(spark):
    seen = spark.createDataFrame(
        [(1, 7, 100, "2024-01-02 00:00:00"), (2, 7, 101, "2024-01-02 00:00:01"), (2, 7, 102, "2024-01-02 00:00:02")],
        "session_id bigint, channel_id bigint, detection_id bigint, ts string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    known = spark.createDataFrame([(1, 7, 5), (2, 7, 6)], "session_id bigint, channel_id bigint, center_hz bigint")
    sessions = spark.createDataFrame([(1,), (2,)], "session_id bigint")
    got = ranges.detection_channel(seen, known, sessions).collect()
    assert sorted((r.detection_id, r.channel_hz) for r in got) == [(100, 5), (101, 6), (102, 6)]
    newest = M.channel_observations(seen, 1).collect()
    assert sorted(r.detection_id for r in newest) == [100, 102]


def test_occupancy_shape_and_edges(spark):
    rows = [("2024-01-14 23:59:59", 870_000_000), ("2024-01-14 23:59:59", 866_950_000), ("2024-01-14 23:50:00", 867_100_000), ("2024-01-14 23:55:00", 869_999_999)]
    df = spark.createDataFrame(rows, "t string, center_hz bigint").withColumn("ts", F.col("t").cast("timestamp"))
    grid = occupancy.occupancy_grid(df, AS_OF, 5, 30, 32)
    assert grid.count() == 10 * 32
    hits = {(r.bucket, r.freq_bin): r.n for r in grid.filter("n > 0").collect()}
    assert hits == {(9, 0): 1, (0, 31): 1}


def test_coverage(spark):
    schema = "session_id bigint, start_hz bigint, end_hz bigint, lo_hz bigint, hi_hz bigint"
    band = (867_000_000, 870_000_000)
    full = [(1, *band, 866_800_000, 869_200_000), (1, *band, 868_000_000, 870_400_000)]
    holes = [(2, *band, 867_500_000, 868_000_000), (2, *band, 868_500_000, 869_000_000)]
    got = occupancy.coverage_gaps(spark.createDataFrame(full + holes, schema)).orderBy("gap_lo_hz").collect()
    assert [tuple(r) for r in got] == [
        (2, 867_000_000, 867_500_000), (2, 868_000_000, 868_500_000), (2, 869_000_000, 870_000_000)
    ]


def test_stitch_prefers_the_latest_window(spark):
    rows = [(1, 1, 0.0, 10.0, [float(v) for v in range(11)]), (1, 2, 40.0, 10.0, [-5.0, -5.0])]
    frames = spark.createDataFrame(rows, "session_id bigint, frame_seq bigint, f0_hz double, bin_hz double, power_db array<double>")
    got = occupancy.stitch_band(frames, 16, 0, 150).orderBy("band_bin").collect()
    assert [r.power_db for r in got] == [0, 1, 2, 3, -5, -5, 6, 7, 8, 9, 10, -140, -140, -140, -140, -140]


def test_storage_cap_and_upsert(spark):
    rows = [(i, f"2024-01-{i:02d}", 10) for i in range(1, 11)]
    recs = spark.createDataFrame(rows, "recording_id bigint, t string, bytes bigint").withColumn("ts", F.col("t").cast("timestamp"))
    kept = M.storage_cap_evict(recs, 50, 15).collect()
    assert {r.recording_id for r in kept} == {8, 9, 10}
    assert M.storage_cap_evict(recs, 1000, 15).count() == 10
    old = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "session_id bigint, channel_id bigint, status string")
    new = spark.createDataFrame([(1, 2, "c", 5), (1, 2, "d", 6), (1, 3, "e", 1)], "session_id bigint, channel_id bigint, status string, v bigint")
    got = M.channel_upsert(old, new, "v").orderBy("channel_id").collect()
    assert [(r.channel_id, r.status) for r in got] == [(1, "a"), (2, "d"), (3, "e")]


def test_config_rules(spark):
    full = {
        "start_hz": 867_000_000, "end_hz": 870_000_000, "step_hz": 0, "sample_rate": 2_400_000, "gain": "auto",
        "ppm": 0, "dwell_ms": 120, "backend": "sim", "device_index": 0, "threshold_db": 6.0, "noise_floor_alpha": 0.05,
        "fft_size": 2048, "spectrum_fps": 10, "spectrum_bins": 1024, "max_iq_storage_gb": 2.0, "retention_days": 30,
    }
    changes = [
        full, {"threshold_db": 7.0}, {"start_hz": 870_000_000}, {"start_hz": 867_000_000, "fft_size": 1000},
        {"fft_size": 2048, "gain": "loud"}, {"gain": "20.7", "noise_floor_alpha": 0.0}, {"noise_floor_alpha": 1.0, "step_hz": 3_000_000},
    ]
    schema = "receiver_id bigint, version bigint, " + ", ".join(f"{k} {KINDS[type(v)]}" for k, v in full.items())
    rows = [(1, i, *[c.get(k) for k in full]) for i, c in enumerate(changes)]
    df = spark.createDataFrame(rows, schema).withColumn("exclusions", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>"))
    got = G.config_audit(df, 3).orderBy("version").collect()
    assert [r.violations for r in got] == [[], [], ["start_before_end"], ["fft_power_of_two"], ["gain"], ["alpha_in_range"], []]
    assert [r.acquisition_changed for r in got] == [False, False, True, True, True, True, True]
    assert got[6].warnings == ["step_leaves_gaps"] and got[6].threshold_db == 7.0
    assert G.latest_config(G.config_audit(df, 3)).first().version == 6


def test_status_decays(spark):
    got = timing.status_decay(arrivals(spark, [0, 2, 10, 50]), F.timestamp_seconds(F.lit(52))).orderBy("ts").collect()
    assert [(int(r.ts.timestamp()), r.status) for r in got] == [
        (0, "active"), (5, "recently_active"), (10, "active"), (13, "recently_active"), (40, "inactive"), (50, "active")
    ]
