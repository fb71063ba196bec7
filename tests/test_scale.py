"""What keeps memory and tasks bounded gives the same rows as the plain way."""

import json
import random
import statistics
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bandsift.functions.samples import decode
from bandsift.operators import channels as ch
from bandsift.operators import cluster, dsp, ranges, timing
from bandsift.operators.tracks import RunningMedian
from bandsift.sources import sigmf
from tests.models import clusters, greedy_keep, merged


def test_running_median_is_exact_in_little_memory():
    pick = random.Random(3)
    for kind in range(4):
        own, seen = RunningMedian(), []
        for i in range(400):
            value = [pick.random(), float(pick.randrange(3)), float(i), float(-i)][kind]
            own.add(value)
            seen.append(value)
            assert own.value() == statistics.median(seen)
        assert sorted(own) == sorted(seen)
    own = RunningMedian()
    values = np.random.default_rng(1).normal(868e6, 3e3, 300_000)
    for value in values.tolist():
        own.add(value)
    assert own.value() == statistics.median(values.tolist()) and list(own) == sorted(values.tolist())
    # 10 M frames of an emitter that is always on stay below 100 MB.
    held = sum(sys.getsizeof(b) for half in (own.low, own.high) for b in half.blocks)
    assert held / len(values) < 9.9


def all_pairs(points, spans):
    return sorted((i, j) for i, x in points for j, low, high in spans if low <= x <= high)


@pytest.mark.parametrize("hot", [1 << 30, 50])
def test_points_in_ranges_of_any_width(spark, hot):
    pick = random.Random(4)
    points = [(i, 868_000_000 if i < 300 else 867_000_000 + pick.randrange(3_000_000)) for i in range(600)]
    spans = [(j, low, low + pick.choice([-5, 0, 10, 5_000, 200_000, 2_500_000, 40_000_000])) for j, low in enumerate(867_000_000 + pick.randrange(3_000_000) for _ in range(40))]
    spans += [(100 + j, 867_990_000 + j, 868_010_000) for j in range(30)]
    p = spark.createDataFrame(points, "i bigint, hz bigint")
    r = spark.createDataFrame(spans, "j bigint, low bigint, high bigint")
    got = ranges.point_in_range(p, r, "hz", "low", "high", 1_000, hot_points=hot)
    assert got.columns == ["i", "hz", "j", "low", "high"]
    assert sorted((x.i, x.j) for x in got.collect()) == all_pairs(points, spans)


def test_a_hot_frequency_is_joined_by_many_tasks(spark):
    """Half of all points have one frequency; split, no task gets much more than the others."""
    points = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 2_000_000).otherwise(F.col("id") * 1000).alias("hz"))
    spans = spark.range(4000).select(F.col("id").alias("j"), (F.col("id") * 1000 - 10).alias("low"), (F.col("id") * 1000 + 10).alias("high"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(keep, ("16", "-1", "false"), strict=True):
            spark.conf.set(k, v)
        got = ranges.point_in_range(points, spans, "hz", "low", "high", 1_000, hot_points=100)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 4000
    assert max(sizes) < 3 * statistics.median(sizes)


def test_channels_of_two_sessions_with_equal_ids_stay_apart(spark):
    rows = [(s, c, 868_000_000 + 100_000 * s + c * 1000, 20_000, 5.0 + s, 10 * c, 60.0 + s) for s in (1, 2) for c in (1, 2, 3)]
    df = spark.createDataFrame(rows, "session_id bigint, channel_id bigint, center_hz bigint, bandwidth_hz bigint, snr_db double, typical_burst_ms int, recurrence_interval_s double")
    df = df.withColumn("last_seen", F.timestamp_seconds(F.lit(1000) + F.col("channel_id"))).withColumn("confidence", F.lit(0.5)).withColumn("observation_count", F.lit(5))
    recordings = spark.createDataFrame([(9, 868_102_000, 3000)], "recording_id bigint, center_hz bigint, sample_rate int")
    near = ranges.recordings_near_channel(recordings, df)
    assert sorted((r.session_id, r.channel_id) for r in near.collect()) == [(1, 1), (1, 2), (1, 3)]
    focus = spark.createDataFrame([(1, 868_200_000, 400_000)], "focus_id bigint, focus_hz bigint, sample_rate int")
    (best,) = ranges.focus_channel(focus, df).collect()
    assert (best.session_id, best.channel_id) == (2, 3)
    rules = spark.createDataFrame([(1, 1, True, 868.15, 868.3, None, None, False), (2, 2, True, None, None, None, None, False)], "rule_id bigint, rule_order bigint, enabled boolean, freq_lo_mhz double, freq_hi_mhz double, min_snr double, min_confidence double, require_regular_cadence boolean")
    got = {(r.session_id, r.channel_id): r.rule_id for r in ranges.alert_rule_match(df, rules).collect()}
    assert got == {(s, c): 3 - s for s in (1, 2) for c in (1, 2, 3)}
    pins = spark.createDataFrame([(2, 1, True, "mine")], "session_id bigint, channel_id bigint, pinned boolean, label string")
    assert [(r.session_id, r.channel_id) for r in ch.pins_join(df, pins).filter("pinned").collect()] == [(2, 1)]
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 2)], "session_id bigint, channel_a bigint, channel_b bigint")
    assert ch.channel_similarity(df, pairs).count() == 2
    due = timing.next_expected(df, F.timestamp_seconds(F.lit(1010)))
    assert due.count() == 6 and {"session_id", "channel_id"} <= set(due.columns)


def test_merges_happen_at_marks(spark):
    """Against a plain pass that merges whenever a second has gone by."""
    rng = np.random.default_rng(9)
    rows = []
    for seq in range(400):
        for hz in sorted({868_000_000 + int(rng.choice([0, 25_000, 60_000, 900_000])) + int(rng.integers(-9000, 9000)) for _ in range(int(rng.integers(0, 3)))}):
            rows.append((1 + seq % 2, seq, hz, int(rng.integers(1, 60)) * 1000, float(rng.integers(-30, -10)), -40.5, float(rng.integers(5, 30))))
    df = spark.createDataFrame(rows, "session_id bigint, frame_seq bigint, center_hz bigint, bandwidth_hz bigint, peak_power_db double, avg_power_db double, snr_db double")
    df = df.withColumn("ts", F.timestamp_micros(F.col("frame_seq") * 150_000))
    marks, want = [], []
    for session in (1, 2):
        frames = [s for s in range(400) if 1 + s % 2 == session]
        times = greedy_keep([s * 150_000 for s in frames], 1_000_000)
        marks += [(session, t // 150_000, t) for t in times]
        live, born = [], {}
        for seq in frames:
            for r in (r for r in rows if r[0] == session and r[1] == seq):
                n = len(live)
                live = step(live, r)
                if len(live) > n:
                    born[live[-1]["id"]] = (seq, r[2])
            if seq * 150_000 in times:
                live, gone = merged(live, 20_000)
                want += [(session, seq, *born[g]) for g in gone]
    marks = spark.createDataFrame(marks, "session_id bigint, frame_seq bigint, t bigint").withColumn("ts", F.timestamp_micros("t"))
    got = cluster.merge_log(df, marks, 20_000).select("session_id", "frame_seq", "merged_seq", "merged_hz").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 10


def step(live, r):
    """One region into the channels of the model."""
    _, seq, hz, width, peak, avg, snr = r
    near = [c for c in live if abs(c["center"] - hz) <= 20_000]
    if not near:
        top = max((c["id"] for c in live), default=0)
        step.last = max(getattr(step, "last", 0), top) + 1
        return [*live, dict(id=step.last, center=hz, width=width, peak=peak, avg=avg, snr=snr, n=1)]
    best = min(near, key=lambda c: abs(c["center"] - hz))
    (one,) = clusters([(0, best["center"], best["width"], best["peak"], best["avg"], best["snr"]), (seq, hz, width, peak, avg, snr)], 10**9)
    best |= {k: one[k] for k in ("center", "width", "peak", "avg", "snr")} | {"n": best["n"] + 1}
    return live


def pairs(folder, n, size=64, rate=1000):
    for i in range(n):
        about = {"core:datetime": f"2024-01-{1 + i % 3:02d}T00:00:00Z", "core:frequency": 868_000_000 + i % 5}
        meta = {"global": {"core:datatype": "cu8", "core:sample_rate": rate}, "captures": [about], "annotations": []}
        (folder / f"c{i}.sigmf-meta").write_text(json.dumps(meta))
        (folder / f"c{i}.sigmf-data").write_bytes(bytes(range(size)))


def test_many_small_recordings_make_few_partitions(spark, tmp_path):
    pairs(tmp_path, 3000)
    (tmp_path / "lone.sigmf-data").write_bytes(b"xx")
    (tmp_path / "note.txt").write_text("x")
    listing = sigmf.list_sigmf(spark, str(tmp_path))
    assert listing.count() == 3000
    rows = sigmf.read_listed(listing, partition_bytes=16_000)
    assert rows.rdd.getNumPartitions() == 12
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3000 and max(sizes) - min(sizes) <= 2
    some = sigmf.read_listed(listing.filter("date = '2024-01-02' AND center_hz = 868000003"), block_samples=10)
    got = some.collect()
    assert len(got) == 200 * 4 and {r.center_hz for r in got} == {868_000_003}
    assert {(r.start_sample, len(r.iq)) for r in got} == {(0, 20), (10, 20), (20, 20), (30, 4)}


def test_large_recordings_are_cut(spark, tmp_path):
    pairs(tmp_path, 2, size=200)
    rows = sigmf.read_sigmf(spark, str(tmp_path), block_samples=7, partition_bytes=50)
    got = sorted((r.capture, r.start_sample, len(r.iq), r.captured_at) for r in rows.collect())
    assert [g[:3] for g in got] == [(f"c{i}", at, 14 if at < 98 else 4) for i in range(2) for at in range(0, 100, 7)]
    assert got[1][3] - got[0][3] == pytest.approx(0.007, abs=1e-6) and rows.rdd.getNumPartitions() >= 8


@pytest.mark.parametrize("apart", [1, 262_144])
def test_chunks_hold_about_as_many_rows_whatever_the_numbers_mean(spark, apart):
    """Frames numbered by count or by sample position: chunks are as long, and the floor is the same."""
    from bandsift.operators import noise
    from bandsift.operators.ordered import attach, dense_chunk, density

    rng = np.random.default_rng(2)
    values = rng.normal(-60, 5, 3000).round(3).tolist()
    rows = [(s, 7 + i * apart, [v, v]) for s in (1, 2) for i, v in enumerate(values[: 3000 // s])]
    df = spark.createDataFrame(rows, "session_id bigint, frame_seq bigint, power_db array<double>")
    placed = attach(df, density(df, ["session_id"], "frame_seq"), ["session_id"]).withColumn("c", dense_chunk("frame_seq", 100))
    sizes = [r["count"] for r in placed.groupBy("session_id", "c").count().collect()]
    assert max(sizes) <= 101 and len(sizes) <= 47
    got = {(r.session_id, r.frame_seq): r.floor_db for r in noise.ema_floor(df, 0.05, width=10).collect()}
    for s in (1, 2):
        now = None
        for i, v in enumerate(values[: 3000 // s]):
            now = v if now is None else 0.95 * now + 0.05 * v
            assert got[s, 7 + i * apart] == pytest.approx(now, abs=1e-9)


def test_throttle_pieces_of_a_thousand_intervals(spark):
    from bandsift.operators.capture import throttle

    rng = np.random.default_rng(3)
    times = np.cumsum(rng.integers(1, 40, 20_000)).tolist()
    df = spark.createDataFrame([(k, t, i) for k in (1, 2) for i, t in enumerate(times[k::k])], "k bigint, t bigint, i bigint")
    for interval in (5, 33, 100):
        got = sorted((r.k, r.t) for r in throttle(df, ["k"], "t", "i", interval).collect())
        assert got == sorted((k, t) for k in (1, 2) for t in greedy_keep(times[k::k], interval))
        got = sorted((r.k, r.t) for r in throttle(df, ["k"], "t", "i", interval, chunk_us=7 * interval).collect())
        assert got == sorted((k, t) for k in (1, 2) for t in greedy_keep(times[k::k], interval))


def test_segments_are_joined_without_blocks_metadata(spark):
    """Overlapping and repeated positions too: a block belongs to the segment that its own start is in."""
    from bandsift.operators import acquisition, dsp

    starts = [0, 4, 8, 20, 22, 26, 26, 40, 44, 45]
    df = spark.createDataFrame([(s, at, [0.0] * 8, 868_000_000 + (at > 41), 100, 0.0) for s in (1, 2) for at in starts], "session_id bigint, start_sample bigint, iq array<float>, center_hz bigint, sample_rate int, captured_at double")
    gaps = acquisition.gap_detect(acquisition.block_meta(df))
    want = {(r.session_id, r.start_sample): r.segment_start for r in gaps.collect()}
    got = dsp.with_segments(df).select("session_id", "start_sample", "segment_start").collect()
    assert len(got) == 2 * len(starts)
    for r in got:
        if r.start_sample != 26:  # of two blocks at one place either may end the other's segment
            assert r.segment_start == want[r.session_id, r.start_sample]
    assert dsp.with_segments(dsp.with_segments(df)).count() == len(got)


def test_narrow_ranges_get_narrow_cells(spark):
    """A range of some kHz must not meet all points of a cell of 100 kHz."""
    spans = spark.createDataFrame([(i, 1_000_000 + 7_001.5 * i - 1_000 - i, 1_000_000 + 7_001.5 * i + 1_000 + i) for i in range(200)], "j bigint, low double, high double")
    widths, level = ranges.cell_widths("low", "high", 100_000)
    for low, high, at in spans.select("low", "high", level).collect():
        assert widths[at] < high - low <= 16 * widths[at]
    points = spark.range(3_000).select(F.col("id"), (F.lit(900_000) + F.col("id") * 571).alias("hz"))
    got = ranges.point_in_range(points, spans, "hz", "low", "high", 100_000)
    own, all_spans = points.collect(), spans.collect()
    want = {(p.id, s.j) for p in own for s in all_spans if s.low <= p.hz <= s.high}
    pairs = [(r.id, r.j) for r in got.collect()]
    assert len(pairs) == len(want) > 500 and set(pairs) == want
    edges = spark.createDataFrame([(0, 900_571.0, 900_571.0), (1, 5.0, 4.0), (2, -1e9, 1e9)], spans.schema)
    assert ranges.point_in_range(points, edges, "hz", "low", "high", 100_000).count() == 3_001


def shuffled(df):
    """Rows that the shuffles of a query write."""
    df.collect()

    def below(node):
        if "ShuffleExchange" in node.getClass().getSimpleName():
            return node.metrics().apply("shuffleRecordsWritten").value() + below(node.child())
        if "QueryStage" in node.getClass().getSimpleName():
            return below(node.plan())
        return sum(below(node.children().apply(i)) for i in range(node.children().size()))

    plan = df._jdf.queryExecution().executedPlan()
    return below(plan.executedPlan() if hasattr(plan, "executedPlan") else plan)


def test_a_recording_moves_once(spark):
    """A window is one row of a shuffle, however many cells it touches or points it holds."""
    recordings = spark.range(4_000).select(F.col("id").alias("recording_id"), (868_000_000 + F.col("id") * 7).alias("center_hz"), (2_000 + F.col("id") % 3 * 1_000).cast("int").alias("sample_rate"))
    channels = spark.range(300).select((F.col("id") % 3).alias("session_id"), F.col("id").alias("channel_id"), (868_000_000 + F.col("id") * 101).alias("center_hz"))
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        near = ranges.recordings_near_channel(recordings, channels)
        assert 4_000 <= shuffled(near) < 4_000 + 5 * 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    want = {(r, c, abs(7 * r - 101 * c)) for r in range(4_000) for c in range(300) if abs(7 * r - 101 * c) <= (2_000 + r % 3 * 1_000) / 2}
    got = [(r.recording_id, r.channel_id, r.distance_hz) for r in near.collect()]
    assert len(got) == len(want) > 50_000 and set(got) == want


@pytest.mark.parametrize("hot,meet", [(1 << 30, 1 << 30), (40, 1 << 30), (1 << 30, 20_000), (40, 20_000)])
def test_points_in_windows_of_any_width(spark, hot, meet):
    """Busy and lonely cells, rows that come twice, nulls, empty and backward windows, both signs."""
    pick = random.Random(6)
    points = [(i if i % 50 else None, 25_000 if i < 200 else pick.randrange(-1_500_000, 1_500_000), i % 4) for i in range(500)]
    points += points[:3] + points[300:303] + [(900, None, 1)]
    widths = [-4, 0, 1, 25, 97, 390, 1_562, 6_250, 25_000, 100_000, 400_000, 3_000_000]
    spans = [(j, pick.randrange(-1_500_000, 1_500_000), pick.choice(widths)) for j in range(150)]
    spans += [(200 + j, 25_000 - j, 3_000) for j in range(60)] + spans[:5]
    spans += [(300 + j, edge, width) for j, (edge, width) in enumerate((e * 25_000 + s, w) for e in (-1, 0, 1) for s in (-1, 0) for w in widths)]
    spans += [(500, None, 5), (501, 5, None), (None, 24_000, 2_000)]
    p = spark.createDataFrame(points, "i bigint, hz bigint, k int")
    r = spark.createDataFrame(spans, "j bigint, at bigint, width int")
    got = ranges.points_in_windows(p, r, "hz", F.col("at") - 0.5, F.col("at") + F.col("width") - 0.5, 100_000, hot, meet)
    assert got.columns == ["i", "hz", "k", "j", "at", "width"]
    full = [x for x in spans if None not in x[1:]]
    want = [(*a, *b) for a in points if a[1] is not None for b in full if b[1] - 0.5 <= a[1] <= b[1] + b[2] - 0.5]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) > 10_000
    none = ranges.points_in_windows(p, r.filter("width = -4"), "hz", F.col("at"), F.col("at") + F.col("width"), 100_000, hot, meet)
    assert none.columns == got.columns and none.count() == 0
    assert ranges.points_in_windows(p.limit(0), r, "hz", F.col("at"), F.col("at") + F.col("width"), 100_000, hot, meet).count() == 0


def test_a_busy_cell_of_windows_is_joined_by_many_tasks(spark):
    """All windows and half of the points lie in one cell; dealt, no task gets much more than the others."""
    points = spark.range(400).select("id", F.when(F.col("id") % 2 == 0, 2_000_000).otherwise(F.col("id") * 10_000).alias("hz"))
    windows = spark.range(600).select(F.col("id").alias("j"), (2_000_000 + F.col("id") % 2).alias("at"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(keep, ("8", "-1"), strict=True):
            spark.conf.set(k, v)
        got = ranges.points_in_windows(points, windows, "hz", F.col("at") - 10, F.col("at") + 10, 100_000, meet=5_000)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 200 * 600
    assert len(sizes) > 15 and max(sizes) < 0.2 * sum(sizes)


def test_focus_meets_few_cells(spark):
    """Many channels lie in a window and many were seen at the same time; nulls and repeats among them."""
    rng = np.random.default_rng(5)
    own = [(int(rng.integers(0, 3)), int(i % 700), None if i % 97 == 0 else int(868_000_000 + rng.integers(0, 3_000)), int(rng.integers(0, 4))) for i in range(1_500)]
    own += [(None, 5, 868_001_000, 3), (1, None, 868_001_000, 3), (1, 2, 868_001_001, None)]
    df = spark.createDataFrame(own, "session_id bigint, channel_id bigint, center_hz bigint, s bigint").withColumn("last_seen", F.timestamp_seconds("s"))
    windows = [(i, int(868_000_000 + rng.integers(-50, 3_050)), int(rng.choice([1, 2, 3, 9, 801, 4_000, 90_000]))) for i in range(120)] + [(120, None, 5), (121, 868_001_000, 1)]
    focus = spark.createDataFrame(windows, "focus_id bigint, focus_hz bigint, sample_rate int")
    got = {r.focus_id: (r.session_id, r.channel_id) for r in ranges.focus_channel(focus, df).collect()}
    low = lambda x: (x is not None, -x if x is not None else 0)
    want = {}
    for i, hz, rate in windows:
        near = [c for c in own if hz is not None and c[2] is not None and abs(c[2] - hz) <= rate / 2]
        if near:
            best = max(near, key=lambda c: (c[3] is not None, c[3] or 0, -abs(c[2] - hz), low(c[0]), low(c[1])))
            want[i] = best[:2]
    assert got == want and len(want) > 80
    cells = focus.select(F.size(ranges._cells_between(F.col("focus_hz") - 50_000_000, F.col("focus_hz"), 0))).filter("focus_hz IS NOT NULL")
    assert max(r[0] for r in cells.collect()) < 150


def test_samples_are_decoded_in_small_pieces(spark, monkeypatch):
    """Batches of many or long rows are cut by samples; a longer row stays whole."""
    sizes = [10, 0, 30, 5_000, 7, 7, 7, None, 90]
    batch = pa.RecordBatch.from_pydict({"raw": [None if n is None else bytes(2 * n) for n in sizes], "at": list(range(len(sizes)))})
    monkeypatch.setattr(dsp, "_SLICE_SAMPLES", 50)
    parts = list(dsp._pieces(iter([batch, batch.slice(0, 0)]), "cu8"))
    assert [p.column("at").to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5, 6, 7], [8], []]
    lists = pa.RecordBatch.from_pydict({"iq": pa.array([[0.0] * 60, [0.0] * 60, [], None], pa.list_(pa.float32()))})
    assert [p.num_rows for p in dsp._pieces(iter([lists]), None)] == [1, 3]
    raw = bytes(range(256))
    assert (decode(raw, "cu8") == ((np.frombuffer(raw, np.uint8) - 127.5) / 127.5).astype(np.float32)).all()
