"""Streams cut into several micro-batches give the batch result; files round-trip."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandsift.operators import acquisition, capture, cluster, maintenance, noise, timing, tracks
from bandsift.operators.ordered import number_chunk
from bandsift.sources import sigmf, tables, text
from bandsift.streaming import buffer, folds, status


class Drained:
    """Streams `df` file by file through `make(stream, closing)`, then closes all keys.

    `time` is event time. Rows go to files by their time plus up to `overlap` seconds, and lie in a
    file in random order.
    """

    def __init__(self, spark, folder):
        self.spark = spark
        self.src, self.marks, self.out, self.checkpoint = (str(folder / x) for x in ("in", "marks", "out", "ck"))

    def __call__(self, df, time, make, keys, until=None, files=4, overlap=0.0, seed=1):
        rng = np.random.default_rng(seed)
        rows = df.withColumn("_t", time.cast("timestamp").cast("double")).collect()
        rows = [rows[i] for i in rng.permutation(len(rows))]
        place = np.array([r["_t"] for r in rows]) + rng.random(len(rows)) * overlap
        part = np.searchsorted(np.quantile(place, [i / files for i in range(1, files)]), place)
        for i in range(files):
            own = [tuple(r)[:-1] for r, p in zip(rows, part, strict=True) if p == i]
            self.spark.createDataFrame(own, df.schema).coalesce(1).write.mode("append").parquet(self.src)
        end = F.max(time) if until is None else F.max(until)
        ends = df.groupBy(*keys).agg(end.cast("timestamp").alias("ts"))
        ends.limit(0).write.parquet(self.marks)
        for last in (False, True):
            if last:
                ends.coalesce(1).write.mode("append").parquet(self.marks)
            stream = self.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(self.src)
            made = make(stream, self.spark.readStream.schema(ends.schema).parquet(self.marks))
            buffer.write_sides(made, keys, self.out, self.checkpoint).trigger(availableNow=True).start().awaitTermination()
        kinds = [f for f in made.schema.fields if f.name != buffer.LATE]
        return self.spark.read.schema(T.StructType(kinds)).parquet(f"{self.out}/results/batch=*")

    def late(self):
        return self.spark.read.parquet(f"{self.out}/late/batch=*")


@pytest.fixture
def drain(spark, tmp_path):
    return Drained(spark, tmp_path)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=lambda r: [(v is not None, v) for v in r])


#: Streams whose files overlap by 20 seconds and wait 30 for rows.
SHUFFLED = {"overlap": 20.0, "files": 5}
WAIT = "30 seconds"


def frames(spark, n=60):
    rng = np.random.default_rng(2)
    rows = [(s, i, [float(v) for v in rng.normal(-60, 5, 8)]) for s in (1, 2) for i in range(n)]
    df = spark.createDataFrame(rows, "session_id bigint, frame_seq bigint, power_db array<double>")
    return df.withColumn("ts", F.timestamp_seconds(F.col("frame_seq") * 2))


def test_ema_of_shuffled_files(spark, drain):
    df = frames(spark)
    got = drain(df, F.col("ts"), lambda s, c: folds.live_ema(s, closing=c, lateness=WAIT), ["session_id"], **SHUFFLED)
    want = rows_of(noise.ema_floor(df))
    got = rows_of(got)
    assert [r[1:] for r in got] == [r[1:] for r in want]
    assert [r[0] for r in got] == pytest.approx([r[0] for r in want])
    assert drain.late().count() == 0


def regions(spark, n=200):
    rng = np.random.default_rng(3)
    rows = [
        (int(rng.integers(1, 3)), i, 868_000_000 + int(rng.choice([0, 30_000, 300_000])) + int(rng.integers(-9000, 9000)),
         int(rng.integers(1, 50)) * 1000, -20.0, -30.0, float(rng.integers(5, 30)))
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows, "session_id bigint, frame_seq bigint, center_hz bigint, bandwidth_hz bigint, peak_power_db double, avg_power_db double, snr_db double"
    ).withColumn("ts", F.timestamp_micros(F.col("frame_seq") * 700_000))


@pytest.mark.parametrize("files, seed", [(1, 1), (3, 2), (7, 3)])
def test_clusters_of_any_cut(spark, drain, files, seed):
    df = regions(spark)
    make = lambda s, c: folds.live_clusters(s, closing=c, lateness=WAIT)
    got = drain(df, F.col("ts"), make, ["session_id"], files=files, overlap=20.0, seed=seed)
    assert rows_of(got) == rows_of(cluster.cluster_regions(df))


def test_tracks_are_all_there(spark, drain):
    """Tracks still open when the segment is over come with the closing mark."""
    rng = np.random.default_rng(4)
    rows = [
        (1, 0, f, f * 2048, 868e6 + float(rng.integers(0, 4)) * 20_000 + float(rng.integers(-4000, 4000)), -20.0, 20.0, 4687.5)
        for f in range(0, 300) for _ in range(int(rng.integers(0, 3)))
    ]
    df = spark.createDataFrame(
        list({(r[2], r[4]): r for r in rows}.values()),
        "session_id bigint, segment_start bigint, frame_id bigint, frame_start bigint, center_hz double, peak_db double, peak_snr_db double, width_hz double",
    )
    make = lambda s, c: folds.live_tracks(s, sample_rate=4096, closing=c, lateness=WAIT)
    got = drain(df, F.timestamp_seconds(F.col("frame_id") / 2), make, ["session_id", "segment_start"], **SHUFFLED)
    assert rows_of(got) == rows_of(tracks.track_regions(df))


def blocks(spark):
    """Blocks of four seconds with gaps and a retune; some have triggers."""
    rows, at = [], 0
    rng = np.random.default_rng(6)
    for i in range(60):
        at += int(rng.choice([0, 0, 0, 0, 0, 0, 0, 7]))
        fired = [i * 10 + k for k in range(int(rng.choice([0, 0, 0, 1, 2])))]
        rows.append((1 + i // 40, at, at + 4, 868_000_000 + (i > 25) * 1000, 1, float(at), fired or None))
        at += 4
    return spark.createDataFrame(rows, "session_id bigint, start_sample bigint, end_sample bigint, center_hz bigint, sample_rate int, captured_at double, triggers array<bigint>")


def test_gaps(spark, drain):
    df = blocks(spark).withColumn("center_hz", F.lit(5).cast("bigint"))
    want = acquisition.gap_detect(df.drop("triggers")).select("session_id", "start_sample", "end_sample", "sample_rate", "segment_start", "is_gap", "missing_samples")
    got = drain(df, F.timestamp_seconds("start_sample"), lambda s, c: folds.live_gaps(s, c, WAIT), ["session_id"], **SHUFFLED)
    assert rows_of(got) == rows_of(want)


CAPTURE = (5.0, 6.0, 30.0)


def test_captures_equal_batch(spark, drain):
    df = blocks(spark)
    gaps = acquisition.gap_detect(df.drop("triggers"))
    fired = df.select("session_id", "start_sample", F.explode("triggers").alias("trigger_id")).join(gaps, ["session_id", "start_sample"])
    fired = fired.select("session_id", "segment_start", "sample_rate", "trigger_id", F.col("start_sample").alias("block_start"), F.col("end_sample").alias("block_end"))
    want = capture.finished_captures(capture.capture_windows(fired, *CAPTURE), gaps, bucket_samples=16)
    make = lambda s, c: folds.live_captures(s, *CAPTURE, every=True, closing=c, lateness=WAIT)
    got = drain(df, F.timestamp_seconds("start_sample"), make, ["session_id"], **SHUFFLED)
    shown = ["session_id", "segment_start", "sample_rate", "capture_start", "deadline", "max_end", "triggers", "capture_end"]
    ended = got.filter("kind <> 'block'").select(shown)
    assert rows_of(ended) == rows_of(want.select(shown)) and ended.count() > 5
    # After each block: what a plain pass over the blocks has pending and buffered.
    state, want = {}, []
    for r in sorted(df.collect(), key=lambda r: (r.session_id, r.start_sample)):
        s = state.setdefault(r.session_id, {"end": None, "hz": None, "pending": None, "done": 0, "lost": 0})
        if (r.start_sample, r.center_hz) != (s["end"], s["hz"]):
            s["lost"] += s["pending"] is not None
            s |= {"pending": None, "segment": r.start_sample}
        s |= {"end": r.end_sample, "hz": r.center_hz}
        for _ in r.triggers or []:
            if s["pending"] is None:
                first = max(s["segment"], r.end_sample - 5)
                s["pending"] = [r.end_sample + 6, first + 30, 0]
            else:
                s["pending"][0] = min(s["pending"][1], r.end_sample + 6)
            s["pending"][2] += 1
        if s["pending"] and r.end_sample >= s["pending"][0]:
            s |= {"pending": None, "done": s["done"] + 1}
        want.append((r.session_id, r.end_sample, s["pending"][2] if s["pending"] else 0, s["done"], s["lost"], min(5, r.end_sample - s["segment"])))
    names = ["session_id", "at_sample", "pending_triggers", "captures_completed", "captures_aborted", "buffered_samples"]
    seen = {tuple(r) for r in got.filter("kind in ('block', 'finished')").select(names).collect()}
    assert seen == set(want)


def test_late_rows_go_to_their_own_side(spark, tmp_path):
    """Rows older than what was folded don't disturb the state and are not lost: they are put out apart."""
    df, src = frames(spark, 30), str(tmp_path / "in")
    writer = lambda: buffer.write_sides(
        folds.live_ema(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src), lateness="4 seconds"),
        ["session_id"], str(tmp_path / "out"), str(tmp_path / "ck"),
    )
    for rows in ("frame_seq between 5 and 19", "frame_seq < 5 or frame_seq = 8", "frame_seq >= 20"):
        df.filter(rows).coalesce(1).write.mode("append").parquet(src)
        writer().trigger(availableNow=True).start().awaitTermination()
    late = spark.read.parquet(f"{tmp_path}/out/late/batch=*")
    assert rows_of(late) == sorted((s, r.ts) for s in (1, 2) for r in df.filter("session_id = 1 and (frame_seq < 5 or frame_seq = 8)").select("ts").collect())
    got = spark.read.parquet(f"{tmp_path}/out/results/batch=*")
    want = noise.ema_floor(df.filter("frame_seq >= 5 and frame_seq < 27"))
    # What is less than four seconds old at the end still waits.
    got, want = rows_of(got.filter("frame_seq < 27")), rows_of(want)
    assert [r[1:] for r in got] == [r[1:] for r in want]
    assert [r[0] for r in got] == pytest.approx([r[0] for r in want])


def test_status_by_timers(spark, drain):
    seconds = [1000, 1002, 1010, 1050, 1200, 1203, 1204, 1400]
    rows = [(s, c, i, t + c) for s in (1, 2) for c in (7, 8) for i, t in enumerate(seconds)]
    df = spark.createDataFrame(rows, "session_id bigint, channel_id bigint, detection_id bigint, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    until = F.timestamp_seconds(F.lit(1420))
    got = drain(df, F.col("ts"), lambda s, c: status.live_status(s, c, WAIT), ["session_id", "channel_id"], until=until, files=3, overlap=20.0)
    assert rows_of(got) == rows_of(timing.status_decay(df, until))


def test_alerts_equal_batch(spark, drain):
    rng = np.random.default_rng(7)
    states = ["active", "recently_active", "inactive"]
    rows = [
        (s, q * 2, c, 868_000_000 + c * 90_000, float(rng.integers(0, 30)), 0.5, 4.0 if c % 2 else None, int(rng.integers(0, 9)), str(rng.choice(states)), float(q) + s / 10)
        for s in (1, 2) for q in range(60) for c in range(6) if rng.random() < 0.8
    ]
    df = spark.createDataFrame(
        rows, "session_id bigint, snapshot_seq bigint, channel_id bigint, center_hz bigint, snr_db double, confidence double, recurrence_interval_s double, observation_count int, status string, t double"
    ).withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint")))
    rules = spark.createDataFrame(
        [(1, 5, True, 868.1, 868.3, 12.0, None, False), (2, 4, True, None, None, 25.0, None, None), (3, 1, False, None, None, None, None, False),
         (4, 2, True, 867.0, 900.0, 20.0, 0.4, True), (5, 3, True, 869.0, 868.0, None, None, False), (6, 9, True, 868.2, 868.2, None, 0.6, False)],
        "rule_id bigint, rule_order bigint, enabled boolean, freq_lo_mhz double, freq_hi_mhz double, min_snr double, min_confidence double, require_regular_cadence boolean",
    )
    want = maintenance.activation_alerts(df, rules, number_chunk("snapshot_seq", 7), debounce_s=5)
    got = drain(df, F.col("ts"), lambda s, c: status.live_alerts(s, rules, 5, c, WAIT), ["session_id"], **SHUFFLED)
    shown = ["session_id", "channel_id", "ts_us", "snapshot_seq", "rule_id"]
    assert rows_of(got.select(shown)) == rows_of(want.select(shown)) and got.count() > 20
    assert {r.rule_id for r in got.select("rule_id").distinct().collect()} == {1, 2, 4}


def test_cu8_bytes():
    raw = sigmf.encode(np.array([-1, -1, 0, 0, 1, 1], np.float32), "cu8")
    assert list(raw) == [0, 0, 128, 128, 255, 255]
    assert np.allclose(sigmf.decode(raw, "cu8"), [-1, -1, 0, 0, 1, 1], atol=0.005)


@pytest.mark.parametrize("fmt", ["cf32", "cu8"])
def test_sigmf_round_trip_in_ranges(spark, tmp_path, fmt):
    iq = [float(v) / 40 for v in range(-40, 40)]
    df = spark.createDataFrame([(1, 868_000_000, 2000, iq, '[{"core:comment":"x"}]')], "session_id bigint, center_hz bigint, sample_rate int, iq array<float>, annotations string")
    df = df.withColumn("captured_ts", F.lit("2024-01-01 00:00:01.5").cast("timestamp"))
    (rec,) = sigmf.write_sigmf(df, str(tmp_path), fmt).collect()
    assert rec.bytes == (320 if fmt == "cf32" else 80) and rec.duration_ms == 20
    back = sigmf.read_sigmf(spark, str(tmp_path), block_samples=7).orderBy("start_sample").collect()
    assert [r.start_sample for r in back] == [0, 7, 14, 21, 28, 35]
    assert np.allclose(np.concatenate([r.iq for r in back]), iq, atol=0.005 if fmt == "cu8" else 1e-6)
    assert back[1].captured_at == pytest.approx(1704067201.5 + 7 / 2000)
    with pytest.raises(ValueError):
        sigmf.write_sigmf(df, str(tmp_path), "wav")


def test_text_sources(spark):
    lines = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    sweep = text.parse_sweep(lines("d,t,100,200,10,2,-1,-2", "d,t,100", "d,t,x,200,10,2,-1", "d, t, 5, 6, .5, 1, -9")).collect()
    assert sorted(tuple(r) for r in sweep) == [(5.0, -9.0), (100.0, -1.0), (110.0, -2.0)]
    decoded = text.parse_decoder_lines(lines('{"model":"A","freq":433.92}', '{"protocol":"B","freq":"x"}', '{"k":1}', "noise", " ", '{"model":"unknown"}')).collect()
    assert [(r.protocol, r.freq_hz, r.known) for r in decoded] == [
        ("A", 433_920_000, True), ("B", None, True), ("unknown", None, False), ("unknown", None, False), ("unknown", None, False)
    ]
    assert decoded[3].fields == '{"raw":"noise"}'
    log = lines('{"sequence":1}', '{"sequence":', "", '{"sequence":2}')
    assert [r.sequence for r in text.parse_candidate_log(log).collect()] == [1, 2]
    assert text.candidate_log_count(log).first().lines == 3


def test_ingest_is_repeatable(spark, tmp_path):
    df = spark.range(10).select(F.lit(1).cast("bigint").alias("session_id"), F.col("id").alias("channel_id"), F.timestamp_seconds(F.col("id") * 40_000).alias("ts"), F.lit(1.0).alias("duration_ms"))
    for batch in (0, 1, 1):
        tables.ingest(df, str(tmp_path), "bursts", batch)
    assert tables.read_table(spark, str(tmp_path), "bursts").count() == 20
    doc = tables.export_document(df, "detections", ["channel_id"]).first().value
    assert doc.startswith('{"kind":"detections","detections":[{"session_id":1,"channel_id":9,')


class HeldState:
    """What a processor asks of its handle, counted."""

    def __init__(self):
        self.timers, self.parts, self.value, self.calls = set(), {}, None, 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return HeldValue(self)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def getValue(self, key):
        return self.parts[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.parts[key] = value

    def removeKey(self, key):
        del self.parts[key]


class HeldValue:
    def __init__(self, own):
        self.own = own

    def get(self):
        return self.own.value

    def update(self, value):
        self.own.calls += 1
        self.own.value = value


def test_rows_far_apart_cost_no_call_each(spark):
    """A key with very many slots has one timer, and its rows wait in few parts."""
    kinds = T.StructType.fromDDL("us bigint, id bigint")
    processor = buffer.OrderedProcessor(lambda key: folds.LiveThrottleFold(key, ["us", "id"], 10), ["k"], ["us", "id"], kinds, T.StructType.fromDDL("k bigint, us bigint, id bigint, late_us bigint"), 1_000_000)
    handle = HeldState()
    processor.init(handle)
    rng = np.random.default_rng(1)
    at = [int(x) * 1_000_000 for x in rng.permutation(20_000)]
    out = []
    for low in range(0, len(at), 10_000):
        batch = pa.table({"k": [7] * 10_000, "us": at[low : low + 10_000], "id": range(10_000), "_time_us": at[low : low + 10_000], "_closing": [False] * 10_000}).to_batches()
        (packed,) = buffer._packed(iter(batch), ["k"], ["us", "id"])
        assert packed.num_rows == 1
        out += processor.handleInputRows((7,), iter(T.Row(**r) for r in packed.select(["_rows", "_closing"]).to_pylist()), None)
    assert handle.calls < 30 and len(handle.timers) == 1 and not out

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms

    seen = []
    for ms in (9_000_500, 15_000_000):
        (first,) = handle.timers
        handle.timers.clear()
        found = list(processor.handleExpiredTimer((7,), Now(ms), Now(first)))
        batch = pa.RecordBatch.from_pydict({"_rows": [r["_rows"] for r in found]})
        seen += [r["us"] for b in buffer._unpacked(iter([batch]), pa.schema([(c, pa.int64()) for c in ("k", "us", "id", "late_us")])) for r in b.to_pylist()]
        assert len(handle.timers) == 1 and min(handle.timers) > ms
    assert seen == [i * 1_000_000 for i in range(15_000)] and handle.calls < 60


def test_a_file_of_many_parts_is_one_micro_batch(spark, tmp_path, monkeypatch):
    """Rows of a table in several parts come in as many micro-batches as files are asked for."""
    from bandsift.catalog import bindings

    events = spark.range(3_000).select(
        F.col("id").alias("event_id"), (F.col("id") % 40).alias("user_id"), F.timestamp_seconds(F.col("id") * 777).cast("timestamp_ntz").alias("ts"), F.lit(1.5).alias("value"), F.lit("x").alias("event_type"), F.lit("{}").alias("props"),
    )
    events.repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(bindings, "FILE_ROWS", 200, raising=False)
    t = bindings.Tables(spark, str(tmp_path))
    found, late = t.out_of_order("detections", "unix_micros(ts)")
    batches = []
    query = found.writeStream.foreachBatch(lambda df, i: batches.append(df.count())).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(batches) == 4 and sum(batches) == 3_000
    rows = found.withColumn("ts_us", F.unix_micros("ts"))
    ends = t.detections.groupBy("session_id", "channel_id").agg(F.max("ts").alias("ts"))
    got = t.drained_to_end(lambda closing: folds.live_throttle(rows, ["session_id", "channel_id"], "ts_us", "detection_id", 1, closing, late), ends)
    assert got.count() == 3_000
