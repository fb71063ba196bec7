"""Folds kept up day by day give what one pass gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandsift.operators import cluster, noise
from bandsift.plans import daily


def rows_of(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def regions(spark, seed=3, n=160):
    rng = np.random.default_rng(seed)
    rows = [
        (int(rng.integers(1, 3)), i, 868_000_000 + int(rng.choice([0, 30_000, 300_000])) + int(rng.integers(-9000, 9000)),
         int(rng.integers(1, 50)) * 1000, -20.0, -30.0, float(rng.integers(5, 30)))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "session_id bigint, frame_seq bigint, center_hz bigint, bandwidth_hz bigint, peak_power_db double, avg_power_db double, snr_db double")
    return df.withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("frame_seq") * 2000))


def whole(spark, df):
    out = cluster.cluster_regions(df)
    return rows_of(out.withColumn("ts_us", F.unix_micros("ts")).withColumn("first_us", F.unix_micros("first_ts")).drop("ts", "first_ts"))


def test_clusters_day_by_day(spark, tmp_path, monkeypatch):
    df = regions(spark)
    rows, fold = daily.cluster_rows(df), daily.daily_clusters(spark, str(tmp_path))
    days = sorted(r[0].isoformat() for r in rows.select("date").distinct().collect())
    assert len(days) == 4 and fold.results().collect() == []
    assert fold.update(rows.filter(F.col("date") < days[2])) == days[:2]
    assert fold.update(rows) == days[2:]
    assert rows_of(fold.results()) == whole(spark, df)
    assert fold.update(rows) == []
    # A day changes: it and the days after it are folded again.
    changed = df.filter("frame_seq <> 70")
    assert fold.update(daily.cluster_rows(changed)) == days[1:]
    assert rows_of(fold.results()) == whole(spark, changed)
    # A session without rows on the last day keeps its state; a day that is gone takes its results along.
    shorter = changed.filter(F.to_date("ts") < days[3])
    assert fold.update(daily.cluster_rows(shorter)) == [] and rows_of(fold.results()) == whole(spark, shorter)
    quiet = changed.filter((F.to_date("ts") != days[2]) | (F.col("session_id") == 1))
    fold.update(daily.cluster_rows(quiet))
    assert rows_of(fold.results()) == whole(spark, quiet)


def test_a_run_that_dies_is_made_up_for(spark, tmp_path, monkeypatch):
    df = regions(spark)
    rows, fold = daily.cluster_rows(df), daily.daily_clusters(spark, str(tmp_path))
    with monkeypatch.context() as m:
        m.setattr(daily.files, "write_text", lambda *_: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            fold.update(rows)
    assert fold.folded() == {}
    fold.update(rows)
    assert rows_of(fold.results()) == whole(spark, df)


def test_noise_day_by_day(spark, tmp_path):
    """The seed of the floor, a retune and the frames still held go from day to day."""
    rng = np.random.default_rng(5)
    rows = [
        (s, 0, i, 2048 * i, 5.0 if i < 70 else 6.0, 1.0, 9, [float(v) for v in rng.normal(-60, 5, 40 if i < 70 else 36)], i // 6)
        for s in (1, 2) for i in range(75)
    ]
    df = spark.createDataFrame(rows, "session_id bigint, segment_start bigint, frame_id bigint, frame_start bigint, f0_hz double, bin_hz double, seed_frames bigint, power_db array<double>, day bigint")
    dated = df.withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day").cast("int"))).drop("day")
    cut, fold = daily.noise_rows(dated), daily.daily_noise(spark, str(tmp_path))
    fold.update(cut.filter("date < '2024-01-08'"))
    fold.update(cut)
    got, want = fold.results().collect(), noise.bin_noise_floor(dated.drop("date")).collect()
    order = lambda r: (r.session_id, r.bin_block, r.frame_start)
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [tuple(r)[:-2] for r in got] == [tuple(r)[:-2] for r in want]
    assert np.allclose(np.concatenate([r.noise_db for r in got]), np.concatenate([r.noise_db for r in want]))
