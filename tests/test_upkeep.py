"""Tables that are kept up on disk: snapshots, retention, recordings; runs that die are finished later."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from bandsift.sources import files, tables, upkeep
from bandsift.sources.snapshot import Snapshot

SCHEMA = "session_id BIGINT, channel_id BIGINT, status STRING"


def channels(spark, *rows):
    return spark.createDataFrame(list(rows), f"{SCHEMA}, version BIGINT")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_snapshot_versions(spark, tmp_path):
    held = Snapshot(spark, str(tmp_path), SCHEMA, buckets=4)
    assert held.read().collect() == []
    first = [(s, c, "new", 1) for s in (1, 2) for c in range(20)]
    assert held.upsert(channels(spark, *first, (1, 3, "newer", 2)), "version", 5) == 1
    want = {r[:2]: r[2] for r in first} | {(1, 3): "newer"}
    assert rows_of(held.read()) == sorted((*k, v) for k, v in want.items())
    before = held.manifest()["held"]
    assert held.upsert(channels(spark, (1, 7, "changed", 1), (9, 9, "added", 1)), "version", 6) == 2
    after = held.manifest()["held"]
    touched = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(touched) <= 2 and all(after[b] == 2 for b in touched)
    # Sent again, or an older one: nothing changes.
    assert held.upsert(channels(spark, (1, 7, "again", 9)), "version", 6) == 2
    assert held.upsert(channels(spark, (1, 7, "again", 9)), "version", 3) == 2
    want |= {(1, 7): "changed", (9, 9): "added"}
    assert rows_of(held.read()) == sorted((*k, v) for k, v in want.items())
    assert rows_of(held.read(1)) == sorted((*r[:2], "newer" if r[:2] == (1, 3) else "new") for r in first)
    gone = spark.createDataFrame([(2, c) for c in range(20)] + [(5, 5)], "session_id bigint, channel_id bigint")
    assert held.drop(gone, 7) == 3
    want = {k: v for k, v in want.items() if k[0] != 2}
    assert rows_of(held.read()) == sorted((*k, v) for k, v in want.items())
    assert held.upsert(channels(spark, (0, 0, "", 0)).limit(0), "version", 8) == 4
    held.vacuum(keep=1)
    assert held.versions() == [4] and rows_of(held.read()) == sorted((*k, v) for k, v in want.items())


def test_a_write_that_died_does_not_count(spark, tmp_path, monkeypatch):
    held = Snapshot(spark, str(tmp_path), SCHEMA, buckets=2)
    held.upsert(channels(spark, (1, 1, "a", 1)), "version", 1)
    with monkeypatch.context() as m:
        m.setattr(files, "write_text", lambda *_: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            held.upsert(channels(spark, (1, 1, "lost", 1), (2, 2, "lost", 1)), "version", 2)
    assert rows_of(held.read()) == [(1, 1, "a")] and files.exists(spark, f"{tmp_path}/data/v=2")
    held.upsert(channels(spark, (1, 2, "b", 1)), "version", 2)
    assert rows_of(held.read()) == [(1, 1, "a"), (1, 2, "b")]
    # Two writers of one version: the second one fails.
    path = held._path(9)
    files.write_text(spark, path, "{}")
    with pytest.raises(OSError):
        files.write_text(spark, path, "{}")


def bursts(spark, n=200):
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 3600)
    return spark.range(n).select(F.lit(1).cast("bigint").alias("session_id"), F.col("id").alias("channel_id"), at.alias("ts"), F.lit(1.0).alias("duration_ms"))


def died_at(monkeypatch, step):
    """The run dies before its step of that number, once."""
    do, count = upkeep._do, [0]

    def dying(spark, what):
        count[0] += 1
        if count[0] == step:
            raise RuntimeError("died")
        return do(spark, what)

    monkeypatch.setattr(upkeep, "_do", dying)


@pytest.mark.parametrize("step", [0, 1, 2, 4])
def test_prune_is_finished_by_the_next_run(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path)
    for batch in (1, 2):
        tables.ingest(bursts(spark), root, "bursts", batch)
    as_of = "2024-01-06 10:30:00"
    if step:
        with monkeypatch.context() as m:
            died_at(m, step)
            with pytest.raises(RuntimeError):
                upkeep.prune_dated(spark, root, "bursts", as_of, 2)
    upkeep.prune_dated(spark, root, "bursts", as_of, 2)
    left = tables.read_table(spark, root, "bursts")
    cutoff = dt.datetime(2024, 1, 4, 10, 30)
    hours = [i for i in range(200) if dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) >= cutoff]
    assert sorted(r.channel_id for r in left.select("channel_id").collect()) == sorted(hours * 2)
    assert not [n for n in os.listdir(f"{root}/bursts") if n < "date=2024-01-04" and n.startswith("date=")]
    assert [n for n in os.listdir(f"{root}/_intents") if n.endswith(".json")] == [] and upkeep.recover(spark, root) == 0


def recordings(spark, root, n=12):
    os.makedirs(f"{root}/iq")
    rows = []
    for i in range(n):
        for suffix in (".sigmf-data", ".sigmf-meta"):
            with open(f"{root}/iq/r{i}{suffix}", "w") as f:
                f.write("x" * 100)
        rows.append((i, i, f"{root}/iq/r{i}.sigmf-data"))
    df = spark.createDataFrame(rows, "recording_id bigint, hour bigint, path string")
    none = [F.lit(None).cast(k).alias(c) for c, k in (("center_hz", "bigint"), ("sample_rate", "int"), ("gain", "string"), ("duration_ms", "bigint"), ("format", "string"), ("sigmf_meta", "string"))]
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("hour") * 9 * 3600)
    tables.ingest(df.select("recording_id", at.alias("ts"), "path", F.lit(100).cast("bigint").alias("bytes"), *none), root, "recordings", 1)
    return lambda: tables.read_table(spark, root, "recordings")


@pytest.mark.parametrize("step", [0, 1, 2, 3])
def test_recordings_go_with_their_files(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path)
    held = recordings(spark, root)
    if step:
        with monkeypatch.context() as m:
            died_at(m, step)
            with pytest.raises(RuntimeError):
                upkeep.evict_recordings(spark, root, held(), 700, 100)
        upkeep.recover(spark, root)
    else:
        upkeep.evict_recordings(spark, root, held(), 700, 100)
    left = lambda: sorted(r[0] for r in held().select("recording_id").collect())
    on_disk = lambda suffix: sorted(int(n[1:].split(".")[0]) for n in os.listdir(f"{root}/iq") if n.endswith(suffix))
    assert left() == on_disk(".sigmf-data") == on_disk(".sigmf-meta") == [6, 7, 8, 9, 10, 11]
    ids = spark.createDataFrame([(7,), (8,), (99,)], "recording_id bigint")
    upkeep.delete_recordings(spark, root, held(), ids)
    upkeep.delete_recordings(spark, root, held(), ids)
    assert left() == on_disk(".sigmf-data") == on_disk(".sigmf-meta") == [6, 9, 10, 11]


def test_files_that_no_row_names_go(spark, tmp_path):
    root = str(tmp_path)
    held = recordings(spark, root, 6)
    rows = held().filter("recording_id <> 2 and recording_id <> 4")
    assert upkeep.delete_orphans(spark, f"{root}/iq", rows, "2000-01-01") == 0
    os.remove(f"{root}/iq/r4.sigmf-meta")
    assert upkeep.delete_orphans(spark, f"{root}/iq", rows, "2100-01-01") == 3
    assert upkeep.delete_orphans(spark, f"{root}/iq", rows, "2100-01-01") == 0
    assert sorted(os.listdir(f"{root}/iq")) == sorted(f"r{i}.sigmf-{x}" for i in (0, 1, 3, 5) for x in ("data", "meta"))
