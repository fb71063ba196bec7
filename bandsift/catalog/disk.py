"""What is written, kept up on disk and read back: snapshots, dated tables, recordings, exports, text files."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandsift.catalog.registry import query
from bandsift.runtime import shared_folder
from bandsift.sources import sigmf, tables, text, upkeep
from bandsift.sources.snapshot import Snapshot

_CHANNEL = ["session_id", "channel_id", "center_hz", "peak_power_db", "status"]


def _snapshot(t) -> Snapshot:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in t.channels.select(_CHANNEL).schema.fields)
    return Snapshot(t.spark, shared_folder(t.spark, "channels"), schema, buckets=8)


@query(
    """WITH u AS (SELECT session_id, channel_id, center_hz, peak_power_db, status FROM channel_updates
         QUALIFY row_number() OVER (PARTITION BY session_id, channel_id ORDER BY version DESC) = 1)
       SELECT session_id, channel_id, coalesce(u.center_hz, c.center_hz) AS center_hz, coalesce(u.peak_power_db, c.peak_power_db) AS peak_power_db,
         coalesce(u.status, c.status) AS status FROM channels c FULL JOIN u USING (session_id, channel_id)"""
)
def channel_upsert_stored(t):
    """The table takes the channels, then a stream of updates in two files, of which one batch runs twice."""
    held, folder = _snapshot(t), shared_folder(t.spark, "updates")
    held.upsert(t.channels.select(*_CHANNEL, F.lit(-1).cast("bigint").alias("version")), "version", -1)
    middle = t.channel_updates.agg(F.percentile_approx("version", 0.5)).first()[0] or 0
    early, rest = (t.channel_updates.filter(f"version {c} {middle}") for c in ("<=", ">"))
    for part in (early, rest):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = t.spark.readStream.schema(early.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    checkpoint = shared_folder(t.spark, "checkpoint")
    held.upsert_stream(stream, "version", checkpoint).trigger(availableNow=True).start().awaitTermination()
    held.upsert(early.withColumn("status", F.lit("sent again")), "version", 0)
    return held.read()


@query("SELECT session_id, channel_id FROM channels ANTI JOIN removed_channels USING (session_id, channel_id)")
def drop_merged_stored(t):
    held = _snapshot(t)
    held.upsert(t.channels.select(*_CHANNEL, F.lit(0).alias("version")), "version", 0)
    held.drop(t.removed_channels, 1)
    held.vacuum(keep=1)
    return held.read().select("session_id", "channel_id")


@query(
    """SELECT CAST(ts AS DATE) AS date, count(*) AS n, CAST(sum(detection_id) AS BIGINT) AS ids FROM detections
       WHERE ts >= TIMESTAMP '2024-01-08 06:30:00' GROUP BY CAST(ts AS DATE)"""
)
def retention_prune_stored(t):
    """What is left in the dated folders of a table after a prune."""
    root = shared_folder(t.spark, "tables")
    tables.ingest(t.detections, root, "detections", 1)
    upkeep.prune_dated(t.spark, root, "detections", "2024-01-15 06:30:00", 7)
    left = tables.read_table(t.spark, root, "detections")
    return left.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("detection_id").alias("ids"))


@query(
    """WITH r AS (SELECT session_id * 1000000 + start_sample AS recording_id, make_timestamp(1704067200000000 + start_sample * 20000000) AS ts, iq FROM iq_blocks),
      kept AS (SELECT *, sum(256) OVER (ORDER BY ts DESC, recording_id DESC ROWS UNBOUNDED PRECEDING) AS onwards FROM r),
      left_over AS (SELECT * FROM kept WHERE onwards <= 64000 AND recording_id NOT IN (SELECT s_suppkey * 32 FROM supplier))
      SELECT CAST(ts AS DATE) AS date, count(*) AS recordings, count(*) AS captures, CAST(sum(len(iq)) AS BIGINT) AS n_values FROM left_over GROUP BY CAST(ts AS DATE)"""
)
def recordings_stored(t):
    """File pairs and rows of recordings that are left after some were evicted and some deleted."""
    root = shared_folder(t.spark, "recordings")
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("start_sample") * 20_000_000)
    number = F.col("session_id") * 1_000_000 + F.col("start_sample")
    captures = t.iq_blocks.select(number.alias("session_id"), at.alias("captured_ts"), "center_hz", "sample_rate", "iq", F.lit(None).cast("string").alias("annotations"))
    written = sigmf.write_sigmf(captures, f"{root}/iq", "cf32")
    rows = written.withColumn("recording_id", F.col("session_id")).withColumn("ts", F.to_timestamp("timestamp"))
    tables.ingest(rows, root, "recordings", 1)
    held = lambda: tables.read_table(t.spark, root, "recordings")
    upkeep.evict_recordings(t.spark, root, held(), 64_000)
    ids = t.base("supplier").select((F.col("s_suppkey") * 32).alias("recording_id"))
    upkeep.delete_recordings(t.spark, root, held(), ids)
    on_disk = sigmf.read_sigmf(t.spark, f"{root}/iq").withColumn("date", F.to_date(F.timestamp_seconds("captured_at")))
    found = on_disk.groupBy("date").agg(F.count_distinct("capture").alias("captures"), F.sum(F.size("iq")).alias("n_values"))
    listed = held().groupBy("date").agg(F.count(F.lit(1)).alias("recordings"))
    return listed.join(found, "date", "full")


@query(
    """SELECT 'csv' AS format, count(*) AS n, CAST(sum(channel_id) AS BIGINT) AS ids, round(sum(snr_db), 6) AS snr, min(strftime(first_seen, '%Y-%m-%d')) AS earliest FROM channels
       UNION ALL SELECT 'json', count(*), CAST(sum(channel_id) AS BIGINT), round(sum(snr_db), 6), min(strftime(first_seen, '%Y-%m-%d')) FROM channels"""
)
def export_files(t):
    """Whole exports as files, read back."""
    folder = shared_folder(t.spark, "export")
    tables.export_csv(t.channels, "channels", f"{folder}/csv", ["channel_id"])
    tables.export_json(t.channels, "channels", f"{folder}/json", ["channel_id"])
    schema = "channel_id BIGINT, snr_db DOUBLE, first_seen STRING"
    read = {
        "csv": t.spark.read.csv(f"{folder}/csv", header=True),
        "json": t.spark.read.schema(schema).json(f"{folder}/json"),
    }
    out = None
    for name, rows in read.items():
        one = rows.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("channel_id").cast("bigint")).alias("ids"),
            F.round(F.sum(F.col("snr_db").cast("double")), 6).alias("snr"),
            F.min(F.substring("first_seen", 1, 10)).alias("earliest"),
        ).select(F.lit(name).alias("format"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _as_text(t, rows, name: str) -> str:
    folder = shared_folder(t.spark, name)
    rows.select("value").write.text(folder)
    return folder


@query(
    r"""WITH p AS (SELECT list_transform(string_split(value, ','), lambda x: trim(x)) AS f FROM sweep_lines),
       q AS (SELECT try_cast(f[3] AS DOUBLE) AS low, try_cast(f[5] AS DOUBLE) AS step, list_transform(f[7:], lambda x: try_cast(x AS DOUBLE)) AS db
         FROM p WHERE len(f) >= 7),
       b AS (SELECT low + (generate_subscripts(db, 1) - 1) * step AS freq_hz, unnest(db) AS power_db FROM q
       WHERE low IS NOT NULL AND step IS NOT NULL AND list_count(db) = len(db))
       SELECT freq_hz, count(*) AS n, round(sum(power_db), 6) AS power FROM b GROUP BY freq_hz"""
)
def sweep_csv_files(t):
    """The sweep table as text files, through the file reader."""
    bins = text.read_sweep_csv(t.spark, _as_text(t, t.sweep_lines, "sweep"))
    return bins.groupBy("freq_hz").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("power_db"), 6).alias("power"))


@query(
    r"""WITH j AS (SELECT CASE WHEN json_valid(value) THEN value END AS o FROM decoder_lines),
       p AS (SELECT coalesce(nullif(json_extract_string(o, '$.model'), ''), nullif(json_extract_string(o, '$.protocol'), ''), 'unknown') AS protocol FROM j),
       g AS (SELECT protocol, count(*) AS n FROM p GROUP BY protocol)
       SELECT 'files' AS how, * FROM g UNION ALL SELECT 'stream', * FROM g"""
)
def decoder_jsonl_files(t):
    """Decoder lines as text files, read as files and as a stream."""
    folder = _as_text(t, t.decoder_lines, "decoder")
    both = {
        "files": text.read_decoder_jsonl(t.spark, folder),
        "stream": t.drained(text.read_decoder_jsonl(t.spark, folder, stream=True)),
    }
    out = None
    for how, rows in both.items():
        one = rows.groupBy("protocol").agg(F.count(F.lit(1)).alias("n")).select(F.lit(how).alias("how"), "*")
        out = one if out is None else out.unionByName(one)
    return out
