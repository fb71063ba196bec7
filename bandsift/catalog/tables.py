"""Queries over text sources, table upkeep and configuration history."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandsift.catalog.registry import query
from bandsift.operators import channels as ch
from bandsift.operators import config as G
from bandsift.operators import maintenance as M
from bandsift.operators import report as R
from bandsift.sources import text

AS_OF = "2024-01-15 00:00:00"


@query(
    r"""WITH p AS (SELECT event_id, list_transform(string_split(value, ','), lambda x: trim(x)) AS f FROM sweep_lines),
       q AS (SELECT event_id, try_cast(f[3] AS DOUBLE) AS low, try_cast(f[5] AS DOUBLE) AS step, list_transform(f[7:], lambda x: try_cast(x AS DOUBLE)) AS db
         FROM p WHERE len(f) >= 7)
       SELECT event_id, low + (generate_subscripts(db, 1) - 1) * step AS freq_hz, unnest(db) AS power_db FROM q
       WHERE low IS NOT NULL AND step IS NOT NULL AND list_count(db) = len(db)"""
)
def read_sweep_csv(t):
    return text.parse_sweep(t.sweep_lines, ["event_id"])


@query(
    r"""WITH j AS (SELECT event_id, value, CASE WHEN json_valid(value) THEN value END AS o FROM decoder_lines),
       p AS (SELECT event_id, coalesce(nullif(json_extract_string(o, '$.model'), ''), nullif(json_extract_string(o, '$.protocol'), ''), 'unknown') AS protocol,
         CASE WHEN json_type(o, '$.freq') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(trunc(CAST(json_extract_string(o, '$.freq') AS DOUBLE) * 1e6) AS BIGINT) END AS freq_hz FROM j)
       SELECT event_id, protocol, coalesce(freq_hz, -1) AS freq_hz, protocol <> 'unknown' AS known FROM p"""
)
def read_decoder_jsonl(t):
    return text.parse_decoder_lines(t.decoder_lines, ["event_id"]).select(
        "event_id", "protocol", F.coalesce("freq_hz", F.lit(-1)).alias("freq_hz"), "known"
    )


@query(
    """SELECT event_id, coalesce(CASE WHEN json_valid(value) THEN json_extract_string(value, '$.model') END, 'none') AS model FROM decoder_lines"""
)
def json_get(t):
    """A field of JSON text; text that is no JSON reads as null."""
    value = F.try_variant_get(F.try_parse_json("value"), "$.model", "string")
    return t.decoder_lines.select("event_id", F.coalesce(value, F.lit("none")).alias("model"))


_LOG = "sequence BIGINT, freq_hz BIGINT, peak_snr_db DOUBLE"


@query(
    r"""SELECT event_id, CAST(json_extract(value, '$.sequence') AS BIGINT) AS sequence, CAST(json_extract(value, '$.freq_hz') AS BIGINT) AS freq_hz,
       CAST(json_extract(value, '$.peak_snr_db') AS DOUBLE) AS peak_snr_db FROM log_lines WHERE value <> '' AND json_valid(value)"""
)
def candidate_log_read(t):
    rows = text.parse_candidate_log(t.log_lines, _LOG, ["event_id"])
    return rows


@query("SELECT count(*) AS lines FROM log_lines WHERE trim(value) <> ''")
def candidate_log_count(t):
    return text.candidate_log_count(t.log_lines)


@query(
    r"""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS ts, kind, message, client_id, data FROM client_events"""
)
def export_csv(t):
    return R.export_rows(t.client_events, "events", ["event_id"])


@query(
    r"""SELECT channel_id, '{"center_hz":' || center_hz || ',"bandwidth_hz":' || bandwidth_hz || '}' AS band FROM channels"""
)
def export_json(t):
    nested = t.channels.select(
        "channel_id", "center_hz", F.struct("center_hz", "bandwidth_hz").alias("band")
    )
    return R.export_rows(nested, "channels", ["center_hz", "channel_id"]).drop("center_hz")


@query("SELECT channel_id, center_hz FROM channels WHERE channel_id IN (SELECT channel_id FROM pins)")
def rows_by_id(t):
    return ch.rows_by_id(t.channels, "channel_id", t.pins).select("channel_id", "center_hz")


@query(
    "SELECT event_id, kind FROM client_events WHERE ts > TIMESTAMP '2024-01-10 12:00:00' ORDER BY event_id DESC LIMIT 200"
)
def events_since(t):
    return M.events_since(t.client_events, "2024-01-10 12:00:00").select("event_id", "kind")


@query("SELECT recording_id, bytes FROM recordings ORDER BY recording_id DESC LIMIT 100")
def newest_rows(t):
    return M.newest_rows(t.recordings, ["recording_id"], 100).select("recording_id", "bytes")


@query("SELECT event_id FROM client_events ORDER BY ts DESC, event_id DESC LIMIT 500")
def recent_events(t):
    return M.recent_events(t.client_events).select("event_id")


@query(
    "SELECT metric, sample_id, value FROM metrics QUALIFY row_number() OVER (PARTITION BY metric ORDER BY sample_id DESC) <= 120"
)
def metrics_history(t):
    return M.metrics_history(t.metrics, chunk_rows=1_000)


@query("SELECT decode_id, count(*) AS n FROM decodes GROUP BY decode_id")
def merge_decodes(t):
    """A third of the decodes are there already; all of them arrive."""
    existing = t.decodes.filter("decode_id % 3 = 0")
    merged = M.merge_decodes(existing, t.decodes)
    return merged.groupBy("decode_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH u AS (SELECT session_id, channel_id, center_hz, peak_power_db, status FROM channel_updates
         QUALIFY row_number() OVER (PARTITION BY session_id, channel_id ORDER BY version DESC) = 1)
       SELECT session_id, channel_id, coalesce(u.center_hz, c.center_hz) AS center_hz, coalesce(u.peak_power_db, c.peak_power_db) AS peak_power_db,
         coalesce(u.status, c.status) AS status FROM channels c FULL JOIN u USING (session_id, channel_id)"""
)
def channel_upsert(t):
    columns = ["session_id", "channel_id", "center_hz", "peak_power_db", "status"]
    return M.channel_upsert(t.channels.select(columns), t.channel_updates, "version")


@query(
    """SELECT session_id, channel_id FROM channels c WHERE NOT EXISTS (SELECT 1 FROM removed_channels r WHERE r.session_id = c.session_id AND r.channel_id = c.channel_id)"""
)
def drop_merged_channels(t):
    return M.drop_merged_channels(t.channels, t.removed_channels).select("session_id", "channel_id")


@query("SELECT detection_id FROM detections WHERE ts >= TIMESTAMP '2024-01-15' - INTERVAL 7 DAY")
def retention_prune(t):
    return M.retention_prune(t.detections, AS_OF, 7).select("detection_id")


@query(
    """SELECT 'detections' AS table_name, count(*) FILTER (ts < TIMESTAMP '2024-01-08') AS deleted FROM detections UNION ALL
       SELECT 'client_events', count(*) FILTER (ts < TIMESTAMP '2024-01-08') FROM client_events"""
)
def retention_counts(t):
    return M.retention_counts(
        {"detections": t.detections, "client_events": t.client_events}, AS_OF, 7
    )


@query(
    """SELECT recording_id FROM (SELECT recording_id, sum(bytes) OVER (ORDER BY ts DESC, recording_id DESC ROWS UNBOUNDED PRECEDING) AS onwards FROM recordings)
       WHERE onwards + 1000000 <= 150000000"""
)
def storage_cap_evict(t):
    return M.storage_cap_evict(t.recordings, 150_000_000, 1_000_000).select("recording_id")


@query("SELECT recording_id FROM recordings WHERE recording_id NOT IN (SELECT s_suppkey FROM supplier)")
def recording_delete(t):
    ids = t.base("supplier").select(F.col("s_suppkey").alias("recording_id"))
    return M.recording_delete(t.recordings, ids).select("recording_id")


@query(
    """SELECT consumer, type, seq FROM messages WHERE type NOT IN ('spectrum', 'scope') UNION ALL
       SELECT consumer, type, max(seq) FROM messages WHERE type IN ('spectrum', 'scope') GROUP BY consumer, type"""
)
def latest_only(t):
    return M.latest_only(t.messages).select("consumer", "type", "seq")


_FIELDS = "start_hz end_hz step_hz sample_rate gain noise_floor_alpha fft_size spectrum_fps backend retention_days".split()
_FULL = ", ".join(f"last_value({f} IGNORE NULLS) OVER w AS {f}" for f in _FIELDS)
_CHANGED = " OR ".join(
    f"{f} IS DISTINCT FROM lag({f}) OVER w" for f in ("start_hz", "end_hz", "step_hz", "sample_rate", "gain", "backend")
)
_BROKEN = [
    ("start_before_end", "start_hz < end_hz"),
    ("sample_rate_positive", "sample_rate > 0"),
    ("alpha_in_range", "noise_floor_alpha > 0 AND noise_floor_alpha <= 1"),
    ("fft_power_of_two", "fft_size > 0 AND (fft_size & (fft_size - 1)) = 0"),
    ("spectrum_fps", "spectrum_fps BETWEEN 1 AND 60"),
    ("retention_days", "retention_days >= 1"),
    ("backend", "backend IN ('sim', 'rtlsdr', 'rtl_power', 'soapy')"),
    ("gain", "lower(trim(gain)) = 'auto' OR try_cast(gain AS DOUBLE) IS NOT NULL"),
]
_VIOLATIONS = ", ".join(f"CASE WHEN NOT coalesce({rule}, true) THEN '{name}' END" for name, rule in _BROKEN)
_AUDIT = f"""full_c AS (SELECT receiver_id, version, {_FULL} FROM config_versions
    WINDOW w AS (PARTITION BY receiver_id ORDER BY version ROWS UNBOUNDED PRECEDING)),
  audit AS (SELECT *, lag(version) OVER w IS NOT NULL AND ({_CHANGED}) AS acquisition_changed,
    array_to_string(list_filter([{_VIOLATIONS}], lambda x: x IS NOT NULL), ',') AS violations,
    array_to_string(list_filter([CASE WHEN end_hz - start_hz < sample_rate THEN 'span_in_one_window' END,
      CASE WHEN step_hz <> 0 AND step_hz > sample_rate THEN 'step_leaves_gaps' END], lambda x: x IS NOT NULL), ',') AS warnings
    FROM full_c WINDOW w AS (PARTITION BY receiver_id ORDER BY version))"""


def _audit(t):
    versions = t.config_versions
    for name, kind in (
        ("exclusions", "array<struct<lo:bigint,hi:bigint>>"),
        ("device_index", "int"),
        ("spectrum_bins", "int"),
        ("max_iq_storage_gb", "double"),
    ):
        versions = versions.withColumn(name, F.lit(None).cast(kind))
    return G.config_audit(versions, chunk_versions=500)


def _shown(df):
    return df.select(
        "receiver_id",
        "version",
        "start_hz",
        "gain",
        "acquisition_changed",
        F.array_join("violations", ",").alias("violations"),
        F.array_join("warnings", ",").alias("warnings"),
    )


_SHOWN = "receiver_id, version, start_hz, gain, acquisition_changed, violations, warnings"


@query(f"WITH {_AUDIT} SELECT {_SHOWN} FROM audit")
def config_audit(t):
    return _shown(_audit(t))


@query(
    f"""WITH {_AUDIT} SELECT {_SHOWN} FROM audit QUALIFY row_number() OVER (PARTITION BY receiver_id ORDER BY version DESC) = 1"""
)
def latest_config(t):
    return _shown(G.latest_config(_audit(t)))


@query("SELECT coalesce(max(version), 0) AS version FROM config_versions")
def latest_version(t):
    return G.latest_version(t.config_versions)
