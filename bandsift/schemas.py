"""One declared schema per table; read paths never infer."""

from __future__ import annotations

PSD_FRAMES = (
    "session_id BIGINT, frame_seq BIGINT, ts TIMESTAMP, f0_hz DOUBLE, bin_hz DOUBLE, "
    "power_db ARRAY<DOUBLE>"
)
REGIONS = (
    "session_id BIGINT, frame_seq BIGINT, ts TIMESTAMP, center_hz BIGINT, bandwidth_hz BIGINT, "
    "peak_power_db DOUBLE, avg_power_db DOUBLE, snr_db DOUBLE, start_hz BIGINT, stop_hz BIGINT, "
    "bin_start INT, bin_stop INT"
)
IQ_BLOCKS = (
    "session_id BIGINT, start_sample BIGINT, center_hz BIGINT, sample_rate INT, "
    "captured_at DOUBLE, iq ARRAY<FLOAT>"
)
CHANNELS = (
    "session_id BIGINT, channel_id BIGINT, center_hz BIGINT, bandwidth_hz BIGINT, "
    "current_power_db DOUBLE, peak_power_db DOUBLE, avg_power_db DOUBLE, snr_db DOUBLE, "
    "observation_count BIGINT, first_seen TIMESTAMP, last_seen TIMESTAMP, "
    "typical_burst_ms DOUBLE, recurrence_interval_s DOUBLE, confidence DOUBLE, status STRING"
)
DETECTIONS = (
    "detection_id BIGINT, session_id BIGINT, channel_id BIGINT, ts TIMESTAMP, center_hz BIGINT, "
    "bandwidth_hz BIGINT, peak_power_db DOUBLE, avg_power_db DOUBLE, snr_db DOUBLE, "
    "duration_ms DOUBLE"
)
SESSIONS = (
    "session_id BIGINT, started_at TIMESTAMP, stopped_at TIMESTAMP, start_hz BIGINT, "
    "end_hz BIGINT, backend STRING, simulation BOOLEAN"
)
RECORDINGS = (
    "recording_id BIGINT, ts TIMESTAMP, path STRING, center_hz BIGINT, sample_rate INT, "
    "gain STRING, duration_ms BIGINT, format STRING, bytes BIGINT, sigmf_meta STRING"
)
CLIENT_EVENTS = (
    "event_id BIGINT, ts TIMESTAMP, kind STRING, message STRING, client_id STRING, data STRING"
)
DECODES = (
    "decode_id BIGINT, ts TIMESTAMP, decoder STRING, protocol STRING, freq_hz BIGINT, "
    "known BOOLEAN, fields STRING, session_id BIGINT"
)
BURSTS = (
    "session_id BIGINT, channel_id BIGINT, ts TIMESTAMP, duration_ms DOUBLE"
)
