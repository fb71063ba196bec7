"""Fixed values and default parameters.

Values below are fixed: results only agree with other installations of the same
pipeline when they are identical.
"""

from __future__ import annotations

# Band and scan defaults.
BAND_START_HZ = 867_000_000
BAND_END_HZ = 870_000_000
DWELL_MS = 120
THRESHOLD_DB = 6.0
FLOOR_ALPHA = 0.05
FLOOR_PERCENTILE = 0.25
EMPTY_FLOOR_DB = -120.0
FFT_SIZE = 2048
SPECTRUM_FPS = 10
SPECTRUM_BINS = 1024
SCOPE_FPS = 20
SCOPE_BINS = 512
ENVELOPE_POINTS = 256
MERGE_GAP_BINS = 3
UNSEEN_DB = -140.0

# Clustering.
PROXIMITY_HZ = 40_000
CENTER_ALPHA = 0.1
POWER_ALPHA = 0.2

# Recurrence.
BURST_GAP_S = 1.0
MAX_ARRIVALS = 512

# Channel status ages, seconds.
ACTIVE_AGE_S = 3.0
RECENT_AGE_S = 30.0

# Fifteen-channel grid.
GRID_FIRST_HZ = 867_569_000
GRID_STEP_HZ = 100_000
GRID_CHANNELS = 15
GRID_LAST_HZ = GRID_FIRST_HZ + GRID_STEP_HZ * (GRID_CHANNELS - 1)
GRID_GUARD_HZ = 40_000

# Wideband evidence.
FRAME_SAMPLES = 2048
WELCH_SEGMENTS = 4
EVIDENCE_THRESHOLD_DB = 12.0
NOISE_ALPHA = 0.02
NOISE_STEP_DOWN_DB = -3.0
NOISE_STEP_UP_DB = 0.25
NOISE_SEED_PERCENTILE = 20.0
HOLDOFF_FRAMES = 2
MIN_QUALIFIED_FRAMES = 2
ASSOCIATION_HZ = 15_000
OCCUPIED_BW_DB = 10.0
LONG_WAKEUP_MS = (900.0, 1400.0)
SHORT_WAKEUP_MS = (35.0, 70.0)
WIDEBAND_MIN_HZ = 30_000
WIDEBAND_MIN_MS = 20.0
CANDIDATE_MIN_SCORE = 2.0
CANDIDATE_BUCKET_HZ = 50_000
CANDIDATE_CAP = 6
RECENT_BURSTS = 200

# Triggered capture, seconds.
PRE_TRIGGER_S = 2.0
POST_TRIGGER_S = 2.5
MAX_CAPTURE_S = 8.0
MAX_RECORDING_MS = 10_000

# Fixed values of the keying hint: percentiles of the level and what they must reach.
KEYING_PERCENTILES = (10, 40, 90, 99)
KEYING_MIN_SAMPLES = 128
KEYING_SILENCE = 1e-9
ON_OFF_CONTRAST = 5.0
ON_OFF_UNIT_PERCENTILE = 20
ON_OFF_MIN_UNIT = 2.0
ON_OFF_MIN_RATE = 10.0
ON_OFF_CONFIDENCE = (0.4, 0.08)
SHIFT_MIN_FLATNESS = 0.5
SHIFT_MIN_SPREAD = 0.02
SHIFT_CONFIDENCE = 0.5
ISOLATE_MIN_SAMPLES = 8

# Pattern score.
NARROWBAND_MAX_HZ = 40_000
SHORT_BURST_MAX_MS = 500
REPEAT_MIN_OBS = 4

# Reference markers in the 868 MHz band: (Hz, label, kind).
REFERENCE_MARKERS = [
    (868_300_000, "wM-Bus S", "wmbus"),
    (868_950_000, "wM-Bus T/C", "wmbus"),
    (869_525_000, "wM-Bus N", "wmbus"),
    (868_100_000, "LoRa 1", "lora"),
    (868_300_000, "LoRa 2", "lora"),
    (868_500_000, "LoRa 3", "lora"),
]

# Reference sub-bands: (low Hz, high Hz, label).
REFERENCE_RANGES = [
    (868_000_000, 868_600_000, "g (868.0–868.6)"),
    (868_700_000, 869_200_000, "g1 (868.7–869.2)"),
    (869_400_000, 869_650_000, "g3 (869.4–869.65)"),
    (869_700_000, 870_000_000, "g4 (869.7–870.0)"),
]

# Width of a time chunk used to split long histories of one key, seconds.
CHUNK_S = 86_400
# Frames per chunk when a history is ordered by frame number.
CHUNK_FRAMES = 512

# Configuration, fixed: fields that restart acquisition when they change, the other fields, the
# allowed range of a field by rule, and the names of the tuners.
ACQUISITION_FIELDS = [
    "start_hz", "end_hz", "step_hz", "sample_rate", "gain", "ppm", "dwell_ms", "backend",
    "device_index", "simulation",
]
OTHER_FIELDS = [
    "threshold_db", "noise_floor_alpha", "fft_size", "spectrum_fps", "spectrum_bins",
    "max_iq_storage_gb", "retention_days", "exclusions",
]
CONFIG_RANGES = {
    "device_index": ("device_index", 0, float("inf")),
    "spectrum_fps": ("spectrum_fps", 1, 60),
    "spectrum_bins": ("spectrum_bins", 16, 8192),
    "storage_cap": ("max_iq_storage_gb", 0, float("inf")),
    "retention_days": ("retention_days", 1, float("inf")),
}
BACKENDS = ["sim", "rtlsdr", "rtl_power", "soapy"]
