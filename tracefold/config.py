"""Thresholds of the operators. Defaults are the reference behaviour."""

from __future__ import annotations

from dataclasses import dataclass, field

SECOND = 1_000_000
DAY = 86_400 * SECOND
MODALITIES = ("camera", "microphone", "bluetooth")

# Streams and the feature names that each may carry.
ALLOWED_KEYS = {
    "camera": ("body_count", "joints"),
    "microphone": ("rms", "peak", "zero_crossing_rate", "spectral_centroid_hz", "spectral_rolloff_hz", "spectral_flatness", "voice_activity_probability"),
    "wifi": ("rssi_mean", "noise_mean", "visible_network_count", "strongest_1", "strongest_2", "strongest_3"),
    "bluetooth": ("clusters", "cluster_count"),
}
# Keys that no stored record may hold, and endings of raw media files.
FORBIDDEN_KEYS = ("ssid", "bssid", "device_name", "peripheral_name", "mac_address", "raw_audio", "raw_frame", "raw_pcm", "transcript")
RAW_EXTENSIONS = ("aif", "aiff", "caf", "jpeg", "jpg", "m4a", "mov", "mp3", "mp4", "png", "wav")
# Layers that a role may write in, and the layer and status of its runs.
ROLE_LAYERS = {"archivist": ("observed", "inferred"), "ethnographer": ("interpreted",), "skeptic": ("interpreted",), "cartographer": ("inferred",), "poet": ("imagined",)}
ROLE_OUTPUT = {"archivist": ("INFERRED", "DRAFT"), "ethnographer": ("INTERPRETED", "PENDING_INTERPRETATION"), "skeptic": ("INTERPRETED", "INSUFFICIENT_EVIDENCE"), "cartographer": ("INFERRED", "DRAFT"), "poet": ("IMAGINED", "ARTIFACT")}


@dataclass(frozen=True)
class Ingest:
    schema_version: int = 1
    most_id_bytes: int = 128
    most_payload_bytes: int = 1 << 20
    most_items: int = 128
    most_string_bytes: int = 128
    silent_gap_us: int = 30 * SECOND
    #: Rows of a ledger that one task scans in order.
    chunk: int = 1_000_000


@dataclass(frozen=True)
class Fusion:
    fresh_us: int = 10 * SECOND
    weights: dict[str, float] = field(default_factory=lambda: {"camera": 0.65, "microphone": 0.20, "bluetooth": 0.15})
    full_clusters: float = 4.0
    contested_over: float = 0.45
    weak_health: float = 0.25


@dataclass(frozen=True)
class Sessions:
    enter: float = 0.70
    enter_us: int = 3 * SECOND
    exit_confidence: float = 0.80
    exit_us: int = 5 * SECOND
    merge_us: int = 5 * SECOND
    episode_us: int = 30 * 60 * SECOND
    bucket_us: int = 60 * SECOND


@dataclass(frozen=True)
class Retention:
    observation_us: int = 7 * DAY
    belief_us: int = 30 * DAY
    event_us: int = 365 * DAY
