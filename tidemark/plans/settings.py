"""Parameters for the driver's sparse stream: one event in minutes, not many a second."""

from tidemark.model import HOUR_MS, CostModel, DetectorConfig, TriageConfig

DETECTOR = DetectorConfig(window_ms=6 * HOUR_MS, sample_interval_ms=HOUR_MS)
LONG = DETECTOR.with_(long_window_ms=24 * HOUR_MS, w_long_repetition=6.0)
COSTS = CostModel()
TRIAGE = TriageConfig(dedup_cooldown_ms=6 * HOUR_MS, trailing_ms=24 * HOUR_MS, retry_ratio=1.2, min_events=3, kill_cooldown_ms=24 * HOUR_MS)
COOLDOWN = 6 * HOUR_MS
THRESHOLD = 4.0
EPISODE_MS = 72 * HOUR_MS
TRAIN_SHARE, VALIDATION_SHARE = 2 / 3, 0.25
