"""Every tunable value of the operators, with its default."""

from __future__ import annotations

from dataclasses import dataclass

# Letters that readers confuse with digits, and the digits they are folded to, place by place.
CONFUSED, FOLDED = "OQDILSBZGT", "0001158267"

VEHICLE_CLASSES = ["car", "motorcycle", "bus", "truck"]
SEVERITIES = ["low", "medium", "high", "critical"]


@dataclass(frozen=True)
class Match:
    plate_weight: float = 0.60
    appearance_weight: float = 0.40
    alert_threshold: float = 0.55
    gram: int = 3
    fallback_gram: int = 2
    min_chars: int = 4
    max_kmh: float = 120.0


@dataclass(frozen=True)
class Clone:
    min_plate_chars: int = 6
    default_plate_conf: float = 0.5
    max_confidence: float = 0.99
    zero_elapsed_violation: float = 0.9
    min_confidence: float = 0.6
    max_kmh: float = 120.0


@dataclass(frozen=True)
class Baseline:
    min_samples: int = 5
    stdev_floor: float = 1.0
    z_high: float = 3.0
    z_elevated: float = 2.0
    z_low: float = -2.0
    max_bucket_age_s: int = 900


@dataclass(frozen=True)
class Vote:
    max_reads: int = 20
    min_chars: int = 4
    min_voters: int = 2


@dataclass(frozen=True)
class Similar:
    threshold: float = 0.80
    ambiguity_margin: float = 0.02
    agree_bonus: float = 0.03
    disagree_penalty: float = 0.05
    limit: int = 25


@dataclass(frozen=True)
class Track:
    base_iou: float = 0.25
    appearance_rescue: float = 0.86
    timeout_s: float = 6.0
    max_tracks: int = 300
    min_travel_px: float = 40.0


@dataclass(frozen=True)
class Journey:
    max_rows: int = 4000
    max_candidates: int = 8
    max_scan: int = 200
    max_journeys: int = 50
    max_gap_s: float = 1800.0
    max_hops: int = 12
    max_span_s: float = 3600.0
    min_similarity: float = 0.84
    floor_similarity: float = 0.80
    min_hops: int = 2
    cap: float = 0.95
    decay: float = 0.08


@dataclass(frozen=True)
class Clock:
    min_year: int = 2025
    max_year: int = 2027
    agree_s: float = 2.5
    live_tolerance_ms: int = 2000
    index_tolerance_ms: int = 250
    live_attempts: int = 4
    index_attempts: int = 30
    reanchor_s: float = 900.0
    retry_ms: int = 20_000
    pending_retry_ms: int = 1_000


@dataclass(frozen=True)
class Dark:
    luma: float = 18.0
    streak: int = 60
    recheck: int = 300


@dataclass(frozen=True)
class Tier:
    slots: int = 3
    hold_us: int = 10_000_000
    wide_ms: int = 1_000
    close_ms: int = 200


@dataclass(frozen=True)
class Frame:
    embed_height: int = 64
    embed_count: int = 8
    plate_height: int = 110
    plate_count: int = 4


@dataclass(frozen=True)
class Search:
    k1: float = 1.5
    b: float = 0.75
    coverage: float = 0.5
    evidence: float = 1.0
    trigram_share: float = 0.7
    trigram_chars: int = 4
    limit: int = 5


@dataclass(frozen=True)
class Retention:
    max_bytes: int = 5 * 1024**3
    max_age_s: int = 7 * 86400
    max_rows: int = 2_000_000
    keep_s: int = 86400


@dataclass(frozen=True)
class Notify:
    min_severity: str = "high"
    cooldown_s: int = 300


@dataclass(frozen=True)
class Report:
    hours: int = 24
    plates: int = 200
    alerts: int = 100
    zone_events: int = 100

    @property
    def limits(self) -> dict[str, int]:
        return {"Plates": self.plates, "Alerts": self.alerts, "Zone events": self.zone_events}
