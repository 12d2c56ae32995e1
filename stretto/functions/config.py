"""Settings of the operators, as frozen records; a tempo that differs by row goes through the Column forms."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SAMPLE_RATE, A4_HZ, F_MIN, F_MAX = 22050, 442.0, 65.0, 2093.0
FAST_TEMPO, SMALL_FRAME, LARGE_FRAME = 120.0, 512, 1024
DEFAULT_TEMPO = 120.0


def frame_size(tempo: Column) -> Column:
    """Samples of a frame (and hop) at a tempo."""
    return F.when(tempo >= FAST_TEMPO, SMALL_FRAME).otherwise(LARGE_FRAME)


@dataclass(frozen=True)
class OnsetSettings:
    window: int = 10
    multiplier: float = 1.6
    least_strength: float = 1e-4
    hamming: bool = True


@dataclass(frozen=True)
class JudgeSettings:
    """How notes are judged. mode: detected_onset, score_grid or anchored_grid."""

    mode: str = "detected_onset"
    onset_beats: float = 0.35
    onset_cap: float = 0.25
    pitch_tolerance: float = 1.0
    trim: float = 0.15
    long_ratio: float = 0.8
    quarter_ratio: float = 0.5
    most_ratio: float | None = None
    pre_beats: float = 0.2
    post_beats: float = 0.35

    def __post_init__(self):
        if self.mode not in ("detected_onset", "score_grid", "anchored_grid"):
            raise ValueError(f"unknown window mode {self.mode}")


@dataclass(frozen=True)
class ReanchorSettings:
    enabled: bool = True
    least_rest_beats: float = 0.5
    end_post_beats: float = 1.0
    end_pre_beats: float = 0.5
    search_post_beats: float = 2.5
    search_pre_beats: float = 0.5
    pitch_tolerance: float = 1.0
    least_frames: int = 4
    run_gap: float = 0.08
    confirm: float = 0.06
    most_shift_beats: float = 2.5


@dataclass(frozen=True)
class StartSettings:
    window_after: float = 3.0
    timeout: float = 30.0
    least_score: float = 0.35
    least_query: float = 1.0
    most_query: float = 2.0
    interval: float = 0.3
    anchor_tolerance: float = 1.0
    anchor_snap: float = 0.15

    def __post_init__(self):
        if self.least_query > self.most_query:
            raise ValueError("least_query exceeds most_query")


@dataclass(frozen=True)
class MatchSettings:
    """Global matching of vector sequences."""

    metric: str = "cosine"
    normalize: str = "z_score"  # z_score, minmax or none
    margin: float = 0.05
    tiebreak: str = "earliest"  # earliest, min_cost or min_cost_latest
    rigid: bool = False


@dataclass(frozen=True)
class PitchFeatureSettings:
    hop: int = 512
    smooth: int = 11
    delta: bool = True
    context_sec: float = 1.5
    per_frame_norm: bool = True


def beat_sec(tempo: Column) -> Column:
    return F.when(tempo > 0, F.lit(60.0) / tempo).otherwise(0.5)


def onset_tolerance(tempo: Column, s: JudgeSettings = JudgeSettings()) -> Column:
    return F.least(F.lit(s.onset_beats) * beat_sec(tempo), F.lit(s.onset_cap))


def grid_pre(tempo: Column, s: JudgeSettings = JudgeSettings()) -> Column:
    return F.greatest(F.lit(0.0), F.lit(s.pre_beats) * beat_sec(tempo))


def grid_post(tempo: Column, s: JudgeSettings = JudgeSettings()) -> Column:
    return F.greatest(F.lit(0.0), F.lit(s.post_beats) * beat_sec(tempo))


def usable_tempo(tempo: Column) -> Column:
    """A tempo that is missing or not positive counts as the default."""
    return F.when(tempo > 0, tempo).otherwise(DEFAULT_TEMPO)


def params_hash(*settings) -> str:
    """Twelve hexadecimal digits that tell settings apart."""
    whole = {type(s).__name__: dataclasses.asdict(s) for s in settings}
    return hashlib.sha256(json.dumps(whole, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]
