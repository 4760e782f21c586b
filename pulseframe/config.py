"""Default parameters of the signal engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Limits, bands and thresholds of the engine."""

    fs: float = 360.0
    fs_min: float = 50.0
    fs_max: float = 10_000.0
    min_samples: int = 100
    min_duration_s: float = 2.0
    min_rhythm_s: float = 5.0
    qrs_band: tuple[float, float] = (0.5, 45.0)
    qrs_order: int = 4
    morph_band: tuple[float, float] = (0.05, 40.0)
    morph_order: int = 2
    ppg_band: tuple[float, float] = (0.5, 8.0)
    ppg_order: int = 3
    notch_q: float = 30.0
    powerline_db: float = 10.0
    mwi_s: float = 0.150
    refractory_s: float = 0.200
    searchback_s: float = 0.360
    calibration_s: float = 2.0
    alpha: float = 0.125
    gap_factor: float = 1.66
    segment_s: float = 5.0
    flat_std: float = 1e-4
    kl_shift: float = 0.15
    cusum_threshold: float = 4.0
    cusum_drift: float = 0.5
    rr_min: float = 0.2
    rr_max: float = 3.0
    ppg_bpm: tuple[float, float] = (25.0, 220.0)
    vt_bpm: float = 120.0
    vt_beats: int = 4
    chunk_s: float = 60.0
    chunk_overlap_s: float = 1.0
    edge_chunk_s: float = 2.0
    edge_overlap_s: float = 0.3
    match_tolerance_s: float = 0.050
    ppg_tolerance_bpm: float = 10.0
    latency_target_s: float = 3.0
    plot_points: int = 5500


DEFAULT = Config()
