"""Options of the stages with their defaults, read from JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class VelocityConfig:
    sampling_frames: int = 540
    region_clusters: int = 4
    min_similarity: float = 0.011
    colour_clusters: int = 5
    max_iter: int = 30
    opening_size: int = 8
    min_area_share: float = 0.15


@dataclass(frozen=True)
class LabelConfig:
    min_calibration_confidence: float = 0.75
    max_player_area: float = 40000
    min_segmentation_score: float = 0.65
    min_dist_to_goals: float = 20
    min_blob_area: float = 1000
    erosion_radius: int = 2
    histogram: str = "ab"
    max_keeper_goal_dist: float = 5
    min_keeper_isolation: float = 2.5
    max_histogram_dist: float = 0.4
    far_touchline: float = 3
    near_touchline: float = 29
    midfield_clusters: int = 10
    validation_share: float = 0.1
    seed: int = 42


@dataclass(frozen=True)
class TrainingConfig:
    classes: int = 5
    max_epochs: int = 100
    batch_size: int = 96
    max_steps: int = 100
    learning_rate: float = 0.001
    patience: int = 7
    seed: int = 42


def load(kind: type, text: str):
    """A config from flat JSON; unknown keys are an error, missing ones keep their defaults."""
    values = json.loads(text)
    unknown = set(values) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    return kind(**values)
