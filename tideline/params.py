"""Parameters of an analysis: detection, weights and grades. Values are the defaults that results are compared under."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Grades from best to worst and the least score of each.
GRADES = ("S", "A", "B", "C")
#: Indicators that have a value for each tick, and those that only intervals have.
TICK_METRICS = ("density", "burst", "activation", "length_mix", "concentration", "overlap")
INTERVAL_METRICS = ("lifecycle", "returning")
#: Shapes of an interval and the duration below which each applies, in seconds.
SHAPES = (("spike", 60), ("short", 180), ("plateau", 600), ("long", None))


@dataclass(frozen=True)
class DetectionParams:
    """How highlight intervals are found. Thresholds given explicitly replace the derived ones where there is a baseline."""

    threshold_mode: str = "sigma"
    candidate_sigma: float = 2.0
    strong_sigma: float = 3.0
    candidate_percentile: float = 97.5
    strong_percentile: float = 99.0
    candidate_threshold: float | None = None
    strong_threshold: float | None = None
    merge_gap: int = 30
    merge_overlap_min: float = 0.5
    min_duration: int = 3
    spam_filter: bool = True
    spam_min_ratio: float = 0.8
    spam_concentration: float = 0.6
    spam_min_repeats: int = 3
    use_merge_overlap: bool = True

    def __post_init__(self):
        if self.threshold_mode not in ("sigma", "robust", "percentile"):
            raise ValueError(f"unknown threshold mode: {self.threshold_mode}")


@dataclass(frozen=True)
class MetricWeights:
    """Two dimensions, each shared out over four indicators."""

    intensity: float = 0.60
    audience: float = 0.40
    within_intensity: dict = field(default_factory=lambda: {"density": 0.30, "burst": 0.20, "activation": 0.35, "length_mix": 0.15})
    within_audience: dict = field(default_factory=lambda: {"concentration": 0.30, "overlap": 0.20, "lifecycle": 0.30, "returning": 0.20})

    def effective(self) -> dict[str, float]:
        return {k: self.intensity * v for k, v in self.within_intensity.items()} | {k: self.audience * v for k, v in self.within_audience.items()}

    def heat(self) -> dict[str, float]:
        """Weights of the tick indicators alone, summing to 1 (all 0 without any positive weight)."""
        own = {k: v for k, v in self.effective().items() if k in TICK_METRICS}
        total = sum(own.values())
        return {k: (v / total if total > 0 else 0.0) for k, v in own.items()}

    @classmethod
    def from_raw(cls, intensity: float, within_intensity: dict, within_audience: dict) -> MetricWeights:
        """Weights from raw slider values: each dimension's are scaled to sum to 1."""

        def scaled(raw: dict) -> dict:
            total = sum(raw.values()) or 1.0
            return {k: v / total for k, v in raw.items()}

        return cls(intensity, 1.0 - intensity, scaled(within_intensity), scaled(within_audience))


@dataclass(frozen=True)
class GradeThresholds:
    s: float = 0.75
    a: float = 0.60
    b: float = 0.45
    c: float = 0.30


@dataclass(frozen=True)
class Windows:
    """Window lengths in ticks, and the length of a tick in milliseconds."""

    tick_ms: int = 1000
    window: int = 10
    overlap_window: int = 30
    silent_most: int = 2
    observation: float = 300.0
    observation_ratio: float = 0.25
    short_most: int = 5
    long_over: int = 15
