"""A whole analysis: from messages to scored highlight intervals, all of it lazy DataFrames over many streams at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import cohorts, detect, prepare, scoring, windows
from tideline.params import DetectionParams, GradeThresholds, MetricWeights, Windows


@dataclass
class Analysis:
    """messages has stream_id, uid, ts_ms and text. cached: keep prepared messages and the table of ticks for several results."""

    messages: DataFrame
    windows: Windows = Windows()
    detection: DetectionParams = DetectionParams()
    weights: MetricWeights = MetricWeights()
    grades: GradeThresholds = GradeThresholds()
    origins: DataFrame | None = None
    dedup: bool = False
    cached: bool = False

    def _kept(self, df: DataFrame) -> DataFrame:
        return df.cache() if self.cached else df

    @cached_property
    def rel(self) -> DataFrame:
        rows = prepare.deduplicated(self.messages) if self.dedup else self.messages
        return self._kept(prepare.relative(rows, self.windows.tick_ms, self.origins))

    @cached_property
    def bounds(self) -> DataFrame:
        return prepare.bounds(self.rel)

    @cached_property
    def grid(self) -> DataFrame:
        return prepare.grid(self.bounds, self.windows.tick_ms)

    @cached_property
    def counts(self) -> DataFrame:
        return self._kept(windows.counts(self.rel, self.grid, self.windows))

    @cached_property
    def density(self) -> DataFrame:
        return self.counts.select("stream_id", "tick", "d")

    @cached_property
    def burst(self) -> DataFrame:
        return windows.burst(self.density)

    @cached_property
    def length_mix(self) -> DataFrame:
        return windows.length_mix(self.counts)

    @cached_property
    def audience(self) -> DataFrame:
        return self._kept(windows.audience(self.rel, self.bounds, self.grid, self.windows))

    @cached_property
    def overlap(self) -> DataFrame:
        return self._kept(windows.overlap(self.rel, self.grid, self.windows))

    @cached_property
    def repeat(self) -> DataFrame:
        return windows.repeat_ratio(self.rel, self.grid, self.windows, self.detection.spam_min_repeats)

    @cached_property
    def spam(self) -> DataFrame:
        return windows.spam_mask(self.repeat, self.audience, self.detection)

    @cached_property
    def thresholds(self) -> DataFrame:
        return detect.thresholds(self.density, self.detection)

    @cached_property
    def candidates(self) -> DataFrame:
        p = self.detection
        return self._kept(
            detect.candidates(
                self.density, self.thresholds, p, self.spam if p.spam_filter else None, self.overlap if p.use_merge_overlap else None, self.windows.tick_ms / 1000
            )
        )

    @cached_property
    def lifecycle(self) -> DataFrame:
        return cohorts.lifecycle(self.rel, self.bounds, self.candidates, self.windows.tick_ms)

    @cached_property
    def returning(self) -> DataFrame:
        return cohorts.returning(self.rel, self.bounds, self.candidates, self.windows.tick_ms)

    @cached_property
    def ticks(self) -> DataFrame:
        """One wide row a tick."""
        keys = ["stream_id", "tick"]
        return self._kept(
            self.burst.join(self.audience.select(*keys, "activation", "concentration"), keys)
            .join(self.length_mix.select(*keys, "short_ratio", "mid_ratio", "long_ratio"), keys)
            .join(self.overlap.select(*keys, "overlap"), keys)
        )

    @cached_property
    def signals(self) -> DataFrame:
        return scoring.signals(self.ticks)

    @cached_property
    def heat(self) -> DataFrame:
        return scoring.heat(self.signals, self.weights)

    @cached_property
    def scored(self) -> DataFrame:
        return scoring.scored(self.candidates, self.signals, self.heat, self.lifecycle, self.returning, self.weights, self.grades)

    @cached_property
    def overall(self) -> DataFrame:
        return scoring.overall(self.heat, self.grades)

    @cached_property
    def grade_counts(self) -> DataFrame:
        return scoring.grade_counts(self.scored)

    def tables(self) -> dict[str, DataFrame]:
        return {
            "messages": self.rel, "stream_bounds": self.bounds, "ticks": self.ticks, "spam": self.spam, "thresholds": self.thresholds, "candidates": self.candidates,
            "lifecycle": self.lifecycle, "returning": self.returning, "heat": self.heat, "scored": self.scored, "overall": self.overall,
        }

    def register(self, prefix: str = "") -> None:
        """Every table as a temporary view, for SQL."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)

    def best(self) -> DataFrame:
        """Each stream's interval with the highest score, the earliest of equals."""
        own = F.max_by(F.struct(*self.scored.columns), F.struct("score", -F.col("cand_id")))
        return self.scored.groupBy("stream_id").agg(own.alias("_best")).select("_best.*")


def analyze(messages: DataFrame, **parameters) -> Analysis:
    return Analysis(messages, **parameters)
