"""Thresholds, runs, merging, peaks, levels and shapes."""

import pytest

from tideline.operators import detect
from tideline.params import DetectionParams


def curve(spark, values):
    return spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "stream_id string, tick bigint, d bigint")


def find(spark, values, exclude=None, overlap=None, parts=3, **p):
    p = DetectionParams(**({"min_duration": 0} | p))
    d = curve(spark, values).repartition(parts)
    ex = None if exclude is None else spark.createDataFrame([("s", t, t in exclude) for t in range(len(values))], "stream_id string, tick bigint, spam boolean")
    ov = None if overlap is None else spark.createDataFrame([("s", t, v) for t, v in overlap.items()], "stream_id string, tick bigint, overlap double")
    return detect.candidates(d, detect.thresholds(d, p), p, ex, ov).orderBy("cand_id").collect()


def test_no_baseline(spark):
    assert find(spark, [0] * 5) == []
    assert find(spark, [0] * 5, candidate_threshold=-1.0, strong_threshold=-1.0) == []


@pytest.mark.parametrize("parts", [1, 2, 4, 10])
def test_exact_tie_is_no_excess(spark, parts):
    (c,) = find(spark, [0, 0, 4] + [0] * 7, parts=parts)
    assert (c["peak_t"], c["peak_density"], c["level"], c["duration"]) == (2, 4, "candidate", 0)


def test_strong(spark):
    (c,) = find(spark, [0] * 50 + [10] + [0] * 50)
    assert c["level"] == "strong"


def test_merging_by_gap(spark):
    (c,) = find(spark, [0] * 40 + [20] * 5 + [0] * 10 + [20] * 5 + [0] * 40)
    assert (c["t_start"], c["t_end"]) == (40, 59)
    assert [c["t_start"] for c in find(spark, [0] * 30 + [10] * 3 + [0] * 30 + [10] * 3 + [0] * 30)] == [30, 63]


@pytest.mark.parametrize(("value", "starts"), [("none", [40]), (0.1, [40, 65]), (0.8, [40]), (None, [40])])
def test_merging_by_overlap(spark, value, starts):
    values = [0] * 40 + [10] * 5 + [0] * 20 + [10] * 5 + [0] * 40
    found = find(spark, values, overlap={1: 0.5} if value == "none" else {65: value})
    assert [c["t_start"] for c in found] == starts


def test_robust_and_percentile(spark):
    base = [4, 5, 4, 6, 5, 4, 5, 6, 4, 5]
    values = base * 12 + [25] * 20 + [0] * 10 + [1000] + base * 10
    (c,) = find(spark, values)
    assert c["peak_density"] == 1000
    (c,) = find(spark, values, threshold_mode="robust")
    assert (c["t_start"], c["t_end"]) == (120, 150)
    ramp = list(range(1, 21))
    assert find(spark, ramp) == []
    (c,) = find(spark, ramp, threshold_mode="percentile", candidate_percentile=80, strong_percentile=95)
    assert (c["t_start"], c["t_end"], c["level"]) == (16, 19, "strong")
    p = DetectionParams(threshold_mode="percentile", candidate_percentile=80, strong_percentile=95)
    t = detect.thresholds(curve(spark, ramp), p).head()
    assert (t["candidate_threshold"], t["strong_threshold"]) == (pytest.approx(16.2), pytest.approx(19.05))


def test_explicit_thresholds(spark):
    t = detect.thresholds(curve(spark, range(20)), DetectionParams(candidate_threshold=5, strong_threshold=6)).head()
    assert (t["candidate_threshold"], t["strong_threshold"]) == (5, 6)
    with pytest.raises(ValueError):
        DetectionParams(threshold_mode="other")
    values = [0] * 30 + [5] * 5 + [0] * 30
    assert find(spark, values, candidate_threshold=4.0, strong_threshold=10.0)[0]["level"] == "candidate"
    assert find(spark, values, candidate_threshold=4.0, strong_threshold=4.5)[0]["level"] == "strong"


def test_exclusion_and_least_duration(spark):
    found = find(spark, [0] * 30 + [10] * 5 + [0] * 60 + [10] * 5 + [0] * 30, exclude=set(range(95, 100)))
    assert [c["t_start"] for c in found] == [30]
    (c,) = find(spark, [0] * 30 + [10] + [0] * 40 + [10] * 5 + [0] * 30, min_duration=3)
    assert (c["t_start"], c["t_end"]) == (71, 75)


def test_peak_may_be_excluded_within_a_span(spark):
    (c,) = find(spark, [0] * 40 + [10, 10, 30, 10, 10] + [0] * 40, exclude={42})
    assert (c["t_start"], c["t_end"], c["peak_t"], c["peak_density"]) == (40, 44, 42, 30)


def test_shapes(spark):
    for n, kind in ((10, "spike"), (120, "short"), (400, "plateau"), (700, "long")):
        (c,) = find(spark, [0] * 9000 + [50] * (n + 1) + [0] * 9000)
        assert (c["duration"], c["shape"]) == (n, kind)
