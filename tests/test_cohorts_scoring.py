"""Cohorts of intervals, weights, heat, scores and grades."""

import pytest

from pyspark.sql import functions as F

from tideline.functions.text import grade
from tideline.operators import cohorts, prepare, scoring
from tideline.params import TICK_METRICS, MetricWeights


def stream(spark, speech, last, intervals):
    """speech: uid -> seconds; last: the stream's end in seconds, from 0."""
    rows = [(u, t) for u, ts in speech.items() for t in ts] + [("edge", 0), ("edge2", last)]
    df = spark.createDataFrame([("s", u, t * 1000, "x") for u, t in rows], "stream_id string, uid string, ts_ms bigint, text string")
    rel = prepare.relative(df)
    cand = spark.createDataFrame([("s", i, a, b) for i, (a, b) in enumerate(intervals)], "stream_id string, cand_id bigint, t_start bigint, t_end bigint")
    return rel, prepare.bounds(rel), cand


def test_lifecycle(spark):
    speech = {"U2": [100, 1500, 3500], "U3": [1520, 1590], "U4": [1400, 1520, 2500], "U5": [1400, 1550, 1750]}
    r = cohorts.lifecycle(*stream(spark, speech, 3500, [(1500, 1600)])).head()
    assert (r["instant"], r["persistent"], r["converted"], r["total_users"]) == (1, 1, 1, 4)
    assert (r["offset_a"], r["offset_b"], r["offset_c"]) == (300, 120, 600)
    r = cohorts.lifecycle(*stream(spark, {}, 100, [(40, 60)])).head()
    assert (r["total_users"], r["offset_a"], r["offset_b"], r["offset_c"]) == (0, 25, 25, 25)
    r = cohorts.lifecycle(*stream(spark, {"U2": [100, 1705], "U1": [1705]}, 1796, [(1700, 1710)])).head()
    assert (r["instant"], r["persistent"], r["converted"], r["total_users"]) == (1, 0, 0, 2)


def test_returning(spark):
    speech = {"U1": [100, 1520], "U2": [100, 1200, 1520], "U3": [1520], "U4": [1300, 1520]}
    r = cohorts.returning(*stream(spark, speech, 1420 + 0, [(1500, 1600)])).head()
    assert (r["returning_count"], r["total_users"], r["ratio"]) == (1, 4, 0.25)
    assert (r["gap_start"], r["gap_end"]) == (1500 - 1520 / 4, 1380)


def test_returning_boundary_and_empty(spark):
    for at, n in ((1145, 0), (1144, 1)):
        r = cohorts.returning(*stream(spark, {"U": [at, 1520]}, 1420, [(1500, 1600)]))
        gap = r.head()["gap_start"]
        r = cohorts.returning(*stream(spark, {"U": [int(gap) - (0 if n == 0 else 1), 1520]}, 1420, [(1500, 1600)])).head()
        assert r["returning_count"] == n
    r = cohorts.returning(*stream(spark, {}, 3000, [(1500, 1600)])).head()
    assert (r["total_users"], r["ratio"]) == (0, None)


def test_weights():
    w = MetricWeights()
    assert sum(w.effective().values()) == pytest.approx(1)
    assert (w.effective()["activation"], w.effective()["returning"]) == (pytest.approx(0.21), pytest.approx(0.08))
    assert sum(w.heat().values()) == pytest.approx(1)
    assert set(MetricWeights(0, 0).heat().values()) == {0.0}
    raw = MetricWeights.from_raw(0.5, {"density": 2, "burst": 2, "activation": 0, "length_mix": 0}, {"concentration": 0, "overlap": 0, "lifecycle": 0, "returning": 0})
    assert raw.effective()["density"] == 0.25 and raw.effective()["overlap"] == 0


def ticks(spark, rows):
    return spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], "stream_id string, tick bigint, d bigint, s double, activation double, short_ratio double, concentration double, overlap double")


def test_signals_and_heat(spark):
    t = ticks(spark, [(0, -1.0, None, None, None, None), (2, 1.0, 0.5, 0.5, 0.5, 0.5), (4, 2.0, 0.5, 0.5, 0.5, 0.5), (None,) * 6])
    s = {r["tick"]: r for r in scoring.signals(t).collect()}
    assert [s[i]["density"] for i in range(4)] == [0, 0.5, 1, None]
    assert [s[i]["burst"] for i in range(4)] == [0, 0.5, 1, None]
    h = {r["tick"]: r["heat"] for r in scoring.heat(scoring.signals(t)).collect()}
    w = MetricWeights().heat()
    assert h[3] is None
    assert h[0] == 0
    assert h[1] == pytest.approx(0.5)
    assert h[2] == pytest.approx(w["density"] + w["burst"] + 0.5 * (1 - w["density"] - w["burst"]))
    zero = scoring.signals(ticks(spark, [(0, 0.0, None, None, None, None)] * 2)).collect()
    assert {r["density"] for r in zero} == {0}
    assert {r["heat"] for r in scoring.heat(scoring.signals(t), MetricWeights(0, 0)).collect()} == {None}


def test_heat_scales_weights_to_what_is_defined(spark):
    s = spark.createDataFrame([("s", 0, None, 1.0, 0.0, 0.0, 0.0, 0.0)], "stream_id string, tick bigint, " + ", ".join(f"{m} double" for m in TICK_METRICS))
    w = MetricWeights().heat()
    assert scoring.heat(s).head()["heat"] == pytest.approx(w["burst"] / (1 - w["density"]))


def test_score_by_hand(spark):
    sig = spark.createDataFrame([("s", i, 1.0, 1.0, 0.5, 0.5, 0.5, 0.5) for i in range(3)], "stream_id string, tick bigint, " + ", ".join(f"{m} double" for m in TICK_METRICS))
    cand = spark.createDataFrame([("s", 0, 0, 2)], "stream_id string, cand_id bigint, t_start bigint, t_end bigint")
    life = spark.createDataFrame([("s", 0, 10, 10)], "stream_id string, cand_id bigint, converted bigint, total_users bigint")
    back = spark.createDataFrame([("s", 0, 0.5)], "stream_id string, cand_id bigint, ratio double")
    r = scoring.scored(cand, sig, scoring.heat(sig), life, back).head()
    assert r["score"] == pytest.approx(0.71) and r["grade"] == "A"
    assert scoring.grade_counts(scoring.scored(cand, sig, scoring.heat(sig), life, back)).head()[1:] == (0, 1, 0, 0)
    none = scoring.scored(cand, sig.where("tick > 90"), scoring.heat(sig.where("tick > 90")), life.where("false"), back.where("false")).head()
    assert (none["score"], none["grade"], none["heat_mean"]) == (0, "", 0)


def test_grades_and_overall(spark):
    scores = {0.80: "S", 0.75: "S", 0.70: "A", 0.60: "A", 0.50: "B", 0.45: "B", 0.35: "C", 0.30: "C", 0.29: ""}
    df = spark.createDataFrame([(k,) for k in scores], "x double").withColumn("g", grade(F.col("x")))
    assert {r["x"]: r["g"] for r in df.collect()} == scores
    h = spark.createDataFrame([("s", i, v) for i, v in enumerate([0.0, 0.5, 1.0])], "stream_id string, tick bigint, heat double")
    r = scoring.overall(h).head()
    assert (r["overall_score"], r["overall_grade"]) == (0.75, "S")
    r = scoring.overall(h.withColumn("heat", F.lit(None).cast("double"))).head()
    assert (r["overall_score"], r["overall_grade"]) == (0, "")
