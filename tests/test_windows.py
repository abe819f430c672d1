"""Sliding indicators against values worked out by hand and against a plain loop."""

import random

import pytest

from tideline.operators import prepare, windows
from tideline.params import Windows


def prepared(spark, rows, origin=0, stream="s"):
    """rows: (t seconds, uid, text)."""
    df = spark.createDataFrame([(stream, u, round(t * 1000), x) for t, u, x in rows], "stream_id string, uid string, ts_ms bigint, text string")
    origins = None if origin is None else spark.createDataFrame([(stream, origin)], "stream_id string, origin_ms bigint")
    rel = prepare.relative(df, 1000, origins)
    b = prepare.bounds(rel)
    return rel, b, prepare.grid(b)


def series(df, value):
    return {r["tick"]: r[value] for r in df.select("tick", value).collect()}


SAMPLE = [(0, "uid_a", "first"), (1, "uid_b", "second"), (1, "uid_c", "third"), (1, "uid_a", "fourth"), (20, "uid_b", "fifth")]


def test_grid_ends_as_defined(spark):
    for last, expected in ((20.0, 21), (20.5, 21), (20.501, 22)):
        _, _, grid = prepared(spark, [(0, "a", "x"), (last, "a", "x")])
        assert sorted(r["tick"] for r in grid.collect()) == list(range(expected + 1))


def test_density(spark):
    rel, b, grid = prepared(spark, SAMPLE)
    d = series(windows.density(rel, grid), "d")
    assert (d[5], d[10], d[20], d[21]) == (None, 4, 0, 1)
    row = b.head()
    assert (row["n_total"], row["dur_ms"]) == (5, 20_000)


def test_right_open_window(spark):
    rel, _, grid = prepared(spark, [(i, "a", "x") for i in range(4)])
    d = series(windows.density(rel, grid, Windows(window=3)), "d")
    assert (d[2], d[3], d[4]) == (None, 3, 3)
    rel, _, grid = prepared(spark, [(t, "a", "x") for t in (0, 5.5, 9.9, 15.0, 15.1)])
    d = series(windows.density(rel, grid), "d")
    assert (d[16], d[10]) == (3, 3)


def test_burst(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([0, 0, 4, 0, 0])], "stream_id string, tick bigint, d bigint")
    s = series(windows.burst(df), "s")
    assert s[0] is None
    assert [pytest.approx(x) for x in (4 / 3, 0, -4 / 3)] == [s[1], s[2], s[4]]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([None, None, 4, 2])], "stream_id string, tick bigint, d bigint")
    rows = {r["tick"]: r for r in windows.burst(df).collect()}
    assert rows[2]["s_rel"] == 4 and rows[3]["s_rel"] == 0.5
    assert rows[1]["s"] is None and rows[2]["s"] is not None


def test_activation(spark):
    rel, b, grid = prepared(spark, SAMPLE)
    a = series(windows.audience(rel, b, grid), "activation")
    assert (a[4], a[20], a[21]) == (None, None, 1)
    assert a[5] == a[10] == pytest.approx(1 / 3)
    pool = {r["uid"]: r["is_silent"] for r in windows.user_pool(rel, b).collect()}
    assert pool == {"uid_b": True}
    rel, b, _ = prepared(spark, [(0, "pre", "x"), (10, "sil", "x"), (11, "sil", "x"), *[(t, "act", "x") for t in (12, 13, 14)]])
    assert {r["uid"]: r["is_silent"] for r in windows.user_pool(rel, b).collect()} == {"sil": True, "act": False}


def test_length_mix(spark):
    rel, _, grid = prepared(spark, [(t, "a", "x" * n) for t, n in ((10, 5), (10.5, 6), (11, 15), (11.5, 16), (12, 3))])
    rows = {r["tick"]: r for r in windows.length_mix(windows.counts(rel, grid)).collect()}
    r = rows[13]
    assert [pytest.approx(x) for x in (0.4, 0.4, 0.2)] == [r["short_ratio"], r["mid_ratio"], r["long_ratio"]]
    assert rows[5]["short_ratio"] is None and rows[10]["short_ratio"] is None
    rel, _, grid = prepared(spark, [(20, "a", "x")])
    rows = series(windows.length_mix(windows.counts(rel, grid)), "short_ratio")
    assert (rows[5], rows[10], rows[21]) == (None, None, 1)


def test_concentration(spark):
    def share(rows, tick):
        rel, b, grid = prepared(spark, rows)
        return series(windows.audience(rel, b, grid), "concentration")[tick]

    base = [(15, "A", "x")] * 5 + [(15, "B", "x")] * 2 + [(15, "C", "x")] * 2
    assert share(base + [(15, u, "x") for u in "DEF"], 16) == pytest.approx(9 / 12)
    assert share(base + [(15, "D", "x")] * 2, 16) == pytest.approx(9 / 11)
    assert [share([(5, "A", "x"), (20, "B", "x")], t) for t in (15, 20, 21)] == [1, None, 1]
    assert share([(5, "A", "x"), (5, "A", "x"), (5, "B", "x"), (6, "C", "x"), (6, "D", "x"), (6, "E", "x"), (12, "Z", "x")], 10) == pytest.approx(4 / 6)


def test_overlap(spark):
    def at(rows, *ticks):
        rel, _, grid = prepared(spark, rows)
        o = series(windows.overlap(rel, grid), "overlap")
        return [o[t] for t in ticks]

    rows = [(0, "A", "x"), (1, "B", "x"), (32, "B", "x"), (33, "C", "x"), (70, "D", "x")]
    assert at(rows, 29, 30, 59, 60, 61, 62) == [None, None, None, pytest.approx(1 / 3), pytest.approx(1 / 2), 0]
    assert at([(0, "A", "x"), (100, "B", "x"), (101, "C", "x")], 61) == [None]
    assert at([(1, "A", "x"), (100, "B", "x")], 61) == [0]


def test_repeat_ratio(spark):
    def at(rows, *ticks):
        rel, _, grid = prepared(spark, rows)
        r = series(windows.repeat_ratio(rel, grid), "repeat_ratio")
        return [r[t] for t in ticks]

    flood = [(5 + i, f"u{i % 2}", "666") for i in range(10)] + [(20 + i, "v", f"text {i}") for i in range(10)]
    r = at(flood, *range(5), *range(25, 30))
    assert r[:5] == [None] * 5 and r[5:] == [0] * 5
    assert at([(t, "a", "x") for t in (5, 6, 7)], 8) == [1]
    assert at([(t, "a", "x") for t in (5, 6)], 7) == [0]
    assert at([(5, "a", " 666 "), (6, "a", "666"), (7, "a", "　666")], 8) == [1]


def test_spam(spark):
    rows = [(5 + i, f"u{i % 2}", "666") for i in range(10)] + [(100 + i, f"w{i}", "all rise") for i in range(10)]
    rel, b, grid = prepared(spark, rows)
    spam = series(windows.spam_mask(windows.repeat_ratio(rel, grid), windows.audience(rel, b, grid)), "spam")
    assert all(spam[t] for t in range(10, 16)) and spam[110] is False


def test_negative_times_count_only_in_activation(spark):
    rel, b, grid = prepared(spark, [(-3, "a", "x"), (2, "b", "x"), (30, "b", "x")], origin=0)
    assert {r["sec"] for r in rel.collect()} == {-3, 2, 30}
    assert series(windows.density(rel, grid), "d")[10] == 1
    out = windows.audience(rel, b.withColumn("dur_ms", b["dur_ms"] * 0), grid)
    assert series(out, "n_users")[0] == 1


def test_empty(spark):
    rel, b, grid = prepared(spark, [])
    for df in (windows.density(rel, grid), windows.burst(windows.density(rel, grid)), windows.audience(rel, b, grid), windows.overlap(rel, grid), windows.repeat_ratio(rel, grid)):
        assert df.count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_loop(spark, seed):
    r = random.Random(seed)
    rows = [(round(r.uniform(0, 120), 3), r.choice("abcdefgh"), r.choice(["x", "hello", "a longer text than that"])) for _ in range(250)]
    rows.append((0, "a", "x"))
    rel, b, grid = prepared(spark, rows)
    d, aud, ov = series(windows.density(rel, grid), "d"), {x["tick"]: x for x in windows.audience(rel, b, grid).collect()}, series(windows.overlap(rel, grid), "overlap")
    rep = series(windows.repeat_ratio(rel, grid), "repeat_ratio")
    for t in d:
        w = [x for x in rows if t - 10 <= int(x[0]) < t]
        assert d[t] == (len(w) if t >= 10 else None)
        counts = sorted((sum(x[1] == u for x in w) for u in {x[1] for x in w}), reverse=True)
        assert aud[t]["concentration"] == (pytest.approx(sum(counts[:3]) / len(w)) if w and t >= 10 else None)
        now, old = {x[1] for x in rows if t - 30 <= int(x[0]) < t}, {x[1] for x in rows if t - 60 <= int(x[0]) < t - 30}
        assert ov[t] == (pytest.approx(len(now & old) / len(now | old)) if t >= 60 and now | old else None)
        n = sum(sum(y[2] == x[2] for y in w) >= 3 for x in w)
        assert rep[t] == (pytest.approx(n / len(w)) if w else None)


def test_streams_apart_and_together(spark):
    one = [(0, "a", "x"), (5, "b", "y"), (30, "a", "x")]
    two = [(0, "q", "z"), (12, "q", "z"), (13, "r", "z")]
    df = spark.createDataFrame([(s, u, t * 1000, x) for s, rows in (("1", one), ("2", two)) for t, u, x in rows], "stream_id string, uid string, ts_ms bigint, text string")
    rel = prepare.relative(df)
    grid = prepare.grid(prepare.bounds(rel))
    both = {(r["stream_id"], r["tick"]): r["d"] for r in windows.density(rel, grid).collect()}
    for s, rows in (("1", one), ("2", two)):
        rel1, _, grid1 = prepared(spark, rows, stream=s)
        assert {k[1]: v for k, v in both.items() if k[0] == s} == series(windows.density(rel1, grid1), "d")


def test_blocks_change_nothing(spark):
    r = random.Random(3)
    density = spark.createDataFrame([(s, t, r.randrange(9) if t >= 10 else None) for s in "ab" for t in range(60)], "stream_id string, tick bigint, d bigint")
    whole = {(x["stream_id"], x["tick"]): (x["s"], x["s_rel"]) for x in windows.burst(density).collect()}
    for block in (1, 2, 3, 7):
        assert {(x["stream_id"], x["tick"]): (x["s"], x["s_rel"]) for x in windows.burst(density, block).collect()} == whole
    changes = spark.createDataFrame([(s, t, r.randrange(-3, 4)) for s in "ab" for t in range(0, 60, 3)], "stream_id string, tick bigint, x bigint")
    grid = density.select("stream_id", "tick")
    sums = [sorted(map(tuple, windows.accumulated(changes, grid, "x", block=b).collect())) for b in (5, 1000)]
    assert sums[0] == sums[1] and len(sums[0]) == 120


def test_overlap_of_random_streams(spark):
    r = random.Random(4)
    rows = [(s, f"u{r.randrange(6)}", r.randrange(0, 90)) for s in "ab" for _ in range(60)] + [("a", "u9", 89), ("b", "u9", 89)]
    rel = spark.createDataFrame(rows, "stream_id string, uid string, sec bigint")
    grid = spark.createDataFrame([(s, t) for s in "ab" for t in range(91)], "stream_id string, tick bigint")
    got = {(x["stream_id"], x["tick"]): (x["n_both"], x["n_any"]) for x in windows.overlap(rel, grid, Windows(overlap_window=7)).collect()}
    for s in "ab":
        for t in range(91):
            now, before = ({u for x, u, at in rows if x == s and lo <= at < hi} for lo, hi in ((t - 7, t), (t - 14, t - 7)))
            assert got[s, t] == ((len(now & before), len(now | before)) if t >= 14 and now | before else (None, None))
