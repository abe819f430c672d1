"""Clip planning, formats, the manifest, reports, the command line, views and streaming."""

import csv
import time

import pytest

from pyspark.sql import functions as F

from tideline.functions import text as fmt
from tideline.operators import clips, cutting
from tideline.params import Windows
from tideline.plans import cli, manifest, report
from tideline.plans.analysis import analyze
from tideline.streaming import live

ANCHOR = 1_000_000


def plan(spark, intervals, **more):
    rows = [("s", i, a, b, p, 9, "strong", b - a, "spike") for i, (a, b, p) in enumerate(intervals)]
    df = spark.createDataFrame(rows, "stream_id string, cand_id bigint, t_start bigint, t_end bigint, peak_t bigint, peak_density bigint, level string, duration bigint, shape string")
    return clips.plan(df, spark.createDataFrame([("s", ANCHOR)], "stream_id string, anchor_ms bigint"), **more)


def chunks(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], "stream_id string, path string, start_ms bigint, end_ms bigint")


def test_plan(spark):
    r = plan(spark, [(100, 120, 110)]).head()
    assert (r["abs_start_ms"] - ANCHOR, r["abs_end_ms"] - ANCHOR) == (90_000, 135_000)
    assert clips.segments(plan(spark, [(100, 120, 110)]), chunks(spark, [("v", 0, None)])).count() == 1
    r = plan(spark, [(100, 200, 150)], max_duration=60.0).head()
    assert (r["abs_start_ms"] - ANCHOR, r["abs_end_ms"] - ANCHOR) == (120_000, 180_000)
    r = plan(spark, [(100, 200, 150)], max_duration=0).head()
    assert r["abs_end_ms"] - r["abs_start_ms"] == 125_000
    assert [x["overlaps_previous"] for x in plan(spark, [(0, 10, 5), (30, 40, 35)]).orderBy("cand_id").collect()] == [False, True]


def test_segments_leave_holes(spark):
    both = chunks(spark, [("a", ANCHOR - 100_000, ANCHOR + 110_000), ("b", ANCHOR + 130_000, None)])
    rows = clips.segments(plan(spark, [(100, 130, 110)]), both).orderBy("segment_index").collect()
    assert [(r["source"], r["local_start_ms"], r["local_end_ms"], r["n_segments"]) for r in rows] == [("a", 190_000, 210_000, 2), ("b", 0, 15_000, 2)]
    assert clips.segments(plan(spark, [(100, 130, 110)]), both.where("false")).count() == 0


def test_chunk_ends(spark):
    rows = spark.createDataFrame([("s", "a", 0), ("s", "b", 600_000), ("s", "c", 4_200_001)], "stream_id string, path string, start_ms bigint")
    assert [r["end_ms"] for r in clips.chunk_ends(rows).orderBy("start_ms").collect()] == [600_000, None, None]


def test_formats(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).head()["x"]

    assert one(fmt.media_time(F.lit(3_661_234))) == "01:01:01.234"
    assert one(fmt.media_time(F.lit(90_000_000))) == "25:00:00.000"
    assert one(fmt.clock(F.lit(-5))) == "00:00:00"
    assert one(fmt.clock(F.lit(3_661.9))) == "01:01:01"
    assert one(fmt.safe_name(F.lit("a/b:c 直_-.é"))) == "a_b_c 直_-.é"
    assert one(fmt.recorder_start_ms(F.lit("1970-01-01-00-00-01-052-t.flv"))) == 1052
    assert one(fmt.recorder_start_ms(F.lit("1970-13-01-00-00-01-052-t.flv"))) is None
    assert one(fmt.recorder_start_ms(F.lit("other.flv"))) is None
    assert one(fmt.percent(F.lit(1), F.lit(8))) == "12%" and one(fmt.percent(F.lit(1), F.lit(0))) == "--"


def test_manifest(spark, tmp_path):
    parts = clips.segments(plan(spark, [(100, 130, 110)]), chunks(spark, [("a", ANCHOR - 100_000, ANCHOR + 110_000), ("b", ANCHOR + 130_000, None)])).withColumn("output", clips.output_name())
    path = tmp_path / "out" / "manifest.csv"
    for _ in range(2):
        assert manifest.write(clips.manifest(parts), str(path)) == 2
    assert path.read_bytes()[:3] == b"\xef\xbb\xbf"
    rows = list(csv.DictReader(path.open(encoding="utf-8-sig")))
    assert tuple(rows[0]) == clips.MANIFEST and rows[0]["t_start"] == "100.0" and rows[0]["status"] == ""
    assert rows[1]["output"].endswith("_p2.mp4") and rows[0]["grade"] == "strong"
    done = spark.createDataFrame([("s", 0, 0, "ok", 20.0)], "stream_id string, cand_id bigint, segment_index bigint, status string, actual_duration_s double")
    assert [r["status"] for r in clips.manifest(parts, done).orderBy("segment_index").collect()] == ["ok", ""]
    command = parts.select(clips.cut_command(fast=True).alias("c")).head()["c"]
    assert command[:2] == ["ffmpeg", "-y"] and "copy" in command


def test_cut_statuses(tmp_path):
    def program(name, body):
        f = tmp_path / name
        f.write_text(f"#!/bin/sh\n{body}\n")
        f.chmod(0o755)
        return str(f)

    good, bad = program("good", "exit 0"), program("bad", "echo no >&2; exit 3")
    silent = program("silent", 'echo \'{"format": {"duration": "2"}, "streams": [{"codec_type": "video"}]}\'')
    assert cutting.cut([bad, "x"], silent) == ("failed", None, None, None, "no")
    assert cutting.cut(["/no/such/cutter", "x"], silent)[0] == "failed"
    assert cutting.cut([good, "x"], silent) == ("invalid", 2.0, True, False, None)
    assert cutting.cut([good, "x"], bad)[0].startswith("probe-failed: ")


def messages(spark):
    rows = [("s", f"u{i % 7}", i * 1000, "hi there") for i in range(0, 400, 4)] + [("s", f"w{i}", (200 + i % 6) * 1000, "wow") for i in range(60)]
    return spark.createDataFrame(rows, "stream_id string, uid string, ts_ms bigint, text string")


def test_analysis_report_and_views(spark):
    a = analyze(messages(spark), cached=True)
    (c,) = a.candidates.collect()
    assert 200 <= c["peak_t"] <= 212 and c["level"] == "strong"
    s = a.scored.head()
    assert 0 <= s["score"] <= 1 and a.best().count() == 1
    for r in a.ticks.where("short_ratio is not null").select((F.col("short_ratio") + F.col("mid_ratio") + F.col("long_ratio")).alias("x")).collect():
        assert r["x"] == pytest.approx(1)
    text = report.text(a)
    for part in ("Overview", "1 Density", "8 Returning", "messages: 160"):
        assert part in text
    a.register("t_")
    assert spark.sql("select count(*) from t_candidates").head()[0] == 1
    assert report.headline(a).count() == report.details(a).count() == 1
    assert report.burst_ticks(a).count() >= 1


def test_command_line(spark, tmp_path, capsys):
    body = "".join(f'<d uid="{r["uid"]}" timestamp="{r["ts_ms"]}">{r["text"]}</d>' for r in messages(spark).collect())
    (tmp_path / "a.xml").write_text(f"<i><metadata><platform>P</platform><user_name>u</user_name></metadata>{body}</i>")
    (tmp_path / "1970-01-01-00-00-00-000-a.mp4").write_text("video")
    (tmp_path / "a.mp4").write_text("video")
    assert cli.main(["report", str(tmp_path / "a.xml")], spark) == 0
    assert "1 Density" in capsys.readouterr().out
    (tmp_path / "lost.xml").write_text("<i><metadata><platform>P</platform></metadata><d uid='u' timestamp='1'>x</d></i>")
    out = tmp_path / "out"
    clip = ["clips", str(tmp_path), "--out", str(out), "--anchor-ms", str(int(time.time() * 1000))]  # the recording begins when its file is made
    assert cli.main([*clip, "--dry-run"], spark) == 0
    said = capsys.readouterr()
    assert "lost.xml: no platform or streamer" in said.err and said.out.startswith("ffmpeg -y")
    assert [r["status"] for r in csv.DictReader((out / "manifest.csv").open(encoding="utf-8-sig"))] == ["dry-run"]
    # programs that stand in for the cutter and the probe
    cutter, prober = tmp_path / "cutter.sh", tmp_path / "prober.sh"
    cutter.write_text('#!/bin/sh\nfor last; do :; done\necho made > "$last"\n')
    prober.write_text('#!/bin/sh\necho \'{"format": {"duration": "7.5"}, "streams": [{"codec_type": "video"}, {"codec_type": "audio"}]}\'\n')
    for f in (cutter, prober):
        f.chmod(0o755)
    assert cli.main([*clip, "--ffmpeg", str(cutter), "--ffprobe", str(prober)], spark) == 0
    (row,) = csv.DictReader((out / "manifest.csv").open(encoding="utf-8-sig"))
    assert (row["status"], row["actual_duration_s"], row["has_video"], row["has_audio"]) == ("ok", "7.5", "true", "true")
    assert (out / row["output"]).read_text() == "made\n"
    assert cli.main(["report", str(tmp_path / "none.xml")], spark) == 1
    with pytest.raises(SystemExit):
        cli.main(["report", "--help"], spark)


def test_streaming_equals_batch(spark, tmp_path):
    start = 10**9  # a watermark begins at 0, so messages at 0 would be late
    rows = messages(spark).withColumn("ts_ms", F.col("ts_ms") + start)
    rows.unionByName(rows).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    w = Windows()
    got = {}
    for name, make in (("d", live.density_and_length), ("repeat_ratio", live.repeat_ratio), ("concentration", live.concentration)):
        q = make(live.without_repeats(live.timed(stream)), w).writeStream.format("memory").queryName(f"live_{name}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        got[name] = {(r["end_ms"] - start) // 1000: r[name] for r in spark.table(f"live_{name}").collect()}
        assert got[name]
    a = analyze(rows, dedup=True, cached=True)
    d = {r["tick"]: r["d"] for r in a.density.collect()}
    rep = {r["tick"]: r["repeat_ratio"] for r in a.repeat.collect()}
    con = {r["tick"]: r["concentration"] for r in a.audience.collect()}
    for mine, theirs in ((got["d"], d), (got["repeat_ratio"], rep), (got["concentration"], con)):
        same = [t for t in mine if t >= 10 and t in theirs]
        assert len(same) > 200
        for t in same:
            assert mine[t] == pytest.approx(theirs[t])
