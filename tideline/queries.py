"""Queries of the engine's operators on the driver's events table, and the same results as DuckDB SQL.

A tick is a minute, as the table spans thirty days, but for the queries that end in _seconds, which have the default
of a second. Chunks of recordings are derived from a user's events by the hour, chat files by the day.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import text as fmt
from tideline.operators import clips, detect, prepare, selection
from tideline.operators import sessions as _sessions_op
from tideline.params import DetectionParams, MetricWeights, Windows
from tideline.plans import report
from tideline.plans.analysis import Analysis
from tideline.sources import chat_xml, events, media

TICK_MS = 60_000
W = Windows(tick_ms=TICK_MS)


def _a(spark: SparkSession, sf_dir: str, by_day: bool = False, **more) -> Analysis:
    return Analysis(events.read(spark, sf_dir, by_day), windows=W, **more)


def _r6(df: DataFrame, *names: str) -> DataFrame:
    return df.select([(F.round(F.col(c), 6) + 0.0).alias(c) if c in names else F.col(c) for c in df.columns])


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording chunk for each user and hour with events: made at its first, last changed at its last."""
    e = events.read(spark, sf_dir)
    hour = F.floor(F.col("ts_ms") / 3_600_000)
    rows = e.groupBy("uid", hour.alias("h")).agg(F.min("ts_ms").alias("created_ms"), F.max("ts_ms").alias("modified_ms"))
    return rows.select(
        F.concat(F.lit("chunk-"), "uid", F.lit("-"), F.col("h").cast("string")).alias("path"), "created_ms", "modified_ms", F.when(F.col("uid").cast("bigint") % 2 == 0, "even").otherwise("odd").alias("platform"),
        F.col("uid").alias("user_name"), F.concat(F.lit("title "), (F.floor(F.col("h") / 24) % 3).cast("string")).alias("room_title"),
    )


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of the whole stream, one for every hour of the first user mod 7 but some, so that there are holes."""
    e = events.read(spark, sf_dir).select("stream_id", F.floor(F.col("ts_ms") / 3_600_000).alias("h")).distinct().where("h % 7 <> 3")
    return clips.chunk_ends(e.select("stream_id", F.concat(F.lit("video-"), F.col("h").cast("string")).alias("path"), (F.col("h") * 3_600_000).alias("start_ms")), 3_600_000)


def density(s, d):
    return _a(s, d).density


def density_by_day(s, d):
    return _a(s, d, by_day=True).density


def burst(s, d):
    return _r6(_a(s, d).burst, "s", "s_rel")


def length_mix(s, d):
    return _r6(_a(s, d).length_mix, "short_ratio", "mid_ratio", "long_ratio")


def activation(s, d):
    return _a(s, d).audience.select("stream_id", "tick", "n_silent", "n_users", "activation")


def concentration(s, d):
    return _a(s, d).audience.select("stream_id", "tick", "top3", "concentration")


def overlap(s, d):
    return _a(s, d).overlap


def repeat_ratio(s, d):
    return _a(s, d).repeat


def spam_mask(s, d):
    return _a(s, d).spam


def user_pool(s, d):
    from tideline.operators.windows import user_pool as pool

    a = _a(s, d)
    return pool(a.rel, a.bounds, W)


def _thresholds(mode):
    def run(s, d):
        return _r6(_a(s, d, detection=DetectionParams(threshold_mode=mode)).thresholds, "mu", "sigma", "candidate_threshold", "strong_threshold")

    return run


def runs(s, d):
    a = _a(s, d)
    return detect.runs(detect.above(a.density, a.thresholds))


def candidates(s, d):
    return _a(s, d, cached=True).candidates


def candidates_time_only(s, d):
    return _a(s, d, detection=DetectionParams(use_merge_overlap=False), cached=True).candidates


def candidates_by_day(s, d):
    return _a(s, d, by_day=True, cached=True).candidates


def candidates_explicit(s, d):
    return _a(s, d, detection=DetectionParams(candidate_threshold=4.0, strong_threshold=7.0, min_duration=0, spam_filter=False), cached=True).candidates


def lifecycle(s, d):
    return _a(s, d, cached=True).lifecycle


def returning(s, d):
    return _a(s, d, cached=True).returning


def signals(s, d):
    return _r6(_a(s, d, cached=True).signals, "density", "burst", "activation", "length_mix", "concentration", "overlap")


def heat(s, d):
    return _a(s, d, cached=True).heat


def scored(s, d):
    return _r6(_a(s, d, cached=True).scored, "score", "heat_mean", "heat_peak", "converted_ratio", "returning_ratio")


def overall(s, d):
    return _r6(_a(s, d, cached=True).overall, "overall_score")


def grade_counts(s, d):
    return _a(s, d, cached=True).grade_counts


def best_interval(s, d):
    return _a(s, d, cached=True).best().select("stream_id", "cand_id", "t_start", "t_end", "grade")


def sessions(s, d):
    return _sessions_op.sessions(_chunks(s, d)).drop("chunks")


def session_chunks(s, d):
    return _sessions_op.clustered(_chunks(s, d)).select("path", "platform", "user_name", "session_no")


def dedup_records(s, d):
    e = events.read(s, d)
    return prepare.deduplicated(e.unionByName(e.where("ts_ms % 5 = 0"))).select("ts_ms", "uid", "text")


def interval_filter(s, d):
    return prepare.between_relative(events.read(s, d), 86_400, 172_800).select("ts_ms", "uid", "text")


def _files(s, d):
    """Chat files of each user and day as bytes (path, content), some of them damaged: cut off, with control signs, or broken."""
    e = events.read(s, d).withColumn("day", F.floor(F.col("ts_ms") / 86_400_000))
    kind = (F.col("uid").cast("bigint") * 31 + F.col("day")) % 13
    line = F.concat(F.lit('<d p="1" user="u" uid="'), "uid", F.lit('" timestamp="'), F.col("ts_ms").cast("string"), F.lit('">'), "text", F.lit("</d>\n"))
    rows = e.groupBy("uid", "day").agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("body")).withColumn("kind", kind)
    named = F.when(F.col("uid").cast("bigint") % 10 != 0, F.concat(F.lit("<user_name>"), "uid", F.lit("</user_name>"))).otherwise("")
    head = F.concat(F.lit("<i><metadata><platform>live</platform>"), named, F.lit("<room_title>day "), F.col("day").cast("string"), F.lit("</room_title></metadata>\n"))
    damage = F.when(F.col("kind") == 0, "a < b").when(F.col("kind") == 2, '<d uid="\x01x">no time</d>').otherwise('<d uid="x">no time</d>')
    content = F.concat(head, damage, "body", F.when(F.col("kind") == 1, "").otherwise("</i>"))
    return rows.select(F.concat(F.lit("chat-"), "uid", F.lit("-"), F.col("day").cast("string"), F.lit(".xml")).alias("path"), content.cast("binary").alias("content"))


def xml_messages(s, d):
    return chat_xml.messages(chat_xml.contents(_files(s, d))).select("path", "uid", "ts_ms", "text")


def xml_files(s, d):
    return chat_xml.contents(_files(s, d)).select("path", "status", "reason", F.size("messages").cast("bigint").alias("n_messages")).withColumn("reason", F.when(F.col("status") != "skipped", F.col("reason")))


def xml_metadata(s, d):
    return chat_xml.contents(_files(s, d)).select("path", *[F.col("metadata").getItem(k).alias(k) for k in ("platform", "user_name", "room_title")])


def _file_chunks(s, d):
    read = chat_xml.contents(_files(s, d))
    day = F.regexp_extract("path", "-(\\d+)\\.xml$", 1).cast("bigint")
    return chat_xml.chunk_table(read, read.select("path", (day * 86_400_000).alias("created_ms"), (day * 86_400_000 + 86_000_000).alias("modified_ms")))


def unclassified(s, d):
    return _sessions_op.classified(_file_chunks(s, d))[1].select("path", "platform")


def xml_sessions(s, d):
    return _sessions_op.sessions(_sessions_op.classified(_file_chunks(s, d))[0]).drop("chunks")


def paired_videos(s, d):
    """Chat files of each user and hour beside recordings of the same name, of the same time, of both kinds, or none."""
    e = events.read(s, d).select("uid", F.floor(F.col("ts_ms") / 3_600_000).alias("h")).distinct().withColumn("k", (F.col("uid").cast("bigint") + F.col("h")) % 5)
    folder = F.concat(F.lit("/rec/"), "uid", F.lit("/"))
    at = F.concat(F.date_format(F.timestamp_millis(F.col("h") * 3_600_000), "yyyy-MM-dd-HH-mm-ss"), F.lit("-000"))
    one = F.concat(folder, at, F.lit("-chat"))
    names = F.when(F.col("k") == 0, F.array(F.concat(one, F.lit(".flv")))).when(F.col("k") == 1, F.array(F.concat(folder, at, F.lit("-video.MP4"))))
    names = names.when(F.col("k") == 2, F.array(F.concat(folder, at, F.lit("-a.ts")), F.concat(folder, at, F.lit("-b.mkv")))).when(F.col("k") == 3, F.array(F.concat(one, F.lit(".flv")), F.concat(folder, at, F.lit("-c.flv"))))
    return media.paired(e.select(F.concat(one, F.lit(".xml")).alias("path")), e.where("k < 4").select(F.explode(names).alias("path")))


def choices(s, d):
    return selection.choices(_sessions_op.sessions(_chunks(s, d)))


def interval_preview(s, d):
    return selection.preview_counts(events.read(s, d, by_day=True), 3_600, 7_200)


def _seconds(s, d, **more):
    """The default grid: ticks of a second, windows of ten."""
    return Analysis(events.read(s, d), **more)


def density_seconds(s, d):
    return _seconds(s, d).density.where("d > 0")


def activation_seconds(s, d):
    return _seconds(s, d).audience.where("n_users is not null").select("stream_id", "tick", "n_silent", "n_users", "activation")


def overlap_seconds(s, d):
    return _seconds(s, d).overlap.where("n_any is not null")


def candidates_seconds(s, d):
    return _seconds(s, d, cached=True).candidates


def chunk_videos(s, d):
    return _videos(s, d)


def _clips(s, d):
    a = _a(s, d, cached=True)
    anchors = a.messages.groupBy("stream_id").agg(F.min("ts_ms").alias("anchor_ms"))
    return clips.plan(a.candidates, anchors, max_duration=900.0, tick_ms=TICK_MS)


def clip_plan(s, d):
    return _clips(s, d).select("stream_id", "cand_id", "abs_start_ms", "abs_end_ms", "overlaps_previous")


def clip_segments(s, d):
    return clips.segments(_clips(s, d), _videos(s, d)).select("cand_id", "source", "local_start_ms", "local_end_ms", "segment_index", "n_segments")


def clip_manifest(s, d):
    parts = clips.segments(_clips(s, d), _videos(s, d)).withColumn("output", clips.output_name())
    return clips.manifest(parts)


def time_formats(s, d):
    e = events.read(s, d).select("ts_ms", "text")
    return e.select("ts_ms", fmt.media_time(F.col("ts_ms") % 400_000_000).alias("media"), fmt.clock(F.col("ts_ms") % 400_000_000 / 1000).alias("clock"), fmt.safe_name(F.col("text")).alias("safe"))


REPORTS = {
    "report_overview": (report.overview, ("duration_s", "duration_min")),
    "report_density": (report.density, ("mu", "sigma")),
    "report_levels": (report.levels, ()),
    "report_burst": (report.burst, ("s_mean", "s_sd", "s_max", "s_rel_max")),
    "report_activation": (report.activation, ("observation", "activation_mean", "activation_max")),
    "report_length": (report.length_mix, ("short_mean", "mid_mean", "long_mean")),
    "report_concentration": (report.concentration, ("concentration_mean", "concentration_max")),
    "report_overlap": (report.overlap, ("overlap_mean",)),
    "report_interval_means": (report.interval_means, ("activation_mean", "short_ratio_mean", "long_ratio_mean", "concentration_mean")),
    "report_spam": (report.spam_ticks, ()),
    "report_lifecycle": (report.lifecycle_lines, ()),
    "report_returning": (report.returning_lines, ("ratio",)),
    "report_headline": (report.headline, ("duration_s", "duration_min", "overall_score", "best_score")),
    "report_details": (report.details, ("score", "heat_mean", "heat_peak", "converted_ratio", "returning_ratio", "ratio")),
    "report_burst_ticks": (report.burst_ticks, ("s",)),
}


def _report(function, names):
    return lambda s, d: _r6(function(_a(s, d, cached=True)), *names)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        density, density_by_day, burst, length_mix, activation, concentration, overlap, repeat_ratio, spam_mask, user_pool, runs, candidates, candidates_time_only, candidates_by_day, candidates_explicit,
        lifecycle, returning, signals, heat, scored, overall, grade_counts, best_interval, sessions, session_chunks, dedup_records, interval_filter, interval_preview, choices, xml_messages, xml_files, xml_metadata, xml_sessions, unclassified, paired_videos, density_seconds, activation_seconds, overlap_seconds, candidates_seconds, chunk_videos, clip_plan, clip_segments, clip_manifest, time_formats,
    )
    return {f.__name__: f for f in own} | {f"thresholds_{m}": _thresholds(m) for m in ("sigma", "robust", "percentile")} | {k: _report(f, n) for k, (f, n) in REPORTS.items()}


# -- the same in SQL -------------------------------------------------------------------------------------------------


def _base(stream: str = "'all'", tick: int = TICK_MS) -> str:
    return f"""
WITH msg AS (SELECT {stream} AS stream_id, CAST(user_id AS VARCHAR) AS uid, (epoch_us(ts) // 1000) AS ts_ms,
        CASE WHEN value < 50 THEN event_type ELSE event_type || ' ' || props END AS text FROM events),
bnd AS (SELECT stream_id, min(ts_ms) AS origin, max(ts_ms) - min(ts_ms) AS dur, count(*) AS n_total FROM msg GROUP BY 1),
m AS (SELECT msg.stream_id, uid, ts_ms, ts_ms - origin AS rel, (ts_ms - origin) // {tick} AS sec, length(text) AS len, trim(text) AS norm FROM msg JOIN bnd USING (stream_id)),
grid AS (SELECT stream_id, unnest(range(0, (2 * dur + {3 * tick - 1}) // {2 * tick} + 1)) AS tick FROM bnd),
sec AS (SELECT stream_id, sec, count(*) AS n, count(*) FILTER (len <= 5) AS ns, count(*) FILTER (len > 15) AS nl FROM m GROUP BY 1, 2),
scat AS (SELECT stream_id, unnest(range(sec + 1, sec + 11)) AS tick, n, ns, nl FROM sec),
cnt AS (SELECT g.stream_id, g.tick, CASE WHEN g.tick >= 10 THEN CAST(coalesce(sum(n), 0) AS BIGINT) END AS d,
        CASE WHEN g.tick >= 10 THEN CAST(coalesce(sum(ns), 0) AS BIGINT) END AS ds, CASE WHEN g.tick >= 10 THEN CAST(coalesce(sum(nl), 0) AS BIGINT) END AS dl
        FROM grid g LEFT JOIN scat USING (stream_id, tick) GROUP BY 1, 2),
mom AS (SELECT stream_id, count(d) AS n, CAST(sum(d) AS BIGINT) AS s1, CAST(sum(d * d) AS BIGINT) AS s2 FROM cnt GROUP BY 1),
stat AS (SELECT stream_id, n, s1 / n AS mu, sqrt(n * s2 - s1 * s1) / n AS sigma, sqrt(n * s2 - s1 * s1) AS root FROM mom),
sm AS (SELECT stream_id, tick, d, sum(d) OVER w3 / count(d) OVER w3 AS sm, lag(d) OVER w AS d0 FROM cnt
       WINDOW w AS (PARTITION BY stream_id ORDER BY tick), w3 AS (PARTITION BY stream_id ORDER BY tick ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
bur AS (SELECT stream_id, tick, d, sm - lag(sm) OVER (PARTITION BY stream_id ORDER BY tick) AS s, d / greatest(coalesce(d0, 1), 1) AS s_rel FROM sm),
len AS (SELECT stream_id, tick, ds / nullif(d, 0) AS short_ratio, 1 - ds / nullif(d, 0) - dl / nullif(d, 0) AS mid_ratio, dl / nullif(d, 0) AS long_ratio FROM cnt),
pool AS (SELECT m.stream_id, uid, count(*) <= 2 AS is_silent FROM m JOIN bnd USING (stream_id) WHERE 4 * rel >= least({300 * tick * 4}, dur) GROUP BY 1, 2),
ut AS (SELECT stream_id, tick, uid, count(*) AS c FROM (SELECT stream_id, uid, unnest(range(sec + 1, sec + 11)) AS tick FROM m) GROUP BY 1, 2, 3),
utr AS (SELECT ut.*, coalesce(is_silent, false) AS silent, row_number() OVER (PARTITION BY ut.stream_id, tick ORDER BY c DESC, uid) AS r FROM ut LEFT JOIN pool USING (stream_id, uid)),
aud0 AS (SELECT stream_id, tick, count(*) AS nu, count(*) FILTER (silent) AS nsil, CAST(sum(c) AS BIGINT) AS nm, CAST(sum(c) FILTER (r <= 3) AS BIGINT) AS top FROM utr GROUP BY 1, 2),
aud AS (SELECT g.stream_id, g.tick, CASE WHEN {4 * tick} * g.tick >= least({300 * tick * 4}, dur) THEN nsil END AS n_silent,
        CASE WHEN {4 * tick} * g.tick >= least({300 * tick * 4}, dur) THEN nu END AS n_users,
        CASE WHEN {4 * tick} * g.tick >= least({300 * tick * 4}, dur) THEN nsil / nu END AS activation,
        CASE WHEN g.tick >= 10 THEN top END AS top3, CASE WHEN g.tick >= 10 THEN top / nm END AS concentration
        FROM grid g JOIN bnd USING (stream_id) LEFT JOIN aud0 USING (stream_id, tick)),
ov0 AS (SELECT stream_id, tick, uid, bool_or(a <= 30) AS now, bool_or(a > 30) AS bef FROM (SELECT stream_id, uid, a, sec + a AS tick FROM (SELECT DISTINCT stream_id, sec, uid FROM m), (SELECT unnest(range(1, 61)) AS a)) GROUP BY 1, 2, 3),
ov AS (SELECT g.stream_id, g.tick, CASE WHEN g.tick >= 60 THEN nb END AS n_both, CASE WHEN g.tick >= 60 THEN na END AS n_any, CASE WHEN g.tick >= 60 THEN nb / na END AS overlap
       FROM grid g LEFT JOIN (SELECT stream_id, tick, count(*) FILTER (now AND bef) AS nb, count(*) AS na FROM ov0 GROUP BY 1, 2) USING (stream_id, tick)),
rp0 AS (SELECT stream_id, tick, norm, count(*) AS c FROM (SELECT stream_id, norm, unnest(range(sec + 1, sec + 11)) AS tick FROM m) GROUP BY 1, 2, 3),
rp AS (SELECT g.stream_id, g.tick, nr AS n_repeated, nw AS n_window, nr / nw AS repeat_ratio FROM grid g
       LEFT JOIN (SELECT stream_id, tick, CAST(sum(CASE WHEN c >= 3 THEN c ELSE 0 END) AS BIGINT) AS nr, CAST(sum(c) AS BIGINT) AS nw FROM rp0 GROUP BY 1, 2) USING (stream_id, tick)),
spm AS (SELECT stream_id, tick, coalesce(repeat_ratio >= 0.8 AND concentration >= 0.6, false) AS spam FROM rp JOIN aud USING (stream_id, tick))
"""


def _cands(cut: str = "mu + 2 * root / n", strong: str = "mu + 3 * root / n", spam: bool = True, by_overlap: bool = True, least: int = 3, tick: int = TICK_MS) -> str:
    return f""",
thr AS (SELECT stream_id, {cut} AS tc, {strong} AS ts FROM stat WHERE sigma > 0),
hot AS (SELECT cnt.stream_id, cnt.tick FROM cnt JOIN thr USING (stream_id) JOIN spm USING (stream_id, tick) WHERE d > tc {"AND NOT spam" if spam else ""}),
run AS (SELECT stream_id, min(tick) AS a, max(tick) AS b FROM (SELECT *, tick - row_number() OVER (PARTITION BY stream_id ORDER BY tick) AS k FROM hot) GROUP BY stream_id, k),
jn AS (SELECT run.*, CASE WHEN a - lag(b) OVER (PARTITION BY run.stream_id ORDER BY a) < 30 {"AND coalesce(overlap >= 0.5, true)" if by_overlap else ""} THEN 0 ELSE 1 END AS o
       FROM run LEFT JOIN ov ON ov.stream_id = run.stream_id AND ov.tick = run.a),
sp AS (SELECT stream_id, min(a) AS t_start, max(b) AS t_end FROM (SELECT *, sum(o) OVER (PARTITION BY stream_id ORDER BY a) AS k FROM jn) GROUP BY stream_id, k HAVING max(b) - min(a) >= {least}),
pk AS (SELECT sp.stream_id, t_start, t_end, max(d) AS peak_density FROM sp JOIN cnt ON cnt.stream_id = sp.stream_id AND tick BETWEEN t_start AND t_end GROUP BY 1, 2, 3),
cd AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY peak_t, t_start) - 1 AS cand_id, t_start, t_end, peak_t, peak_density,
       CASE WHEN peak_density > ts THEN 'strong' ELSE 'candidate' END AS level, t_end - t_start AS duration,
       CASE WHEN (t_end - t_start) * {tick // 1000} < 60 THEN 'spike' WHEN (t_end - t_start) * {tick // 1000} < 180 THEN 'short' WHEN (t_end - t_start) * {tick // 1000} < 600 THEN 'plateau' ELSE 'long' END AS shape
       FROM (SELECT pk.*, (SELECT min(tick) FROM cnt WHERE cnt.stream_id = pk.stream_id AND tick BETWEEN t_start AND t_end AND d = peak_density) AS peak_t FROM pk) JOIN thr USING (stream_id))
"""


_T = TICK_MS
_COHORTS = f""",
cu AS (SELECT DISTINCT cd.stream_id, cand_id, t_start, t_end, uid FROM cd JOIN m ON m.stream_id = cd.stream_id AND m.rel BETWEEN t_start * {_T} AND t_end * {_T}),
sn AS (SELECT stream_id, uid, 4 * min(rel) AS f, 4 * max(rel) AS l FROM m GROUP BY 1, 2),
lf0 AS (SELECT cu.stream_id, cand_id, f, l, 4 * t_start * {_T} AS a4, 4 * t_end * {_T} AS b4, least({300 * _T * 4}, dur) AS oa, least({120 * _T * 4}, dur) AS ob, least({600 * _T * 4}, dur) AS oc
        FROM cu JOIN sn USING (stream_id, uid) JOIN bnd USING (stream_id)),
lf1 AS (SELECT stream_id, cand_id, CASE WHEN f >= a4 AND l <= b4 THEN 1 WHEN f < a4 - oa AND l > b4 + oa THEN 2 WHEN f >= a4 - ob AND f <= b4 AND l > b4 + oc THEN 3 END AS k FROM lf0),
lf AS (SELECT cd.stream_id, cd.cand_id, cd.t_start, cd.t_end, count(*) FILTER (k = 1) AS instant, count(*) FILTER (k = 2) AS persistent, count(*) FILTER (k = 3) AS converted, count(lf1.cand_id) AS total_users,
       least({300 * _T * 4}, any_value(dur)) / {4 * _T} AS offset_a, least({120 * _T * 4}, any_value(dur)) / {4 * _T} AS offset_b, least({600 * _T * 4}, any_value(dur)) / {4 * _T} AS offset_c
       FROM cd JOIN bnd USING (stream_id) LEFT JOIN lf1 ON lf1.stream_id = cd.stream_id AND lf1.cand_id = cd.cand_id GROUP BY 1, 2, 3, 4),
rt0 AS (SELECT cu.stream_id, cand_id, uid, bool_or(4 * rel < 4 * t_start * {_T} - least({1200 * _T * 4}, dur)) AS bef,
        bool_or(4 * rel >= 4 * t_start * {_T} - least({1200 * _T * 4}, dur) AND 4 * rel < 4 * t_start * {_T} - least({120 * _T * 4}, dur)) AS ins
        FROM cu JOIN bnd USING (stream_id) JOIN m USING (stream_id, uid) GROUP BY 1, 2, 3),
rt AS (SELECT cd.stream_id, cd.cand_id, cd.t_start, cd.t_end, count(*) FILTER (bef AND NOT ins) AS returning_count, count(rt0.uid) AS total_users,
       count(*) FILTER (bef AND NOT ins) / nullif(count(rt0.uid), 0) AS ratio,
       (4 * cd.t_start * {_T} - least({1200 * _T * 4}, any_value(dur))) / {4 * _T} AS gap_start, (4 * cd.t_start * {_T} - least({120 * _T * 4}, any_value(dur))) / {4 * _T} AS gap_end
       FROM cd JOIN bnd USING (stream_id) LEFT JOIN rt0 ON rt0.stream_id = cd.stream_id AND rt0.cand_id = cd.cand_id GROUP BY 1, 2, 3, 4)
"""


def _mean(values: dict[str, str], weights: dict[str, float]) -> str:
    up = " + ".join(f"coalesce({v} * CAST({weights[k]!r} AS DOUBLE), 0)" for k, v in values.items())
    down = " + ".join(f"CASE WHEN {v} IS NOT NULL THEN CAST({weights[k]!r} AS DOUBLE) ELSE 0 END" for k, v in values.items())
    return f"({up}) / nullif({down}, 0)"


_TICKS = ("density", "burst", "activation", "length_mix", "concentration", "overlap")
_SIGNALS = f""",
mx AS (SELECT stream_id, max(d) AS md, max(greatest(s, 0)) FILTER (s IS NOT NULL) AS ms FROM bur GROUP BY 1),
sg AS (SELECT b.stream_id, b.tick, CASE WHEN md = 0 THEN d * 0.0 ELSE d / md END AS density,
       CASE WHEN s IS NULL THEN NULL WHEN ms = 0 THEN 0.0 ELSE greatest(s, 0) / ms END AS burst, activation, short_ratio AS length_mix, 1 - concentration AS concentration, 1 - overlap AS overlap
       FROM bur b JOIN mx USING (stream_id) JOIN aud USING (stream_id, tick) JOIN len USING (stream_id, tick) JOIN ov USING (stream_id, tick)),
ht AS (SELECT stream_id, tick, {_mean({k: k for k in _TICKS}, MetricWeights().heat())} AS heat FROM sg)
"""

_SCORED = f""",
cs AS (SELECT cd.stream_id, cd.cand_id, max(density) AS density, max(burst) AS burst, avg(activation) AS activation, avg(length_mix) AS length_mix, avg(concentration) AS concentration, avg(overlap) AS overlap,
       avg(heat) AS hm, max(heat) AS hp FROM cd JOIN sg ON sg.stream_id = cd.stream_id AND sg.tick BETWEEN t_start AND t_end JOIN ht ON ht.stream_id = sg.stream_id AND ht.tick = sg.tick GROUP BY 1, 2),
sc0 AS (SELECT cd.*, cs.* EXCLUDE (stream_id, cand_id), coalesce(converted / nullif(lf.total_users, 0), 0) AS lifecycle, coalesce(rt.ratio, 0) AS ret
        FROM cd JOIN cs USING (stream_id, cand_id) JOIN lf USING (stream_id, cand_id) JOIN rt USING (stream_id, cand_id)),
sc AS (SELECT *, least(greatest(coalesce({_mean({k: k for k in (*_TICKS, "lifecycle")} | {"returning": "ret"}, MetricWeights().effective())}, 0), 0), 1) AS score FROM sc0),
scg AS (SELECT stream_id, cand_id, t_start, t_end, peak_t, peak_density, level, duration, shape, score,
        CASE WHEN score >= 0.75 THEN 'S' WHEN score >= 0.6 THEN 'A' WHEN score >= 0.45 THEN 'B' WHEN score >= 0.3 THEN 'C' ELSE '' END AS grade,
        coalesce(hm, 0) AS heat_mean, coalesce(hp, 0) AS heat_peak, lifecycle AS converted_ratio, ret AS returning_ratio FROM sc)
"""

_CHUNKS = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS uid, (epoch_us(ts) // 1000) AS ts_ms FROM events),
ch AS (SELECT 'chunk-' || uid || '-' || CAST(ts_ms // 3600000 AS VARCHAR) AS path, min(ts_ms) AS created_ms, max(ts_ms) AS modified_ms, CASE WHEN CAST(uid AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS platform,
       uid AS user_name, 'title ' || CAST((ts_ms // 3600000 // 24) % 3 AS VARCHAR) AS title FROM e GROUP BY uid, ts_ms // 3600000),
op AS (SELECT *, CASE WHEN created_ms - lag(modified_ms) OVER w <= 3600000 AND title = lag(title) OVER w THEN 0 ELSE 1 END AS o FROM ch WINDOW w AS (PARTITION BY platform, user_name ORDER BY created_ms, path)),
cl AS (SELECT *, CAST(sum(o) OVER (PARTITION BY platform, user_name ORDER BY created_ms, path) AS BIGINT) AS session_no FROM op)
"""

_VIDEOS = """vd AS (SELECT 'all' AS stream_id, 'video-' || CAST(h AS VARCHAR) AS path, h * 3600000 AS start_ms, CASE WHEN lead(h) OVER (ORDER BY h) - h <= 1 THEN lead(h) OVER (ORDER BY h) * 3600000 END AS end_ms
       FROM (SELECT DISTINCT (epoch_us(ts) // 1000) // 3600000 AS h FROM events) WHERE h % 7 <> 3)"""

_CLIPS = f""",
cp0 AS (SELECT cd.*, origin + t_start * {_T} - 10000 AS s0, origin + t_end * {_T} + 15000 AS e0, origin + peak_t * {_T} AS p0 FROM cd JOIN bnd USING (stream_id)),
cp1 AS (SELECT *, CASE WHEN e0 - s0 > 900000 THEN greatest(s0, p0 - 450000) ELSE s0 END AS abs_start_ms, CASE WHEN e0 - s0 > 900000 THEN least(e0, p0 + 450000) ELSE e0 END AS abs_end_ms FROM cp0),
cp AS (SELECT *, coalesce(abs_start_ms < lag(abs_end_ms) OVER (PARTITION BY stream_id ORDER BY cand_id), false) AS overlaps_previous FROM cp1)
"""

_SEGMENTS = f"""{_CLIPS}, {_VIDEOS},
sgm0 AS (SELECT cp.*, path AS source, start_ms, greatest(abs_start_ms, start_ms) AS lo, least(abs_end_ms, coalesce(end_ms, abs_end_ms)) AS hi FROM cp JOIN vd USING (stream_id)),
sgm AS (SELECT *, lo - start_ms AS local_start_ms, hi - start_ms AS local_end_ms, row_number() OVER (PARTITION BY stream_id, cand_id ORDER BY start_ms, source) - 1 AS segment_index,
        count(*) OVER (PARTITION BY stream_id, cand_id) AS n_segments FROM sgm0 WHERE lo < hi)
"""


_FILES = """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS uid, (epoch_us(ts) // 1000) AS ts_ms, CASE WHEN value < 50 THEN event_type ELSE event_type || ' ' || props END AS text FROM events),
xf AS (SELECT uid, ts_ms // 86400000 AS day, (CAST(uid AS BIGINT) * 31 + ts_ms // 86400000) % 13 AS kind, 'chat-' || uid || '-' || CAST(ts_ms // 86400000 AS VARCHAR) || '.xml' AS path, ts_ms, text FROM e),
xg AS (SELECT path, uid, day, kind, count(*) AS n FROM xf GROUP BY 1, 2, 3, 4)
"""


def _r(*names: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in names)


def _first(value: str) -> str:
    return f"min(tick) FILTER ({value} = (SELECT max({value}) FROM t)) AS {value}_peak_t"


def oracle_sql() -> dict[str, str]:
    b, day = _base(), _base("CAST(CAST(ts AS DATE) AS VARCHAR)")
    sec = _base(tick=1000)
    c = b + _cands()
    full = c + _COHORTS + _SIGNALS + _SCORED
    thr = "SELECT stream_id, n, {} FROM {}"
    return {
        "density": b + "SELECT stream_id, tick, d FROM cnt",
        "density_by_day": day + "SELECT stream_id, tick, d FROM cnt",
        "burst": b + f"SELECT stream_id, tick, d, {_r('s', 's_rel')} FROM bur",
        "length_mix": b + f"SELECT stream_id, tick, {_r('short_ratio', 'mid_ratio', 'long_ratio')} FROM len",
        "activation": b + "SELECT stream_id, tick, n_silent, n_users, activation FROM aud",
        "concentration": b + "SELECT stream_id, tick, top3, concentration FROM aud",
        "overlap": b + "SELECT * FROM ov",
        "repeat_ratio": b + "SELECT * FROM rp",
        "spam_mask": b + "SELECT * FROM spm",
        "user_pool": b + "SELECT * FROM pool",
        "thresholds_sigma": b + f"SELECT stream_id, n, {_r('mu', 'sigma')}, round(mu + 2 * root / n, 6) + 0.0 AS candidate_threshold, round(mu + 3 * root / n, 6) + 0.0 AS strong_threshold FROM stat",
        "thresholds_robust": b + f""", md AS (SELECT stream_id, median(d) AS med FROM cnt GROUP BY 1), ma AS (SELECT stream_id, any_value(med) AS med, median(abs(d - med)) * 1.4826 AS mad FROM cnt JOIN md USING (stream_id) GROUP BY 1)
            SELECT stream_id, n, {_r('mu', 'sigma')}, round(CASE WHEN mad > 0 THEN med + 2 * mad ELSE mu + 2 * root / n END, 6) + 0.0 AS candidate_threshold,
            round(CASE WHEN mad > 0 THEN med + 3 * mad ELSE mu + 3 * root / n END, 6) + 0.0 AS strong_threshold FROM stat JOIN ma USING (stream_id)""",
        "thresholds_percentile": b + f""", q AS (SELECT stream_id, quantile_cont(d, 0.975) AS qc, quantile_cont(d, 0.99) AS qs FROM cnt GROUP BY 1)
            SELECT stream_id, n, {_r('mu', 'sigma')}, round(qc, 6) + 0.0 AS candidate_threshold, round(qs, 6) + 0.0 AS strong_threshold FROM stat JOIN q USING (stream_id)""",
        "runs": b + _cands(spam=False) + "SELECT stream_id, a AS run_start, b AS run_end FROM run",
        "candidates": c + "SELECT * FROM cd",
        "candidates_time_only": b + _cands(by_overlap=False) + "SELECT * FROM cd",
        "candidates_by_day": day + _cands() + "SELECT * FROM cd",
        "candidates_explicit": b + _cands("4.0", "7.0", spam=False, least=0) + "SELECT * FROM cd",
        "lifecycle": c + _COHORTS + "SELECT * FROM lf",
        "returning": c + _COHORTS + "SELECT * FROM rt",
        "signals": b + _SIGNALS + f"SELECT stream_id, tick, {_r(*_TICKS)} FROM sg",
        "heat": b + _SIGNALS + f"SELECT stream_id, tick, heat FROM ht",
        "scored": full + f"SELECT stream_id, cand_id, t_start, t_end, peak_t, peak_density, level, duration, shape, {_r('score')}, grade, {_r('heat_mean', 'heat_peak', 'converted_ratio', 'returning_ratio')} FROM scg",
        "overall": b + _SIGNALS + """SELECT stream_id, round(x, 6) + 0.0 AS overall_score, CASE WHEN x >= 0.75 THEN 'S' WHEN x >= 0.6 THEN 'A' WHEN x >= 0.45 THEN 'B' WHEN x >= 0.3 THEN 'C' ELSE '' END AS overall_grade
            FROM (SELECT stream_id, 0.5 * avg(heat) + 0.5 * max(heat) AS x FROM ht GROUP BY 1)""",
        "grade_counts": full + "SELECT stream_id, " + ", ".join(f"count(*) FILTER (grade = '{g}') AS n_{g.lower()}" for g in "SABC") + " FROM scg GROUP BY 1",
        "best_interval": full + "SELECT stream_id, cand_id, t_start, t_end, grade FROM scg QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY score DESC, cand_id) = 1",
        "sessions": _CHUNKS + """, ss AS (SELECT platform, user_name, min(created_ms) AS start_ms, arg_max(modified_ms, (created_ms, path)) AS end_ms, arg_min(title, (created_ms, path)) AS title, count(*) AS n_chunks FROM cl GROUP BY platform, user_name, session_no),
            od AS (SELECT *, row_number() OVER (PARTITION BY platform, user_name, start_ms // 86400000 ORDER BY start_ms) AS ordinal FROM ss)
            SELECT *, strftime(make_timestamp(start_ms * 1000), '%Y-%m-%d') || ' 第' || CAST(ordinal AS VARCHAR) || '场' || CASE WHEN title <> '' THEN ' · ' || title ELSE '' END AS label FROM od""",
        "session_chunks": _CHUNKS + "SELECT path, platform, user_name, session_no FROM cl",
        "dedup_records": b + "SELECT DISTINCT ts_ms, uid, text FROM msg",
        "interval_filter": b + "SELECT ts_ms, uid, text FROM msg JOIN bnd USING (stream_id) WHERE ts_ms BETWEEN origin + 86400000 AND origin + 172800000",
        "xml_messages": _FILES + "SELECT path, uid, ts_ms, text FROM xf WHERE kind <> 0",
        "xml_files": _FILES + """SELECT path, CASE kind WHEN 0 THEN 'skipped' WHEN 1 THEN 'repaired' WHEN 2 THEN 'repaired' ELSE 'ok' END AS status,
            CASE kind WHEN 1 THEN 'file breaks off, closed at its end' WHEN 2 THEN 'control characters removed' END AS reason, CASE WHEN kind = 0 THEN 0 ELSE n END AS n_messages FROM xg""",
        "xml_metadata": _FILES + "SELECT path, 'live' AS platform, CASE WHEN CAST(uid AS BIGINT) % 10 <> 0 THEN uid END AS user_name, 'day ' || CAST(day AS VARCHAR) AS room_title FROM xg",
        "unclassified": _FILES + "SELECT path, 'live' AS platform FROM xg WHERE CAST(uid AS BIGINT) % 10 = 0",
        "xml_sessions": _FILES + """SELECT 'live' AS platform, uid AS user_name, day * 86400000 AS start_ms, day * 86400000 + 86000000 AS end_ms, 'day ' || CAST(day AS VARCHAR) AS title, CAST(1 AS BIGINT) AS n_chunks, CAST(1 AS BIGINT) AS ordinal,
            strftime(make_timestamp(day * 86400000000), '%Y-%m-%d') || ' 第1场 · day ' || CAST(day AS VARCHAR) AS label FROM xg WHERE CAST(uid AS BIGINT) % 10 <> 0""",
        "paired_videos": """WITH h AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS uid, (epoch_us(ts) // 1000) // 3600000 AS h FROM events),
            n AS (SELECT (CAST(uid AS BIGINT) + h) % 5 AS k, '/rec/' || uid || '/' || strftime(make_timestamp(h * 3600000000), '%Y-%m-%d-%H-%M-%S') || '-000' AS p FROM h)
            SELECT p || '-chat.xml' AS path, CASE k WHEN 0 THEN p || '-chat.flv' WHEN 1 THEN p || '-video.MP4' WHEN 3 THEN p || '-chat.flv' END AS video, CASE k WHEN 2 THEN 'ambiguous' WHEN 4 THEN 'missing' END AS problem FROM n""",
        "choices": _CHUNKS + """, ss AS (SELECT platform, user_name, session_no, min(created_ms) AS start_ms, count(*) AS n FROM cl GROUP BY 1, 2, 3)
            SELECT platform, user_name, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_chunks, min(start_ms) AS first_start_ms, max(start_ms) AS last_start_ms FROM ss GROUP BY 1, 2""",
        "interval_preview": day + "SELECT stream_id, count(*) FILTER (rel BETWEEN 3600000 AND 7200000) AS n FROM m GROUP BY 1",
        "density_seconds": sec + "SELECT stream_id, tick, d FROM cnt WHERE d > 0",
        "activation_seconds": sec + "SELECT stream_id, tick, n_silent, n_users, activation FROM aud WHERE n_users IS NOT NULL",
        "overlap_seconds": sec + "SELECT * FROM ov WHERE n_any IS NOT NULL",
        "candidates_seconds": sec + _cands(tick=1000) + "SELECT * FROM cd",
        "chunk_videos": f"WITH {_VIDEOS} SELECT * FROM vd",
        "clip_plan": c + _CLIPS + "SELECT stream_id, cand_id, abs_start_ms, abs_end_ms, overlaps_previous FROM cp",
        "clip_segments": c + _SEGMENTS + "SELECT cand_id, source, local_start_ms, local_end_ms, segment_index, n_segments FROM sgm",
        "clip_manifest": c + _SEGMENTS + """SELECT cand_id AS clip_index, level AS grade, shape, level, printf('%.1f', CAST(t_start AS DOUBLE)) AS t_start, printf('%.1f', CAST(t_end AS DOUBLE)) AS t_end, printf('%.1f', CAST(peak_t AS DOUBLE)) AS peak_t,
            abs_start_ms, abs_end_ms, overlaps_previous, segment_index, n_segments, source, local_start_ms, local_end_ms,
            printf('clip_%03d_', cand_id) || level || '_' || shape || '_' || strftime(make_timestamp(abs_start_ms * 1000), '%H-%M-%S') || '-' || strftime(make_timestamp(abs_end_ms * 1000), '%H-%M-%S')
            || CASE WHEN n_segments > 1 THEN '_p' || CAST(segment_index + 1 AS VARCHAR) ELSE '' END || '.mp4' AS output, '' AS status, '' AS actual_duration_s, '' AS has_video, '' AS has_audio FROM sgm""",
        "time_formats": b + """SELECT ts_ms, printf('%02d:%02d:%02d.%03d', x // 3600000, (x // 60000) % 60, (x // 1000) % 60, x % 1000) AS media, printf('%02d:%02d:%02d', x // 3600000, (x // 60000) % 60, (x // 1000) % 60) AS clock,
            regexp_replace(text, '[^\\p{L}\\p{N} _.\\-]', '_', 'g') AS safe FROM (SELECT *, ts_ms % 400000000 AS x FROM msg)""",
        "report_overview": b + "SELECT stream_id, n_total, round(dur / 1000, 6) + 0.0 AS duration_s, round(dur / 60000, 6) + 0.0 AS duration_min FROM bnd",
        "report_density": b + f", t AS (SELECT * FROM cnt) SELECT stat.stream_id, {_r('mu', 'sigma')}, d_max, d_peak_t, sigma > 0 AS has_baseline FROM stat JOIN (SELECT stream_id, max(d) AS d_max, {_first('d')} FROM t GROUP BY 1) USING (stream_id)",
        "report_levels": c + "SELECT bnd.stream_id, count(*) FILTER (level = 'candidate') AS n_candidate, count(*) FILTER (level = 'strong') AS n_strong FROM bnd LEFT JOIN cd USING (stream_id) GROUP BY 1",
        "report_burst": b + "SELECT stream_id, round(avg(s), 6) + 0.0 AS s_mean, round(stddev_pop(s), 6) + 0.0 AS s_sd, round(max(s), 6) + 0.0 AS s_max, round(max(s_rel), 6) + 0.0 AS s_rel_max FROM bur GROUP BY 1",
        "report_activation": b + f""", t AS (SELECT * FROM aud), p AS (SELECT stream_id, count(*) FILTER (is_silent) AS n_silent_users, count(*) FILTER (NOT is_silent) AS n_active_users FROM pool GROUP BY 1)
            SELECT bnd.stream_id, round(least({300 * _T * 4}, dur) / {4 * _T}, 6) + 0.0 AS observation, n_silent_users, n_active_users, activation_mean, activation_max, activation_peak_t FROM bnd JOIN p USING (stream_id)
            JOIN (SELECT stream_id, round(avg(activation), 6) + 0.0 AS activation_mean, round(max(activation), 6) + 0.0 AS activation_max, {_first('activation')} FROM t GROUP BY 1) USING (stream_id)""",
        "report_length": b + "SELECT stream_id, " + ", ".join(f"round(avg({k}_ratio), 6) + 0.0 AS {k}_mean" for k in ("short", "mid", "long")) + ", count(*) FILTER (short_ratio > 0.70) AS n_short_surge, count(*) FILTER (long_ratio > 0.30) AS n_long_surge FROM len GROUP BY 1",
        "report_concentration": b + f", t AS (SELECT * FROM aud) SELECT stream_id, round(avg(concentration), 6) + 0.0 AS concentration_mean, round(max(concentration), 6) + 0.0 AS concentration_max, {_first('concentration')} FROM t GROUP BY 1",
        "report_overlap": b + "SELECT stream_id, round(avg(overlap), 6) + 0.0 AS overlap_mean, count(*) FILTER (overlap < 0.30) AS n_drops FROM ov GROUP BY 1",
        "report_interval_means": c + "SELECT cd.stream_id, cand_id, " + ", ".join(f"round(avg({k}), 6) + 0.0 AS {k}_mean" for k in ("activation", "short_ratio", "long_ratio", "concentration")) + " FROM cd JOIN aud ON aud.stream_id = cd.stream_id AND aud.tick BETWEEN t_start AND t_end JOIN len ON len.stream_id = aud.stream_id AND len.tick = aud.tick GROUP BY 1, 2",
        "report_spam": b + "SELECT stream_id, count(*) FILTER (spam) AS n_spam FROM spm GROUP BY 1",
        "report_lifecycle": c + _COHORTS + "SELECT stream_id, cand_id, t_start, t_end, " + ", ".join(f"{k}, CASE WHEN total_users > 0 THEN CAST(CAST(round_even({k} / total_users * 100, 0) AS BIGINT) AS VARCHAR) || '%' ELSE '--' END AS {k}_pct" for k in ("instant", "persistent", "converted")) + ", total_users, offset_a, offset_b, offset_c FROM lf",
        "report_headline": full + """, best AS (SELECT stream_id, cand_id AS best_cand_id, round(score, 6) + 0.0 AS best_score, grade AS best_grade, t_start AS best_t_start, t_end AS best_t_end FROM scg
            QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY score DESC, cand_id) = 1), o AS (SELECT stream_id, 0.5 * avg(heat) + 0.5 * max(heat) AS x FROM ht GROUP BY 1)
            SELECT bnd.stream_id, n_total, round(dur / 1000, 6) + 0.0 AS duration_s, round(dur / 60000, 6) + 0.0 AS duration_min, (SELECT count(*) FROM cd WHERE cd.stream_id = bnd.stream_id) AS n_intervals,
            round(x, 6) + 0.0 AS overall_score, CASE WHEN x >= 0.75 THEN 'S' WHEN x >= 0.6 THEN 'A' WHEN x >= 0.45 THEN 'B' WHEN x >= 0.3 THEN 'C' ELSE '' END AS overall_grade,
            best_cand_id, best_score, best_grade, best_t_start, best_t_end FROM bnd JOIN o USING (stream_id) LEFT JOIN best USING (stream_id)""",
        "report_details": full + f"""SELECT scg.stream_id, scg.cand_id, scg.t_start, scg.t_end, peak_t, peak_density, level, duration, shape, {_r('score')}, grade, {_r('heat_mean', 'heat_peak', 'converted_ratio', 'returning_ratio')},
            instant, persistent, converted, lf.total_users, returning_count, round(ratio, 6) + 0.0 AS ratio FROM scg JOIN lf USING (stream_id, cand_id) JOIN rt USING (stream_id, cand_id)""",
        "report_burst_ticks": b + ", z AS (SELECT stream_id, stddev_pop(s) AS sd FROM bur GROUP BY 1) SELECT stream_id, tick, round(s, 6) + 0.0 AS s FROM bur JOIN z USING (stream_id) WHERE s > 3 * sd",
        "report_returning": c + _COHORTS + "SELECT stream_id, cand_id, t_start, t_end, returning_count, total_users, round(ratio, 6) + 0.0 AS ratio, gap_start <= 0 AS gap_before_start FROM rt",
    }
