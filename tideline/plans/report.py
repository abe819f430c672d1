"""Result sets of the report, each a small DataFrame, and the report as text."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import percent
from tideline.operators.detect import exploded, moments
from tideline.plans.analysis import Analysis


def _first_peak(value: str) -> Column:
    return (-F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(value), (-F.col("tick")).alias("n"))))["n"]).alias(f"{value}_peak_t")


def overview(a: Analysis) -> DataFrame:
    return a.bounds.select("stream_id", "n_total", (F.col("dur_ms") / 1000).alias("duration_s"), (F.col("dur_ms") / 60000).alias("duration_min"))


def density(a: Analysis) -> DataFrame:
    peaks = a.density.groupBy("stream_id").agg(F.max("d").alias("d_max"), _first_peak("d"))
    return moments(a.density).join(peaks, "stream_id").select("stream_id", "mu", "sigma", "d_max", "d_peak_t", (F.col("sigma") > 0).alias("has_baseline"))


def levels(a: Analysis) -> DataFrame:
    own = a.candidates.groupBy("stream_id").agg(F.count_if(F.col("level") == "candidate").alias("n_candidate"), F.count_if(F.col("level") == "strong").alias("n_strong"))
    return a.bounds.select("stream_id").join(own, "stream_id", "left").select("stream_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_candidate", "n_strong")])


def burst(a: Analysis) -> DataFrame:
    return a.burst.groupBy("stream_id").agg(F.avg("s").alias("s_mean"), F.stddev_pop("s").alias("s_sd"), F.max("s").alias("s_max"), F.max("s_rel").alias("s_rel_max"))


def activation(a: Analysis) -> DataFrame:
    from tideline.operators.windows import observation_quarter_ms, user_pool

    pool = user_pool(a.rel, a.bounds, a.windows).groupBy("stream_id").agg(F.count_if("is_silent").alias("n_silent_users"), F.count_if(~F.col("is_silent")).alias("n_active_users"))
    own = a.audience.groupBy("stream_id").agg(F.avg("activation").alias("activation_mean"), F.max("activation").alias("activation_max"), _first_peak("activation"))
    obs = a.bounds.select("stream_id", (observation_quarter_ms(F.col("dur_ms"), a.windows) / (4 * a.windows.tick_ms)).alias("observation"))
    return obs.join(pool, "stream_id", "left").join(own, "stream_id").select("stream_id", "observation", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_silent_users", "n_active_users")], "activation_mean", "activation_max", "activation_peak_t")


def length_mix(a: Analysis) -> DataFrame:
    return a.length_mix.groupBy("stream_id").agg(
        *[F.avg(f"{k}_ratio").alias(f"{k}_mean") for k in ("short", "mid", "long")], F.count_if(F.col("short_ratio") > 0.70).alias("n_short_surge"), F.count_if(F.col("long_ratio") > 0.30).alias("n_long_surge")
    )


def concentration(a: Analysis) -> DataFrame:
    return a.audience.groupBy("stream_id").agg(F.avg("concentration").alias("concentration_mean"), F.max("concentration").alias("concentration_max"), _first_peak("concentration"))


def overlap(a: Analysis) -> DataFrame:
    return a.overlap.groupBy("stream_id").agg(F.avg("overlap").alias("overlap_mean"), F.count_if(F.col("overlap") < 0.30).alias("n_drops"))


def interval_means(a: Analysis) -> DataFrame:
    """Means of the indicators within each interval; null where none is defined."""
    cols = ("activation", "short_ratio", "long_ratio", "concentration")
    own = exploded(a.candidates, "cand_id").join(a.ticks.select("stream_id", "tick", *cols), ["stream_id", "tick"], "left")
    return own.groupBy("stream_id", "cand_id").agg(*[F.avg(c).alias(f"{c}_mean") for c in cols])


def spam_ticks(a: Analysis) -> DataFrame:
    return a.spam.groupBy("stream_id").agg(F.count_if("spam").alias("n_spam"))


def lifecycle_lines(a: Analysis) -> DataFrame:
    return a.lifecycle.select("stream_id", "cand_id", "t_start", "t_end", *[c for k in ("instant", "persistent", "converted") for c in (F.col(k), percent(F.col(k), F.col("total_users")).alias(f"{k}_pct"))], "total_users", "offset_a", "offset_b", "offset_c")


def returning_lines(a: Analysis) -> DataFrame:
    return a.returning.select("stream_id", "cand_id", "t_start", "t_end", "returning_count", "total_users", "ratio", (F.col("gap_start") <= 0).alias("gap_before_start"))


def headline(a: Analysis) -> DataFrame:
    """A stream's overview tiles: messages, length, intervals, own score and grade, and its best interval."""
    best = a.best().select("stream_id", F.col("cand_id").alias("best_cand_id"), F.col("score").alias("best_score"), F.col("grade").alias("best_grade"), F.col("t_start").alias("best_t_start"), F.col("t_end").alias("best_t_end"))
    n = a.candidates.groupBy("stream_id").agg(F.count("*").alias("n_intervals"))
    return overview(a).join(n, "stream_id", "left").join(a.overall, "stream_id", "left").join(best, "stream_id", "left").withColumn("n_intervals", F.coalesce("n_intervals", F.lit(0)))


def details(a: Analysis) -> DataFrame:
    """The table of intervals: what each is, and its cohorts."""
    keys = ["stream_id", "cand_id"]
    return a.scored.join(a.lifecycle.select(*keys, "instant", "persistent", "converted", "total_users"), keys).join(a.returning.select(*keys, "returning_count", "ratio"), keys)


def burst_ticks(a: Analysis, k: float = 3.0) -> DataFrame:
    """Ticks whose rise exceeds k standard deviations."""
    return a.burst.join(burst(a).select("stream_id", "s_sd"), "stream_id").where(F.col("s") > k * F.col("s_sd")).select("stream_id", "tick", "s")


def _f(value, digits: int = 3) -> str:
    return "--" if value is None else f"{value:.{digits}f}"


def text(a: Analysis) -> str:
    """The report of each stream. All that is gathered are a few rows a stream and one an interval."""
    parts = {n: {r["stream_id"]: r for r in f(a).collect()} for n, f in (("o", overview), ("d", density), ("b", burst), ("a", activation), ("l", length_mix), ("c", concentration), ("v", overlap), ("n", levels), ("s", spam_ticks))}
    cuts = {r["stream_id"]: r for r in a.thresholds.collect()}
    rows = {n: f.orderBy("cand_id").collect() for n, f in (("h", a.candidates), ("m", interval_means(a)), ("y", lifecycle_lines(a)), ("r", returning_lines(a)))}
    of_stream: dict[str, dict[str, list]] = {n: defaultdict(list) for n in rows}
    for n, x in rows.items():
        for r in x:
            of_stream[n][r["stream_id"]].append(r)
    w = a.windows.window
    out = []
    for s in sorted(parts["o"]):
        p = {n: x.get(s) for n, x in parts.items()}
        own = {n: of_stream[n][s] for n in rows}
        table = ["# | t_start | t_end | duration | peak_d | level | shape"] + [f"{r['cand_id'] + 1} | {r['t_start']:.1f} | {r['t_end']:.1f} | {r['duration']:.1f} | {r['peak_density']:.0f} | {r['level']} | {r['shape']}" for r in own["h"]]
        out += [f"== Overview: {s} ==", f"messages: {p['o']['n_total']}", f"span: {p['o']['duration_s']:.1f} s ({p['o']['duration_min']:.1f} min)"]
        out += [f"== 1 Density (window {w}) =="] + ([] if p["d"] and p["d"]["has_baseline"] else ["warning: no reliable baseline in a stream this short"])
        if p["d"]:
            out += [f"mean {_f(p['d']['mu'])}, deviation {_f(p['d']['sigma'])}", f"highest {_f(p['d']['d_max'], 0)} at {_f(p['d']['d_peak_t'], 1)}"]
        if s in cuts:
            out.append(f"over {_f(cuts[s]['candidate_threshold'], 2)} ({a.detection.threshold_mode}): {p['n']['n_candidate']}, over {_f(cuts[s]['strong_threshold'], 2)}: {p['n']['n_strong']}")
        if a.detection.spam_filter and p["s"]:
            out.append(f"ticks left out as spam: {p['s']['n_spam']}")
        out += table if own["h"] else []
        out += ["== 2 Burst ==", f"mean {_f(p['b']['s_mean'])}, deviation {_f(p['b']['s_sd'])}, highest {_f(p['b']['s_max'])}, relative {_f(p['b']['s_rel_max'])}" if p["b"] else "no values"]
        x = p["a"]
        out += ["== 3 Activation of silent users ==", f"observation {_f(x['observation'], 1)}, silent {x['n_silent_users']}, active {x['n_active_users']} (at most {a.windows.silent_most} messages)"]
        out += ["warning: no silent users"] if not x["n_silent_users"] else []
        out.append(f"mean {_f(x['activation_mean'])}, highest {_f(x['activation_max'])} at {_f(x['activation_peak_t'], 1)}" if x["activation_mean"] is not None else "warning: observation covers all of the stream")
        x = p["l"]
        out += [f"== 4 Message length (window {w}) ==", f"short/mid/long {_f(x['short_mean'])} / {_f(x['mid_mean'])} / {_f(x['long_mean'])}, surges of short {x['n_short_surge']}, of long {x['n_long_surge']}"]
        out += [f"== 5 Concentration (three busiest, window {w}) ==", f"mean {_f(p['c']['concentration_mean'])}, highest {_f(p['c']['concentration_max'])} at {_f(p['c']['concentration_peak_t'], 1)}"]
        out += [f"== 6 Overlap of users (window {a.windows.overlap_window}) ==", f"mean {_f(p['v']['overlap_mean'])}, ticks under 30%: {p['v']['n_drops']}"]
        if own["m"]:
            out.append("in intervals (activation, short, long, concentration): " + "  ".join(f"#{r['cand_id'] + 1}: " + "/".join("--" if r[c] is None else f"{100 * r[c]:.1f}%" for c in ("activation_mean", "short_ratio_mean", "long_ratio_mean", "concentration_mean")) for r in own["m"]))
        out += ["== Intervals ==", *(table if own["h"] else ["none; a threshold of 1.5 deviations may find some"])]
        out += ["== 7 Lifecycle of users =="] + ([f"[{r['t_start']:.1f},{r['t_end']:.1f}] offsets {r['offset_a']:.0f}/{r['offset_b']:.0f}/{r['offset_c']:.0f}: instant {r['instant']} ({r['instant_pct']}), persistent {r['persistent']} ({r['persistent_pct']}), converted {r['converted']} ({r['converted_pct']}) of {r['total_users']}" for r in own["y"]] or ["no intervals"])
        out += ["== 8 Returning users =="] + ([f"[{r['t_start']:.1f},{r['t_end']:.1f}]: {r['returning_count']} of {r['total_users']}, {'--' if r['ratio'] is None else f'{100 * r["ratio"]:.1f}%'}{'  (the silence would begin before the stream)' if r['gap_before_start'] else ''}" for r in own["r"]] or ["no intervals"])
    return "\n".join(out) + "\n"
