"""Judging notes of a performance: onsets against their neighbours', durations by frames in a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import config as C
from ..functions.music import timing_result
from .assign import assign
from .rangejoin import per_window


def onset_check(assigned: DataFrame, s: C.JudgeSettings = C.JudgeSettings()) -> DataFrame:
    """Adds onset_error (detected - expected) and onset_ok.

    The first note, and one whose predecessor got no onset, is held against its own time; others by the distance from the
    note before. A note without an onset is not ok.
    """
    w = Window.partitionBy("perf_id").orderBy("ord")
    error = F.col("det") - F.col("onset")
    before, expected_before = F.lag("det").over(w), F.lag("onset").over(w)
    judged = assigned.withColumn("onset_error", error).withColumn("_cmp", F.when(before.isNull(), error).otherwise((F.col("det") - before) - (F.col("onset") - expected_before)))
    return judged.withColumn("onset_ok", F.coalesce(F.abs("_cmp") <= C.onset_tolerance(F.col("tempo"), s), F.lit(False))).drop("_cmp")


def windows(assigned: DataFrame, s: C.JudgeSettings, hop: Column) -> DataFrame:
    """Adds t0, t1 (where a note's frames are looked for; null when a note fails without looking), fast and hop."""
    w = Window.partitionBy("perf_id").orderBy("ord")
    next_det, next_onset = F.lead("det").over(w), F.lead("onset").over(w)
    if s.mode == "detected_onset":
        start, end = F.col("det"), next_det
    elif s.mode == "score_grid":
        start, end = F.col("onset"), next_onset
    else:
        start, end = F.col("onset"), F.least(F.col("onset") + F.col("dur"), next_onset)
    pads = (C.grid_pre(F.col("tempo"), s), C.grid_post(F.col("tempo"), s)) if s.mode == "anchored_grid" else (F.lit(0.0), F.lit(0.0))
    step = F.greatest(F.col("dur"), F.col("hop"))
    rows = assigned.withColumn("hop", hop).withColumn("_s", start).withColumn("_e", end)
    rows = rows.withColumn("_e", F.when(F.col("_e").isNull() | (F.col("_e") <= F.col("_s")), F.col("_s") + F.col("dur")).otherwise(F.col("_e")))
    rows = rows.withColumn("fast", F.col("dur") < C.beat_sec(F.col("tempo")))
    rows = rows.withColumn("_e", F.when(F.col("fast"), F.greatest(F.col("_e"), F.col("_s") + step)).otherwise(F.col("_e")))
    rows = rows.withColumn("t0", F.col("_s") - pads[0]).withColumn("t1", F.col("_e") + pads[1])
    rows = rows.withColumn("t1", F.when(F.col("t1") <= F.col("t0"), F.col("t0") + step).otherwise(F.col("t1")))
    silent = F.col("dur") <= 0
    return rows.withColumn("t0", F.when(~silent, F.col("t0"))).withColumn("t1", F.when(~silent, F.col("t1"))).drop("_s", "_e")


def trimmed_counts(windowed: DataFrame, frames: DataFrame, s: C.JudgeSettings) -> DataFrame:
    """windowed (perf_id, ord, t0, t1, midi, fast and what else it carries) with n_frames, mid_n and valid: frames in the window,
    those left by the trim, and those of the right pitch.

    Of a slow note's frames, in order, the first and last share (one at least) don't count; if that leaves none, the middle one does.
    """
    heard = frames.select("perf_id", "frame_idx", "t", F.col("midi").alias("heard"), "voiced")
    found = F.sort_array(F.collect_list(F.when(F.col("frame_idx").isNotNull(), F.struct("frame_idx", "heard", "voiced"))))
    rows = per_window(windowed, heard, "perf_id", "ord", "t0", "t1", "t", found.alias("_f")).withColumn("n_frames", F.size("_f").cast("long"))
    n = F.col("n_frames")
    head = F.greatest(F.lit(1), F.floor(n * F.lit(s.trim))).cast("int")
    kept = F.when(F.col("fast") | (n <= 1), F.col("_f")).when(2 * head >= n, F.slice("_f", (F.floor(n / 2) + 1).cast("int"), F.lit(1))).otherwise(F.slice("_f", head + 1, (n - 2 * head).cast("int")))
    right = F.filter("_f", lambda f: f["voiced"] & (F.abs(f["heard"] - F.col("midi")) <= F.lit(s.pitch_tolerance)))
    rows = rows.withColumn("_f", kept).withColumn("mid_n", F.size("_f").cast("long"))
    return rows.withColumn("valid", F.size(right).cast("long")).drop("_f")


def measure(rows: DataFrame, s: C.JudgeSettings) -> DataFrame:
    """Adds the duration verdict by the counts: duration_detected, duration_ratio, duration_mode, valid_frame_count, duration_ok."""
    valid, mid = F.coalesce("valid", F.lit(0)), F.coalesce("mid_n", F.lit(0))
    looked = F.col("t0").isNotNull()
    detected = F.when(~looked, 0.0).when(F.col("fast"), valid * F.col("hop")).when(mid > 0, valid / mid * F.col("dur")).otherwise(0.0)
    rows = rows.withColumn("valid_frame_count", F.when(looked, valid).otherwise(0).cast("long")).withColumn("duration_detected", detected)
    rows = rows.withColumn("duration_ratio", F.when(F.col("dur") > 0, F.col("duration_detected") / F.col("dur")))
    rows = rows.withColumn("duration_mode", F.when(F.col("fast") | (F.col("dur") <= 0), "faster_than_quarter").otherwise("quarter_or_longer"))
    least = F.when(F.col("dur") >= 2 * C.beat_sec(F.col("tempo")), s.long_ratio).otherwise(s.quarter_ratio)
    long_ok = F.col("duration_ratio") >= least
    if s.most_ratio is not None:
        long_ok = long_ok & (F.col("duration_ratio") <= s.most_ratio)
    ok = F.when(~looked, False).when(F.col("fast"), F.col("valid_frame_count") >= 1).otherwise(F.coalesce(long_ok, F.lit(False)))
    return rows.withColumn("duration_ok", ok).drop("n_frames", "mid_n", "valid")


def judge(expected: DataFrame, onsets: DataFrame, frames: DataFrame, s: C.JudgeSettings = C.JudgeSettings(), hop: Column | float = 512 / 22050) -> DataFrame:
    """Segments: a row per expected note (rests are not among them) with its onset, duration and timing verdicts."""
    hop = F.lit(hop) if isinstance(hop, float) else hop
    assigned = assign(expected, onsets)
    windowed = windows(onset_check(assigned, s), s, hop)
    out = measure(trimmed_counts(windowed, frames, s), s)
    return out.withColumn("rhythm_ok", F.col("duration_ok")).withColumn("timing_result", timing_result(F.col("onset_ok"), F.col("duration_ok")))
