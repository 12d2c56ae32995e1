"""The flagship: notes against what was played, per note and per performance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import config as C
from ..functions.music import timing_result
from .assign import greedy
from .rangejoin import per_window
from .rhythm import measure


def pitch_medians(windows: DataFrame, frames: DataFrame) -> DataFrame:
    """windows (perf_id, ord, p0, p1, ...) with pitch_detected: the median pitch of voiced frames in [p0, p1), -1 without any."""
    voiced = frames.where("voiced and midi > 0").select("perf_id", "t", F.col("midi").alias("heard"))
    return per_window(windows, voiced, "perf_id", "ord", "p0", "p1", "t", F.coalesce(F.median("heard"), F.lit(-1.0)).alias("pitch_detected"))


#: A frame as it stands in a stretch of what was heard.
FRAMES = "array<struct<frame_idx:bigint,t:double,midi:double,voiced:boolean>>"


def recognize(expected: DataFrame, onsets: DataFrame, frames: DataFrame, s: C.JudgeSettings = C.JudgeSettings(mode="anchored_grid"), hop: Column | float = 512 / 22050) -> DataFrame:
    """A verdict per expected note. The pitch is looked for from the detected onset, if any, over the detected duration."""
    own = F.col("perf_id").cast(expected.schema["perf_id"].dataType).alias("perf_id")
    found = onsets.select(own, F.col("t").cast("double").alias("onset"), F.lit(None).cast(FRAMES).alias("frames"))
    tracked = frames.select(own, F.lit(None).cast("double").alias("onset"), F.array(F.struct("frame_idx", "t", "midi", "voiced")).cast(FRAMES).alias("frames"))
    return recognize_heard(expected, found.unionByName(tracked), s, hop)


def recognize_heard(expected: DataFrame, heard: DataFrame, s: C.JudgeSettings = C.JudgeSettings(mode="anchored_grid"), hop: Column | float = 512 / 22050) -> DataFrame:
    """The same from heard (perf_id, onset, frames): rows that hold a detected onset or null, and any number of frames or null.

    Frames are ten times the notes, so they are not dealt out by windows: a performance's notes and all that was heard of it meet
    once, and nothing else is shuffled. Where heard and expected are dealt by perf_id already, nothing is shuffled here.
    """
    hop = F.lit(hop) if isinstance(hop, float) else hop
    tempo = F.col("tempo")
    pads = (C.grid_pre(tempo, s), C.grid_post(tempo, s)) if s.mode == "anchored_grid" else (F.lit(0.0), F.lit(0.0))
    notes = expected.withColumn("hop", hop).withColumn("fast", F.col("dur") < C.beat_sec(tempo))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in notes.schema.fields)
    schema += ", det double, onset_error double, onset_ok boolean, t0 double, t1 double, n_frames long, mid_n long, valid long, pitch_detected double"
    notes = notes.withColumn("_tolerance", C.onset_tolerance(tempo, s)).withColumn("_pre", pads[0]).withColumn("_post", pads[1])
    rows = notes.groupBy("perf_id").cogroup(heard.select("perf_id", "onset", "frames").groupBy("perf_id")).applyInArrow(lambda a, b: performed(a, b, s), schema)
    rows = measure(rows, s).withColumn("rhythm_ok", F.col("duration_ok")).withColumn("timing_result", timing_result(F.col("onset_ok"), F.col("duration_ok")))
    rows = rows.withColumn("missed", F.col("det").isNull() & (F.col("valid_frame_count") == 0))
    right = (F.col("pitch_detected") >= 0) & (F.abs(F.col("pitch_detected") - F.col("midi")) <= s.pitch_tolerance)
    rows = rows.withColumn("pitch_ok", F.coalesce(right, F.lit(False)))
    rows = rows.withColumn("overall", F.col("pitch_ok") & F.col("rhythm_ok") & ~F.col("missed"))
    dims = F.array_compact(F.array(F.when(F.col("missed"), "missed"), F.when(~F.col("onset_ok"), "onset"), F.when(~F.col("duration_ok"), "duration"), F.when(~F.col("pitch_ok"), "pitch")))
    return rows.withColumn("error_dims", dims).drop("t0", "t1")


def stretches(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) of all positions of the windows [low, high), window by window."""
    n = high - low
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)


def medians(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The median of each window's values, -1 of none."""
    window, at = stretches(low, high)
    ordered = values[at][np.lexsort((values[at], window))]
    out, n = np.full(len(low), -1.0), high - low
    some = np.flatnonzero(n)
    begin = (np.cumsum(n) - n)[some]
    a, b = ordered[begin + (n[some] - 1) // 2], ordered[begin + n[some] // 2]
    out[some] = np.where(a == b, a, 0.5 * a + 0.5 * b)
    return out


def performed(notes: pa.Table, heard: pa.Table, s: C.JudgeSettings) -> pa.Table:
    """One performance's notes with the columns of onset_check, windows, trimmed_counts and pitch_medians, by the same rules."""
    notes = notes.sort_by("ord")
    number = lambda c: notes.column(c).to_numpy().astype(np.float64)  # noqa: E731  null: NaN
    onset, dur, midi, hop = (number(c) for c in ("onset", "dur", "midi", "hop"))
    fast = notes.column("fast").fill_null(False).to_numpy()
    found = greedy(notes.column("onset").to_pylist(), pc.drop_null(heard.column("onset")).to_pylist())
    det = np.array([np.nan if t is None else t for t in found], np.float64)
    following = lambda x: np.r_[x[1:], np.full(len(x) and 1, np.nan)]
    error, before = det - onset, np.r_[np.full(len(det) and 1, np.nan), det[:-1]]
    compared = np.where(np.isnan(before), error, (det - before) - (onset - np.r_[np.full(len(onset) and 1, np.nan), onset[:-1]]))
    onset_ok = np.abs(compared) <= number("_tolerance")

    if s.mode == "detected_onset":
        start, end = det, following(det)
    elif s.mode == "score_grid":
        start, end = onset, following(onset)
    else:
        start, end = onset, np.fmin(onset + dur, following(onset))
    step = np.fmax(dur, hop)
    end = np.where(np.isnan(end) | (end <= start), start + dur, end)
    end = np.where(fast, np.fmax(end, start + step), end)
    t0, t1 = start - number("_pre"), end + number("_post")
    t1 = np.where(t1 <= t0, t0 + step, t1)
    t0, t1 = np.where(dur > 0, t0, np.nan), np.where(dur > 0, t1, np.nan)

    frames = heard.column("frames").combine_chunks().flatten()
    frame_idx, t, pitch, voiced = frames.flatten()
    if not notes.column("perf_id").null_count:  # what has no performance meets no frames
        timed = t.is_valid()
    else:
        timed = pa.array(np.zeros(len(t), bool))
    counted = pc.and_(timed, frame_idx.is_valid()).to_numpy(zero_copy_only=False)
    idx = frame_idx.fill_null(0).to_numpy()
    t, heard_midi, voiced = t.to_numpy(zero_copy_only=False), pitch.to_numpy(zero_copy_only=False), voiced.fill_null(False).to_numpy(zero_copy_only=False)
    sounding = timed.to_numpy(zero_copy_only=False) & voiced & pitch.is_valid().to_numpy(zero_copy_only=False) & ~(heard_midi <= 0)

    def between(times: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = high > low
        return np.where(some, np.searchsorted(times, low), 0), np.where(some, np.searchsorted(times, high), 0)

    order = np.flatnonzero(counted)
    order = order[np.argsort(t[order], kind="stable")]
    low, high = between(t[order], t0, t1)
    n = high - low
    head = np.maximum(1, np.floor(n * s.trim)).astype(np.int64)
    first = np.where(fast | (n <= 1), 0, np.where(2 * head >= n, n // 2, head))
    last = np.where(fast | (n <= 1), n, np.where(2 * head >= n, n // 2 + 1, n - head))
    if (np.diff(idx[order]) > 0).all():
        window, at = stretches(low + first, low + last)
        at = order[at]
    else:  # frames count in the order of their numbers, whatever their times
        window, at = stretches(low, high)
        at = order[at]
        absent = ~pitch.is_valid().to_numpy(zero_copy_only=False)
        by = np.lexsort((voiced[at], heard_midi[at], ~absent[at], idx[at], window))
        window, at = window[by], at[by]
        place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        kept = (place >= first[window]) & (place < last[window])
        window, at = window[kept], at[kept]
    right = voiced[at] & (np.abs(heard_midi[at] - midi[window]) <= s.pitch_tolerance)
    valid, mid = np.bincount(window[right], minlength=len(n)), last - first

    sounds = np.where(fast, valid * hop, np.where(mid > 0, valid / np.maximum(mid, 1) * dur, 0.0))
    sounds = np.where(np.isnan(t0), 0.0, sounds)
    p0 = np.where(np.isnan(det), onset, det)
    order = np.flatnonzero(sounding)
    order = order[np.argsort(t[order], kind="stable")]
    pitches = medians(heard_midi[order], *between(t[order], p0, p0 + np.fmax(sounds, 0.001)))

    out = notes.drop_columns(["_tolerance", "_pre", "_post"])
    for name, values in {"det": det, "onset_error": error, "onset_ok": onset_ok, "t0": t0, "t1": t1, "n_frames": n, "mid_n": mid, "valid": valid}.items():
        out = out.append_column(name, pa.array(values, from_pandas=True))
    return out.append_column("pitch_detected", pa.array(pitches))


def summarize(verdicts: DataFrame) -> DataFrame:
    """One row per performance: totals, errors by dimension, accuracy."""
    return verdicts.groupBy("perf_id").agg(
        F.count("*").alias("total"), F.count_if("overall").alias("correct"), F.count_if(~F.col("onset_ok")).alias("onset_errors"), F.count_if(~F.col("duration_ok")).alias("duration_errors"),
        F.count_if(~F.col("pitch_ok")).alias("pitch_errors"), F.count_if("missed").alias("missed"), (F.count_if("overall") / F.count("*")).alias("accuracy"),
    )
