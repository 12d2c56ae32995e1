"""Queries on performances: range joins, assignment, judgement, verdicts, onset picking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.config import JudgeSettings
from ..operators import onset, reanchor
from ..operators.assign import assign
from ..operators.rangejoin import join_times
from ..operators.recognize import pitch_medians, recognize_heard, summarize
from ..operators.rhythm import judge, onset_check, trimmed_counts, windows
from . import views as V

HOP = V.HOP
MODES = {"judge_detected": "detected_onset", "judge_grid": "score_grid", "judge_anchored": "anchored_grid"}


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    e = V.expected(spark, sf)
    return e.withColumn("t0", F.col("onset")).withColumn("t1", F.col("onset") + F.col("dur"))


def range_join_counts(spark: SparkSession, sf: str) -> DataFrame:
    met = join_times(_windows(spark, sf), V.frames(spark, sf).withColumnRenamed("midi", "heard"), "perf_id", "t0", "t1", "t")
    ok = F.col("voiced") & (F.abs(F.col("heard") - F.col("midi")) <= 1.0)
    return met.groupBy("perf_id", "ord").agg(F.count("frame_idx").alias("n_frames"), F.count_if(ok).alias("n_match"))


def pitch_median(spark: SparkSession, sf: str) -> DataFrame:
    w = _windows(spark, sf).withColumnsRenamed({"t0": "p0", "t1": "p1"})
    return pitch_medians(w, V.frames(spark, sf)).select("perf_id", "ord", F.round("pitch_detected", 6).alias("pitch_detected"))


def pitch_upper_median(spark: SparkSession, sf: str) -> DataFrame:
    w = _windows(spark, sf).withColumn("p0", F.col("onset") - 0.1).withColumn("p1", F.col("onset") + F.col("dur") + 0.175)
    met = join_times(w.select("perf_id", "ord", "p0", "p1"), V.frames(spark, sf).where("voiced"), "perf_id", "p0", "p1", "t", "inner")
    return met.groupBy("perf_id", "ord").agg(F.expr("element_at(array_sort(collect_list(midi)), cast(count(*) div 2 + 1 as int))").alias("upper_median"))


def trimmed_density(spark: SparkSession, sf: str) -> DataFrame:
    w = _windows(spark, sf).withColumn("fast", F.lit(False))
    c = trimmed_counts(w, V.frames(spark, sf), JudgeSettings())
    return c.select("perf_id", "ord", "n_frames", "mid_n", "valid")


def assign_onsets(spark: SparkSession, sf: str) -> DataFrame:
    return assign(V.expected(spark, sf), V.onsets(spark, sf)).select("perf_id", "ord", F.round("det", 6).alias("det"))


def onset_check_ioi(spark: SparkSession, sf: str) -> DataFrame:
    return onset_check(assign(V.expected(spark, sf), V.onsets(spark, sf))).select("perf_id", "ord", F.round("onset_error", 6).alias("onset_error"), "onset_ok")


def _judged(mode: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        j = judge(V.expected(spark, sf), V.onsets(spark, sf), V.frames(spark, sf), JudgeSettings(mode=mode), HOP)
        return j.select("perf_id", "ord", "onset_ok", "valid_frame_count", F.round("duration_detected", 6).alias("duration_detected"), F.round("duration_ratio", 6).alias("duration_ratio"), "duration_mode", "duration_ok", "timing_result")

    return query


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return recognize_heard(V.expected(spark, sf), V.heard(spark, sf), hop=HOP)


def recognize_query(spark: SparkSession, sf: str) -> DataFrame:
    v = _verdicts(spark, sf)
    return v.select("perf_id", "ord", "measure", "idx", F.round("onset_error", 6).alias("onset_error"), "onset_ok", F.round("pitch_detected", 6).alias("pitch_detected"), "pitch_ok", "duration_ok", "missed", "overall", F.array_join("error_dims", ",").alias("error_dims"))


def recognize_summary(spark: SparkSession, sf: str) -> DataFrame:
    expected = V.expected(spark, sf).drop("measure", "idx")  # no total needs them, and idx would be a sort of its own
    return summarize(recognize_heard(expected, V.heard(spark, sf), hop=HOP)).withColumn("accuracy", F.round("accuracy", 6))


def measure_report(spark: SparkSession, sf: str) -> DataFrame:
    v = _verdicts(spark, sf).groupBy("perf_id", "measure").agg(F.array_sort(F.collect_list(F.struct("ord", "midi", "rhythm_ok"))).alias("n"), F.count_if("rhythm_ok").alias("hits"), F.count("*").alias("notes"))
    return v.select("perf_id", "measure", "hits", "notes", F.array_join(F.transform("n", lambda x: F.concat(x["midi"].cast("int").cast("string"), F.when(x["rhythm_ok"], "+").otherwise("-"))), " ").alias("line"))


def ok_rates(spark: SparkSession, sf: str) -> DataFrame:
    rate = lambda c: F.round(F.count_if(c) / F.count("*"), 3)
    return _verdicts(spark, sf).agg(F.count("*").alias("n"), F.count_if("rhythm_ok").alias("rhythm_ok"), rate("rhythm_ok").alias("rhythm_rate"), F.count_if("onset_ok").alias("onset_ok"), rate("onset_ok").alias("onset_rate"))


def flux_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return onset.thresholds(V.flux(spark, sf)).select("perf_id", "frame_idx", F.round("threshold", 6).alias("threshold"))


def peaks(spark: SparkSession, sf: str) -> DataFrame:
    return onset.peaks(V.flux(spark, sf)).select("perf_id", "frame_idx")


def onset_times(spark: SparkSession, sf: str) -> DataFrame:
    return onset.peak_times(onset.peaks(V.flux(spark, sf)), 512, 22050).select("perf_id", F.round("t", 6).alias("t"))


def spectral_flux_vec(spark: SparkSession, sf: str) -> DataFrame:
    return onset.spectral_flux(V.features(spark, sf)).select("seq_id", "idx", F.round("flux", 5).alias("flux"))


def rest_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return reanchor.rest_gaps(V.expected(spark, sf)).select("perf_id", "ord", F.round("gap", 6).alias("gap"))


def pitch_runs(spark: SparkSession, sf: str) -> DataFrame:
    voiced = V.frames(spark, sf).where("voiced")
    return reanchor.runs(voiced, "perf_id", "t", 0.15).select("perf_id", F.round("run_start", 6).alias("run_start"), F.round("run_end", 6).alias("run_end"), "n")


def reanchor_query(spark: SparkSession, sf: str) -> DataFrame:
    notes, _ = reanchor.apply(V.expected(spark, sf), V.frames(spark, sf), HOP)
    return notes.select("perf_id", "ord", F.round("onset", 6).alias("onset"), F.round("dur", 6).alias("dur"), F.round("shift", 6).alias("shift"))


QUERIES = {
    "range_join_counts": range_join_counts, "pitch_median": pitch_median, "pitch_upper_median": pitch_upper_median, "trimmed_density": trimmed_density, "assign_onsets": assign_onsets, "onset_check_ioi": onset_check_ioi,
    **{name: _judged(mode) for name, mode in MODES.items()}, "recognize": recognize_query, "recognize_summary": recognize_summary, "measure_report": measure_report, "ok_rates": ok_rates,
    "flux_threshold": flux_threshold, "peaks": peaks, "onset_times": onset_times, "spectral_flux_vec": spectral_flux_vec, "rest_gaps": rest_gaps, "pitch_runs": pitch_runs, "reanchor": reanchor_query,
}

NOTES = f"{V.V_NOTES}, {V.V_EXPECTED}"
ALL = f"{NOTES}, {V.V_ONSETS}, {V.V_FRAMES}"
MET = "v_expected e left join v_frames f on f.perf_id = e.perf_id and f.t >= e.onset and f.t < e.onset + e.dur"

#: The greedy assignment as a recursion over each performance's notes, the onsets left in a list.
ASSIGNED = """
numbered as (select *, row_number() over (partition by perf_id order by ord) as step from v_expected),
heard as (select perf_id, list(t order by t) as rest from v_onsets group by perf_id),
walk as (
  select n.perf_id, 0::bigint as step, null::double as det, coalesce(h.rest, []::double[]) as rest from (select distinct perf_id from v_expected) n left join heard h using (perf_id)
  union all
  select perf_id, step, rest[best], list_concat(rest[:best - 1], rest[best + 1:]) from (
    select w.perf_id, n.step, w.rest, list_position(list_transform(w.rest, lambda x: abs(x - n.onset)), list_min(list_transform(w.rest, lambda x: abs(x - n.onset)))) as best
    from walk w join numbered n on n.perf_id = w.perf_id and n.step = w.step + 1)),
assigned as (select n.*, w.det from numbered n join walk w using (perf_id, step))"""

CHECKED = """
checked as (
  select *, det - onset as onset_error, least(0.35::double * (60.0::double / tempo), 0.25::double) as tau, 60.0::double / tempo as beat,
    case when lag(det) over w is null then det - onset else (det - lag(det) over w) - (onset - lag(onset) over w) end as cmp, lead(det) over w as next_det, lead(onset) over w as next_onset
  from assigned window w as (partition by perf_id order by ord)),
judged as (select *, coalesce(abs(cmp) <= tau, false) as onset_ok from checked)"""


def _windowed(mode: str) -> str:
    start, end = {"detected_onset": ("det", "next_det"), "score_grid": ("onset", "next_onset"), "anchored_grid": ("onset", "least(onset + dur, next_onset)")}[mode]
    pre, post = ("0.2::double * beat", "0.35::double * beat") if mode == "anchored_grid" else ("0.0::double", "0.0::double")
    return f"""
w1 as (select *, {start} as s, case when {end} is null or {end} <= {start} then {start} + dur else {end} end as e0, dur < beat as fast, {HOP}::double as hop from judged),
w2 as (select *, case when fast then greatest(e0, s + greatest(dur, hop)) else e0 end as e from w1),
w3 as (select *, s - {pre} as t0, case when e + {post} <= s - {pre} then s - {pre} + greatest(dur, hop) else e + {post} end as t1 from w2),
met as (
  select w.perf_id, w.ord, w.fast, w.midi as want, f.midi, f.voiced, f.frame_idx, count(f.frame_idx) over p as n, row_number() over (p order by f.frame_idx) - 1 as rn
  from w3 w join v_frames f on f.perf_id = w.perf_id and f.t >= w.t0 and f.t < w.t1 window p as (partition by w.perf_id, w.ord)),
kept as (
  select *, case when fast or n <= 1 then true when 2 * greatest(1, floor(n * 0.15::double)) >= n then rn = n // 2 else rn >= greatest(1, floor(n * 0.15::double)) and rn < n - greatest(1, floor(n * 0.15::double)) end as k from met),
counted as (select perf_id, ord, count(*) filter (k) as mid_n, count(*) filter (k and voiced and abs(midi - want) <= 1.0) as valid from kept group by perf_id, ord),
m1 as (select w.*, coalesce(valid, 0) as valid, coalesce(mid_n, 0) as mid_n from w3 w left join counted using (perf_id, ord)),
m2 as (
  select *, case when t0 is null then 0 else valid end::bigint as valid_frame_count, case when t0 is null then 0.0 when fast then valid * hop when mid_n > 0 then valid::double / mid_n * dur else 0.0 end::double as duration_detected from m1),
m3 as (select *, duration_detected / dur as duration_ratio, case when fast then 'faster_than_quarter' else 'quarter_or_longer' end as duration_mode from m2),
segments as (
  select *, case when t0 is null then false when fast then valid_frame_count >= 1 else duration_ratio >= case when dur >= 2 * beat then 0.8::double else 0.5::double end end as duration_ok from m3)"""


def _segments(mode: str) -> str:
    return f"with recursive {ALL}, {ASSIGNED}, {CHECKED}, {_windowed(mode)}"


VERDICTS = f"""{_segments("anchored_grid")},
spans as (select perf_id, ord, coalesce(det, onset) as p0, coalesce(det, onset) + greatest(duration_detected, 0.001::double) as p1 from segments),
pitched as (select s.perf_id, s.ord, coalesce(median(f.midi), -1.0) as pitch_detected from spans s left join v_frames f on f.perf_id = s.perf_id and f.voiced and f.midi > 0 and f.t >= s.p0 and f.t < s.p1 group by s.perf_id, s.ord),
v1 as (select *, det is null and valid_frame_count = 0 as missed, pitch_detected >= 0 and abs(pitch_detected - midi) <= 1.0 as pitch_ok, duration_ok as rhythm_ok from segments join pitched using (perf_id, ord)),
verdicts as (select *, pitch_ok and rhythm_ok and not missed as overall from v1)"""

TIMING = "case when onset_ok and duration_ok then 'CORRECT' when duration_ok then 'ONSET_ERROR' when onset_ok then 'DURATION_ERROR' else 'BOTH_ERROR' end"
THRESHOLD = f"with {V.V_FLUX}, t as (select *, 1.6::double * avg(flux) over (partition by perf_id order by frame_idx rows between 10 preceding and 10 following) as threshold from v_flux)"
PEAKS = f"{THRESHOLD}, f as (select *, greatest(flux - threshold, 0.0) as filtered from t), p as (select *, lead(filtered) over (partition by perf_id order by frame_idx) as after from f)"

SQL = {
    "range_join_counts": f"with {ALL} select e.perf_id, e.ord, count(f.frame_idx) as n_frames, count(*) filter (f.voiced and abs(f.midi - e.midi) <= 1.0) as n_match from {MET} group by e.perf_id, e.ord",
    "pitch_median": f"with {ALL} select e.perf_id, e.ord, round(coalesce(median(case when f.voiced and f.midi > 0 then f.midi end), -1.0), 6) as pitch_detected from {MET} group by e.perf_id, e.ord",
    "pitch_upper_median": f"with {ALL} select e.perf_id, e.ord, (list_sort(list(f.midi)))[count(*) // 2 + 1] as upper_median from v_expected e join v_frames f on f.perf_id = e.perf_id and f.voiced and f.t >= e.onset - 0.1::double and f.t < e.onset + e.dur + 0.175::double group by e.perf_id, e.ord",
    "trimmed_density": f"""with {ALL}, met as (select e.perf_id, e.ord, e.midi as want, f.midi, f.voiced, f.frame_idx, count(f.frame_idx) over p as n, row_number() over (p order by f.frame_idx) - 1 as rn from {MET} window p as (partition by e.perf_id, e.ord)),
      kept as (select *, frame_idx is not null and case when n <= 1 then true when 2 * greatest(1, floor(n * 0.15::double)) >= n then rn = n // 2 else rn >= greatest(1, floor(n * 0.15::double)) and rn < n - greatest(1, floor(n * 0.15::double)) end as k from met)
      select perf_id, ord, count(frame_idx) as n_frames, count(*) filter (k) as mid_n, count(*) filter (k and voiced and abs(midi - want) <= 1.0) as valid from kept group by perf_id, ord""",
    "assign_onsets": f"with recursive {NOTES}, {V.V_ONSETS}, {ASSIGNED} select perf_id, ord, round(det, 6) as det from assigned",
    "onset_check_ioi": f"with recursive {NOTES}, {V.V_ONSETS}, {ASSIGNED}, {CHECKED} select perf_id, ord, round(onset_error, 6) as onset_error, onset_ok from judged",
    **{name: f"{_segments(mode)} select perf_id, ord, onset_ok, valid_frame_count, round(duration_detected, 6) as duration_detected, round(duration_ratio, 6) as duration_ratio, duration_mode, duration_ok, {TIMING} as timing_result from segments" for name, mode in MODES.items()},
    "recognize": f"""{VERDICTS} select perf_id, ord, measure, idx, round(onset_error, 6) as onset_error, onset_ok, round(pitch_detected, 6) as pitch_detected, pitch_ok, duration_ok, missed, overall,
      concat_ws(',', case when missed then 'missed' end, case when not onset_ok then 'onset' end, case when not duration_ok then 'duration' end, case when not pitch_ok then 'pitch' end) as error_dims from verdicts""",
    "recognize_summary": f"""{VERDICTS} select perf_id, count(*) as total, count(*) filter (overall) as correct, count(*) filter (not onset_ok) as onset_errors, count(*) filter (not duration_ok) as duration_errors, count(*) filter (not pitch_ok) as pitch_errors,
      count(*) filter (missed) as missed, round(count(*) filter (overall) / count(*), 6) as accuracy from verdicts group by perf_id""",
    "measure_report": f"{VERDICTS} select perf_id, measure, count(*) filter (rhythm_ok) as hits, count(*) as notes, string_agg(midi::int::varchar || case when rhythm_ok then '+' else '-' end, ' ' order by ord) as line from verdicts group by perf_id, measure",
    "ok_rates": f"{VERDICTS} select count(*) as n, count(*) filter (rhythm_ok) as rhythm_ok, round(count(*) filter (rhythm_ok) / count(*), 3) as rhythm_rate, count(*) filter (onset_ok) as onset_ok, round(count(*) filter (onset_ok) / count(*), 3) as onset_rate from verdicts",
    "flux_threshold": f"{THRESHOLD} select perf_id, frame_idx, round(threshold, 6) as threshold from t",
    "peaks": f"{PEAKS} select perf_id, frame_idx from p where filtered > after and filtered >= 0.0001",
    "onset_times": f"{PEAKS} select perf_id, round(frame_idx * 512.0::double / 22050.0::double, 6) as t from p where filtered > after and filtered >= 0.0001",
    "spectral_flux_vec": f"""with {V.V_FEAT}, l as (select *, lag(vec) over (partition by seq_id order by idx) as before from v_feat)
      select seq_id, idx, round(list_sum(list_transform(generate_series(1, len(vec)), lambda i: greatest(vec[i] - coalesce(before[i], 0.0), 0.0))), 5) as flux from l""",
    "rest_gaps": f"with {NOTES}, g as (select *, onset - lag(onset + dur) over (partition by perf_id order by ord) as gap, 60.0::double / tempo as beat from v_expected) select perf_id, ord, round(gap, 6) as gap from g where gap >= 0.5::double * beat - 1e-9",
    "pitch_runs": f"""with {ALL}, a as (select *, case when t - lag(t) over (partition by perf_id order by t) <= 0.15::double then 0 else 1 end as fresh from v_frames where voiced),
      b as (select *, sum(fresh) over (partition by perf_id order by t rows unbounded preceding) as island from a) select perf_id, round(min(t), 6) as run_start, round(max(t), 6) as run_end, count(*) as n from b group by perf_id, island""",
}
