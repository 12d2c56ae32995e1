"""Queries on scores: timelines, intervals, lookups, validation, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import contract, timeline
from ..operators.rangejoin import covering
from . import views as V


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    return V.notes(spark, sf).withColumnRenamed("perf_id", "score_id")


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return _notes(spark, sf).groupBy("score_id").agg(F.max("measure").cast("int").alias("total_measures"))


def timeline_onsets(spark: SparkSession, sf: str) -> DataFrame:
    n = timeline.running_onsets(V.notes(spark, sf).withColumn("sec", F.col("q").cast("double") / 4), "perf_id", "ord", "sec")
    return n.select("perf_id", "ord", F.round("onset", 6).alias("onset"))


def chord_anchor(spark: SparkSession, sf: str) -> DataFrame:
    n = V.notes(spark, sf).withColumn("is_chord", F.col("l_partkey") % 5 == 0)
    return timeline.chord_onsets(n, "perf_id", "ord").select("perf_id", "ord", F.round("onset", 6).alias("onset"))


def tempo_ffill(spark: SparkSession, sf: str) -> DataFrame:
    n = V.notes(spark, sf).withColumn("tempo", F.when(F.col("l_partkey") % 23 == 0, F.col("q") * 4.0))
    return timeline.in_force(n, "perf_id", "ord", "tempo", 120.0).select("perf_id", "ord", "tempo")


def _tempo_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A tempo mark every tenth note, an offset of three units late."""
    n = V.notes(spark, sf).where("l_partkey % 10 = 0")
    marks = n.groupBy("perf_id", (F.col("cum") + 3).cast("double").alias("div")).agg(F.max(F.col("q") + 50.0).alias("tempo"))
    return marks


def tempo_offset_asof(spark: SparkSession, sf: str) -> DataFrame:
    n = V.notes(spark, sf).select("perf_id", "ord", F.col("cum").cast("double").alias("div"))
    return timeline.tempo_at(n, _tempo_changes(spark, sf), "perf_id").select("perf_id", "ord", F.coalesce("tempo", F.lit(60.0)).alias("tempo"))


def tempo_pieces(spark: SparkSession, sf: str) -> DataFrame:
    n = V.notes(spark, sf).select("perf_id", "ord", F.col("cum").cast("double").alias("div"), F.col("q").cast("double").alias("ticks"))
    out = timeline.piecewise_seconds(n, _tempo_changes(spark, sf), "perf_id", 4.0, 60.0)
    return out.select("perf_id", "ord", F.round("start_sec", 4).alias("start_sec"), F.round("end_sec", 4).alias("end_sec"))


def multirest_expand(spark: SparkSession, sf: str) -> DataFrame:
    m = V.notes(spark, sf).groupBy("perf_id", "measure").agg(F.min("l_partkey").alias("p"))
    m = m.select("perf_id", "measure", F.lit(2.0).alias("bar_sec"), F.when(F.col("p") % 13 == 0, F.col("p") % 3 + 2).alias("rest_bars"))
    return timeline.multiple_rests(m, "perf_id").select("perf_id", "measure", "skipped", "onset")


def score_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.catalogue(_scores(spark, sf), _notes(spark, sf))


def measure_notes(spark: SparkSession, sf: str) -> DataFrame:
    """The notes of every piece's third measure."""
    return timeline.in_measure(_notes(spark, sf), 3).select("score_id", "ord", "measure", F.round("onset", 6).alias("onset"), "pitch_midi")


def interval_partition(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.intervals(_scores(spark, sf))


def notes_per_interval(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.notes_per_interval(_scores(spark, sf), _notes(spark, sf).where("not is_rest"))


def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    n = _notes(spark, sf)
    return n.groupBy("score_id").agg(F.count_if(~F.col("is_rest")).alias("note_count"), F.max("measure").cast("int").alias("total_measures"), F.ceil(F.max("measure") / 4).cast("int").alias("interval_count"), F.min_by("pitch_midi", "ord").alias("first_pitch"), F.max_by("pitch_midi", "ord").alias("last_pitch"))


def note_index(spark: SparkSession, sf: str) -> DataFrame:
    return timeline.numbered(_notes(spark, sf)).select("score_id", "ord", F.col("note_index_in_measure").cast("int").alias("note_index_in_measure"))


def practice_slice(spark: SparkSession, sf: str) -> DataFrame:
    n = _notes(spark, sf)
    starts = n.where("ord = 11").select("score_id", "measure").join(timeline.numbered(n).where("ord = 11").select("score_id", F.col("note_index_in_measure").alias("note_index")), "score_id")
    starts = starts.where("score_id % 2 = 0")
    return timeline.practice_slice(n, starts).select("score_id", "ord", F.round("onset", 6).alias("onset"))


def start_lookup(spark: SparkSession, sf: str) -> DataFrame:
    n = timeline.numbered(_notes(spark, sf))
    return n.where("note_index_in_measure = 2").select("score_id", "measure", "ord", F.round("onset", 6).alias("onset"))


def resolve_nth_note(spark: SparkSession, sf: str) -> DataFrame:
    """The first note of each measure by beat and onset, where beats run backwards in the list."""
    n = _notes(spark, sf).where("not is_rest").withColumn("beat", (F.col("l_partkey") % 4 + 1).cast("double"))
    rank = F.row_number().over(Window.partitionBy("score_id", "measure").orderBy("beat", "onset", "ord"))
    return n.withColumn("nth", rank).where("nth = 1").select("score_id", "measure", "ord", "beat")


def template_t0(spark: SparkSession, sf: str) -> DataFrame:
    e = timeline.calibrate(_events(spark, sf), "perf_id", "duration")
    rank = F.row_number().over(Window.partitionBy("perf_id", "measure").orderBy("beat", "start_sec", "note_id"))
    return e.withColumn("nth", rank).where("nth = 1 and measure = 3").select("perf_id", "note_id", F.round("start_sec", 6).alias("t0"))


def score_violations(spark: SparkSession, sf: str) -> DataFrame:
    n = timeline.numbered(_notes(spark, sf)).withColumn("duration", F.when(F.col("q") % 10 == 0, 0.0).otherwise(F.col("dur"))).withColumn("tempo", F.when(F.col("l_partkey") % 31 == 0, F.lit(float("nan"))).when(F.col("l_partkey") % 29 == 0, -1.0).otherwise(120.0))
    n = n.withColumn("pitch_midi", F.when(F.col("l_partkey") % 19 != 0, F.col("pitch_midi"))).withColumn("measure", F.col("measure") - 1)
    return contract.note_violations(n).select("score_id", "ord", F.array_join("violations", ",").alias("violations"))


def track_violations(spark: SparkSession, sf: str) -> DataFrame:
    e = V.load(spark, sf, "events").select("event_id", (F.col("event_id") % 5 * 22050).cast("int").alias("sample_rate"), F.when(F.col("event_id") % 7 > 0, 512).alias("frame_size"), (F.col("value") - 5).alias("window_duration_sec"))
    return contract.track_violations(e).select("event_id", F.array_join("violations", ",").alias("violations"))


def template_map(spark: SparkSession, sf: str) -> DataFrame:
    """A given template wins over the mapped one."""
    s = V.load(spark, sf, "supplier").select(F.col("s_suppkey").alias("score_id"), F.col("s_nationkey").alias("map_key"), F.when(F.col("s_suppkey") % 9 == 0, F.lit("override")).alias("given"))
    m = V.load(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("map_key"), F.col("n_name").alias("template_id"))
    return s.join(m, "map_key", "left").select("score_id", F.coalesce("given", "template_id").alias("template_id"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Note events of a template, its recording a tenth longer than the score."""
    n = V.notes(spark, sf).where("not is_rest")
    last = F.max(F.col("onset") + F.col("dur")).over(Window.partitionBy("perf_id"))
    return n.select("perf_id", F.col("ord").alias("note_id"), "measure", (F.col("l_partkey") % 4 + 1).cast("double").alias("beat"), F.col("onset").alias("start_sec"), (F.col("onset") + F.col("dur")).alias("end_sec"), (last * F.lit(1.1)).alias("duration"))


def calibrate_events(spark: SparkSession, sf: str) -> DataFrame:
    e = timeline.calibrate(_events(spark, sf), "perf_id", "duration", 0.5)
    return e.select("perf_id", "note_id", F.round("scale", 6).alias("scale"), F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"))


def _nearest(closed: bool):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        n = V.notes(spark, sf)
        points = n.select("perf_id", F.col("ord").alias("point_id"), (F.col("onset") + (F.col("l_partkey") % 7) * F.lit(0.05)).alias("t"))
        return covering(points, _events(spark, sf).select("perf_id", "note_id", "start_sec", "end_sec"), "perf_id", closed).select("perf_id", "point_id", "note_id", "covered")

    return query


def beat_tolerant_index(spark: SparkSession, sf: str) -> DataFrame:
    """In each measure the index of the note on beat 2.005, or of the one nearest to it."""
    e = _events(spark, sf)
    w = Window.partitionBy("perf_id", "measure").orderBy("note_id")
    e = e.withColumn("i", F.row_number().over(w)).withColumn("d", F.abs(F.col("beat") - F.lit(2.005)))
    best = F.min_by("i", F.struct(F.when(F.col("d") < 0.01, 0).otherwise(1), F.when(F.col("d") < 0.01, 0.0).otherwise(F.col("d")), F.col("i")))
    return e.groupBy("perf_id", "measure").agg(best.cast("int").alias("note_index"))


def interval_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Score data back to notes: rests dropped, pitches rounded to the even half."""
    n = _notes(spark, sf).where("not is_rest").withColumn("p", F.col("pitch_midi") + F.col("l_partkey") % 2 * 0.5)
    return n.select("score_id", "ord", F.bround("p").cast("int").alias("pitch_midi"))


QUERIES = {
    "timeline_onsets": timeline_onsets, "chord_anchor": chord_anchor, "tempo_ffill": tempo_ffill, "tempo_offset_asof": tempo_offset_asof, "tempo_pieces": tempo_pieces, "multirest_expand": multirest_expand,
    "score_catalogue": score_catalogue, "measure_notes": measure_notes, "interval_partition": interval_partition, "notes_per_interval": notes_per_interval, "score_summary": score_summary, "note_index": note_index, "practice_slice": practice_slice, "start_lookup": start_lookup,
    "resolve_nth_note": resolve_nth_note, "template_t0": template_t0, "score_violations": score_violations, "track_violations": track_violations, "template_map": template_map, "calibrate_events": calibrate_events,
    "nearest_note_halfopen": _nearest(False), "nearest_note_closed": _nearest(True), "beat_tolerant_index": beat_tolerant_index, "score_round_trip": interval_round_trip,
}

N = f"with {V.V_NOTES}"
EVENTS = """v_events as (select perf_id, ord as note_id, measure, (l_partkey % 4 + 1)::double as beat, onset as start_sec, onset + dur as end_sec, max(onset + dur) over (partition by perf_id) * 1.1::double as duration from v_notes where not is_rest)"""
MARKS = "marks as (select perf_id, (cum + 3)::double as div, max(q + 50.0::double) as tempo from v_notes where l_partkey % 10 = 0 group by all)"
POINTS = "points as (select perf_id, ord as point_id, onset + (l_partkey % 7) * 0.05::double as t from v_notes)"


def _nearest_sql(op: str) -> str:
    return f"""{N}, {EVENTS}, {POINTS},
      c as (select perf_id, point_id, arg_min(note_id, row(e.end_sec - e.start_sec, e.note_id)) as own from points p join v_events e using (perf_id) where p.t >= e.start_sec and p.t {op} e.end_sec group by perf_id, point_id),
      n as (select perf_id, point_id, arg_min(note_id, row(abs(e.start_sec - p.t), e.start_sec, e.note_id)) as near from points p join v_events e using (perf_id) group by perf_id, point_id)
      select perf_id, point_id, coalesce(own, near) as note_id, own is not null as covered from n left join c using (perf_id, point_id)"""


SQL = {
    "timeline_onsets": f"{N} select perf_id, ord, round(coalesce(sum(q / 4.0::double) over (partition by perf_id order by ord rows between unbounded preceding and 1 preceding), 0.0), 6) as onset from v_notes",
    "chord_anchor": f"{N} select perf_id, ord, round(coalesce(last_value(case when l_partkey % 5 <> 0 then onset end ignore nulls) over (partition by perf_id order by ord rows unbounded preceding), onset), 6) as onset from v_notes",
    "tempo_ffill": f"{N} select perf_id, ord, coalesce(last_value(case when l_partkey % 23 = 0 then q * 4.0::double end ignore nulls) over (partition by perf_id order by ord rows unbounded preceding), 120.0)::double as tempo from v_notes",
    "tempo_offset_asof": f"{N}, {MARKS} select n.perf_id, n.ord, coalesce(m.tempo, 60.0)::double as tempo from v_notes n asof left join marks m on n.perf_id = m.perf_id and n.cum >= m.div",
    "tempo_pieces": f"""{N}, {MARKS}, pieces as (select perf_id, div, tempo, coalesce(sum((nxt - div) / 4.0 * 60.0 / tempo) over (partition by perf_id order by div rows between unbounded preceding and 1 preceding), 0.0) as at from
        (select *, lead(div) over (partition by perf_id order by div) as nxt from (select * from marks union all select distinct perf_id, 0.0::double, 60.0::double from v_notes)))
      select n.perf_id, n.ord, round(a.at + (n.cum - a.div) / 4.0 * 60.0 / a.tempo, 4) as start_sec, round(b.at + (n.cum + n.q - b.div) / 4.0 * 60.0 / b.tempo, 4) as end_sec
      from v_notes n asof join pieces a on n.perf_id = a.perf_id and n.cum >= a.div asof join pieces b on n.perf_id = b.perf_id and n.cum + n.q >= b.div""",
    "multirest_expand": f"""{N}, m as (select perf_id, measure, case when min(l_partkey) % 13 = 0 then min(l_partkey) % 3 + 2 end as bars from v_notes group by all),
      s as (select *, coalesce(measure <= max(case when bars > 1 then measure + bars - 1 end) over (partition by perf_id order by measure rows between unbounded preceding and 1 preceding), false) as skipped from m)
      select perf_id, measure, skipped, coalesce(sum(case when skipped then 0.0 else 2.0 * coalesce(bars, 1) end::double) over (partition by perf_id order by measure rows between unbounded preceding and 1 preceding), 0.0)::double as onset from s""",
    "score_catalogue": f"{N} select perf_id as score_id, perf_id::varchar as title, max(measure)::int as total_measures, ceil(max(measure) / 4.0)::int as interval_count, count(*) as note_count from v_notes group by perf_id",
    "measure_notes": f"{N} select perf_id as score_id, ord, measure, round(onset, 6) as onset, pitch_midi from v_notes where measure = 3",
    "interval_partition": f"{N}, s as (select perf_id as score_id, max(measure)::int as total from v_notes group by all), i as (select *, unnest(generate_series(1, total, 4))::int as start_measure from s) select score_id, ((start_measure - 1) // 4)::int as id, start_measure, least(start_measure + 3, total)::int as end_measure from i",
    "notes_per_interval": f"""{N}, s as (select perf_id as score_id, max(measure)::int as total from v_notes group by all), i as (select *, unnest(generate_series(1, total, 4))::int as start_measure from s)
      select score_id, ((start_measure - 1) // 4)::int as id, start_measure, least(start_measure + 3, total)::int as end_measure, count(n.ord) as note_count from i left join v_notes n on n.perf_id = score_id and not n.is_rest and (n.measure - 1) // 4 = (start_measure - 1) // 4 group by all""",
    "score_summary": f"{N} select perf_id as score_id, count(*) filter (not is_rest) as note_count, max(measure)::int as total_measures, ceil(max(measure) / 4.0)::int as interval_count, arg_min(pitch_midi, ord) as first_pitch, arg_max(pitch_midi, ord) as last_pitch from v_notes group by all",
    "note_index": f"{N} select perf_id as score_id, ord, (row_number() over (partition by perf_id, measure order by ord))::int as note_index_in_measure from v_notes",
    "practice_slice": f"{N} select n.perf_id as score_id, n.ord, round(n.onset - coalesce(a.onset, 0.0), 6) as onset from v_notes n left join v_notes a on a.perf_id = n.perf_id and a.ord = 11 and a.perf_id % 2 = 0 where a.ord is null or n.ord >= 11",
    "start_lookup": f"{N} select perf_id as score_id, measure, ord, round(onset, 6) as onset from v_notes qualify row_number() over (partition by perf_id, measure order by ord) = 2",
    "resolve_nth_note": f"{N} select perf_id as score_id, measure, ord, (l_partkey % 4 + 1)::double as beat from v_notes where not is_rest qualify row_number() over (partition by perf_id, measure order by l_partkey % 4, onset, ord) = 1",
    "template_t0": f"{N}, {EVENTS} select perf_id, note_id, round(start_sec * (duration / max(end_sec) over (partition by perf_id)), 6) as t0 from v_events qualify measure = 3 and row_number() over (partition by perf_id, measure order by beat, start_sec, note_id) = 1",
    "score_violations": f"""{N} select perf_id as score_id, ord, concat_ws(',', case when measure - 1 < 1 then 'measure' end, case when q % 10 = 0 then 'duration' end, case when l_partkey % 31 = 0 or l_partkey % 29 = 0 then 'tempo' end, case when not is_rest and l_partkey % 19 = 0 then 'pitch' end) as violations from v_notes""",
    "track_violations": "select event_id, concat_ws(',', case when event_id % 5 = 0 then 'sample_rate' end, case when event_id % 7 = 0 then 'frame_size' end, case when value - 5 <= 0 then 'window_duration' end) as violations from events",
    "template_map": "select s_suppkey as score_id, case when s_suppkey % 9 = 0 then 'override' else n_name end as template_id from supplier left join nation on n_nationkey = s_nationkey and n_nationkey % 2 = 0",
    "calibrate_events": f"{N}, {EVENTS}, s as (select *, greatest(duration - 0.5, 1e-6) / max(end_sec) over (partition by perf_id) as scale from v_events) select perf_id, note_id, round(scale, 6) as scale, round(0.5 + start_sec * scale, 6) as start_sec, round(0.5 + end_sec * scale, 6) as end_sec from s",
    "nearest_note_halfopen": _nearest_sql("<"),
    "nearest_note_closed": _nearest_sql("<="),
    "beat_tolerant_index": f"{N}, {EVENTS}, i as (select *, row_number() over (partition by perf_id, measure order by note_id) as i, abs(beat - 2.005::double) as d from v_events) select perf_id, measure, arg_min(i, row(d >= 0.01, case when d < 0.01 then 0.0 else d end, i))::int as note_index from i group by all",
    "score_round_trip": f"{N} select perf_id as score_id, ord, round_even(pitch_midi + l_partkey % 2 * 0.5::double, 0)::int as pitch_midi from v_notes where not is_rest",
}
