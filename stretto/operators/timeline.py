"""Score timelines as window sums: tempo in force, running onsets, chords, multiple rests, intervals of measures, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.music import interval_of, sec_per_quarter


def in_force(items: DataFrame, key: str, order: str, value: str, default: float) -> DataFrame:
    """Fills value forward: the last one given up to each item, default before the first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default)))


def running_onsets(items: DataFrame, key: str, order: str, seconds: str) -> DataFrame:
    """Adds onset: the seconds of all items before."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("onset", F.coalesce(F.sum(seconds).over(w), F.lit(0.0)))


def chord_onsets(items: DataFrame, key: str, order: str) -> DataFrame:
    """A chord tone (is_chord) takes the onset of the last item that is none."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.last(F.when(~F.col("is_chord"), F.col("onset")), ignorenulls=True).over(w)
    return items.withColumn("onset", F.coalesce(anchor, F.col("onset")))


def tempo_at(notes: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """As-of join by one sort: each note (key, div, ...) with the tempo of the last change (key, div, tempo) at or before it."""
    both = notes.withColumn("tempo", F.lit(None).cast("double")).withColumn("_note", F.lit(1)).unionByName(changes.withColumn("_note", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("div", "_note").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("tempo", F.last("tempo", ignorenulls=True).over(w)).where("_note = 1").drop("_note")


def piecewise_seconds(notes: DataFrame, changes: DataFrame, key: str, divisions: float, default: float) -> DataFrame:
    """Adds start_sec and end_sec under tempo changes anywhere, also inside a note: changes (key, div, tempo) cut time into pieces.

    Each end of a note meets the piece it lies in by an as-of sort; a piece's own start is a running sum over changes.
    """
    first = notes.select(key).distinct().withColumn("div", F.lit(0.0)).withColumn("tempo", F.lit(default)).withColumn("_given", F.lit(0))
    pieces = first.unionByName(changes.select(key, F.col("div").cast("double").alias("div"), "tempo").withColumn("_given", F.lit(1)))
    w = Window.partitionBy(key).orderBy("div", "_given")
    length = (F.lead("div").over(w) - F.col("div")) / divisions * sec_per_quarter(F.col("tempo"))
    before = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    pieces = pieces.withColumn("at", before).withColumn("piece", F.struct("div", "at", "tempo")).select(key, "div", "piece", F.lit(0).alias("_kind"))
    numbered = notes.withColumn("_id", F.struct(*[c for c in notes.columns]))
    ends = numbered.select(key, "_id", F.explode(F.array(F.struct(F.lit("start_sec").alias("e"), F.col("div").cast("double").alias("div")), F.struct(F.lit("end_sec").alias("e"), (F.col("div") + F.col("ticks")).cast("double").alias("div")))).alias("x"))
    both = pieces.unionByName(ends.select(key, F.col("x.div").alias("div"), F.col("x.e").alias("e"), "_id", F.lit(1).alias("_kind")), allowMissingColumns=True)
    last = F.last("piece", ignorenulls=True).over(Window.partitionBy(key).orderBy("div", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    placed = both.withColumn("p", last).where("_kind = 1").withColumn("sec", F.col("p.at") + (F.col("div") - F.col("p.div")) / divisions * sec_per_quarter(F.col("p.tempo")))
    pivot = placed.groupBy("_id").agg(F.max(F.when(F.col("e") == "start_sec", F.col("sec"))).alias("start_sec"), F.max(F.when(F.col("e") == "end_sec", F.col("sec"))).alias("end_sec"))
    return pivot.select("_id.*", "start_sec", "end_sec")


def multiple_rests(measures: DataFrame, key: str) -> DataFrame:
    """Measures (key, measure, bar_sec, rest_bars or null) with their start: a rest over N bars adds them to its first measure,
    and the N - 1 after it are skipped."""
    w = Window.partitionBy(key).orderBy("measure")
    covered = F.max(F.when(F.col("rest_bars") > 1, F.col("measure") + F.col("rest_bars") - 1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = measures.withColumn("skipped", F.coalesce(F.col("measure") <= covered, F.lit(False)))
    length = F.when(F.col("skipped"), 0.0).otherwise(F.col("bar_sec") * F.coalesce("rest_bars", F.lit(1)))
    return running_onsets(rows.withColumn("_len", length), key, "measure", "_len").drop("_len")


def intervals(scores: DataFrame, size: int = 4) -> DataFrame:
    """score_id, id, start_measure, end_measure for scores (score_id, total_measures); none for a score without measures."""
    if size <= 0:
        raise ValueError("an interval has one measure at least")
    starts = scores.where("total_measures > 0").withColumn("start_measure", F.explode(F.sequence(F.lit(1), F.col("total_measures").cast("int"), F.lit(size))))
    return starts.select("score_id", F.floor((F.col("start_measure") - 1) / size).cast("int").alias("id"), "start_measure", F.least(F.col("start_measure") + size - 1, F.col("total_measures").cast("int")).alias("end_measure"))


def notes_per_interval(scores: DataFrame, notes: DataFrame, size: int = 4) -> DataFrame:
    """intervals with note_count, 0 where there are no notes (score_id, measure)."""
    counts = notes.groupBy("score_id", interval_of(F.col("measure"), size).alias("id")).agg(F.count("*").alias("note_count"))
    return intervals(scores, size).join(counts, ["score_id", "id"], "left").withColumn("note_count", F.coalesce("note_count", F.lit(0)))


def catalogue(scores: DataFrame, notes: DataFrame, size: int = 4) -> DataFrame:
    """score_id, title, total_measures, interval_count, note_count of scores (score_id, total_measures and a title, if any)."""
    counts = notes.groupBy("score_id").agg(F.count("*").alias("note_count"))
    title = F.col("title") if "title" in scores.columns else F.col("score_id").cast("string")
    bars = F.col("total_measures").cast("int")
    rows = scores.select("score_id", title.alias("title"), bars.alias("total_measures"), F.greatest(F.lit(0), F.ceil(bars / size)).cast("int").alias("interval_count"))
    return rows.join(counts, "score_id", "left").withColumn("note_count", F.coalesce("note_count", F.lit(0)))


def in_measure(notes: DataFrame, measure: int, key: str = "score_id") -> DataFrame:
    """The notes of one measure, in their order within it."""
    return notes.where(F.col("measure") == measure).orderBy(key, *["ord"] if "ord" in notes.columns else ["beat", "start_sec", "note_id"])


def calibrate(events: DataFrame, key: str, duration: str, offset: float = 0.0) -> DataFrame:
    """Stretches start_sec and end_sec so that the last end falls on the recording's duration; adds scale."""
    last = F.max("end_sec").over(Window.partitionBy(key))
    rows = events.withColumn("scale", F.greatest(F.col(duration) - offset, F.lit(1e-6)) / last)
    return rows.withColumn("start_sec", F.lit(offset) + F.col("start_sec") * F.col("scale")).withColumn("end_sec", F.lit(offset) + F.col("end_sec") * F.col("scale"))


def numbered(notes: DataFrame, key: str = "score_id") -> DataFrame:
    """Adds note_index_in_measure: from 1, in the order of the list."""
    return notes.withColumn("note_index_in_measure", F.row_number().over(Window.partitionBy(key, "measure").orderBy("ord")))


def practice_slice(notes: DataFrame, starts: DataFrame, key: str = "score_id") -> DataFrame:
    """Notes from each score's start (key, measure, note_index; null or absent: the first note) on, onsets from there.

    A start that does not exist is an error, as is an index below 1.
    """
    n = numbered(notes, key)
    s = starts.select(key, F.col("measure").alias("_m"), F.col("note_index").alias("_i"))
    checked = n.join(s, key, "left")
    w = Window.partitionBy(key)
    hit = F.min(F.when((F.col("measure") == F.col("_m")) & (F.col("note_index_in_measure") == F.col("_i")), F.col("ord"))).over(w)
    first = F.min("ord").over(w)
    wanted = F.col("_m").isNotNull()
    anchor = F.when(~wanted, first).when(hit.isNotNull(), hit).otherwise(F.raise_error(F.lit("no such start note")).cast("bigint"))
    rows = checked.withColumn("_anchor", anchor).where("ord >= _anchor")
    base = F.first("onset").over(Window.partitionBy(key).orderBy("ord"))
    return rows.withColumn("onset", F.col("onset") - base).drop("_m", "_i", "_anchor")
