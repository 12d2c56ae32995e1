"""Checks of interchange data as columns: each row's violations; strict mode raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.0"


def violations(**rules: Column) -> Column:
    """The names of the rules that do not hold; a rule that is null does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def note_violations(notes: DataFrame) -> DataFrame:
    """Adds violations to note rows (measure, note_index_in_measure, duration, tempo, pitch_midi, is_rest)."""
    return notes.withColumn("violations", violations(
        measure=F.col("measure") >= 1, note_index=F.col("note_index_in_measure") >= 1, duration=F.col("duration") > 0, tempo=(F.col("tempo") > 0) & ~F.isnan("tempo"), pitch=F.col("is_rest") | F.col("pitch_midi").isNotNull(),
    ))


def track_violations(tracks: DataFrame) -> DataFrame:
    """Adds violations to track headers (sample_rate, frame_size, window_duration_sec)."""
    return tracks.withColumn("violations", violations(sample_rate=F.col("sample_rate") > 0, frame_size=F.col("frame_size") > 0, window_duration=(F.col("window_duration_sec") > 0) & ~F.isnan("window_duration_sec")))


def strict(checked: DataFrame, what: str) -> DataFrame:
    """The rows, or an error that names what the first bad one violates."""
    return checked.withColumn("violations", F.when(F.size("violations") == 0, F.col("violations")).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.array_join("violations", ", "))).cast("array<string>"))).where("size(violations) = 0").drop("violations")


def to_expected(notes: DataFrame) -> DataFrame:
    """Notes that sound as (perf_id, ord, onset, dur, midi, ...); one without a pitch is an error that names it."""
    sounding = notes.where(~F.col("is_rest"))
    named = F.concat(F.lit("note without pitch: measure "), F.col("measure").cast("string"), F.lit(" index "), F.col("note_index_in_measure").cast("string"))
    return sounding.withColumn("midi", F.when(F.col("pitch_midi").isNotNull(), F.col("pitch_midi")).otherwise(F.raise_error(named).cast("double")))
