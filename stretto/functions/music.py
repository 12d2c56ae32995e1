"""Scalar functions of pitch, time and notation as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import A4_HZ

# Names and tables of the notation.
NOTE_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
FLAT_NAMES = ["C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B"]
STEP_SEMITONES = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
KEYS_BY_FIFTHS = {-7: "Cb major", -6: "Gb major", -5: "Db major", -4: "Ab major", -3: "Eb major", -2: "Bb major", -1: "F major", 0: "C major", 1: "G major", 2: "D major", 3: "A major", 4: "E major", 5: "B major", 6: "F# major", 7: "C# major"}
BEAT_UNITS = {
    "maxima": 32.0, "long": 16.0, "breve": 8.0, "whole": 4.0, "half": 2.0, "quarter": 1.0, "eighth": 0.5, "16th": 0.25, "32nd": 0.125,
    "64th": 0.0625, "128th": 0.03125, "256th": 0.015625, "512th": 0.0078125, "1024th": 0.00390625,
}


def table(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def hz_to_midi(hz: Column, a4: float = A4_HZ) -> Column:
    return F.when(hz <= 0, -1.0).otherwise(F.lit(69.0) + F.lit(12.0) * F.log2(F.when(hz > 0, hz) / F.lit(a4)))


def midi_to_hz(midi: Column, a4: float = A4_HZ) -> Column:
    return F.when(midi < 0, 0.0).otherwise(F.lit(a4) * F.pow(F.lit(2.0), (midi - F.lit(69.0)) / F.lit(12.0)))


def named(number: Column, names: list[str]) -> Column:
    """Name and octave of a whole midi number."""
    return F.concat(F.element_at(F.array(*map(F.lit, names)), (F.pmod(number, F.lit(12)) + 1).cast("int")), (F.floor(number / F.lit(12.0)) - 1).cast("int").cast("string"))


def midi_to_name(midi: Column) -> Column:
    """Sharp name of the nearest semitone, halves to the even one; null for a missing or negative pitch."""
    return F.when(midi >= 0, named(F.bround(midi).cast("int"), NOTE_NAMES))


def hz_to_name(hz: Column, a4: float = A4_HZ) -> Column:
    return F.when(hz > 0, named(F.bround(hz_to_midi(hz, a4)).cast("int"), NOTE_NAMES))


def written_name(midi: Column) -> Column:
    """Flat name a whole tone higher, as a B flat instrument reads it; ? without a pitch."""
    return F.coalesce(F.when(midi >= 0, named(F.bround(midi).cast("int") + 2, FLAT_NAMES)), F.lit("?"))


def spelled_name(step: Column, alter: Column, octave: Column) -> Column:
    sign = F.element_at(table({-2: "bb", -1: "b", 0: "", 1: "#", 2: "##"}), alter.cast("int"))
    return F.concat(step, F.coalesce(sign, F.lit("")), octave.cast("int").cast("string"))


def spelled_midi(step: Column, alter: Column, octave: Column, chromatic: Column) -> Column:
    return ((octave + 1) * 12 + F.element_at(table(STEP_SEMITONES), step) + F.coalesce(alter, F.lit(0)) + F.coalesce(chromatic, F.lit(0))).cast("int")


def key_name(fifths: Column) -> Column:
    return F.coalesce(F.element_at(table(KEYS_BY_FIFTHS), fifths.cast("int")), F.concat(fifths.cast("int").cast("string"), F.lit(" fifths")))


def quarter_tempo(per_minute: Column, unit: Column, dots: Column) -> Column:
    """Quarters a minute of a metronome mark; an unknown unit counts as a quarter, each dot half as much again."""
    return per_minute * F.coalesce(F.element_at(table(BEAT_UNITS), unit), F.lit(1.0)) * F.pow(F.lit(1.5), dots.cast("double"))


def sec_per_quarter(tempo: Column) -> Column:
    return F.lit(60.0) / F.greatest(tempo, F.lit(1e-6))


def measure_sec(beats: Column, beat_type: Column, tempo: Column) -> Column:
    return beats * F.lit(4.0) / beat_type * sec_per_quarter(tempo)


def ticks_sec(ticks: Column, divisions: Column, tempo: Column) -> Column:
    return ticks / divisions * sec_per_quarter(tempo)


def beat_in_quarters(ticks: Column, divisions: Column) -> Column:
    return ticks / divisions + F.lit(1.0)


def beat_in_beats(ticks: Column, divisions: Column, beat_type: Column) -> Column:
    return ticks / (divisions * F.lit(4.0) / beat_type) + F.lit(1.0)


def frame_to_sec(frame: Column, hop: int = 512, rate: int = 22050) -> Column:
    return frame * F.lit(float(hop)) / F.lit(float(rate))


def sec_to_frame(sec: Column, hop: int = 512, rate: int = 22050) -> Column:
    return F.bround(sec * F.lit(float(rate)) / F.lit(float(hop))).cast("int")


def timing_result(onset_ok: Column, duration_ok: Column) -> Column:
    return F.when(onset_ok & duration_ok, "CORRECT").when(duration_ok, "ONSET_ERROR").when(onset_ok, "DURATION_ERROR").otherwise("BOTH_ERROR")


def cost_score(cost: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + cost)


def slug(name: Column) -> Column:
    """Letters, digits, hyphens and underscores of a name, all else one underscore; 48 characters at most, score if none is left."""
    kept = F.regexp_replace(F.trim(name), r"[^\p{L}\p{N}_-]+", "_")
    s = F.substring(F.regexp_replace(F.regexp_replace(kept, "_+", "_"), "^_+|_+$", ""), 1, 48)
    return F.when(F.length(s) > 0, s).otherwise("score")


def interval_of(measure: Column, size: int = 4) -> Column:
    """The interval (from 0) of a measure; a measure below 1 is an error."""
    return F.when(measure >= 1, F.floor((measure - 1) / F.lit(float(size))).cast("int")).otherwise(F.raise_error(F.lit("measure numbers begin at 1")).cast("int"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def frame_cost(a: Column, b: Column, metric: str = "l2") -> Column:
    """Distance of two vectors: l2, or 1 - cosine (1 where a vector has next to no length)."""
    if metric == "l2":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return F.when((norm(a) < 1e-8) | (norm(b) < 1e-8), 1.0).otherwise(F.lit(1.0) - dot(a, b) / (norm(a) * norm(b)))
