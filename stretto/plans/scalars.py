"""Queries of scalar functions over rows of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import config as C
from ..functions import music as M
from .views import load


def hz_midi_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").withColumn("hz", F.col("value") * 8 - 20)
    midi = M.hz_to_midi(F.col("hz"))
    return e.select("event_id", F.round(midi, 6).alias("midi"), F.round(M.midi_to_hz(midi), 6).alias("hz_back"))


def pitch_names(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").withColumn("hz", F.col("value") * 8 - 20).withColumn("midi", F.col("event_id") % 256 / 2.0 - 5)
    return e.select("event_id", M.hz_to_name(F.col("hz")).alias("of_hz"), M.midi_to_name(F.col("midi")).alias("of_midi"), M.written_name(F.when(F.col("midi") >= 0, F.col("midi"))).alias("written"))


def key_names(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", M.key_name((F.col("event_id") % 21 - 10).cast("int")).alias("key"))


def tempo_units(spark: SparkSession, sf: str) -> DataFrame:
    names = [*M.BEAT_UNITS, "unknown"]
    unit = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % len(names) + 1).cast("int"))
    return load(spark, sf, "events").select("event_id", M.quarter_tempo(F.col("value"), unit, F.col("event_id") % 3).alias("bpm"))


def beat_position(spark: SparkSession, sf: str) -> DataFrame:
    ticks, divisions, kind = (F.col("l_orderkey") % 97).cast("double"), (F.col("l_linenumber") + 1).cast("double"), F.when(F.col("l_partkey") % 2 == 0, 4.0).otherwise(8.0)
    tempo = F.col("l_quantity") * 3
    return load(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(M.beat_in_quarters(ticks, divisions), 6).alias("in_quarters"), F.round(M.beat_in_beats(ticks, divisions, kind), 6).alias("in_beats"),
        F.round(M.ticks_sec(ticks, divisions, tempo), 6).alias("sec"), F.round(M.measure_sec(F.lit(3.0), kind, tempo), 6).alias("bar_sec"),
    )


def frame_clock(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events")
    size = C.frame_size(F.col("value") * 4)
    return e.select("event_id", F.round(M.frame_to_sec(F.col("event_id")), 6).alias("sec"), M.sec_to_frame(F.col("value") + F.lit(0.0003)).alias("frame"), size.alias("frame_size"), F.round(size / F.lit(22050.0), 8).alias("hop_sec"))


def tolerance_table(spark: SparkSession, sf: str) -> DataFrame:
    tempo = F.col("value") * 4 - 20
    return load(spark, sf, "events").select(
        "event_id", F.round(C.onset_tolerance(tempo), 6).alias("tau"), F.round(C.beat_sec(tempo), 6).alias("beat"), F.round(C.grid_pre(tempo), 6).alias("pre"), F.round(C.grid_post(tempo), 6).alias("post"), F.round(C.usable_tempo(tempo), 6).alias("tempo")
    )


def cost_scores(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    a, b = F.slice("v", 1, 12), F.slice("v", 13, 12)
    return e.select("vec_id", F.round(M.frame_cost(a, b, "l2"), 6).alias("l2"), F.round(M.frame_cost(a, b, "cosine"), 6).alias("cosine"), F.round(M.cost_score(M.frame_cost(a, b, "l2")), 6).alias("score"))


def slugs(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", M.slug(F.col("p_name")).alias("slug"), F.substring(F.sha2(F.col("p_name").cast("binary"), 256), 1, 12).alias("hash"))


def spelled(spark: SparkSession, sf: str) -> DataFrame:
    step = F.element_at(F.array(*map(F.lit, "CDEFGAB")), (F.col("event_id") % 7 + 1).cast("int"))
    alter, octave = (F.col("event_id") % 5 - 2).cast("int"), (F.col("event_id") % 8).cast("int")
    return load(spark, sf, "events").select("event_id", M.spelled_name(step, alter, octave).alias("name"), M.spelled_midi(step, alter, octave, F.lit(-2)).alias("midi"))


QUERIES = {
    "hz_midi_roundtrip": hz_midi_roundtrip, "pitch_names": pitch_names, "key_names": key_names, "tempo_units": tempo_units, "beat_position": beat_position, "frame_clock": frame_clock,
    "tolerance_table": tolerance_table, "cost_scores": cost_scores, "slugs": slugs, "spelled_pitches": spelled,
}

_HZ = "select *, value * 8 - 20 as hz from events"
_MIDI = "case when hz <= 0 then -1.0 else 69.0 + 12.0 * log2(case when hz > 0 then hz end / 442.0::double) end"


def _name(number: str, names: list[str]) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"([{listed}])[(({number}) % 12 + 12) % 12 + 1] || (floor(({number}) / 12.0) - 1)::int::varchar"


def _map(values: dict) -> str:
    quote = lambda x: f"'{x}'" if isinstance(x, str) else f"{x}"
    return "map {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in values.items()) + "}"


_UNITS = ", ".join(f"'{n}'" for n in [*M.BEAT_UNITS, "unknown"])
_TEMPO = "with t as (select event_id, value * 4 - 20 as tempo from events), b as (select *, case when tempo > 0 then 60.0::double / tempo else 0.5 end::double as beat from t)"

SQL = {
    "hz_midi_roundtrip": f"with h as ({_HZ}), m as (select event_id, ({_MIDI})::double as midi from h) select event_id, round(midi, 6) as midi, round(case when midi < 0 then 0.0 else 442.0::double * pow(2.0::double, (midi - 69.0::double) / 12.0::double) end, 6) as hz_back from m",
    "pitch_names": f"""with h as (select *, event_id % 256 / 2.0::double - 5 as midi from ({_HZ})), n as (select *, round_even({_MIDI}, 0)::int as k, round_even(midi, 0)::int as j from h)
      select event_id, case when hz > 0 then {_name("k", M.NOTE_NAMES)} end as of_hz, case when midi >= 0 then {_name("j", M.NOTE_NAMES)} end as of_midi, case when midi >= 0 then {_name("j + 2", M.FLAT_NAMES)} else '?' end as written from n""",
    "key_names": f"select event_id, coalesce(({_map(M.KEYS_BY_FIFTHS)})[(event_id % 21 - 10)::int], (event_id % 21 - 10)::varchar || ' fifths') as key from events",
    "tempo_units": f"select event_id, value * coalesce(({_map(M.BEAT_UNITS)})[([{_UNITS}])[event_id % {len(M.BEAT_UNITS) + 1} + 1]]::double, 1.0) * pow(1.5::double, event_id % 3) as bpm from events",
    "beat_position": """with n as (select *, (l_orderkey % 97)::double as ticks, (l_linenumber + 1)::double as divisions, case when l_partkey % 2 = 0 then 4.0 else 8.0 end::double as kind, l_quantity * 3 as tempo from lineitem)
      select l_orderkey, l_linenumber, l_partkey, round(ticks / divisions + 1.0, 6) as in_quarters, round(ticks / (divisions * 4.0::double / kind) + 1.0, 6) as in_beats, round(ticks / divisions * (60.0::double / greatest(tempo, 1e-6)), 6) as sec,
        round(3.0::double * 4.0 / kind * (60.0::double / greatest(tempo, 1e-6)), 6) as bar_sec from n""",
    "frame_clock": "select event_id, round(event_id * 512.0::double / 22050.0::double, 6) as sec, round_even((value + 0.0003::double) * 22050.0::double / 512.0::double, 0)::int as frame, case when value * 4 >= 120 then 512 else 1024 end as frame_size, round(case when value * 4 >= 120 then 512 else 1024 end / 22050.0::double, 8) as hop_sec from events",
    "tolerance_table": f"{_TEMPO} select event_id, round(least(0.35::double * beat, 0.25), 6) as tau, round(beat, 6) as beat, round(greatest(0.0, 0.2::double * beat), 6) as pre, round(greatest(0.0, 0.35::double * beat), 6) as post, round(case when tempo > 0 then tempo else 120.0 end, 6) as tempo from b",
    "cost_scores": """with e as (select vec_id, (embedding::double[])[1:12] as a, (embedding::double[])[13:24] as b from embeddings), c as (select vec_id, list_distance(a, b) as l2, 1.0 - list_cosine_similarity(a, b) as cosine from e)
      select vec_id, round(l2, 6) as l2, round(cosine, 6) as cosine, round(1.0 / (1.0 + l2), 6) as score from c""",
    "slugs": r"""select p_partkey, case when s = '' then 'score' else s end as slug, substr(sha256(p_name), 1, 12) as hash from (select p_partkey, p_name, left(regexp_replace(regexp_replace(regexp_replace(trim(p_name), '[^\p{L}\p{N}_-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 48) as s from part)""",
    "spelled_pitches": f"""with e as (select event_id, (['C', 'D', 'E', 'F', 'G', 'A', 'B'])[event_id % 7 + 1] as step, event_id % 5 - 2 as alter, event_id % 8 as octave from events)
      select event_id, step || (['bb', 'b', '', '#', '##'])[alter + 3] || octave::varchar as name, ((octave + 1) * 12 + ({_map(M.STEP_SEMITONES)})[step] + alter - 2)::int as midi from e""",
}
