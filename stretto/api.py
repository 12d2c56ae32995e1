"""The engine's front door: whole jobs over tables of scores and recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.config import SAMPLE_RATE, JudgeSettings, MatchSettings, PitchFeatureSettings, ReanchorSettings, frame_size, params_hash
from .functions.music import midi_to_name
from .operators import contract, matching, onset, reanchor, template, timeline
from .operators.recognize import recognize, summarize
from .operators.rhythm import judge
from .sources import audio, musicxml, stores


def now() -> Column:
    """This moment in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def convert_musicxml(spark: SparkSession, paths: str, part_id: str | None = None, interval_measures: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, notes, intervals) of notation files: onsets, note numbers by measure, notes by interval, provenance."""
    items = musicxml.scan(spark, paths)
    # a hash of the path rather than chance, so that a repeated stage gives the same ids
    ids = items.select("path").distinct().withColumn("score_id", musicxml.score_id(F.col("path")))
    headers = musicxml.score_headers(items, part_id=part_id).join(ids, "path").withColumn("created_at", now())
    notes = timeline.numbered(musicxml.practice_notes(items, part_id=part_id).join(ids, "path")).withColumn("is_rest", F.lit(False))
    return headers, notes, timeline.notes_per_interval(headers, notes, interval_measures)


def practice(notes: DataFrame, headers: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Expected notes of each score, from its start note on if one is given: the form that judgement takes."""
    rows = notes.join(headers.select("score_id", "tempo"), "score_id")
    rows = timeline.practice_slice(rows, starts) if starts is not None else timeline.numbered(rows) if "note_index_in_measure" not in notes.columns else rows
    sounding = contract.to_expected(rows)
    return sounding.select(F.col("score_id").alias("perf_id"), "ord", "onset", F.col("duration").alias("dur"), "midi", "measure", F.col("note_index_in_measure").alias("idx"), "tempo")


def detected(recordings: DataFrame, tempo: float = 120.0) -> tuple[DataFrame, DataFrame, float]:
    """(onsets, frames, hop in seconds) of recordings (perf_id, pcm, sample_rate), framed for the tempo."""
    hop = 512 if tempo >= 120 else 1024
    onsets = onset.peak_times(onset.peaks(audio.flux_frames(recordings, hop)), hop, SAMPLE_RATE).select("perf_id", "t")
    return onsets, audio.pitch_frames(recordings, hop), hop / SAMPLE_RATE


def recognize_from_track(expected: DataFrame, onsets: DataFrame, frames: DataFrame, settings: JudgeSettings = JudgeSettings(mode="anchored_grid")) -> tuple[DataFrame, DataFrame]:
    """(verdicts, summaries) from onsets and frames already found; the hop follows each score's tempo."""
    verdicts = recognize(expected, onsets, frames, settings, frame_size(F.col("tempo")) / F.lit(float(SAMPLE_RATE)))
    return verdicts, summarize(verdicts)


def recognize_recordings(expected: DataFrame, recordings: DataFrame, tempo: float = 120.0, settings: JudgeSettings = JudgeSettings(mode="anchored_grid")) -> tuple[DataFrame, DataFrame]:
    """(verdicts, summaries) straight from recordings."""
    onsets, frames, hop = detected(recordings, tempo)
    verdicts = recognize(expected.withColumn("perf_id", F.col("perf_id").cast("string")), onsets, frames, settings, hop)
    return verdicts, summarize(verdicts)


def evaluate_rhythm(expected: DataFrame, onsets: DataFrame | None = None, frames: DataFrame | None = None, settings: JudgeSettings = JudgeSettings(), hop: float = 512 / SAMPLE_RATE, reanchored: ReanchorSettings | None = None, recordings: DataFrame | None = None, paths: str | None = None, tempo: float = 120.0) -> DataFrame:
    """Segments of judgement, after re-anchoring at rests if that is asked for. What is heard is given as onsets and frames, or found
    in recordings (perf_id, pcm, sample_rate), or in files; what is not given comes from the recordings, and without them is an error."""
    if onsets is None or frames is None:
        if recordings is None and paths is None:
            raise ValueError("onsets and frames, recordings or paths of files are needed")
        recordings = recordings if recordings is not None else audio.read_recordings(expected.sparkSession, paths)
        heard, track, hop = detected(recordings, tempo)
        onsets, frames = heard if onsets is None else onsets, track if frames is None else frames
        expected = expected.withColumn("perf_id", F.col("perf_id").cast("string"))
    if reanchored is not None:
        expected, _ = reanchor.apply(expected, frames, hop, reanchored)
    return judge(expected, onsets, frames, settings, hop)


def observed(rows: DataFrame) -> DataFrame:
    """Each row as one JSON record, for a look at it."""
    return rows.select(F.to_json(F.struct("*")).alias("record"))


def estimate_pitch(spark: SparkSession, paths: str, start: float = 0.0, end: float | None = None) -> DataFrame:
    """perf_id, pitch_midi, pitch of files: the median of what is voiced from start to end, null where nothing is."""
    frames = audio.pitch_frames(audio.read_recordings(spark, paths))
    inside = F.col("voiced") & (F.col("t") >= start) & (F.col("t") < (end if end is not None else float("inf")))
    out = frames.groupBy("perf_id").agg(F.median(F.when(inside, F.col("midi"))).alias("pitch_midi"))
    return out.withColumn("pitch", midi_to_name(F.col("pitch_midi")))


def build_template(spark: SparkSession, paths: str, scores: str | None = None, root: str = stores.TEMPLATES, settings: PitchFeatureSettings = PitchFeatureSettings(), guard: bool = True, overwrite: bool = False) -> DataFrame:
    """Templates of recordings, saved under root by the files' names; their meta rows. scores: notation files of the same names, whose
    notes are stretched onto the recordings. Recordings that last too short or too long for a template are an error while guard is on."""
    named = lambda c: F.regexp_extract(c, r"([^/]+)\.[^./]+$", 1)
    recordings = audio.read_recordings(spark, paths).withColumn("perf_id", named("perf_id"))
    lasting = recordings.select(F.col("perf_id").alias("seq_id"), (F.length("pcm") / 4 / F.col("sample_rate")).alias("duration_sec"))
    lasting = matching.guarded(lasting, matching.TEMPLATE_SEC, "a template") if guard else lasting
    schema = "seq_id string, note_id string, measure int, beat double, pitch_midi int, start_sec double, end_sec double"
    events = spark.createDataFrame([], schema)
    if scores is not None:
        given = musicxml.note_events(musicxml.scan(spark, scores))
        events = given.select(named("path").alias("seq_id"), "note_id", F.col("measure").cast("int").alias("measure"), F.col("beat").cast("double").alias("beat") if "beat" in given.columns else F.lit(None).cast("double").alias("beat"), F.col("pitch_midi").cast("int").alias("pitch_midi"), "start_sec", "end_sec")
    frames, stretched = template.build(audio.chroma_frames(recordings, settings.hop), events, lasting, settings)
    counts = frames.where("kind = 'fine'").groupBy("template_id").agg(F.count("*").alias("num_frames"))
    meta = lasting.withColumnRenamed("seq_id", "template_id").join(counts, "template_id").select(
        "template_id", F.lit("pitch").alias("feature_kind"), F.lit(paths).alias("source_wav"), F.lit(SAMPLE_RATE).alias("sample_rate"), F.lit(settings.hop).alias("hop_length"), F.lit(settings.hop / SAMPLE_RATE).alias("frame_sec"),
        "num_frames", "duration_sec", now().alias("created_at"), F.lit(params_hash(settings)).alias("params_hash"),
    )
    stores.save_templates(meta, frames, stretched.withColumnRenamed("seq_id", "template_id") if scores is not None else None, root, overwrite)
    return stores.load_templates(spark, root)[0]


def _paired(spark: SparkSession, template_id: str, paths: str, root: str, settings: PitchFeatureSettings) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, float]:
    """(names of pairs, template frames, query frames, note events, seconds of a frame): each file is a pair with the template. The
    query's features are made as the template's meta says its own were."""
    meta, frames, events = stores.load_templates(spark, root, [template_id])
    own = meta.select("frame_sec", "params_hash", "hop_length").first()
    if own.params_hash is not None and own.params_hash != params_hash(settings):
        raise ValueError(f"template {template_id} was made with other settings")
    recordings = audio.read_recordings(spark, paths)
    lasting = (F.length("pcm") / 4 / F.col("sample_rate")).alias("duration_sec")
    names = recordings.select("perf_id", F.lit(template_id).alias("template_id"), F.xxhash64("perf_id").alias("pair"), lasting)
    query = template.pitch_sequence(audio.chroma_frames(recordings, settings.hop), settings).select(F.xxhash64("seq_id").alias("pair"), "idx", "vec")
    held = names.join(frames.where("kind = 'fine'"), "template_id").select("pair", "idx", "vec")
    notes = names.join(events, "template_id").drop("template_id", "perf_id", "duration_sec")
    return names, held, query, notes, float(own.frame_sec)


def match_query(spark: SparkSession, template_id: str, paths: str, root: str = stores.TEMPLATES, mode: str = "global", top_k: int = 3, least_score: float = 0.35, settings: PitchFeatureSettings = PitchFeatureSettings(), matched: MatchSettings = MatchSettings()) -> DataFrame:
    """Where recordings of a few seconds lie in a template: perf_id, template_id and what match_templates gives."""
    names, held, query, _, frame_sec = _paired(spark, template_id, paths, root, settings)
    found = matching.match_templates(held, query, frame_sec, mode, top_k, least_score, matched, durations=names.select("pair", "duration_sec"))
    return names.drop("duration_sec").join(found, "pair").drop("pair")


def locate_query(spark: SparkSession, template_id: str, paths: str, root: str = stores.TEMPLATES, contexts: DataFrame | None = None, settings: PitchFeatureSettings = PitchFeatureSettings(), matched: MatchSettings = MatchSettings()) -> DataFrame:
    """The note at which recordings begin in a template that has note events: perf_id and what locate gives, with the note's measure,
    beat and pitch. contexts: (perf_id, last_sec, last_timestamp, timestamp) of recordings located before."""
    names, held, query, notes, frame_sec = _paired(spark, template_id, paths, root, settings)
    if notes.limit(1).count() == 0:
        raise ValueError(f"template {template_id} has no note events")
    given = contexts if contexts is not None else spark.createDataFrame([], "perf_id string, last_sec double, last_timestamp double, timestamp double")
    near = matching.context_windows(given.join(names, "perf_id"), query, frame_sec)
    in_frames = notes.withColumn("start_sec", F.col("start_sec") / F.lit(frame_sec)).withColumn("end_sec", F.col("end_sec") / F.lit(frame_sec))
    found = matching.locate(held, query, near, in_frames, settings=matched)
    found = found.join(notes.select("pair", "note_id", "measure", "beat", "pitch_midi"), ["pair", "note_id"], "left")
    return names.join(found, "pair").drop("pair").withColumn("start_sec", F.col("start") * F.lit(frame_sec)).withColumn("end_sec", F.col("end") * F.lit(frame_sec))
