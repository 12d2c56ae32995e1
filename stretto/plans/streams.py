"""Queries on packets, samples and notation files made of the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.config import StartSettings
from ..operators import onset
from ..sources import audio, musicxml
from ..streaming import sessions
from . import views as V

RATE = 22050


def _packets(spark: SparkSession, sf: str) -> DataFrame:
    """Events as packets: of a user's numbered events some are lost and some come again late."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = V.load(spark, sf, "events").select(F.col("user_id").alias("session_id"), "event_id", (F.row_number().over(order) - 1).cast("long").alias("n")).where("event_id % 7 <> 3")
    seq = F.when(F.col("event_id") % 11 == 0, F.greatest(F.col("n") - 3, F.lit(0))).otherwise(F.col("n"))
    pcm = F.transform(F.sequence(F.lit(1), (F.col("event_id") % 50 + 50).cast("int")), lambda i: (i / F.lit(1000.0)).cast("float"))
    return e.select("session_id", seq.alias("seq"), pcm.alias("pcm"), F.lit(RATE).alias("sample_rate"), F.lit(None).cast("double").alias("t0_sec"), (F.col("n") * F.lit(0.01)).alias("arrived"))


#: Short sessions, as the packets are few: evaluated with every packet, started by a window that is filled by four fifths.
SHORT = StartSettings(timeout=0.4, least_score=0.8, least_query=0.05, most_query=0.1, interval=0.0)


def _filled(pcm: np.ndarray, rate: int) -> tuple[float, float, float]:
    """A matcher that hears its anchor the better, the more there is to hear."""
    return len(pcm) / round(SHORT.most_query * rate), 1.0, 1.0


def stream_start(spark: SparkSession, sf: str) -> DataFrame:
    out = sessions.replay_starts(_packets(spark, sf), lambda session: _filled, SHORT)
    return out.select("session_id", "state", F.round("score", 6).alias("score"), "buffer_samples", "filled_samples", "dropped")


def stream_rhythm(spark: SparkSession, sf: str) -> DataFrame:
    """Each piece's first four notes, half a second each, played from its notation in packets of 3,000 samples."""
    base = V.load(spark, sf, "supplier").select(F.col("s_suppkey").alias("session_id"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in b.column("session_id").to_pylist():
                x = np.concatenate([np.r_[0.4 * np.sin(2 * np.pi * 442 * 2 ** ((n["midi"] - 69) / 12) * np.arange(int(0.42 * RATE)) / RATE), np.zeros(RATE // 2 - int(0.42 * RATE))] for n in _played(i)[0]]).astype(np.float32)
                parts = [x[k : k + 3000].tolist() for k in range(0, len(x), 3000)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.list_(pa.float32())), pa.array([RATE] * len(parts), pa.int32()), pa.array([k == len(parts) - 1 for k in range(len(parts))])],
                    names=["session_id", "seq", "pcm", "sample_rate", "last"],
                )

    packets = base.mapInArrow(run, "session_id long, seq long, pcm array<float>, sample_rate int, last boolean")
    return sessions.replay_rhythm(packets, _played)


def _played(session: int) -> tuple[list[dict], float]:
    return [{"onset": 0.5 * k, "dur": 0.5, "midi": 55.0 + (session * 7 + 5 * k) % 24} for k in range(4)], 120.0


def _recordings(spark: SparkSession, sf: str) -> DataFrame:
    """Half a second of a sine for each piece."""
    s = V.load(spark, sf, "supplier").select(F.col("s_suppkey").alias("perf_id"), (F.lit(48) + F.col("s_suppkey") % 36).cast("double").alias("midi"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            t = np.arange(RATE // 2) / RATE
            pcm = [(0.5 * np.sin(2 * np.pi * 442.0 * 2 ** ((m - 69) / 12) * t)).astype("<f4").tobytes() for m in b.column("midi").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("perf_id"), b.column("midi"), pa.array(pcm, pa.binary()), pa.array([RATE] * len(b), pa.int32())], names=["perf_id", "midi", "pcm", "sample_rate"])

    return s.mapInArrow(run, "perf_id long, midi double, pcm binary, sample_rate int")


def pitch_track_sine(spark: SparkSession, sf: str) -> DataFrame:
    """The median pitch heard in each sine, to the nearest semitone."""
    f = audio.pitch_frames(_recordings(spark, sf)).where("voiced")
    return f.groupBy(F.col("perf_id").cast("long").alias("perf_id")).agg(F.round(F.median("midi")).alias("midi"))


def stft_flux(spark: SparkSession, sf: str) -> DataFrame:
    """Onsets of the sines: one at the beginning."""
    f = audio.flux_frames(_recordings(spark, sf))
    return onset.peak_times(onset.peaks(f), 512, RATE).groupBy("perf_id").agg(F.round(F.min("t"), 6).alias("first"))


def pcm_rms_norm(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as samples, brought to one level."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = [np.array(v, np.float64) for v in b.column("embedding").to_pylist()]
            rms, peak = [float(np.sqrt((v**2).mean())) for v in x], [float(audio.rms_normalized(v, 0.1).max()) for v in x]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(rms, pa.float64()), pa.array(peak, pa.float64())], names=["vec_id", "rms", "peak"])

    found = V.load(spark, sf, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, rms double, peak double")
    return found.select("vec_id", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Each piece as a notation file: 16 ticks a measure of its own, tempo 120, then 90 from the third measure on."""
    n = V.notes(spark, sf).withColumn("bar", F.floor((F.col("ord") - 1) / 4).cast("long"))
    step = F.element_at(F.array(*map(F.lit, "CDEFGAB")), (F.col("l_partkey") % 7 + 1).cast("int"))
    sound = F.when(F.col("is_rest"), "<rest/>").otherwise(F.concat(F.lit("<pitch><step>"), step, F.lit("</step><octave>"), (F.col("l_partkey") % 5 + 2).cast("string"), F.lit("</octave></pitch>")))
    n = n.withColumn("xml", F.concat(F.lit("<note>"), sound, F.lit("<duration>"), F.col("q").cast("string"), F.lit("</duration></note>")))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "xml"))), lambda s: s["xml"]), "")
    bars = n.withColumn("k", F.col("ord")).groupBy("perf_id", "bar").agg(ordered("k").alias("notes"))
    head = F.when(F.col("bar") == 0, "<attributes><divisions>4</divisions><key><fifths>-1</fifths></key></attributes><direction><sound tempo='120'/></direction>").when(F.col("bar") == 2, "<direction><sound tempo='90'/></direction>").otherwise("")
    bars = bars.withColumn("xml", F.concat(F.lit("<measure number='"), (F.col("bar") + 1).cast("string"), F.lit("'>"), head, F.col("notes"), F.lit("</measure>"))).withColumn("k", F.col("bar"))
    whole = bars.groupBy("perf_id").agg(ordered("k").alias("measures"))
    content = F.concat(F.lit("<score-partwise><part id='P1'>"), F.col("measures"), F.lit("</part></score-partwise>")).cast("binary")
    return whole.select(F.concat(F.lit("piece/"), F.col("perf_id").cast("string"), F.lit(".xml")).alias("path"), content.alias("content"), F.sha2(content, 256).alias("sha256"))


def musicxml_practice(spark: SparkSession, sf: str) -> DataFrame:
    n = musicxml.practice_notes(musicxml.scan_contents(_files(spark, sf)))
    return n.select("path", "ord", "pitch", "pitch_midi", "measure", F.round("beat", 6).alias("beat"), F.round("onset", 5).alias("onset"), F.round("duration", 6).alias("duration"))


def musicxml_events(spark: SparkSession, sf: str) -> DataFrame:
    n = musicxml.note_events(musicxml.scan_contents(_files(spark, sf)))
    return n.select("path", "note_id", "measure", "pitch_midi", F.round("start_sec", 5).alias("start_sec"), F.round("end_sec", 5).alias("end_sec"))


def musicxml_headers(spark: SparkSession, sf: str) -> DataFrame:
    return musicxml.score_headers(musicxml.scan_contents(_files(spark, sf))).select("path", "title", "tempo", "time_signature", "key", "total_measures")


QUERIES = {"stream_start": stream_start, "stream_rhythm": stream_rhythm, "pitch_track_sine": pitch_track_sine, "stft_flux": stft_flux, "pcm_rms_norm": pcm_rms_norm, "musicxml_practice": musicxml_practice, "musicxml_events": musicxml_events, "musicxml_headers": musicxml_headers}

_FILE = f"""with {V.V_NOTES}, p as (select *, (ord - 1) // 4 as bar, coalesce(sum(q / 4.0 * case when (ord - 1) // 4 < 2 then 0.5 else 60.0 / 90 end::double) over (partition by perf_id order by ord rows between unbounded preceding and 1 preceding), 0.0)::double as began,
    q / 4.0 * case when (ord - 1) // 4 < 2 then 0.5 else 60.0 / 90 end::double as len, l_partkey % 5 + 2 as octave, l_partkey % 7 + 1 as s from v_notes),
  n as (select 'piece/' || perf_id || '.xml' as path, * exclude (measure, pitch_midi), (['C', 'D', 'E', 'F', 'G', 'A', 'B'])[s] || octave as pitch, ((octave + 1) * 12 + ([0, 2, 4, 5, 7, 9, 11])[s])::int as pitch_midi, (bar + 1)::int as measure, (cum - min(cum) over (partition by perf_id, bar)) / 4.0 + 1 as beat from p)"""

SQL = {
    "stream_start": """with e as (select user_id as session_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as n from events), p as (select session_id, n, case when event_id % 11 = 0 then greatest(n - 3, 0) else n end as seq, event_id % 50 + 50 as size from e where event_id % 7 <> 3),
      x as (select *, coalesce(max(seq) over (partition by session_id order by n rows between unbounded preceding and 1 preceding), -1) + 1 as want from p),
      y as (select *, case when seq >= want then size * (1 + seq - want) else 0 end as more, case when seq >= want then size * (seq - want) else 0 end as silent, n * 0.01::double - first_value(n * 0.01::double) over (partition by session_id order by n) as elapsed from x),
      z as (select *, sum(more) over (partition by session_id order by n rows unbounded preceding) as total from y),
      ends as (select *, case when elapsed >= 0.4::double then 'timed_out' when least(total, 2205) / 2205::double >= 0.8::double then 'started' end as ended from z),
      stop as (select session_id, coalesce(min(n) filter (ended is not null), max(n)) as n from ends group by session_id),
      last as (select e.session_id, coalesce(e.ended, 'listening') as state, e.n as stopped from ends e join stop using (session_id, n)),
      scored as (select session_id, max(case when least(total, 2205) >= 1103 and elapsed < 0.4::double then least(total, 2205) / 2205::double else 0.0 end) as score from ends join last using (session_id) where n <= stopped group by session_id)
      select session_id, any_value(state) as state, round(any_value(score), 6) as score, sum(more)::bigint as buffer_samples, sum(silent)::bigint as filled_samples, count(*) filter (seq < want) as dropped from ends join last using (session_id) join scored using (session_id) where n <= stopped group by session_id""",
    "pitch_track_sine": "select s_suppkey as perf_id, (48 + s_suppkey % 36)::double as midi from supplier",
    "pcm_rms_norm": "with e as (select vec_id, embedding::double[] as v from embeddings), r as (select *, sqrt(list_dot_product(v, v) / len(v)) as rms from e) select vec_id, round(rms, 6) as rms, round(list_max(v) * (0.1::double / rms), 6) as peak from r",
    "musicxml_practice": f"{_FILE} select path, row_number() over (partition by path order by ord) as ord, pitch, pitch_midi, measure, round(beat, 6)::double as beat, round(began, 5) as onset, round(len, 6)::double as duration from n where not is_rest",
    "musicxml_events": f"{_FILE} select path, 'P1_m' || measure || '_n' || row_number() over (partition by path order by ord) as note_id, measure, pitch_midi, round(began, 5) as start_sec, round(began + len, 5) as end_sec from n where not is_rest",
    "musicxml_headers": f"{_FILE} select path, perf_id::varchar as title, 120.0::double as tempo, '4/4' as time_signature, 'F major' as key, max(measure)::int as total_measures from n group by path, perf_id",
}
