"""From notation and samples to verdicts."""

from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from stretto import __main__, api

RATE = 22050


def written_score(folder):
    notes = "".join(f"<note><pitch><step>{s}</step><octave>4</octave></pitch><duration>1</duration></note>" for s in "CDEF")
    (folder / "scale.xml").write_text(f"<score-partwise><part id='P1'><measure number='1'><attributes><divisions>1</divisions></attributes><direction><sound tempo='120'/></direction>{notes}</measure></part></score-partwise>")


def test_recordings_to_verdicts(spark, tmp_path):
    written_score(tmp_path)
    headers, notes, intervals = api.convert_musicxml(spark, f"{tmp_path}/scale.xml")
    assert headers.first().tempo == 120.0 and intervals.first().note_count == 4
    expected = api.practice(notes, headers).withColumn("perf_id", F.lit("take1"))
    pcm = np.concatenate([np.r_[0.4 * np.sin(2 * np.pi * 442 * 2 ** ((m - 69) / 12) * np.arange(int(0.42 * RATE)) / RATE), np.zeros(int(0.5 * RATE) - int(0.42 * RATE))] for m in (60, 62, 64, 65)])
    recordings = spark.createDataFrame([("take1", bytearray(pcm.astype("<f4").tobytes()), RATE)], "perf_id string, pcm binary, sample_rate int")
    verdicts, totals = api.recognize_recordings(expected, recordings)
    assert totals.first().total == 4 and totals.first().correct == 4
    assert all(r.pitch_ok and not r.missed for r in verdicts.collect())
    onsets, frames, hop = api.detected(recordings)
    assert api.evaluate_rhythm(expected, onsets, frames, hop=hop).where("duration_ok").count() == 4
    again, totals = api.recognize_from_track(expected, onsets, frames.withColumn("midi", F.when(F.col("voiced"), F.col("midi") + 5).otherwise(-1.0)))
    assert totals.first().pitch_errors == 4 and totals.first().correct == 0
    assert api.observed(again).count() == 4


def test_practice_from_a_start(spark, tmp_path):
    written_score(tmp_path)
    headers, notes, _ = api.convert_musicxml(spark, f"{tmp_path}/scale.xml")
    starts = headers.select("score_id", F.lit(1).alias("measure"), F.lit(3).alias("note_index"))
    got = api.practice(notes.drop("note_index_in_measure"), headers, starts).orderBy("ord").collect()
    assert [(r.midi, r.onset, r.idx) for r in got] == [(64.0, 0.0, 3), (65.0, 0.5, 4)]


def test_command_line(spark, tmp_path):
    written_score(tmp_path)
    __main__.main(["import", f"{tmp_path}/scale.xml", f"{tmp_path}/out"])
    assert spark.read.parquet(f"{tmp_path}/out/notes").count() == 4


def test_time_is_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        told = spark.range(1).select(api.now().alias("t")).first().t
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert abs((datetime.strptime(told, "%Y-%m-%dT%H:%M:%SZ") - datetime.now(timezone.utc).replace(tzinfo=None)).total_seconds()) < 120


def test_build_match_and_locate(spark, tmp_path, capsys):
    from stretto.sources import audio

    midi = [60, 64, 67, 62, 65, 69, 71, 59, 63, 66, 70, 61]
    tone = lambda m: 0.4 * np.sin(2 * np.pi * 442 * 2 ** ((m - 69) / 12) * np.arange(RATE // 2) / RATE)
    pcm = np.concatenate([tone(m) for m in midi]).astype(np.float32)
    (tmp_path / "whole.wav").write_bytes(audio.encode_wav(pcm, RATE))
    (tmp_path / "take.wav").write_bytes(audio.encode_wav(pcm[2 * RATE : int(4.2 * RATE)], RATE))
    names = {0: "C", 2: "D", 4: "E", 5: "F", 7: "G", 9: "A", 11: "B"}
    step = lambda m: f"<step>{names.get(m % 12, names.get(m % 12 - 1))}</step>" + ("" if m % 12 in names else "<alter>1</alter>")
    bars = "".join(f"<measure number='{k + 1}'>" + ("<attributes><divisions>1</divisions></attributes><direction><sound tempo='120'/></direction>" if k == 0 else "") + "".join(f"<note><pitch>{step(m)}<octave>{m // 12 - 1}</octave></pitch><duration>1</duration></note>" for m in midi[4 * k : 4 * k + 4]) + "</measure>" for k in range(3))
    (tmp_path / "whole.xml").write_text(f"<score-partwise><part id='P1'>{bars}</part></score-partwise>")
    root = f"{tmp_path}/templates"
    with pytest.raises(Exception, match="a template of"):
        api.build_template(spark, f"{tmp_path}/whole.wav", root=f"{tmp_path}/none")
    __main__.main(["build", f"{tmp_path}/whole.wav", "--scores", f"{tmp_path}/whole.xml", "--root", root, "--allow-short-template"])
    assert '"template_id":"whole"' in capsys.readouterr().out
    for mode in ("global", "coarse_local"):
        r = api.match_query(spark, "whole", f"{tmp_path}/take.wav", root, mode).orderBy("rank").first()
        assert abs(r.start_sec - 2.0) < 0.6 and r.template_id == "whole" and r.rank == 1
    r = api.locate_query(spark, "whole", f"{tmp_path}/take.wav", root).first()
    assert abs(r.start_sec - 2.0) < 0.6 and r.measure in (1, 2) and not r.context_used
    perf = api.match_query(spark, "whole", f"{tmp_path}/take.wav", root).first().perf_id
    before = spark.createDataFrame([(perf, 1.0, 10.0, 11.0)], "perf_id string, last_sec double, last_timestamp double, timestamp double")
    near = api.locate_query(spark, "whole", f"{tmp_path}/take.wav", root, before).first()
    assert near.context_used and near.note_id == r.note_id
    (tmp_path / "short.wav").write_bytes(audio.encode_wav(pcm[: RATE // 2], RATE))
    with pytest.raises(Exception, match="a query of"):
        api.match_query(spark, "whole", f"{tmp_path}/short.wav", root).collect()
    assert abs(api.estimate_pitch(spark, f"{tmp_path}/take.wav", 0.1, 0.4).first().pitch_midi - 65) < 0.3
    with pytest.raises(ValueError):
        api.evaluate_rhythm(spark.createDataFrame([], "perf_id string"))
