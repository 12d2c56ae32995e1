"""Notation files, contracts and stores."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stretto.operators import contract, timeline
from stretto.sources import json_io, musicxml, stores

HEAD = "<score-partwise><work><work-title>Study</work-title></work><part id='P1'>"
TAIL = "</part></score-partwise>"


def note(step="C", octave=4, ticks=1, extra=""):
    return f"<note>{extra}<pitch><step>{step}</step><octave>{octave}</octave></pitch><duration>{ticks}</duration></note>"


def scanned(spark, body):
    files = spark.createDataFrame([("dir/piece.xml", (HEAD + body + TAIL).encode(), "x")], "path string, content binary, sha256 string")
    return musicxml.scan_contents(files).cache()


def practice(spark, body, **options):
    return musicxml.practice_notes(scanned(spark, body), **options).orderBy("ord").collect()


ATTR = "<attributes><divisions>1</divisions><time><beats>4</beats><beat-type>4</beat-type></time></attributes>"


def test_two_quarters_and_a_rest(spark):
    body = f"<measure number='1'>{ATTR}{note('C')}{note('D')}<note><rest/><duration>2</duration></note></measure>"
    got = practice(spark, body)
    assert [(r.pitch, r.pitch_midi, r.onset, r.duration, r.beat) for r in got] == [("C4", 60, 0.0, 0.5, 1.0), ("D4", 62, 0.5, 0.5, 2.0)]
    head = musicxml.score_headers(scanned(spark, body)).first()
    assert (head.title, head.tempo, head.time_signature, head.key, head.total_measures) == ("Study", 120.0, "4/4", "C major", 1)
    assert [r.note_index_in_measure for r in timeline.numbered(spark.createDataFrame(got).withColumn("score_id", F.lit(1))).orderBy("ord").collect()] == [1, 2]


def test_chord_shares_its_onset(spark):
    body = f"<measure number='1'>{ATTR.replace('<divisions>1', '<divisions>2')}{note('E')}{note('A', extra='<chord/>')}{note('G')}</measure>"
    assert [r.onset for r in practice(spark, body)] == [0.0, 0.0, 0.25]
    events = musicxml.note_events(scanned(spark, body), 116.0).collect()
    assert {e.pitch_midi for e in events if e.start_sec == 0} == {64, 69} and all(e.beat == 1.0 for e in events if e.start_sec == 0)


def test_multiple_rest_adds_bars_and_skips_placeholders(spark):
    attr = "<attributes><divisions>2</divisions><time><beats>6</beats><beat-type>8</beat-type></time><measure-style><multiple-rest>2</multiple-rest></measure-style></attributes><direction><sound tempo='60'/></direction>"
    body = f"<measure number='1'>{attr}</measure><measure number='2'></measure><measure number='3'>{note('C', ticks=2)}</measure>"
    got = practice(spark, body)
    assert [(r.onset, r.measure) for r in got] == [(6.0, 3)]


@pytest.mark.parametrize("sound,tempo", [("", 100.5), ("<sound tempo='90'/>", 90.0)])
def test_dotted_mark_and_playback_tempo(spark, sound, tempo):
    mark = f"<direction><direction-type><metronome><beat-unit>quarter</beat-unit><beat-unit-dot/><per-minute>67</per-minute></metronome></direction-type>{sound}</direction>"
    body = f"<measure number='1'>{ATTR}{mark}{note()}</measure>"
    assert musicxml.score_headers(scanned(spark, body)).first().tempo == tempo
    assert abs(practice(spark, body)[0].duration - 60 / tempo) < 1e-9


def test_timelines_differ_where_they_should(spark):
    late = "<direction><direction-type/><offset>4</offset><sound tempo='240'/></direction>"
    hidden = note("B").replace("<note>", "<note print-object='no'>")
    unpitched = "<note><unpitched/><duration>1</duration></note>"
    body = f"<measure number='1'>{ATTR}<direction><sound tempo='120'/></direction>{late}{hidden}{unpitched}{note('C', ticks=3)}</measure><measure number='2'>{note('D')}</measure>"
    p = practice(spark, body)
    assert [r.pitch for r in p] == ["B4", "C4", "D4"] and p[0].duration == 0.25  # the later tempo holds at once
    e = sorted(musicxml.note_events(scanned(spark, body)).collect(), key=lambda r: r.start_sec)
    assert [(r.pitch_midi, r.start_sec) for r in e] == [(None, 0.0), (60, 0.5), (62, 2.0)] and abs(e[2].duration_sec - 0.25) < 1e-9


def test_a_mark_inside_a_note_splits_it(spark):
    body = f"<measure number='1'>{ATTR}<direction><sound tempo='60'/></direction><direction><offset>2</offset><sound tempo='120'/></direction>{note('C', ticks=4)}</measure>"
    e = musicxml.note_events(scanned(spark, body)).first()
    assert abs(e.end_sec - 3.0) < 1e-9


def test_rebase(spark):
    body = f"<measure number='1'>{ATTR}{note()}{note()}</measure><measure number='2'>{note()}</measure>"
    n = musicxml.practice_notes(scanned(spark, body))
    assert [r.onset for r in musicxml.rebased(n, 2).orderBy("ord").collect()] == [0.0, 0.5, 0.0]


def test_contract_and_files(spark, tmp_path):
    score = {"schema": "score_data", "schema_version": "1.0", "score_id": "s1", "title": "t", "tempo": 120, "time_signature": "4/4", "key": "C major", "total_measures": 1, "interval_measures": 4, "intervals": [], "notes": [{"pitch": "C4", "measure": 1, "beat": 1, "onset": 0, "duration": 0.5, "interval_id": 0, "pitch_midi": 60, "note_index_in_measure": 1, "is_rest": False}]}
    (tmp_path / "a.json").write_text(json.dumps(score))
    head, notes = json_io.read_scores(spark, f"{tmp_path}/a.json")
    assert notes.count() == 1 and head.first().title == "t"
    stores.save_scores(head, notes, f"{tmp_path}/store")
    with pytest.raises(FileExistsError):
        stores.save_scores(head, notes, f"{tmp_path}/store")
    stores.save_scores(head.withColumn("title", F.lit("new")), notes, f"{tmp_path}/store", overwrite=True)
    stores.save_scores(head.withColumn("score_id", F.lit("s2")), notes.limit(0), f"{tmp_path}/store")
    meta, back = stores.load_scores(spark, f"{tmp_path}/store")
    assert {(r.score_id, r.title, r.note_count, r.interval_count) for r in meta.collect()} == {("s1", "new", 1, 1), ("s2", "t", 0, 1)}
    assert [(r.score_id, r.pitch, r.onset, r.ord) for r in back.collect()] == [("s1", "C4", 0.0, 0)]
    # the layout of one folder per score is read as well; a folder without notes is an error
    (tmp_path / "store" / "s3").mkdir()
    (tmp_path / "store" / "s3" / "meta.json").write_text(json.dumps(score | {"score_id": "s3", "note_count": 1, "interval_count": 1}, indent=2))
    assert [r.score_id for r in stores.list_scores(spark, f"{tmp_path}/store").collect()] == ["s1", "s2", "s3"]
    with pytest.raises(Exception, match="without header or notes"):
        stores.load_scores(spark, f"{tmp_path}/store")[0].collect()
    (tmp_path / "store" / "s3" / "notes.json").write_text(json.dumps({"schema_version": "1.0", "score_id": "s3", "notes": score["notes"]}, indent=2))
    assert stores.load_scores(spark, f"{tmp_path}/store", ["s3"])[1].count() == 1 and stores.load_scores(spark, f"{tmp_path}/store")[0].count() == 3
    with pytest.raises(FileNotFoundError):
        stores.load_scores(spark, f"{tmp_path}/store", ["none"])
    assert stores.list_scores(spark, f"{tmp_path}/nowhere").count() == 0
    stores.dump_scores(head, notes, f"{tmp_path}/dump")
    assert json_io.read_scores(spark, f"{tmp_path}/dump/*/*")[1].first().pitch_midi == 60
    with pytest.raises(Exception, match="duration"):
        stores.dump_scores(head, notes.withColumn("duration", F.lit(0.0)), f"{tmp_path}/bad")
    track = spark.createDataFrame([("p/1", 22050, 512, 0.1)], "perf_id string, sample_rate int, frame_size int, window_duration_sec double")
    frames = spark.createDataFrame([("p/1", 0, 0.0, 262.0, 60.0, "C4", True), ("p/1", 1, 0.1, None, None, None, False)], "perf_id string, frame_idx long, t double, frequency_hz double, midi double, pitch string, voiced boolean")
    stores.dump_tracks(track, frames, f"{tmp_path}/tracks")
    assert [(r.t, r.midi, r.voiced) for r in json_io.read_tracks(spark, f"{tmp_path}/tracks/*/*")[1].orderBy("frame_idx").collect()] == [(0.0, 60.0, True), (0.1, None, False)]
    (tmp_path / "b.json").write_text(json.dumps(score | {"schema": "other"}))
    with pytest.raises(Exception, match="not score data"):
        json_io.read_scores(spark, f"{tmp_path}/b.json")[1].collect()
    bad = spark.createDataFrame([(0, 1, 0.0, float("nan"), None, False)], "measure int, note_index_in_measure int, duration double, tempo double, pitch_midi double, is_rest boolean")
    assert contract.note_violations(bad).first().violations == ["measure", "duration", "tempo", "pitch"]
    (tmp_path / "map.json").write_text(json.dumps({"schema_version": "1", "entries": {"s1": {"template_id": "t1"}, "s2": "t2"}}))
    assert {(r.score_id, r.template_id) for r in json_io.read_template_map(spark, f"{tmp_path}/map.json").collect()} == {("s1", "t1"), ("s2", "t2")}


def test_calibration_and_intervals(spark):
    e = spark.createDataFrame([(1, 0.0, 1.0, 10.0), (1, 1.0, 2.0, 10.0)], "p int, start_sec double, end_sec double, d double")
    got = timeline.calibrate(e, "p", "d").orderBy("start_sec").collect()
    assert got[0].scale == 5.0 and got[1].end_sec == 10.0
    s = spark.createDataFrame([("a", 9), ("b", 0)], "score_id string, total_measures int")
    assert [(r.id, r.start_measure, r.end_measure) for r in timeline.intervals(s).orderBy("id").collect()] == [(0, 1, 4), (1, 5, 8), (2, 9, 9)]
    with pytest.raises(ValueError):
        timeline.intervals(s, 0)


def test_templates_and_reports(spark, tmp_path):
    root = f"{tmp_path}/templates"
    meta = spark.createDataFrame([("t1", 0.1, 2.0)], "template_id string, frame_sec double, duration_sec double")
    frames = spark.createDataFrame([("t1", "fine", k, [float(k)]) for k in range(4)] + [("t1", "coarse", 0, [1.5])], "template_id string, kind string, idx long, vec array<double>")
    events = spark.createDataFrame([("t1", "n1", 0.0, 1.0)], "template_id string, note_id string, start_sec double, end_sec double")
    stores.save_templates(meta, frames, events, root)
    with pytest.raises(FileExistsError):
        stores.save_templates(meta, frames, events, root)
    stores.save_templates(meta.withColumn("duration_sec", F.lit(3.0)), frames, events, root, overwrite=True)
    (tmp_path / "templates" / "t2").mkdir()
    (tmp_path / "templates" / "t2" / "meta.json").write_text(json.dumps({"template_id": "t2", "duration_sec": 1.0}, indent=1))
    np.save(tmp_path / "templates" / "t2" / "pitch.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    more = spark.createDataFrame([("t1", "x"), ("t2", "y")], "template_id string, note_id string")
    m, f, e = stores.load_templates(spark, root, fallback_events=more)
    assert {(r.template_id, r.duration_sec) for r in m.collect()} == {("t1", 3.0), ("t2", 1.0)}
    assert f.where("template_id = 't1' and kind = 'fine'").count() == 4 and [r.vec for r in f.where("template_id = 't2'").orderBy("idx").collect()] == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]
    assert {(r.template_id, r.note_id) for r in e.collect()} == {("t1", "n1"), ("t2", "y")}
    with pytest.raises(FileNotFoundError):
        stores.load_templates(spark, root, ["t9"])
    measures = spark.createDataFrame([("p", 1, 1, 2, "60+ 62-"), ("p", 2, 1, 1, "64+")], "perf_id string, measure int, hits long, notes long, line string")
    stores.write_report(measures, spark.createDataFrame([(3, 2)], "total int, hits int"), f"{tmp_path}/report")
    text = spark.read.text(f"{tmp_path}/report/markdown/*/*", wholetext=True).first()[0]
    assert "# p" in text and "| 1 | 1/2 | 60+ 62- |" in text and spark.read.json(f"{tmp_path}/report/summary").first().hits == 2
