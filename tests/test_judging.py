"""Judgement of synthetic performances: the table of small cases, batch against the in-memory form, onsets, re-anchoring."""

import random

import numpy as np
import pytest

from stretto.functions.config import JudgeSettings, MatchSettings, StartSettings
from stretto.operators import assign, matching, reanchor, rhythm
from stretto.operators.recognize import recognize, summarize
from stretto.sources import audio
from stretto.streaming import sessions

HOP = 512 / 22050


def track(notes, wrong=lambda note, share: False, silence=False):
    """Frames that follow the notes; wrong(note, place within it) makes a frame five semitones off."""
    end = max(o + d for o, d, _ in notes) + 0.5
    t = np.arange(int(end / HOP)) * HOP
    midi = np.full(len(t), -1.0)
    for k, (o, d, m) in enumerate(notes):
        for i in np.flatnonzero((t >= o) & (t < o + d)):
            midi[i] = m + 5 if wrong(k, (t[i] - o) / d) else m
    if silence:
        midi[:] = -1.0
    return t, midi, midi >= 0


def judged(notes, onsets, frames, mode="detected_onset", tempo=120.0):
    return sessions.judge_notes([{"onset": o, "dur": d, "midi": m} for o, d, m in notes], onsets, *frames, HOP, tempo, JudgeSettings(mode=mode))


CASES = [
    ("close onset", [(0, 0.5, 69)], [0.05], {}, "detected_onset", lambda s: s[0]["onset_ok"] and abs(s[0]["onset_error"] - 0.05) < 1e-9),
    ("beyond tolerance", [(0, 0.5, 69)], [0.225], {}, "detected_onset", lambda s: not s[0]["onset_ok"]),
    ("whole phrase late", [(0, 0.5, 60), (0.5, 0.5, 62)], [0.3, 0.8], {}, "detected_onset", lambda s: [x["onset_ok"] for x in s] == [False, True]),
    ("half note too thin", [(0, 1.0, 60)], [0.0], {"wrong": lambda k, p: p > 0.6}, "detected_onset", lambda s: not s[0]["duration_ok"]),
    ("quarter thick enough", [(0, 0.5, 60)], [0.0], {"wrong": lambda k, p: p > 0.6}, "detected_onset", lambda s: s[0]["duration_ok"]),
    ("quarter too thin", [(0, 0.5, 60)], [0.0], {"wrong": lambda k, p: p > 0.45}, "detected_onset", lambda s: not s[0]["duration_ok"]),
    ("eighth without frames", [(0, 0.25, 60)], [0.0], {"silence": True}, "detected_onset", lambda s: not s[0]["duration_ok"]),
    ("eighth with one", [(0, 0.25, 60)], [0.0], {"wrong": lambda k, p: p > 0.05}, "detected_onset", lambda s: s[0]["duration_ok"]),
    ("flashes at both ends", [(0, 1.0, 60)], [0.0], {"wrong": lambda k, p: p < 0.1 or p > 0.9}, "detected_onset", lambda s: s[0]["duration_ok"]),
    ("no onset", [(0, 0.5, 60)], [], {}, "detected_onset", lambda s: s[0]["timing_result"] == "BOTH_ERROR"),
    ("no frames", [(0, 0.5, 60)], [0.0], {"silence": True}, "detected_onset", lambda s: s[0]["timing_result"] == "DURATION_ERROR"),
    ("grid, one onset", [(0, 0.5, 60), (0.5, 0.5, 62)], [0.35], {}, "score_grid", lambda s: all(x["duration_ok"] for x in s) and not s[1]["onset_ok"]),
    ("anchored", [(0, 0.5, 60), (0.5, 0.5, 62)], [0.0, 0.5], {}, "anchored_grid", lambda s: all(x["timing_result"] == "CORRECT" for x in s)),
]


@pytest.mark.parametrize("name,notes,onsets,kind,mode,holds", CASES, ids=[c[0] for c in CASES])
def test_cases(name, notes, onsets, kind, mode, holds):
    assert holds(judged(notes, onsets, track(notes, **kind), mode))


def performance(seed, n=40):
    rng = random.Random(seed)
    notes, at = [], 0.0
    for _ in range(n):
        d = rng.choice([0.125, 0.25, 0.5, 1.0])
        notes.append((at, d, float(rng.randrange(55, 75))))
        at += d + rng.choice([0, 0, 0.5])
    onsets = [o + rng.uniform(-0.3, 0.3) for o, _, _ in notes if rng.random() < 0.85] + [rng.uniform(0, at) for _ in range(3)]
    odd = {k for k in range(n) if rng.random() < 0.3}
    return notes, onsets, track(notes, lambda k, p: k in odd and p > 0.4)


@pytest.mark.parametrize("mode", ["detected_onset", "score_grid", "anchored_grid"])
def test_batch_equals_in_memory_judgement(spark, mode):
    plays = {p: performance(p) for p in range(6)}
    expected = spark.createDataFrame([(p, k, float(o), float(d), m, 1, k + 1, 120.0) for p, (n, _, _) in plays.items() for k, (o, d, m) in enumerate(n)], "perf_id long, ord long, onset double, dur double, midi double, measure int, idx int, tempo double")
    onsets = spark.createDataFrame([(p, t) for p, (_, o, _) in plays.items() for t in o], "perf_id long, t double")
    frames = spark.createDataFrame([(p, k, float(t), float(m), bool(v)) for p, (_, _, f) in plays.items() for k, (t, m, v) in enumerate(zip(*f))], "perf_id long, frame_idx long, t double, midi double, voiced boolean")
    got = {(r.perf_id, r.ord): r for r in rhythm.judge(expected, onsets, frames, JudgeSettings(mode=mode), HOP).collect()}
    assert len(got) == 240
    for p, (n, o, f) in plays.items():
        for s in judged(n, o, f, mode):
            r = got[p, s["index"]]
            assert (r.onset_ok, r.duration_ok, r.valid_frame_count, r.timing_result) == (s["onset_ok"], s["duration_ok"], s["valid_frame_count"], s["timing_result"])
            assert abs(r.duration_detected - s["duration_detected"]) < 1e-9 and r.det == s["det"]
    verdicts = recognize(expected, onsets, frames, JudgeSettings(mode=mode), HOP)
    totals = {r.perf_id: r for r in summarize(verdicts).collect()}
    assert all(t.total == 40 and 0 <= t.accuracy <= 1 for t in totals.values())


def test_greedy_equals_plain_search():
    rng = random.Random(3)
    for _ in range(200):
        expected = sorted(round(rng.uniform(0, 5), 1) for _ in range(rng.randrange(8)))
        found = [round(rng.uniform(0, 5), 1) for _ in range(rng.randrange(8))]
        rest, want = sorted(found), []
        for t in expected:
            want.append(rest.pop(min(range(len(rest)), key=lambda k: abs(rest[k] - t))) if rest else None)
        assert assign.greedy(expected, found) == want


def test_reanchor(spark):
    notes = [(0.0, 0.5, 60.0), (1.0, 0.5, 62.0), (1.5, 0.5, 64.0)]
    heard = [(0.0, 0.3, 60.0), (1.2, 0.5, 62.0), (1.7, 0.5, 64.0)]
    t, midi, voiced = track(heard)
    expected = spark.createDataFrame([(1, k, o, d, m, 120.0) for k, (o, d, m) in enumerate(notes)], "perf_id long, ord long, onset double, dur double, midi double, tempo double")
    frames = spark.createDataFrame([(1, float(a), float(b), bool(c)) for a, b, c in zip(t, midi, voiced)], "perf_id long, t double, midi double, voiced boolean")
    moved, events = reanchor.apply(expected, frames, HOP)
    rows = {r.ord: r for r in moved.collect()}
    event = events.collect()
    assert len(event) == 1 and abs(event[0].event_shift - 0.2) < 0.08 and event[0].rest_start < 0.45
    assert rows[0].dur < 0.45 and abs(rows[2].onset - 1.5 - event[0].event_shift) < 1e-4
    still, none = reanchor.apply(expected, frames, HOP, reanchor.ReanchorSettings(enabled=False))
    assert none.count() == 0 and {r.onset for r in still.collect()} == {0.0, 1.0, 1.5}


def test_onsets_and_pitch_of_sines():
    rate = 22050
    assert len(audio.onsets(np.zeros(rate), rate)) == 0
    tone = lambda sec: np.sin(2 * np.pi * 440 * np.arange(int(sec * rate)) / rate) * 0.5
    found = audio.onsets(np.concatenate([tone(0.35), np.zeros(int(0.25 * rate)), tone(0.35)]), rate)
    assert len(found) >= 2 and found[0] < 0.15 and min(abs(found - 0.6)) < 0.06
    _, hz, voiced = audio.pitch_track(tone(0.5), rate)
    assert voiced.all() and abs(12 * np.log2(np.median(hz) / 440)) < 0.1
    assert len(audio.pitch_track(np.zeros(100), rate)[0]) == 0
    x = audio.decode_wav(audio.encode_wav(tone(0.2), rate), rate)
    assert np.abs(x - tone(0.2)).max() < 1e-3
    with pytest.raises(ValueError):
        audio.decode_pcm(b"")
    clean = audio.preprocessed(tone(0.5), rate, highpass=80, top_db=40, use_harmonic=True, band=(100, 4000), target_rms=0.1, peak=0.9)
    assert 0.05 < np.sqrt((clean**2).mean()) < 0.15
    assert audio.chroma(tone(0.5), rate).sum(0).argmax() == 9 and audio.mel_db(tone(0.5), rate).shape[1] == 128


def brute_dtw(t, q, band=None):
    n, m = len(t), len(q)
    slack = None if band is None else max(1, int(band * max(n, m)))
    dp = {(i, 0): (0.0, i) for i in range(n + 1)}
    for j in range(1, m + 1):
        for i in range(1, n + 1):
            if slack is None or max(1, j - slack) <= i <= min(n, n - (m - j) + slack):
                options = [dp.get(k, (np.inf, 0)) for k in ((i - 1, j - 1), (i - 1, j), (i, j - 1))]
                best = min(range(3), key=lambda k: options[k][0])
                dp[i, j] = (float(np.linalg.norm(t[i - 1] - q[j - 1])) + options[best][0], i - 1 if j == 1 else options[best][1])
    return [dp.get((i, m), (np.inf, 0)) for i in range(1, n + 1)]


def test_warping_equals_cell_by_cell():
    rng = np.random.default_rng(4)
    for n, m, band in ((20, 5, None), (30, 12, None), (30, 12, 0.2), (8, 8, 0.1)):
        t, q = rng.standard_normal((n, 3)), rng.standard_normal((m, 3))
        cost, start = matching.warp(t, q, "l2", band)
        for (c, s), a, b in zip(brute_dtw(t, q, band), cost, start):
            assert np.isclose(c, a) or (np.isinf(c) and np.isinf(a))
            assert np.isinf(c) or s == b
    with pytest.raises(ValueError):
        matching.warp(t[:3], q)
    planted = np.zeros((20, 4))
    planted[2:6], planted[12:16] = np.eye(4), np.eye(4)
    assert {s for _, s, _ in matching.diverse(planted, np.eye(4), 2, separation=4)} == {2, 12}
    assert matching.best_global(planted, np.eye(4), MatchSettings("l2"))[0][1] <= 2
    assert matching.coarse_refined(rng.standard_normal((60, 4)), rng.standard_normal((8, 4)))


def test_start_session():
    s = sessions.StartSession(0.0, StartSettings(), 1000)
    found = lambda pcm, rate: (0.9, 1.0, 1.0)
    assert s.push(0, np.zeros(500), 1000, None, 0.1, found) == "listening"
    assert s.push(2, np.zeros(500), 1000, None, 0.2, None) == "listening" and s.filled == 500 and s.total == 1500
    assert s.push(1, np.zeros(500), 1000, None, 0.3, None) == "listening" and s.dropped == 1
    assert s.push(3, np.zeros(500), 1000, None, 0.4, found) == "started" and s.close() == "started"
    late = sessions.StartSession(0.0, StartSettings(timeout=1.0), 1000)
    assert len(s.settled()) < 1000 and len(s.pcm) == 0 and s.push(4, np.zeros(500), 1000, None, 0.5, found) == "started"
    assert late.evaluate(1.5, found) == "timed_out" and late.push(0, np.zeros(10), 1000, None, 2.0, found) == "timed_out"
    with pytest.raises(ValueError):
        sessions.StartSession(0.0, StartSettings(), 1000).push(0, np.zeros(1), 999, None, 0.0)
    with pytest.raises(ValueError):
        StartSettings(least_query=3.0, most_query=2.0)


def test_rhythm_session_agrees_with_the_whole():
    rate = 22050
    notes = [{"onset": 0.5 * k, "dur": 0.5, "midi": 60.0 + 2 * k} for k in range(5)]
    pieces = [0.4 * np.sin(2 * np.pi * 442 * 2 ** ((n["midi"] - 69) / 12) * np.arange(int(0.42 * rate)) / rate) for n in notes]
    pcm = np.concatenate([np.concatenate([p, np.zeros(int(0.5 * rate) - len(p))]) for p in pieces]).astype(np.float32)
    s = sessions.RhythmSession(notes, 120.0, rate)
    out = []
    for i in range(0, len(pcm), 2000):
        got = s.push(pcm[i : i + 2000], rate)
        while got:
            out.append(got)
            got = s.poll()
    out += s.flush()
    assert [x["index"] for x in out] == list(range(5))
    assert all(x["duration_ok"] for x in out) and sum(x["onset_ok"] for x in out) >= 4
    assert [x["timing_result"] for x in s.segments()][-1] == out[-1]["timing_result"]
    # frames heard piece by piece are those of the whole, and few samples stay
    assert np.allclose(s.rises, audio.spectral_flux(pcm, 512)) and len(s.tail) < 3000
    t, hz, voiced = audio.pitch_track(pcm, rate, 512)
    assert s.voiced == voiced.tolist()
    whole = sessions.judge_notes(notes, audio.onsets(pcm, rate, 512), t, np.where(voiced, 69 + 12 * np.log2(np.maximum(hz, 1e-9) / 442.0), -1.0), voiced, 512 / rate)
    assert [x["timing_result"] for x in whole] == [x["timing_result"] for x in out]


def test_rhythm_stream_equals_replay(spark, tmp_path):
    rate = 22050
    notes = [{"onset": 0.5 * k, "dur": 0.5, "midi": 60.0 + 2 * k} for k in range(4)]
    pcm = np.concatenate([np.r_[0.4 * np.sin(2 * np.pi * 442 * 2 ** ((n["midi"] - 69) / 12) * np.arange(9000) / rate), np.zeros(rate // 2 - 9000)] for n in notes]).astype(np.float32)
    parts = [pcm[i : i + 4000].tolist() for i in range(0, len(pcm), 4000)]
    rows = [(sid, k, p, rate, k == len(parts) - 1) for sid in range(2) for k, p in enumerate(parts)]
    packets = spark.createDataFrame(rows, "session_id long, seq long, pcm array<float>, sample_rate int, last boolean")
    for k in range(3):
        packets.where(f"seq >= {k * 4} and seq < {k * 4 + 4}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    packets.where("seq = 0").write.parquet(f"{tmp_path}/in/9")  # after the end: dropped
    stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    score = lambda sid: (notes, 120.0)
    query = sessions.judge_stream(stream, score).writeStream.format("memory").queryName("rhythm").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("rhythm").collect())) == sorted(map(tuple, sessions.replay_rhythm(packets, score).collect()))
    assert spark.table("rhythm").count() == 8


def test_streaming_equals_replay(spark, tmp_path):
    rng = random.Random(5)
    rows = [(sid, seq, [0.1] * 50, 1000, None, seq * 0.05) for sid in range(4) for seq in range(30) if rng.random() > 0.2]
    packets = spark.createDataFrame(rows, "session_id long, seq long, pcm array<float>, sample_rate int, t0_sec double, arrived double")
    for part in range(3):
        packets.where(f"seq >= {part * 10} and seq < {part * 10 + 10}").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = sessions.detect_starts(stream).writeStream.format("memory").queryName("starts").outputMode("update").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {r.session_id: r for r in spark.sql("select * from starts order by buffer_samples").collect()}
    for r in sessions.replay_starts(packets).collect():
        assert (last[r.session_id].buffer_samples, last[r.session_id].filled_samples) == (r.buffer_samples, r.filled_samples)
