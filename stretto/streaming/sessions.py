"""Live sessions: keyed state over packets of samples. The state machines are plain objects with the clock passed in; the streaming
operators keep them per session and feed them micro-batches, and a replay over a finished table feeds them everything."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.config import JudgeSettings, StartSettings
from ..operators.assign import greedy
from ..sources import audio

#: (samples, rate) to (score, seconds in the template, seconds of the anchor).
Matcher = Callable[[np.ndarray, int], tuple[float, float, float]]


@dataclass
class StartSession:
    """Waits for a performance to start: listening, then started, timed_out or closed, where it stays.

    Late and repeated packets are dropped, missing ones become silence: as long as the times of packets tell, else as many
    packets of this size. Only the trailing window of samples is kept.
    """

    opened: float
    settings: StartSettings = field(default_factory=StartSettings)
    rate: int = audio.SAMPLE_RATE
    state: str = "listening"
    expected: int = 0
    total: int = 0
    filled: int = 0
    dropped: int = 0
    ends: float | None = None
    last_size: int = 0
    evaluated: float | None = None
    score: float = 0.0
    detected: float | None = None
    pcm: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))

    def missing(self, seq: int, size: int, t0: float | None) -> int:
        if seq <= self.expected:
            return 0
        if t0 is not None and self.ends is not None:
            return int(round(max(0.0, t0 - self.ends) * self.rate))
        return (seq - self.expected) * (size or self.last_size or max(1, int(round(self.rate / 256))))

    def push(self, seq: int, samples: np.ndarray, rate: int, t0: float | None, now: float, match: Matcher | None = None) -> str:
        if self.state != "listening":
            return self.state
        if rate != self.rate:
            raise ValueError(f"a packet of rate {rate} in a session of {self.rate}")
        if seq < self.expected:
            self.dropped += 1
            return self.evaluate(now, match)
        gap = self.missing(seq, len(samples), t0)
        self.filled += gap
        self.total += gap + len(samples)
        self.expected, self.last_size = seq + 1, len(samples)
        if t0 is not None:
            self.ends = t0 + len(samples) / self.rate
        keep = max(1, int(round(self.settings.most_query * self.rate)))
        self.pcm = np.concatenate([self.pcm, np.zeros(min(gap, keep), np.float32), samples.astype(np.float32)])[-keep:]
        return self.evaluate(now, match)

    def evaluate(self, now: float, match: Matcher | None) -> str:
        """Also what a heartbeat without samples does."""
        if self.state != "listening":
            return self.state
        if now - self.opened >= self.settings.timeout:
            self.state = "timed_out"
        elif match and len(self.pcm) / self.rate >= self.settings.least_query and (self.evaluated is None or now - self.evaluated >= self.settings.interval):
            self.evaluated = now
            self.score, self.detected, anchor = match(self.pcm, self.rate)
            if self.score >= self.settings.least_score and abs(self.detected - anchor) <= self.settings.anchor_tolerance:
                self.state = "started"
        return self.state

    def close(self) -> str:
        self.state = "closed" if self.state == "listening" else self.state
        return self.state

    def settled(self) -> bytes:
        """What is kept of it between batches; one that has ended needs its samples no more."""
        if self.state != "listening":
            self.pcm = self.pcm[:0]
        return pickle.dumps(self)


RESULT = "session_id long, state string, score double, detected double, buffer_samples long, filled_samples long, dropped long"


def _result(key: int, s: StartSession) -> pd.DataFrame:
    return pd.DataFrame({"session_id": [key], "state": [s.state], "score": [float(s.score)], "detected": pd.array([s.detected], "Float64"), "buffer_samples": [s.total], "filled_samples": [s.filled], "dropped": [s.dropped]})


def _feed(s: StartSession, packets: pd.DataFrame, match: Matcher | None) -> None:
    for p in packets.itertuples():
        t0 = None if p.t0_sec is None or p.t0_sec != p.t0_sec else float(p.t0_sec)
        s.push(int(p.seq), np.asarray(p.pcm, np.float32), int(p.sample_rate), t0, float(p.arrived), match)


def detect_starts(packets: DataFrame, matcher: Callable[[int], Matcher] | None = None, settings: StartSettings = StartSettings()) -> DataFrame:
    """A stream of packets (session_id, seq, pcm, sample_rate, t0_sec, arrived) to a row per session and micro-batch.

    arrived, in seconds, is the clock, so a replay gives the same results; a processing-time timer ends sessions that fall silent.
    matcher makes a session's matching function. A session's state is a window of samples and a few numbers; of one that has ended
    the numbers stay, so whatever comes later is told the same end again.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            s = pickle.loads(state.get[0])
            s.evaluate(s.opened + settings.timeout, None)
            state.update((s.settled(),))
            yield _result(key[0], s)
            return
        rows = pd.concat(list(batches)).sort_values(["arrived", "seq"], kind="stable")
        s = pickle.loads(state.get[0]) if state.exists else StartSession(float(rows["arrived"].iloc[0]), settings, int(rows["sample_rate"].iloc[0]))
        _feed(s, rows, matcher(key[0]) if matcher else None)
        state.update((s.settled(),))
        if s.state == "listening":
            state.setTimeoutDuration(int(settings.timeout * 1000))
        yield _result(key[0], s)

    return packets.groupBy("session_id").applyInPandasWithState(run, RESULT, "session binary", "update", GroupStateTimeout.ProcessingTimeTimeout)


def replay_starts(packets: DataFrame, matcher: Callable[[int], Matcher] | None = None, settings: StartSettings = StartSettings()) -> DataFrame:
    """The final state of each session of a finished table of packets."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["arrived", "seq"], kind="stable")
        s = StartSession(float(rows["arrived"].iloc[0]), settings, int(rows["sample_rate"].iloc[0]))
        _feed(s, rows, matcher(key[0]) if matcher else None)
        return _result(key[0], s)

    return packets.groupBy("session_id").applyInPandas(run, RESULT)


# Rhythm


def judge_notes(expected: list[dict], onsets: Iterable[float], t: np.ndarray, midi: np.ndarray, voiced: np.ndarray, hop: float, tempo: float = 120.0, s: JudgeSettings = JudgeSettings()) -> list[dict]:
    """What the batch operator does for one performance held in memory. expected: onset, dur, midi, is_rest."""
    notes = [n for n in expected if not n.get("is_rest")]
    det = greedy([n["onset"] for n in notes], list(onsets))
    beat = 60.0 / tempo if tempo > 0 else 0.5
    tau, out = min(s.onset_beats * beat, s.onset_cap), []
    for k, (n, d) in enumerate(zip(notes, det)):
        before = det[k - 1] if k else None
        error = None if d is None else d - n["onset"]
        off = None if d is None else error if before is None else (d - before) - (n["onset"] - notes[k - 1]["onset"])
        next_onset, next_det = (notes[k + 1]["onset"], det[k + 1]) if k + 1 < len(notes) else (None, None)
        if s.mode == "detected_onset":
            a, b = d, next_det
        elif s.mode == "score_grid":
            a, b = n["onset"], next_onset
        else:
            a, b = n["onset"], n["onset"] + n["dur"] if next_onset is None else min(n["onset"] + n["dur"], next_onset)
        pre, post = (max(0.0, s.pre_beats * beat), max(0.0, s.post_beats * beat)) if s.mode == "anchored_grid" else (0.0, 0.0)
        dur, fast = n["dur"], n["dur"] < beat
        valid, detected, ok = 0, 0.0, False
        if a is not None and dur > 0:
            b = a + dur if b is None or b <= a else b
            b = max(b, a + max(dur, hop)) if fast else b
            t0, t1 = a - pre, b + post
            t1 = t0 + max(dur, hop) if t1 <= t0 else t1
            i, j = np.searchsorted(t, [t0, t1])
            size = j - i
            if not fast and size > 1:
                head = max(1, int(size * s.trim))
                i, j = (i + head, j - head) if 2 * head < size else (i + size // 2, i + size // 2 + 1)
            valid = int((voiced[i:j] & (np.abs(midi[i:j] - n["midi"]) <= s.pitch_tolerance)).sum())
            detected = valid * hop if fast else valid / (j - i) * dur if j > i else 0.0
            ratio = detected / dur
            ok = valid >= 1 if fast else ratio >= (s.long_ratio if dur >= 2 * beat else s.quarter_ratio) and (s.most_ratio is None or ratio <= s.most_ratio)
        onset_ok = off is not None and abs(off) <= tau
        out.append({"index": k, "det": d, "onset_error": error, "onset_ok": onset_ok, "duration_detected": detected, "duration_ok": bool(ok), "valid_frame_count": valid, "timing_result": {(True, True): "CORRECT", (False, True): "ONSET_ERROR", (True, False): "DURATION_ERROR"}.get((onset_ok, bool(ok)), "BOTH_ERROR")})
    return out


class RhythmSession:
    """Judges notes as they close: when the next one has an onset where it is expected and the samples reach past both.

    Each frame is analysed once, as its samples come: what stays is a rise, a pitch and a mark a frame, and the samples of the
    frames not yet whole.
    """

    #: Samples of a pitch frame.
    PITCH_SIZE = 2048

    def __init__(self, expected: list[dict], tempo: float = 120.0, rate: int = audio.SAMPLE_RATE, settings: JudgeSettings = JudgeSettings()):
        self.expected = [n for n in expected if not n.get("is_rest")]
        if not self.expected:
            raise ValueError("no note to judge")
        self.tempo, self.rate, self.settings = tempo if tempo > 0 else 120.0, rate, settings
        self.size = 512 if self.tempo >= 120 else 1024
        self.tail, self.total, self.emitted, self.closed = np.zeros(0, np.float32), 0, 0, False
        self.spectrum = np.zeros(self.size // 2 + 1)
        self.rises: list[float] = []
        self.midi: list[float] = []
        self.voiced: list[bool] = []
        self.queue: list[dict] = []
        self.known: tuple[tuple[float, ...], list[dict]] | None = None

    @property
    def seconds(self) -> float:
        return self.total / self.rate

    def hear(self, samples: np.ndarray) -> None:
        """Analyses the frames that the samples complete; both kinds of frames begin every size samples."""
        self.tail = np.concatenate([self.tail, samples.astype(np.float32)])
        self.total += len(samples)
        begin = self.total - len(self.tail)
        new = self.tail[len(self.rises) * self.size - begin :]
        spectra = audio.magnitudes(new, self.size)
        for m in spectra:
            self.rises.append(float(np.maximum(m - self.spectrum, 0).sum()))
            self.spectrum = m
        _, hz, voiced = audio.pitch_track(self.tail[len(self.midi) * self.size - begin :], self.rate, self.size, self.PITCH_SIZE)
        self.midi += np.where(voiced, 69 + 12 * np.log2(np.maximum(hz, 1e-9) / 442.0), -1.0).tolist()
        self.voiced += voiced.tolist()
        self.tail = self.tail[min(len(self.rises), len(self.midi)) * self.size - begin :].copy()

    def segments(self) -> list[dict]:
        """The judgement of all samples so far; again only when the onsets have changed."""
        onsets = tuple((audio.pick_peaks(np.array(self.rises)) * self.size / self.rate).tolist())
        if self.known is None or self.known[0] != onsets or self.closed:
            t = np.arange(len(self.midi)) * self.size / self.rate
            self.known = onsets, judge_notes(self.expected, onsets, t, np.array(self.midi), np.array(self.voiced, bool), self.size / self.rate, self.tempo, self.settings)
        return self.known[1]

    def push(self, samples: np.ndarray, rate: int) -> dict | None:
        if rate != self.rate:
            raise ValueError(f"a packet of rate {rate} in a session of {self.rate}")
        if not self.closed and len(samples):
            self.hear(samples)
            self._advance(False)
        return self.poll()

    def poll(self) -> dict | None:
        return self.queue.pop(0) if self.queue else None

    def flush(self) -> list[dict]:
        if not self.closed:
            self.known = None
            self._advance(True)
            self.closed = True
        out, self.queue = self.queue, []
        return out

    def _advance(self, final: bool) -> None:
        n = len(self.expected)
        if self.emitted >= n or self.total < self.size:
            return
        if not final and (self.emitted + 1 >= n or self.seconds < self.expected[self.emitted + 1]["onset"]):
            return
        beat = 60.0 / self.tempo
        tau = min(self.settings.onset_beats * beat, self.settings.onset_cap)
        segments = self.segments()
        while self.emitted < n:
            if not final:
                if self.emitted + 1 >= n:
                    break
                here, after, want = segments[self.emitted]["det"], segments[self.emitted + 1]["det"], self.expected[self.emitted + 1]["onset"]
                if here is None or after is None or abs(after - want) > tau or self.seconds < max(after + 0.01, want):
                    break
            self.queue.append(segments[self.emitted])
            self.emitted += 1


RHYTHM = "session_id long, note_index long, onset_ok boolean, duration_ok boolean, timing_result string"


def _judged(key: int, out: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({"session_id": [key] * len(out), "note_index": [s["index"] for s in out], "onset_ok": [bool(s["onset_ok"]) for s in out], "duration_ok": [bool(s["duration_ok"]) for s in out], "timing_result": [s["timing_result"] for s in out]})


def _heard(session: RhythmSession, rows: pd.DataFrame) -> list[dict]:
    out = []
    for p in rows.sort_values("seq", kind="stable").itertuples():
        got = session.push(np.asarray(p.pcm, np.float32), int(p.sample_rate))
        while got is not None:
            out.append(got)
            got = session.poll()
        if p.last:
            out += session.flush()
    return out


def judge_stream(packets: DataFrame, scores: Callable[[int], tuple[list[dict], float]], settings: JudgeSettings = JudgeSettings(), idle: float = 3600.0) -> DataFrame:
    """A stream of packets (session_id, seq, pcm, sample_rate, last) to the notes that close; a packet marked last closes the rest.

    So does a silence of idle seconds. Of a closed session a mark stays, by which what comes after it is dropped.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session = pickle.loads(state.get[0]) if state.exists else None
        if state.hasTimedOut:
            out = session.flush() if session else []
            state.update((pickle.dumps(None),))
            yield _judged(key[0], out)
            return
        rows = pd.concat(list(batches))
        if not state.exists:
            notes, tempo = scores(key[0])
            session = RhythmSession(notes, tempo, int(rows["sample_rate"].iloc[0]), settings)
        out = _heard(session, rows) if session else []
        if session and not session.closed:
            state.update((pickle.dumps(session),))
            state.setTimeoutDuration(int(idle * 1000))
        else:
            state.update((pickle.dumps(None),))
        yield _judged(key[0], out)

    return packets.groupBy("session_id").applyInPandasWithState(run, RHYTHM, "session binary", "append", GroupStateTimeout.ProcessingTimeTimeout)


def replay_rhythm(packets: DataFrame, scores: Callable[[int], tuple[list[dict], float]], settings: JudgeSettings = JudgeSettings()) -> DataFrame:
    """The notes that each session of a finished table of packets has closed."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        notes, tempo = scores(key[0])
        return _judged(key[0], _heard(RhythmSession(notes, tempo, int(rows["sample_rate"].iloc[0]), settings), rows))

    return packets.groupBy("session_id").applyInPandas(run, RHYTHM)
