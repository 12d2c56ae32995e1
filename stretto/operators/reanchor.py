"""Re-anchoring after rests: where a rest lets the player drift, later notes move along."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import ReanchorSettings, beat_sec

EVENT = ("rest_gap", "prev_end_expected", "prev_end_detected", "rest_start", "expected_before", "detected", "event_shift")


def rest_gaps(expected: DataFrame, s: ReanchorSettings = ReanchorSettings()) -> DataFrame:
    """Notes before which the score rests for long enough, with that gap. A shift moves both sides, so gaps never change."""
    w = Window.partitionBy("perf_id").orderBy("ord")
    gaps = expected.withColumn("gap", F.col("onset") - F.lag(F.col("onset") + F.col("dur")).over(w))
    return gaps.where(F.col("gap") >= F.lit(s.least_rest_beats) * beat_sec(F.col("tempo")) - 1e-9)


def runs(frames: DataFrame, key: str, time: str, gap: float) -> DataFrame:
    """Islands of frames no further apart than gap: run_start, run_end, n."""
    w = Window.partitionBy(key).orderBy(time)
    fresh = F.when(F.col(time) - F.lag(time).over(w) <= gap, 0).otherwise(1)
    islands = frames.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "_island").agg(F.min(time).alias("run_start"), F.max(time).alias("run_end"), F.count("*").alias("n")).drop("_island")


class Track:
    """A performance's frames in order of time."""

    def __init__(self, t: np.ndarray, midi: np.ndarray, voiced: np.ndarray, hop: float):
        order = np.argsort(t, kind="stable")
        self.t, self.midi, self.voiced, self.hop = t[order], midi[order], voiced[order], hop

    def matches(self, low: float, high: float, midi: float, tolerance: float) -> tuple[int, np.ndarray]:
        i, j = np.searchsorted(self.t, [low, high])
        return int(i), self.voiced[i:j] & (np.abs(self.midi[i:j] - midi) <= tolerance)

    def release(self, note: dict, end: float, beat: float, limit: float, s: ReanchorSettings) -> float | None:
        """When a note was let go: after its match nearest the expected end that something else soon follows, else after its last."""
        low, high = max(note["onset"], end - s.end_pre_beats * beat), min(end + s.end_post_beats * beat, limit)
        if high <= low:
            return None
        i, ok = self.matches(low, high, note["midi"], s.pitch_tolerance)
        at = i + np.flatnonzero(ok)
        if not len(at):
            return None
        soon = max(s.confirm, 2 * self.hop)
        for k in at[np.argsort(np.abs(self.t[at] - end), kind="stable")]:
            a, b = np.searchsorted(self.t, self.t[k] + 1e-9, "right"), np.searchsorted(self.t, self.t[k] + soon, "right")
            if (~self.voiced[a:b] | (np.abs(self.midi[a:b] - note["midi"]) > s.pitch_tolerance)).any():
                return min(float(self.t[k]) + self.hop, limit)
        return min(float(self.t[at[-1]]) + self.hop, limit)

    def entry(self, midi: float, low: float, high: float, expected: float, s: ReanchorSettings) -> float | None:
        """The start, nearest the expected one, of a run of enough matching frames."""
        i, ok = self.matches(low, high, midi, s.pitch_tolerance)
        t = self.t[i + np.flatnonzero(ok)]
        if len(t) < s.least_frames:
            return None
        edge = np.flatnonzero(np.r_[True, np.diff(t) > s.run_gap])
        starts = t[edge[np.diff(np.r_[edge, len(t)]) >= s.least_frames]]
        return float(starts[np.argmin(np.abs(starts - expected))]) if len(starts) else None


def shifted(notes: list[dict], track: Track, s: ReanchorSettings) -> None:
    """Moves the notes of one performance in place; what happened at a note stands in its event."""
    drift = 0.0
    for k, note in enumerate(notes):
        note["onset"] += drift
        note["shift"] = drift
        if not k or not s.enabled:
            continue
        before, beat = notes[k - 1], 60.0 / note["tempo"] if note["tempo"] > 0 else 0.5
        end, expected = before["onset"] + max(0.0, before["dur"]), note["onset"]
        gap = expected - end
        if gap + 1e-9 < s.least_rest_beats * beat:
            continue
        rest = track.release(before, end, beat, expected - s.confirm, s)
        if rest is None or rest >= expected - 1e-6:
            rest = end
        length = max(track.hop, rest - before["onset"])
        if abs(length - before["dur"]) <= s.most_shift_beats * beat:
            before["dur"] = length
        low, high = max(rest + s.confirm, expected - s.search_pre_beats * beat), expected + s.search_post_beats * beat
        found = track.entry(note["midi"], low, high if high > low else low + s.search_post_beats * beat, expected, s)
        if found is None or abs(found - expected) > s.most_shift_beats * beat:
            continue
        move = found - expected
        note["event"] = dict(zip(EVENT, (gap, end, rest, rest, expected, found, move)))
        if abs(move) >= 1e-4:
            note["onset"] += move
            drift += move
            note["shift"] = drift


def apply(expected: DataFrame, frames: DataFrame, hop: float, s: ReanchorSettings = ReanchorSettings()) -> tuple[DataFrame, DataFrame]:
    """(notes with onset, dur and shift as moved, events to four places). Each shift moves the search of all later notes, so a performance is one group."""
    fields = [f for f in expected.schema.fields if f.name not in ("onset", "dur")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "onset double, dur double, shift double", *[f"{c} double" for c in EVENT]])

    def run(notes: pa.Table, heard: pa.Table) -> pa.Table:
        rows = notes.sort_by("ord").to_pylist()
        column = lambda c: heard.column(c).to_numpy(zero_copy_only=False)
        shifted(rows, Track(column("t"), column("midi"), column("voiced").astype(bool), hop), s)
        for r in rows:
            r |= dict.fromkeys(EVENT) | r.pop("event", {})
        return pa.Table.from_pylist(rows, pa.schema([*[pa.field(f.name, notes.schema.field(f.name).type) for f in fields], *[pa.field(c, pa.float64()) for c in ("onset", "dur", "shift", *EVENT)]]))

    out = expected.groupBy("perf_id").cogroup(frames.select("perf_id", "t", "midi", "voiced").groupBy("perf_id")).applyInArrow(lambda a, b: run(a, b), schema)
    return out.drop(*EVENT), out.where("detected is not null").withColumns({c: F.round(c, 4) for c in EVENT})
