"""Notation files: a scan to items in document order, and the two timelines made of them."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import music as M

#: An item of a part: attributes, direction, backup, forward, note, or bars (what a multiple rest adds after its measure).
ITEM = pa.schema([
    ("path", pa.string()), ("title", pa.string()), ("sha256", pa.string()), ("part_no", pa.int32()), ("part_id", pa.string()), ("measure_seq", pa.int32()), ("measure", pa.int32()), ("seq", pa.int64()), ("kind", pa.string()),
    ("divisions", pa.float64()), ("beats", pa.float64()), ("beat_type", pa.float64()), ("chromatic", pa.int32()), ("fifths", pa.int32()), ("bars", pa.int32()), ("tempo", pa.float64()), ("mark", pa.float64()), ("offset", pa.float64()),
    ("ticks", pa.float64()), ("is_chord", pa.bool_()), ("is_rest", pa.bool_()), ("is_grace", pa.bool_()), ("is_cue", pa.bool_()), ("step", pa.string()), ("alter", pa.int32()), ("octave", pa.int32()), ("voice", pa.string()),
])
ITEM_SQL = "path string, title string, sha256 string, part_no int, part_id string, measure_seq int, measure int, seq long, kind string, divisions double, beats double, beat_type double, chromatic int, fifths int, bars int, tempo double, mark double, offset double, ticks double, is_chord boolean, is_rest boolean, is_grace boolean, is_cue boolean, step string, alter int, octave int, voice string"


def _bare(tag: str) -> str:
    return tag.rpartition("}")[2]


def _find(e: ET.Element, *path: str) -> ET.Element | None:
    for name in path:
        e = next((c for c in e if _bare(c.tag) == name), None)
        if e is None:
            return None
    return e


def _text(e: ET.Element | None, *path: str) -> str | None:
    e = _find(e, *path) if e is not None else None
    return e.text.strip() if e is not None and e.text and e.text.strip() else None


def _number(text: str | None) -> float | None:
    try:
        return float(text) if text is not None else None
    except ValueError:
        return None


def _tempo(direction: ET.Element) -> tuple[float | None, float | None]:
    """(quarters a minute, the mark as written): an attribute for playback wins over a printed mark."""
    sound = _find(direction, "sound")
    if sound is not None and sound.get("tempo") is not None:
        return float(sound.get("tempo")), float(sound.get("tempo"))
    mark = next((e for e in direction.iter() if _bare(e.tag) == "metronome"), None)
    per_minute = _number(_text(mark, "per-minute"))
    if per_minute is None:
        return None, None
    unit = M.BEAT_UNITS.get((_text(mark, "beat-unit") or "quarter").lower(), 1.0)
    return per_minute * unit * 1.5 ** sum(_bare(c.tag) == "beat-unit-dot" for c in mark), per_minute


def items_of(content: bytes, path: str = "", sha256: str | None = None) -> Iterator[dict]:
    """All parts' items; the placeholder measures under a multiple rest are left out."""
    root = ET.fromstring(content)
    title = _text(root, "work", "work-title") or _text(root, "movement-title") or PurePosixPath(path).stem
    for part_no, part in enumerate(e for e in root if _bare(e.tag) == "part"):
        skip = seq = 0
        for measure_seq, measure in enumerate(e for e in part if _bare(e.tag) == "measure"):
            if skip:
                skip -= 1
                continue
            here = {"path": path, "title": title, "sha256": sha256, "part_no": part_no, "part_id": part.get("id"), "measure_seq": measure_seq, "measure": int(measure.get("number", "0").split(".")[0] or 0)}
            bars = 0
            for e in measure:
                kind = _bare(e.tag)
                row: dict = {"kind": kind}
                if kind == "attributes":
                    beats, rest = _text(e, "time", "beats"), _number(_text(e, "measure-style", "multiple-rest"))
                    divisions = _number(_text(e, "divisions"))
                    row |= {"divisions": max(divisions, 1.0) if divisions is not None else None, "beats": float(beats.split("+")[0]) if beats else None, "beat_type": _number(_text(e, "time", "beat-type"))}
                    row |= {"chromatic": int(_number(_text(e, "transpose", "chromatic")) or 0) if _find(e, "transpose") is not None else None, "fifths": int(f) if (f := _text(e, "key", "fifths")) else None}
                    bars = max(bars, int(rest)) if rest is not None else bars
                elif kind == "direction":
                    row["tempo"], row["mark"] = _tempo(e)
                    row["offset"] = _number(_text(e, "offset")) or 0.0
                    if row["tempo"] is None:
                        continue
                elif kind in ("backup", "forward"):
                    row["ticks"] = _number(_text(e, "duration")) or 0.0
                elif kind == "note":
                    octave = _text(e, "pitch", "octave")
                    step = _text(e, "pitch", "step")
                    pitched = step in M.STEP_SEMITONES and octave is not None
                    row |= {"ticks": _number(_text(e, "duration")) or 0.0, "is_chord": _find(e, "chord") is not None, "is_rest": _find(e, "rest") is not None, "is_grace": _find(e, "grace") is not None}
                    row |= {"is_cue": e.get("print-object") == "no" or _find(e, "cue") is not None, "voice": _text(e, "voice")}
                    row |= {"step": step, "alter": int(_number(_text(e, "pitch", "alter")) or 0), "octave": int(octave)} if pitched else {}
                else:
                    continue
                seq += 1
                yield here | row | {"seq": seq}
            seq += 1
            yield here | {"kind": "bars", "bars": bars, "seq": seq}
            skip = max(bars - 1, 0)


def scan(spark: SparkSession, paths: str) -> DataFrame:
    """Items of all files under paths, a file in one task."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content", F.sha2("content", 256).alias("sha256"))
    return scan_contents(files)


def scan_contents(files: DataFrame) -> DataFrame:
    """Items of files (path, content, sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, sha in zip(*(b.column(c).to_pylist() for c in ("path", "content", "sha256"))):
                rows = list(items_of(content, path, sha))
                yield pa.RecordBatch.from_pylist(rows, ITEM)

    return files.mapInArrow(run, ITEM_SQL)


def _parts(items: DataFrame, part_id: str | None) -> DataFrame:
    return items.where(F.col("part_id") == part_id) if part_id is not None else items.where("part_no = 0")


def practice_notes(items: DataFrame, default_tempo: float = 120.0, part_id: str | None = None) -> DataFrame:
    """path, ord, pitch, pitch_midi, measure, beat, onset, duration, part_id: the first part's (or one part's) sounding notes.

    All as window sums over items in document order: the state in force, seconds and divisions before each item, the last
    note a chord tone belongs to. Tempo changes hold from where they are written. A move back or forth moves divisions only.
    """
    w = Window.partitionBy("path", "part_no").orderBy("seq")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = _parts(items, part_id)
    for name, default in (("divisions", 1.0), ("beats", 4.0), ("beat_type", 4.0), ("chromatic", 0), ("tempo", default_tempo)):
        rows = rows.withColumn(name, F.coalesce(F.last(name, ignorenulls=True).over(upto), F.lit(default)))
    note = F.coalesce((F.col("kind") == "note") & ~F.col("is_grace"), F.lit(False))
    own = note & ~F.col("is_chord")
    sounds = note & ~F.col("is_rest") & F.col("step").isNotNull() & (F.col("ticks") > 0)
    length = M.ticks_sec(F.col("ticks"), F.col("divisions"), F.col("tempo"))
    bar_ticks = F.col("beats") * (F.lit(4.0) / F.col("beat_type")) * F.col("divisions")
    rows = rows.withColumn("_sec", F.when(own & (F.col("is_rest") | sounds), length).when(F.col("kind") == "bars", F.col("bars") * M.measure_sec(F.col("beats"), F.col("beat_type"), F.col("tempo"))).otherwise(0.0))
    rows = rows.withColumn("_div", F.when(own | (F.col("kind") == "forward"), F.col("ticks")).when(F.col("kind") == "backup", -F.col("ticks")).when(F.col("kind") == "bars", F.col("bars") * bar_ticks).otherwise(0.0))
    rows = rows.withColumn("_at", F.coalesce(F.sum("_sec").over(before), F.lit(0.0))).withColumn("_pos", F.coalesce(F.sum("_div").over(before), F.lit(0.0)))
    rows = rows.withColumn("_bar", F.first("_pos").over(Window.partitionBy("path", "part_no", "measure_seq").orderBy("seq")))
    anchor = F.last(F.when(own & sounds, F.struct("_at", "_pos")), ignorenulls=True).over(upto)
    rows = rows.withColumn("_anchor", F.when(F.col("is_chord"), F.coalesce(anchor, F.struct(F.lit(0.0).alias("_at"), F.lit(0.0).alias("_pos")))).otherwise(F.struct("_at", "_pos"))).withColumn("_length", length).where(sounds)
    out = rows.select(
        "path", "seq", M.spelled_name(F.col("step"), F.col("alter"), F.col("octave")).alias("pitch"), M.spelled_midi(F.col("step"), F.col("alter"), F.col("octave"), F.col("chromatic")).alias("pitch_midi"), "measure",
        M.beat_in_quarters(F.col("_anchor._pos") - F.col("_bar"), F.col("divisions")).alias("beat"), F.col("_anchor._at").alias("onset"), F.col("_length").alias("duration"), "part_id",
    )
    return out.withColumn("ord", F.row_number().over(Window.partitionBy("path").orderBy("onset", "measure", "beat", "seq")).cast("long")).drop("seq")


def score_headers(items: DataFrame, default_tempo: float = 120.0, part_id: str | None = None) -> DataFrame:
    """path, title, sha256, tempo (the first in force), time_signature, key, total_measures."""
    rows = _parts(items, part_id)
    first_note = F.min(F.when((F.col("kind") == "note") & ~F.col("is_grace") & ~F.col("is_rest") & F.col("step").isNotNull() & (F.col("ticks") > 0), F.col("seq")))
    head = rows.groupBy("path").agg(
        F.first("title").alias("title"), F.first("sha256").alias("sha256"), first_note.alias("_note"), F.min_by("tempo", F.when(F.col("tempo").isNotNull(), F.col("seq"))).alias("_tempo"), F.min(F.when(F.col("tempo").isNotNull(), F.col("seq"))).alias("_mark"),
        F.max_by("beats", F.when(F.col("beats").isNotNull(), F.col("seq"))).alias("_beats"), F.max_by("beat_type", F.when(F.col("beat_type").isNotNull(), F.col("seq"))).alias("_type"), F.max_by("fifths", F.when(F.col("fifths").isNotNull(), F.col("seq"))).alias("_fifths"), F.max("measure").alias("total_measures"),
    )
    tempo = F.when(F.col("_mark").isNotNull() & (F.col("_note").isNull() | (F.col("_mark") < F.col("_note"))), F.col("_tempo")).otherwise(default_tempo)
    whole = lambda c, d: F.coalesce(F.col(c), F.lit(d)).cast("int").cast("string")
    return head.select("path", "title", "sha256", tempo.alias("tempo"), F.concat_ws("/", whole("_beats", 4.0), whole("_type", 4.0)).alias("time_signature"), M.key_name(F.coalesce("_fifths", F.lit(0))).alias("key"), "total_measures")


def rebased(notes: DataFrame, measure: int) -> DataFrame:
    """Onsets from a measure's first note on (from the first later note, if it has none); earlier notes stay."""
    w = Window.partitionBy("path")
    at = F.coalesce(F.min_by("onset", F.when(F.col("measure") == measure, F.col("ord"))).over(w), F.min_by("onset", F.when(F.col("measure") >= measure, F.col("ord"))).over(w), F.lit(0.0))
    return notes.withColumn("onset", F.when(F.col("measure") >= measure, F.col("onset") - at).otherwise(F.col("onset")))


EVENT = pa.schema([("path", pa.string()), ("note_id", pa.string()), ("measure", pa.int32()), ("beat", pa.float64()), ("pitch_midi", pa.int32()), ("start_sec", pa.float64()), ("end_sec", pa.float64()), ("duration_sec", pa.float64()), ("part_id", pa.string()), ("voice", pa.string())])
EVENT_SQL = "path string, note_id string, measure int, beat double, pitch_midi int, start_sec double, end_sec double, duration_sec double, part_id string, voice string"


class Cursor:
    """A part's place in divisions and seconds, under tempo marks that take effect later on, even inside a note."""

    def __init__(self, tempo: float):
        self.tempo, self.div, self.sec, self.divisions = tempo, 0.0, 0.0, 1.0
        self.later: list[tuple[float, float]] = []

    def seconds(self, ticks: float) -> float:
        return ticks / self.divisions * 60.0 / max(self.tempo, 1e-6)

    def take_effect(self) -> None:
        while self.later and self.later[0][0] <= self.div + 1e-9:
            self.tempo = self.later.pop(0)[1]

    def mark(self, tempo: float, offset: float) -> None:
        self.later = sorted([*self.later, (self.div + max(0.0, offset), tempo)], key=lambda m: m[0])
        self.take_effect()

    def forward(self, ticks: float) -> float:
        """Goes on by ticks, piece by piece between marks; the seconds that took."""
        goal, began = self.div + ticks, self.sec
        while goal - self.div > 1e-12:
            self.take_effect()
            stop = min([goal, *[at for at, _ in self.later if at > self.div + 1e-12]])
            self.sec += self.seconds(stop - self.div)
            self.div = stop
        self.take_effect()
        return self.sec - began

    def back(self, ticks: float) -> None:
        self.div -= ticks
        self.sec -= self.seconds(ticks)


def events_of(items: list[dict], default_tempo: float = 60.0) -> list[dict]:
    """Note events of one part's items in order. Cue and hidden notes take no time; an unpitched note has no midi number."""
    at = Cursor(default_tempo)
    beats = beat_type = 4.0
    chromatic = count = 0
    anchor, bar, in_measure = (0.0, 0.0), 0.0, None
    out = []
    for x in items:
        if x["measure_seq"] != in_measure:
            in_measure, bar = x["measure_seq"], at.div
            at.take_effect()
        kind = x["kind"]
        if kind == "attributes":
            at.divisions = x["divisions"] or at.divisions
            beats, beat_type = x["beats"] or beats, x["beat_type"] or beat_type
            chromatic = chromatic if x["chromatic"] is None else x["chromatic"]
        elif kind == "direction":
            at.mark(x["mark"], x["offset"])
        elif kind == "backup":
            at.back(x["ticks"])
        elif kind == "forward":
            at.forward(x["ticks"])
        elif kind == "bars" and x["bars"]:
            at.forward(x["bars"] * beats * 4.0 / max(beat_type, 1e-6) * at.divisions)
        elif kind == "note" and not x["is_cue"]:
            place = anchor if x["is_chord"] else (at.div, at.sec)
            if x["is_chord"] or x["is_grace"]:
                length = at.seconds(x["ticks"])
            else:
                anchor = place
                length = at.forward(x["ticks"])
            if x["is_rest"] or x["is_grace"] or x["ticks"] <= 0:
                continue
            count += 1
            midi = None if x["step"] is None else (x["octave"] + 1) * 12 + M.STEP_SEMITONES[x["step"]] + x["alter"] + chromatic
            out.append({
                "path": x["path"], "note_id": f"{x['part_id'] or 'part'}_m{x['measure']}_n{count}", "measure": x["measure"], "beat": (place[0] - bar) / (at.divisions * 4.0 / max(beat_type, 1e-6)) + 1.0, "pitch_midi": midi,
                "start_sec": place[1], "end_sec": place[1] + length, "duration_sec": length, "part_id": x["part_id"], "voice": x["voice"],
            })
    return out


def note_events(items: DataFrame, default_tempo: float = 60.0, part_id: str | None = None) -> DataFrame:
    """Note events of all parts (or one), for a template: one sequential pass per part, parts independent."""
    rows = items.where(F.col("part_id") == part_id) if part_id is not None else items

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(events_of(table.sort_by("seq").to_pylist(), default_tempo), EVENT)

    return rows.groupBy("path", "part_no").applyInArrow(lambda t: run(t), EVENT_SQL)


def score_id(path: Column) -> Column:
    """A readable id: the file's name and eight characters of its path's hash."""
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    return F.concat_ws("_", M.slug(stem), F.substring(F.sha2(path, 256), 1, 8))
