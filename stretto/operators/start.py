"""Where a recording starts: a query matched against the part of its template that follows the expected first note."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import MatchSettings, StartSettings
from ..functions.music import midi_to_name
from .matching import Match, best_global, match_pairs, normalized
from .rangejoin import covering


def anchors(events: DataFrame, starts: DataFrame) -> DataFrame:
    """pair, note_id, template_sec: the note of each start (pair, measure, note_index) in its template, by beat and time.

    A start without such a note is an error.
    """
    nth = F.row_number().over(Window.partitionBy("pair", "measure").orderBy("beat", "start_sec", "note_id"))
    found = starts.join(events.withColumn("note_index", nth).select("pair", "measure", "note_index", "note_id", "start_sec"), ["pair", "measure", "note_index"], "left")
    sec = F.when(F.col("start_sec").isNotNull(), F.col("start_sec")).otherwise(F.raise_error(F.concat(F.lit("no such start note in measure "), F.col("measure").cast("string"))).cast("double"))
    return found.select("pair", F.col("note_id").alias("anchor_id"), sec.alias("template_sec"))


def detect_starts(templates: DataFrame, queries: DataFrame, events: DataFrame, starts: DataFrame, frame_sec: float, s: StartSettings = StartSettings(), m: MatchSettings = MatchSettings()) -> DataFrame:
    """pair, started, score, template_sec, detected_sec, anchor_delta, note_id, pitch, onset.

    templates and queries are sequences (pair, idx, vec) of frames of frame_sec. Only the stretch of a template from its anchor on
    is matched. A match near the anchor is the anchor's note, another the note that covers it or is nearest.
    """
    at = anchors(events, starts)
    first = F.bround(F.col("template_sec") / F.lit(frame_sec)).cast("long")
    near = templates.join(at.withColumn("first", first), "pair").where((F.col("idx") >= F.col("first")) & (F.col("idx") <= F.bround((F.col("template_sec") + s.window_after) / F.lit(frame_sec))))

    def kernel(t: np.ndarray, q: np.ndarray) -> list[Match]:
        return best_global(*normalized(t, q, m.normalize), m) if 0 < len(q) <= len(t) else []

    found = match_pairs(near.select("pair", "idx", "vec"), queries, kernel).join(at.withColumn("first", first), "pair")
    found = found.withColumn("detected_sec", (F.col("start") + F.col("first")) * F.lit(frame_sec)).withColumn("anchor_delta", F.abs(F.col("detected_sec") - F.col("template_sec")))
    length = queries.groupBy("pair").agg((F.count("*") * F.lit(frame_sec)).alias("query_sec"))
    notes = covering(found.select("pair", F.col("pair").alias("point_id"), F.col("detected_sec").alias("t")), events.select("pair", "note_id", "start_sec", "end_sec"), "pair").select("pair", F.col("note_id").alias("near_id"))
    rows = found.join(length, "pair").join(notes, "pair", "left").withColumn("note_id", F.when(F.col("anchor_delta") <= s.anchor_snap, F.col("anchor_id")).otherwise(F.col("near_id")))
    rows = rows.join(events.select("pair", "note_id", "pitch_midi"), ["pair", "note_id"], "left")
    started: Column = (F.col("query_sec") >= s.least_query) & (F.col("score") >= s.least_score) & (F.col("anchor_delta") <= s.anchor_tolerance)
    return rows.select("pair", started.alias("started"), "score", "template_sec", "detected_sec", "anchor_delta", "note_id", midi_to_name(F.col("pitch_midi").cast("double")).alias("pitch"), F.greatest(F.lit(0.0), F.col("detected_sec") - F.col("template_sec")).alias("onset"))
