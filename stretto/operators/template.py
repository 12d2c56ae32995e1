"""Templates: features of a recording with a coarse form, and the score's note events stretched onto it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.config import SAMPLE_RATE, PitchFeatureSettings
from . import features
from .timeline import calibrate


def pitch_sequence(chroma: DataFrame, s: PitchFeatureSettings = PitchFeatureSettings()) -> DataFrame:
    """seq_id, idx, center_frame, vec of raw rows: smoothed, each of length 1, with differences, averaged over the context."""
    seq = features.smooth(chroma, s.smooth) if s.smooth > 1 else chroma
    seq = features.l2_frames(seq) if s.per_frame_norm else seq
    seq = features.delta(seq) if s.delta else seq
    frames = int(round(s.context_sec * SAMPLE_RATE / s.hop))
    if frames > 1:
        seq = features.context_mean(seq, frames)
        return seq.withColumn("idx", F.row_number().over(features.Window.partitionBy("seq_id").orderBy("center_frame")) - 1)
    return seq.withColumn("center_frame", F.col("idx"))


def build(chroma: DataFrame, events: DataFrame, durations: DataFrame, s: PitchFeatureSettings = PitchFeatureSettings(), offset: float = 0.0, least_sec: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(frames: template_id, kind fine or coarse, idx, vec; note events on the recording's time).

    durations (seq_id, duration_sec); a recording shorter than least_sec, if given, is an error.
    """
    if least_sec is not None:
        durations = durations.withColumn("duration_sec", F.when(F.col("duration_sec") >= least_sec, F.col("duration_sec")).otherwise(F.raise_error(F.lit("the recording is too short")).cast("double")))
    fine = pitch_sequence(chroma, s).select("seq_id", "idx", "vec")
    coarse = features.average_pool(fine, 4)
    frames = fine.withColumn("kind", F.lit("fine")).unionByName(coarse.withColumn("kind", F.lit("coarse"))).withColumnRenamed("seq_id", "template_id")
    stretched = calibrate(events.join(durations, "seq_id"), "seq_id", "duration_sec", offset)
    return frames, stretched.drop("duration_sec")
