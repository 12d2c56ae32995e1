"""Onsets from a strength curve: adaptive threshold, rectification, peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import OnsetSettings


def spectral_flux(vectors: DataFrame, key: str = "seq_id", order: str = "idx", vec: str = "vec") -> DataFrame:
    """Adds flux: the rise of each component over the vector before (zeros before the first), summed."""
    before = F.lag(vec).over(Window.partitionBy(key).orderBy(order))
    rise = F.zip_with(F.col(vec), F.coalesce(before, F.transform(vec, lambda x: x * 0.0)), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    return vectors.withColumn("flux", F.aggregate(rise, F.lit(0.0), lambda s, x: s + x))


def thresholds(flux: DataFrame, s: OnsetSettings = OnsetSettings()) -> DataFrame:
    """Adds threshold: a multiple of the mean over the frames around, as far as there are any."""
    w = Window.partitionBy("perf_id").orderBy("frame_idx").rowsBetween(-s.window, s.window)
    return flux.withColumn("threshold", F.lit(s.multiplier) * F.avg("flux").over(w))


def peaks(flux: DataFrame, s: OnsetSettings = OnsetSettings()) -> DataFrame:
    """Frames whose strength over the threshold is above the next frame's; the last frame never is one."""
    rows = thresholds(flux, s).withColumn("filtered", F.greatest(F.col("flux") - F.col("threshold"), F.lit(0.0)))
    after = F.lead("filtered").over(Window.partitionBy("perf_id").orderBy("frame_idx"))
    return rows.withColumn("_after", after).where((F.col("filtered") > F.col("_after")) & (F.col("filtered") >= s.least_strength)).drop("_after")


def peak_times(peak_rows: DataFrame, hop: int, rate: int) -> DataFrame:
    return peak_rows.withColumn("t", F.col("frame_idx") * F.lit(float(hop)) / F.lit(float(rate)))
