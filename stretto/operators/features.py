"""Vector sequences (seq_id, idx, vec) as windows: smoothing, differences, context, pooling, normalisation, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.music import norm


def _sum_vectors(rows: Column, like: Column) -> Column:
    return F.aggregate(rows, F.transform(like, lambda x: x * 0.0), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))


def smooth(seq: DataFrame, frames: int = 11) -> DataFrame:
    """The mean over frames centred on each, with zeros beyond the ends: always divided by frames."""
    w = Window.partitionBy("seq_id").orderBy("idx").rowsBetween(-(frames // 2), frames // 2)
    return seq.withColumn("vec", F.transform(_sum_vectors(F.collect_list("vec").over(w), F.col("vec")), lambda x: x / F.lit(float(frames))))


def l2_frames(seq: DataFrame) -> DataFrame:
    """Each vector to length 1; next to no length stays as it is."""
    return seq.withColumn("_n", norm(F.col("vec"))).withColumn("vec", F.when(F.col("_n") < 1e-8, F.col("vec")).otherwise(F.transform("vec", lambda x: x / F.col("_n")))).drop("_n")


def delta(seq: DataFrame) -> DataFrame:
    """Each vector with its difference to the one before (zeros for the first) behind it."""
    before = F.coalesce(F.lag("vec").over(Window.partitionBy("seq_id").orderBy("idx")), F.col("vec"))
    return seq.withColumn("vec", F.concat(F.col("vec"), F.zip_with("vec", before, lambda a, b: a - b)))


def context_mean(seq: DataFrame, frames: int) -> DataFrame:
    """Means over each whole run of frames (of all, if there are fewer), with center_frame, the middle of the run."""
    w = Window.partitionBy("seq_id").orderBy("idx")
    size = F.count("*").over(Window.partitionBy("seq_id"))
    rows = seq.withColumn("_c", F.least(F.lit(frames), size)).withColumn("_v", F.collect_list("vec").over(w.rowsBetween(0, frames - 1))).withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", size)
    rows = rows.where("_i + _c <= _n").withColumn("vec", F.transform(_sum_vectors(F.slice(F.col("_v"), F.lit(1), F.col("_c").cast("int")), F.col("vec")), lambda x: x / F.col("_c")))
    return rows.withColumn("center_frame", (F.col("_i") + F.floor(F.col("_c") / 2)).cast("long")).drop("_c", "_v", "_i", "_n")


def average_pool(seq: DataFrame, by: int = 4) -> DataFrame:
    """Means of each by frames; a remainder is dropped, a sequence shorter than by stays as it is."""
    n = F.count("*").over(Window.partitionBy("seq_id"))
    rows = seq.withColumn("_n", n)
    short = rows.where(F.col("_n") < by).select("seq_id", "idx", "vec")
    groups = rows.where(F.col("_n") >= by).groupBy("seq_id", F.floor(F.col("idx") / by).cast("long").alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "vec"))).alias("g")).where(F.size("g") == by)
    pooled = groups.withColumn("_r", F.transform("g", lambda s: s["vec"])).select("seq_id", "idx", F.transform(_sum_vectors(F.col("_r"), F.col("_r")[0]), lambda x: x / F.lit(float(by))).alias("vec"))
    return pooled.unionByName(short)


def template_stats(seq: DataFrame) -> DataFrame:
    """seq_id, mean, std (population; 1 where it is next to nothing) by component."""
    each = seq.select("seq_id", F.posexplode("vec").alias("d", "x")).groupBy("seq_id", "d").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    by_dim = F.array_sort(F.collect_list(F.struct("d", "m", F.when(F.col("s") < 1e-6, 1.0).otherwise(F.col("s")).alias("s"))))
    return each.groupBy("seq_id").agg(by_dim.alias("t")).select("seq_id", F.transform("t", lambda t: t["m"]).alias("mean"), F.transform("t", lambda t: t["s"]).alias("std"))


def standardize(rows: DataFrame, stats: DataFrame, template: str) -> DataFrame:
    """Rows with a column template, their vec by that sequence's mean and deviation."""
    joined = rows.join(stats.select(F.col("seq_id").alias("_t"), "mean", "std"), F.col(template) == F.col("_t"))
    z = F.zip_with(F.zip_with("vec", "mean", lambda a, b: a - b), F.col("std"), lambda a, b: a / b)
    return joined.withColumn("vec", z).drop("_t", "mean", "std")


def shared_minmax(rows: DataFrame, group: str) -> DataFrame:
    """vec between 0 and 1 by the least and the largest component of the whole group; zeros if they are equal."""
    w = Window.partitionBy(group)
    rows = rows.withColumn("_a", F.min(F.array_min("vec")).over(w)).withColumn("_b", F.max(F.array_max("vec")).over(w))
    scaled = F.transform("vec", lambda x: F.when(F.col("_b") - F.col("_a") < 1e-12, 0.0).otherwise((x - F.col("_a")) / (F.col("_b") - F.col("_a"))))
    return rows.withColumn("vec", scaled).drop("_a", "_b")


def slice_window(seq: DataFrame, start: Column, end: Column, hop: int = 512, rate: int = 22050) -> DataFrame:
    """Rows whose center_frame lies between two times, ends included, with centers from the first one on."""
    a, b = (F.bround(t * F.lit(float(rate)) / F.lit(float(hop))) for t in (start, end))
    rows = seq.where((F.col("center_frame") >= a) & (F.col("center_frame") <= b))
    return rows.withColumn("offset", F.min("center_frame").over(Window.partitionBy("seq_id"))).withColumn("center_frame", F.col("center_frame") - F.col("offset"))
