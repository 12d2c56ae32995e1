"""Interval joins as hash joins: windows and times meet in buckets of time, then by their exact bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket: windows are mostly shorter, so most are in one or two. Seconds of a span, which one task sorts.
WIDTH, SPAN = 2.0, 64.0


def join_times(windows: DataFrame, times: DataFrame, key: str, start: str, end: str, time: str, how: str = "left", width: float = WIDTH) -> DataFrame:
    """Rows of windows with each row of times of the same key and start <= time < end.

    A window that spans several buckets is there once for each, and with how="left" so are its unmatched copies: what follows
    aggregates over the matched rows of a window. A window whose bounds are null or the wrong way round has no times.
    """
    low, high = F.floor(F.col(start) / width), F.floor(F.col(end) / width)
    buckets = F.when(F.col(end) > F.col(start), F.sequence(low, high)).otherwise(F.array(low))
    left = windows.withColumn("_bucket", F.explode(F.coalesce(buckets, F.array(F.lit(0).cast("long")))))
    right = times.withColumn("_bucket", F.floor(F.col(time) / width))
    left, right = left.alias("w"), right.alias("t")
    on = (F.col(f"w.{key}") == F.col(f"t.{key}")) & (F.col("w._bucket") == F.col("t._bucket")) & (F.col(f"t.{time}") >= F.col(f"w.{start}")) & (F.col(f"t.{time}") < F.col(f"w.{end}"))
    return left.join(right, on, how).select("w.*", *[F.col(f"t.{c}") for c in times.columns if c != key]).drop("_bucket")


def per_window(windows: DataFrame, times: DataFrame, key: str, number: str, start: str, end: str, time: str, *aggregates: Column) -> DataFrame:
    """windows (one row for each key and number) with aggregates over the rows of times in [start, end).

    A window's own columns travel with its matches, so nothing before it is computed a second time to be joined back.
    """
    own = [c for c in windows.columns if c not in (key, number)]
    met = join_times(windows.select(key, number, F.struct(*own).alias("_own"), F.col(start).alias("_start"), F.col(end).alias("_end")), times, key, "_start", "_end", time)
    out = met.groupBy(key, number).agg(F.first("_own").alias("_own"), *aggregates)
    return out.select(key, number, "_own.*", *[c for c in out.columns if c not in (key, number, "_own")])


def nearest_start(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """points (key, point_id, t) with near_id: the interval of the nearest start, the earlier of equally near ones.

    An as-of join both ways: points and starts of a span of time in one order, each point between its neighbours; a span's own first
    and last start stand in for it in what the spans around it are told. So a long key falls into many tasks, and no window looks
    ahead, which would begin anew at each row.
    """
    starts = intervals.groupBy(key, F.col("start_sec").alias("t")).agg(F.min("note_id").alias("note_id"))
    own, point = dict(intervals.dtypes)["note_id"], dict(points.dtypes)["point_id"]
    both = points.select(key, "t", "point_id").withColumn("at", F.lit(None).cast(f"struct<t:double,note_id:{own}>")).unionByName(
        starts.select(key, "t", F.lit(None).cast(point).alias("point_id"), F.struct(F.col("t").cast("double").alias("t"), "note_id").alias("at"))
    )
    both = both.withColumn("_span", F.floor(F.col("t") / SPAN))
    edges = both.groupBy(key, "_span").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    rising, falling = Window.partitionBy(key).orderBy("_span"), Window.partitionBy(key).orderBy(F.desc("_span"))
    told = edges.select(
        key, "_span", F.last("hi", ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, -1)).alias("left"), F.last("lo", ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, -1)).alias("right")
    )
    upto = lambda order: Window.partitionBy(key, "_span").orderBy(order, F.col("point_id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("b", F.last("at", ignorenulls=True).over(upto(F.asc("t")))).withColumn("a", F.last("at", ignorenulls=True).over(upto(F.desc("t"))))
    placed = placed.where("point_id is not null").join(told, [key, "_span"])
    placed = placed.withColumn("b", F.coalesce("b", "left")).withColumn("a", F.coalesce("a", "right"))
    near = F.when(F.col("b").isNull() | (F.abs(F.col("a.t") - F.col("t")) < F.abs(F.col("b.t") - F.col("t"))), F.col("a.note_id")).otherwise(F.col("b.note_id"))
    return placed.select(key, "point_id", "t", near.alias("near_id"))


def covering(points: DataFrame, intervals: DataFrame, key: str, closed: bool = False) -> DataFrame:
    """points (key, point_id, t) with note_id and covered: the interval that covers t, or else the one of the nearest start.

    Of covering intervals (key, note_id, start_sec, end_sec) the shortest counts, then the smallest note_id. closed: the end
    belongs to an interval.
    """
    spans = intervals.where("end_sec >= start_sec").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start_sec") / WIDTH), F.floor(F.col("end_sec") / WIDTH)))).alias("i")
    at = points.withColumn("_bucket", F.floor(F.col("t") / WIDTH)).alias("p")
    upper = F.col("p.t") <= F.col("i.end_sec") if closed else F.col("p.t") < F.col("i.end_sec")
    met = at.join(spans, (F.col(f"p.{key}") == F.col(f"i.{key}")) & (F.col("p._bucket") == F.col("i._bucket")) & (F.col("p.t") >= F.col("i.start_sec")) & upper)
    best = met.groupBy(F.col(f"p.{key}").alias(key), F.col("p.point_id").alias("point_id")).agg(F.min_by("i.note_id", F.struct(F.col("i.end_sec") - F.col("i.start_sec"), F.col("i.note_id"))).alias("own"))
    near = nearest_start(points, intervals, key).join(best, [key, "point_id"], "left")
    return near.select(key, "point_id", "t", F.coalesce("own", "near_id").alias("note_id"), F.col("own").isNotNull().alias("covered"))
