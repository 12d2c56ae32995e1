"""The tables of scores and performances that the queries run on, as projections of the given star schema; and the same in SQL.

A supplier's line items are a piece, in the order of their full key; quantities are durations, so onsets are running sums. Sums
stay whole numbers until the last step, which makes the two engines agree to the bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNIT, HOP = 0.05, 0.1


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """perf_id, ord, q, cum (whole units), dur, onset, pitch_midi, measure, is_rest, keyed rows of all pieces."""
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    is_rest = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")
    rows = load(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", is_rest.alias("is_rest"))
    # dealt here, so that what is derived is not shuffled, and tables that need different columns of it share one shuffle
    rows = rows.repartition("l_suppkey").withColumn("ord", F.row_number().over(order)).withColumn("q", F.col("l_quantity").cast("long"))
    rows = rows.withColumn("cum", F.sum("q").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("q"))
    return rows.select(
        F.col("l_suppkey").alias("perf_id"), F.col("ord").cast("long").alias("ord"), "q", "cum", (F.col("q") * F.lit(UNIT)).alias("dur"), (F.col("cum") * F.lit(UNIT)).alias("onset"),
        (F.lit(48) + F.col("l_partkey") % 36).cast("double").alias("pitch_midi"), (F.floor(F.col("cum") / 40) + 1).cast("long").alias("measure"),
        "is_rest", "l_orderkey", "l_linenumber", "l_partkey",
    )


V_NOTES = """v_notes as (
  select perf_id, ord, q, cum, q * 0.05::double as dur, cum * 0.05::double as onset, pitch_midi, (cum // 40 + 1)::bigint as measure, is_rest, l_orderkey, l_linenumber, l_partkey from (
    select l_suppkey as perf_id, row_number() over w as ord, l_quantity::bigint as q,
      (sum(l_quantity::bigint) over (w rows between unbounded preceding and current row))::bigint - l_quantity::bigint as cum,
      (48 + l_partkey % 36)::double as pitch_midi, (l_returnflag = 'R' and l_linestatus = 'F') as is_rest, l_orderkey, l_linenumber, l_partkey
    from lineitem window w as (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)))"""


def expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """perf_id, ord, onset, dur, midi, measure, idx, tempo of the notes that sound."""
    idx = Window.partitionBy("perf_id", "measure").orderBy("ord")
    sounding = notes(spark, sf_dir).where(~F.col("is_rest"))
    return sounding.select("perf_id", "ord", "onset", "dur", F.col("pitch_midi").alias("midi"), "measure", F.row_number().over(idx).cast("long").alias("idx"), F.lit(120.0).alias("tempo"))


V_EXPECTED = """v_expected as (
  select perf_id, ord, onset, dur, pitch_midi as midi, measure, row_number() over (partition by perf_id, measure order by ord) as idx, 120.0::double as tempo from v_notes where not is_rest)"""


def _shift() -> Column:
    return ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 41 - 20).cast("double") / F.lit(100.0)


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """perf_id, t: detected onsets, some missing, none exact."""
    n = notes(spark, sf_dir).where(~F.col("is_rest") & (F.col("l_partkey") % 17 != 0))
    return n.select("perf_id", (F.col("onset") + _shift()).alias("t"))


V_ONSETS = """v_onsets as (
  select perf_id, onset + ((l_orderkey * 7919 + l_linenumber * 104729) % 41 - 20)::double / 100.0::double as t from v_notes where not is_rest and l_partkey % 17 <> 0)"""


def _frames(n: DataFrame) -> DataFrame:
    """The notes that have frames, with the first and the last of their numbers."""
    first, last = F.ceil(F.col("cum") / 2).cast("long"), (F.ceil((F.col("cum") + F.col("q")) / 2) - 1).cast("long")
    return n.where(~F.col("is_rest")).withColumn("first", first).withColumn("last", last)


def _frame(k: Column) -> tuple[Column, Column]:
    """(midi, voiced) of a note's frame."""
    off = F.when((F.col("l_orderkey") + k) % 7 == 0, 2.0).when((F.col("l_orderkey") + k) % 5 == 0, 0.4).otherwise(0.0)
    voiced = (F.col("l_partkey") + k * 3) % 11 != 0
    return F.when(voiced, F.col("pitch_midi") + off).otherwise(-1.0), voiced


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """perf_id, frame_idx, t, midi, voiced at a hop of two units: what a pitch tracker might have heard."""
    n = _frames(notes(spark, sf_dir)).where("last >= first")
    f = n.select("perf_id", "pitch_midi", "l_orderkey", "l_partkey", F.explode(F.sequence("first", "last")).alias("frame_idx"))
    midi, voiced = _frame(F.col("frame_idx"))
    return f.select("perf_id", "frame_idx", (F.col("frame_idx") * F.lit(HOP)).alias("t"), midi.alias("midi"), voiced.alias("voiced"))


def heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """perf_id, onset, frames: the rows of onsets and frames by note, so that they stay where their notes are."""
    n = _frames(notes(spark, sf_dir))

    def frame(k: Column) -> Column:
        midi, voiced = _frame(k)
        return F.struct(k.alias("frame_idx"), (k * F.lit(HOP)).alias("t"), midi.alias("midi"), voiced.alias("voiced"))

    found = F.when(F.col("l_partkey") % 17 != 0, F.col("onset") + _shift())
    return n.select("perf_id", found.alias("onset"), F.when(F.col("last") >= F.col("first"), F.transform(F.sequence("first", "last"), frame)).alias("frames"))


V_FRAMES = """v_frames as (
  select perf_id, k as frame_idx, k * 0.1::double as t, case when voiced then pitch_midi + (case when (l_orderkey + k) % 7 = 0 then 2.0 when (l_orderkey + k) % 5 = 0 then 0.4 else 0.0 end)::double else -1.0::double end as midi, voiced
  from (select *, (l_partkey + k * 3) % 11 <> 0 as voiced from (
    select perf_id, pitch_midi, l_orderkey, l_partkey, unnest(generate_series(ceil(cum / 2.0)::bigint, ceil((cum + q) / 2.0)::bigint - 1)) as k from v_notes where not is_rest)))"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, idx, vec: each label's embeddings in order of vec_id."""
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("long").alias("seq_id"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("idx"), F.col("embedding").cast("array<double>").alias("vec"))


V_FEAT = """v_feat as (
  select label::bigint as seq_id, row_number() over (partition by label order by vec_id) - 1 as idx, embedding::double[] as vec from embeddings)"""


def flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """perf_id, frame_idx, flux: a user's events in order."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("perf_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_idx"), F.col("value").alias("flux"))


V_FLUX = """v_flux as (
  select user_id as perf_id, row_number() over (partition by user_id order by ts, event_id) - 1 as frame_idx, value as flux from events)"""
