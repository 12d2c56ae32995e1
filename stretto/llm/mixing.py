"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

A source that is to give more words than it has gives whole epochs first; what is left of its target it gives by weighted
sampling without replacement: document i draws the exponential key -ln(u_i) / w_i from a hash of its id, and documents enter in
the keys' order until the running sum of their words is nearest the budget. No source is sorted in one task: a source's keys are
cut at their own quantiles, the sums of the slices are added up, and the slice in which the budget ends is cut again, until few
documents are left to be looked at one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Slices that a source's keys are cut into at a time, and documents that are few enough to be sorted.
SLICES, EDGE_ROWS = 64, 2_000
#: Sources up to which their table, a few numbers each, is broadcast; parts that a source falls into beyond.
BROADCAST_SOURCES, SALTS = 20_000, 64
WORDS = r"[^\x20\x09-\x0D]+"


def text_quality(text: Column, size: Column) -> Column:
    """A weight from a text alone, in 0.25 to 1: ordinary mean word length weighs most."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.when(mean.between(3.5, 12.0), 1.0).when(mean.between(2.5, 20.0), 0.5).otherwise(0.25)


def targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """source, source_size, target. Sources by code point, null last, weigh as weights say, repeating; together they get share
    times all words; a target above most times its source's words stops there and its excess goes to the others by weight.

    The shares that stop are those whose bound is least in proportion to their weight, so one running sum over the sources in
    that order gives the level at which the rest share: a source gets min(bound, level * weight).
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("bound", F.col("source_size") * F.lit(float(most)))
    rising = Window.orderBy(F.col("bound") / F.col("weight"), "source")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # the level counts where the source itself does not stop below it: the first such one
    s = s.withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.col("level")))
    s = s.withColumn("level", F.coalesce(F.max("open").over(everything), F.lit(float("inf"))))
    return s.select("source", "source_size", F.least(F.col("bound"), F.col("level") * F.col("weight")).alias("target"))


def met(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """rows (doc_id, source, ...) with the columns of their source's row: sent to all tasks while there are few sources, else met
    under salted keys, so that no source gathers in one task."""
    per_source = per_source.withColumnRenamed("source", "_w")
    if per_source.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(per_source), rows.source.eqNullSafe(F.col("_w"))).drop("_w")
    salted = per_source.withColumn("_salt_w", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SALTS)).cast("int"))
    return rows.join(salted, rows.source.eqNullSafe(F.col("_w")) & (F.col("_salt") == F.col("_salt_w"))).drop("_w", "_salt", "_salt_w")


def edges(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (source, budget, ...) with lo, hi and before: the budget ends among the keys in (lo, hi], and the documents of keys up
    to lo have before words. Of keys that many documents share the slice stays whole."""
    inf = float("inf")
    state = wanted.withColumn("lo", F.lit(-inf)).withColumn("hi", F.lit(inf)).withColumn("before", F.lit(0).cast("long"))
    inside, last = sized.select("doc_id", "source", "size", "sort_key"), None
    quantiles = F.percentile_approx("sort_key", F.array(*[F.lit(k / SLICES) for k in range(1, SLICES)]), F.lit(2000))
    while True:
        cuts = common.written(inside.groupBy("source").agg(quantiles.alias("q"), F.count("*").alias("rows")), "cuts")
        most = cuts.agg(F.max("rows")).first()[0] or 0
        if most <= EDGE_ROWS or most == last:
            return state
        last = most
        slice_of = F.aggregate("q", F.lit(0), lambda n, x: n + F.when(x < F.col("sort_key"), 1).otherwise(0))
        sums = met(inside, cuts.drop("rows")).groupBy("source", slice_of.alias("slice")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("slice"))
        placed = sums.withColumn("below", upto - F.col("words")).withColumnRenamed("source", "s")
        joined = placed.join(state.select(F.col("source").alias("w"), "budget", F.col("before").alias("sofar")), F.col("s").eqNullSafe(F.col("w")))
        found = joined.where("sofar + below <= budget").groupBy("s").agg(F.max(F.struct("slice", "below")).alias("last"))
        found = found.join(cuts.select(F.col("source").alias("c"), "q"), F.col("s").eqNullSafe(F.col("c"))).select("s", "last.*", "q")
        state = state.join(found, state.source.eqNullSafe(found.s), "left").drop("s")
        bound = lambda k: F.try_element_at("q", k)
        state = state.withColumn("lo", F.when(F.col("slice") > 0, bound(F.greatest(F.col("slice"), F.lit(1)))).otherwise(F.col("lo")))
        state = state.withColumn("hi", F.when(F.col("slice") < SLICES - 1, bound(F.col("slice") + 1)).otherwise(F.col("hi")))
        state = common.written(state.withColumn("before", F.col("before") + F.coalesce("below", F.lit(0))).drop("slice", "below", "q"), "edges")
        inside = met(sized.select("doc_id", "source", "size", "sort_key"), state.select("source", "lo", "hi")).where("sort_key > lo and sort_key <= hi").drop("lo", "hi")


def mix(docs: DataFrame, weights: list[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (words: copies times size) and the columns keep, per row.

    A null text has size 0 and takes no part beyond its row; a null source is a source; repeated rows draw the same key and stay
    separate rows. Documents enter whole, so a source misses its target by half of one document at most. Reruns agree, since the
    keys are hashes. An empty table gives an empty result. Columns of docs that are not in keep are dropped; one of them that has
    a name of the result's comes back as own_ and its name.
    """
    names = common.own_names(keep, ("doc_id", "source", "text", "size", "source_size", "target", "copies", "taken"))
    inner = {c: f"kept_{k}" for k, c in enumerate(names)}
    table = docs.select("doc_id", "source", F.coalesce(F.col("text"), F.lit("")).alias("text"), *[F.col(c).alias(n) for c, n in inner.items()])
    size = F.regexp_count(F.col("text"), F.lit(WORDS)).cast("long")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    sized = table.withColumn("size", size).withColumn("weight", text_quality(F.col("text"), F.col("size"))).drop("text")
    sized = common.written(sized.withColumn("sort_key", -F.log(u) / F.col("weight")).drop("weight"), "sized")
    sums = common.written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sums")
    wanted = targets(sums, list(weights), share, most)
    wanted = wanted.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(0).cast("long"))
    wanted = common.written(wanted.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("budget", F.when(F.col("budget") >= 0.5, F.col("budget")).otherwise(0.0)), "targets")
    joined = met(sized, edges(sized, wanted))
    running = Window.partitionBy("source").orderBy("sort_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = (F.col("sort_key") > F.col("lo")) & (F.col("sort_key") <= F.col("hi"))
    edge = joined.where(at_edge).withColumn("after", F.col("before") + F.sum("size").over(running))
    # in as long as the sum with it is nearer the budget than the sum without it
    edge = edge.withColumn("more", (F.col("after") - F.col("size") / 2 <= F.col("budget")) & (F.col("budget") > 0)).drop("after")
    rest = joined.where(~at_edge).withColumn("more", F.col("sort_key") <= F.col("lo"))
    return rest.unionByName(edge).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("epochs") + F.col("more").cast("long")).alias("copies"),
        ((F.col("epochs") + F.col("more").cast("long")) * F.col("size")).alias("taken"), *[F.col(n).alias(names[c]) for c, n in inner.items()],
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs with its own columns, each as often as the mix takes it."""
    columns = [c for c in docs.columns if c not in ("doc_id", "source")]
    names = {c: f"own_{k}" for k, c in enumerate(columns)}
    carried = docs.select("doc_id", "source", "text", *[F.col(c).alias(n) for c, n in names.items()])
    taken = mix(carried, keep=tuple(names.values()), **options)
    taken = taken.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])
