"""Exact top-k inner products by block-at-a-time pruning.

Vectors are sparse or dense lists of integer term weights. Rows fall into parts by hash, a part's rows are cut into blocks by id,
and a block keeps each term's largest and smallest weight, and so does a part. A query visits blocks in the order of its bound on
their scores - the summed extremes of its terms - scores a block through its forward index, and stops when the next bound is below
its kth score, which one part hands on to all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .vectors import matrix, usable

#: Rows of a part, about; rows of a block; queries that meet a part together; parts whose extremes a query block meets together.
PART_ROWS, BLOCK_ROWS, QUERY_ROWS, PACK_PARTS = 4096, 64, 1024, 1024
GROUPED = "g long, ids binary, counts binary, dims int, kind string, weights binary"
GROUPED_NAMES = [c.split()[0] for c in GROUPED.split(", ")]


LEAST, MOST = -(1 << 63), (1 << 63) - 1


def packed(rows: DataFrame, group: str) -> DataFrame:
    """The rows of each group in one row of bytes, by id; weights in the narrowest type that holds them."""

    def pack(table: pa.Table) -> pa.Table:
        x = matrix(table.column("w"), np.int64)
        ids, n = table.column("vec_id").to_numpy(), table.column("n").to_numpy()
        order = np.lexsort((*x.T[::-1], ids))
        kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= x.min(initial=0) and x.max(initial=0) <= np.iinfo(k).max)
        return pa.table(
            {"g": pa.array([table.column(group)[0].as_py()], pa.int64()), "ids": pa.array([ids[order].astype("<i8").tobytes()]), "counts": pa.array([n[order].astype("<i8").tobytes()]), "dims": pa.array([x.shape[1]], pa.int32()), "kind": pa.array([kind]), "weights": pa.array([x[order].astype(kind).tobytes()])}
        )

    return rows.groupBy(group).applyInArrow(pack, GROUPED)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, counts, weights."""
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["counts"], "<i8"), np.frombuffer(row["weights"], row["kind"]).reshape(len(ids), row["dims"]).astype(np.int64)


def widened(*weights: np.ndarray) -> list[np.ndarray]:
    """Weights with zeros to the same number of terms, in a type in which sums of their products are exact: doubles as long as no
    sum leaves 53 bits, then integers, then integers of any size."""
    dims = max(w.shape[1] for w in weights)
    weights = [np.pad(w, ((0, 0), (0, dims - w.shape[1]))) for w in weights]
    # by the magnitudes as doubles, with room for their own rounding
    most = np.prod([np.abs(w.astype(np.float64)).max(initial=0) for w in weights[:2]]) * max(1, dims) * 1.001
    return [w.astype(np.float64 if most < 2**53 else np.int64 if most < 2**63 else object) for w in weights]


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The most that each query can score with rows between those extremes."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, counts: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query's position, ids, scores, blocks scored) of each query's k best rows in a part, but none below its floor.

    Rows that are equal stand there once, with a count. Of a query's own one copy does not count.
    """
    q, x = widened(q, x)
    starts = np.arange(0, len(x), BLOCK_ROWS)
    most = bounds(q, np.maximum.reduceat(x, starts), np.minimum.reduceat(x, starts))
    order = np.argsort(-most, axis=1, kind="stable")
    for r in range(len(q)):
        top_s, top_i = np.zeros(0, x.dtype if x.dtype != object else np.int64), np.zeros(0, np.int64)
        least = floor[r] if floor is not None else None
        seen = 0
        # blocks are scored a few at a time, as many as the bounds ask for
        while seen < len(starts):
            some = order[r, seen : seen + 4]
            if least is not None:
                some = some[most[r, some] >= least]
            if not len(some):
                break
            seen += len(some)
            rows = (starts[some][:, None] + np.arange(BLOCK_ROWS)).ravel()
            rows = rows[rows < len(x)]
            s, i, n = x[rows] @ q[r], ids[rows], np.minimum(counts[rows], k + 1)
            if s.dtype == object:
                s = np.array([max(LEAST, min(MOST, v)) for v in s.tolist()], np.int64)
            own = np.flatnonzero(i == q_ids[r])
            n[own] -= (x[rows[own]] == q[r]).all(1)
            if least is not None:
                n = np.where(s >= least, n, 0)
            s, i = np.concatenate([top_s, np.repeat(s, n)]), np.concatenate([top_i, np.repeat(i, n)])
            first = np.lexsort((-i, s))[::-1][:k]
            top_s, top_i = s[first], i[first]
            if len(top_s) == k:
                least = top_s[-1]
        yield r, top_i, top_s, seen


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row its k best other rows by inner product of floor(scale * x).

    Ties go to the smaller id. Queries are the rows for which is_query holds; they meet all rows in blocks. A block of queries takes
    each query's kth best score from one part first; of the other parts it is sent only to those whose extremes let a query reach
    that score, and there blocks below it are passed over. Vectors that are null or hold a null or non-finite component take no part,
    nor do rows with a null id; an empty vector scores 0 against all. Every row but the query's own is a candidate, so repeated rows
    are candidates of each other and queries of their own. Shorter vectors end in zeros. A scaled component beyond 64 bits is the
    nearest long, and so is a score. Fewer rows than k give fewer results; an empty table
    none.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    finite = usable(vector) | (F.size(vector) == 0)
    scaled = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * F.lit(scale)))
    rows = vectors.where(F.col(id_column).isNotNull() & finite).select(F.col(id_column).cast("long").alias("vec_id"), scaled.alias("w"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # zeros at the end say nothing: without them equal vectors are equal lists
    length = F.aggregate("w", F.struct(F.lit(0).alias("i"), F.lit(0).alias("last")), lambda s, x: F.struct((s["i"] + 1).alias("i"), F.when(x != 0, s["i"] + 1).otherwise(s["last"]).alias("last")))["last"]
    rows = rows.withColumn("w", F.when(F.try_element_at("w", F.lit(-1)) == 0, F.slice("w", F.lit(1), length)).otherwise(F.col("w")))
    rows = common.written(rows.groupBy("vec_id", "w").agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("asked")), "weights")
    parts = max(1, -(-rows.count() // PART_ROWS))
    queries = rows.where("asked > 0")
    groups = max(1, -(-queries.count() // QUERY_ROWS))
    held = common.written(packed(rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "w", F.lit(3)), F.lit(parts)).cast("long")), "part"), "parts")
    # a query carries the number of its own rows that ask, in place of a count
    asked = queries.drop("n").withColumnRenamed("asked", "n").withColumn("block", F.pmod(F.xxhash64("vec_id", "w", F.lit(5)), F.lit(groups)).cast("long"))
    asked = common.written(packed(asked, "block"), "queries").select([F.col(c).alias(f"q_{c}") for c in GROUPED_NAMES])

    def asked_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return unpack({c: row[f"q_{c}"] for c in GROUPED_NAMES})

    def scored(batches: Iterator[pa.RecordBatch], with_floor: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                q_ids, _, q = asked_of(row)
                ids, counts, x = unpack(row)
                out = list(best(q_ids, q, ids, counts, x, k, [int(f) for f in row["floor"]] if with_floor else None))
                sizes = [len(i) for _, i, _, _ in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(sum(sizes), row["q_g"], np.int64)), pa.array(np.repeat(np.arange(len(q_ids)), sizes), pa.int64()), pa.array([v for _, i, _, _ in out for v in i.tolist()], pa.int64()), pa.array([int(v) for _, _, s, _ in out for v in s.tolist()], pa.int64())],
                    names=["block", "position", "vec_id", "score"],
                )

    found_schema = "block long, position long, vec_id long, score long"
    first = asked.withColumn("part", F.pmod(F.col("q_g"), F.lit(parts))).join(held.withColumnRenamed("g", "part"), "part")
    first = common.written(first.mapInArrow(lambda batches: scored(batches, False), found_schema), "first")
    kth = F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-(1 << 63)))
    floors = first.groupBy("block", "position").agg(kth.alias("kth"))
    floors = floors.groupBy("block").agg(F.expr("map_from_entries(collect_list(struct(position, kth)))").alias("kths"))
    floors = asked.join(floors, F.col("q_g") == F.col("block"), "left").select(
        *asked.columns, F.transform(F.sequence(F.lit(0), (F.length("q_ids") / 8 - 1).cast("int")), lambda i: F.coalesce(F.try_element_at("kths", i.cast("long")), F.lit(-(1 << 63)))).alias("floor")
    )
    floors = common.written(floors, "floors")

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                _, _, x = unpack(row)
                yield pa.RecordBatch.from_pylist([{"part": row["g"], "high": x.max(0).tolist(), "low": x.min(0).tolist()}], pa.schema([("part", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))]))

    edges = held.mapInArrow(extremes, "part long, high array<long>, low array<long>").withColumn("pack", F.floor(F.col("part") / PACK_PARTS))
    packs = edges.groupBy("pack").agg(F.collect_list(F.struct("part", "high", "low")).alias("edges"))  # of a bounded number of parts

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                _, _, q = asked_of(row)
                dims = max(len(e["high"]) for e in row["edges"])
                high, low = (np.array([e[c] + [0] * (dims - len(e[c])) for e in row["edges"]], np.int64).reshape(len(row["edges"]), dims) for c in ("high", "low"))
                own = row["q_g"] % parts
                wide, both = widened(q, np.concatenate([np.maximum(high, 0), np.minimum(low, 0)]))
                hit = (bounds(wide, both[: len(high)], both[len(high) :]) >= np.array(row["floor"]).astype(wide.dtype)[:, None]).any(0)
                met = [e["part"] for e, h in zip(row["edges"], hit.tolist()) if h and e["part"] != own]
                yield pa.RecordBatch.from_arrays([pa.array([row["q_g"]] * len(met), pa.int64()), pa.array(met, pa.int64())], names=["block", "part"])

    number = F.sequence(F.lit(0).cast("long"), F.lit((parts - 1) // PACK_PARTS).cast("long"))
    pairs = floors.withColumn("pack", F.explode(number)).join(packs, "pack").mapInArrow(reached, "block long, part long")
    met = pairs.join(floors, F.col("block") == F.col("q_g")).drop("block").join(held.withColumnRenamed("g", "part"), "part")
    rest = met.mapInArrow(lambda batches: scored(batches, True), found_schema)
    ranked = first.unionByName(rest).withColumn("rank", F.expr("row_number() over (partition by block, position order by score desc, vec_id)")).where(F.col("rank") <= k)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                q_ids, rows, _ = asked_of(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q_ids), row["q_g"], np.int64)), pa.array(np.arange(len(q_ids))), pa.array(q_ids), pa.array(rows)], names=["block", "position", "query_id", "times"])

    names = asked.mapInArrow(named, "block long, position long, query_id long, times long")
    out = ranked.join(names, ["block", "position"]).withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
