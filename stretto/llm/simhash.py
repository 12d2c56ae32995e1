"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints differ in at most tau bits. Their bits are dealt into partitions, correlated bits together; partition i gets a
threshold t_i >= -1 with sum(t_i + 1) = tau + 1, so two fingerprints within tau are within t_i in some partition. The
thresholds come from dynamic programming on estimated candidate counts: selective partitions may be probed more widely, others
are not probed at all (-1). A partition within t_i is probed by its value with each choice of t_i bits left out. What meets
under a probe is verified by counting bits.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Fingerprints looked at to choose partitions and thresholds. The choice bears on cost only: any choice finds every link.
PLAN_SAMPLE = 2048
#: Fingerprints under one probe that one task compares at once; larger groups are cut into parts of this size, and each pair of
#: parts is a group of its own.
PART = 4096
#: Large groups, a key and a count each, up to which their list is broadcast; beyond, probes meet it by a shuffle.
BROADCAST_GROUPS = 100_000
#: Bits of 64 within which two fingerprints link.
LINK_TAU = 3
#: A probe's cost in compared pairs.
PROBE_COST = 60.0
WORDS = ("fp", "w1", "w2", "w3")


def hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 (seed 42) of a text's shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size).tolist()
    return list(map(xxhash.xxh64_intdigest, [joined[i:j] for i, j in zip(begin, end[shingle - 1 :].tolist())], repeat(42)))


def majority(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each text: found holds all hashes, counts their number by text. A bit is set if over half have it."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    # eight counters of a byte each in a word: sums of up to 255 hashes at once
    n = counts[some]
    pieces = -(-n // 255)
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    piece_of = np.repeat(np.arange(len(some)), pieces)
    begin_piece = np.concatenate([[0], np.cumsum(pieces)])[:-1]
    starts = first[piece_of] + 255 * (np.arange(len(piece_of)) - begin_piece[piece_of])
    fp = np.zeros(len(some), np.uint64)
    for shift in range(8):
        lanes = np.add.reduceat((found >> np.uint64(shift)) & np.uint64(0x0101010101010101), starts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), begin_piece, axis=0)
        for byte in range(8):
            fp |= (2 * sums[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + shift)
    out[some] = fp
    return out


#: Words of a wide fingerprint after the first: each from the same hashes, mixed by another odd factor.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def remixed(h: np.ndarray, factor: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(factor)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def fingerprints(docs: DataFrame, shingle: int = 3, wide: bool = False) -> DataFrame:
    """doc_id, fp (64 bits as a long), w1, w2, w3 (the rest of 256 bits, or 0) for every row.

    Null texts are empty, texts without words have fingerprint 0.
    """
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got, counts = [], np.zeros(len(b), np.int64)
            for k, text in enumerate(b.column("text").to_pylist()):
                h = np.array(hashes(text, shingle), np.uint64)
                counts[k] = len(h)
                got.append(h)
            every = np.concatenate(got) if got else np.zeros(0, np.uint64)
            words = [majority(every, counts), *[majority(remixed(every, f), counts) if wide else np.zeros(len(b), np.uint64) for f in FACTORS]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(w.view(np.int64)) for w in words]], names=["doc_id", *WORDS])

    table = common.text_table(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return table.mapInArrow(run, "doc_id long, fp long, w1 long, w2 long, w3 long")


def deal_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """The 64 bits in equal partitions; each begins with the bit most correlated with those left and takes its nearest."""
    if len(bits) < 2:
        return [list(range(k, 64, parts)) for k in range(parts)]
    x = bits - bits.mean(0)
    norm = np.sqrt((x * x).sum(0))
    corr = np.abs((x.T @ x) / np.maximum(np.outer(norm, norm), 1e-9))
    np.fill_diagonal(corr, 0)
    left, out = set(range(64)), []
    for k in range(parts):
        room = 64 // parts + (k < 64 % parts)
        rest = sorted(left)
        own = [max(rest, key=lambda i: (corr[i, rest].sum(), -i))]
        while len(own) < room:
            rest = [i for i in sorted(left) if i not in own]
            own.append(max(rest, key=lambda i: (corr[i, own].sum(), -i)))
        left -= set(own)
        out.append(sorted(own))
    return out


def thresholds(costs: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """The cheapest thresholds with sum(t + 1) = tau + 1; costs[i][t + 1] is partition i's cost at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for k, x in enumerate(cost):
                if used + k <= tau + 1 and (used + k not in new or c + x < new[used + k][0]):
                    new[used + k] = (c + x, [*chosen, k - 1])
        best = new
    return best.get(tau + 1, (math.inf, []))


def plan(sample: np.ndarray, total: int, tau: int) -> list[tuple[int, list[int]]]:
    """(partition's number, masks to probe under) from a sample of fingerprints and the number of all."""
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
    best: tuple[float, list[list[int]], list[int]] = (math.inf, [], [])
    for m in range(1, tau + 2):
        dealt = deal_bits(bits, m)
        costs = []
        for own in dealt:
            b = bits[:, own]
            if len(b) > 1:
                differ = (b.sum(1)[:, None] + b.sum(1)[None, :] - 2 * b @ b.T)[np.triu_indices(len(b), 1)]
                near = [(np.sum(differ <= t + 0.5) + 1) / len(differ) for t in range(3)]
            else:
                near = [1.0] * 3
            costs.append([0.0] + [total * math.comb(len(own), t) * PROBE_COST + near[t] * total * total / 2 for t in range(min(3, len(own) + 1))])
        cost, chosen = thresholds(costs, tau)
        if cost < best[0]:
            best = (cost, dealt, chosen)
    out = []
    for k, (own, t) in enumerate(zip(best[1], best[2])):
        if t >= 0:
            whole = sum(1 << i for i in own)
            out.append((k, [whole - sum(1 << i for i in gone) for gone in itertools.combinations(own, t)]))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near(a: np.ndarray, b: np.ndarray, tau: int, wide: int | None) -> np.ndarray:
    """Which fingerprints (words in the last axis) differ in at most tau bits of the first word, and wide bits of all."""
    ok = np.bitwise_count(a[..., 0] ^ b[..., 0]) <= tau
    return ok if wide is None else ok & (np.bitwise_count(a ^ b).sum(-1, dtype=np.int32) <= wide)


def linked_in_group(words: np.ndarray, tau: int, wide: int | None) -> np.ndarray:
    """For each fingerprint of a group the smallest position that links within the group reach."""
    n = len(words)
    root = np.arange(n)
    first = words[:, 0]
    for i in range(0, n, 256):
        a, b = np.nonzero(np.bitwise_count(first[i : i + 256, None] ^ first[None, i:]) <= tau)
        a, b = a + i, b + i
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
        for k in range(0, len(a) if wide is not None else 0, 1 << 18):
            part = slice(k, k + (1 << 18))
            far = ~near(words[a[part]], words[b[part]], tau, wide)
            a[part][far] = b[part][far]
        root = common.components(n, np.concatenate([root, a]), np.concatenate([np.arange(n), b]))
    return root


def verified(batches: Iterator[pa.RecordBatch], tau: int, wide: int | None) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (key, a, b) in, links out: each group's links as stars around its smallest members."""

    def settle(key: np.ndarray, ids: np.ndarray, words: np.ndarray) -> pa.RecordBatch | None:
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
        size = np.diff(np.r_[edge, len(key)])
        left, right = [], []
        small = np.repeat((size > 1) & (size <= 48), size)
        i, w, own = ids[small], words[small], np.repeat(np.arange(len(size)), size)[small]
        for off in range(1, 48):
            hit = np.flatnonzero(own[off:] == own[:-off]) if len(w) > off else []
            if not len(hit):
                break
            hit = hit[near(w[hit], w[hit + off], tau, wide)]
            left.append(i[hit])
            right.append(i[hit + off])
        for g in np.flatnonzero(size > 48):
            i, at = np.unique(ids[edge[g] : edge[g] + size[g]], return_index=True)
            root = linked_in_group(words[edge[g] + at], tau, wide)
            own = root != np.arange(len(i))
            left.append(i[own])
            right.append(i[root[own]])
        a, b = np.concatenate([ids[:0], *left]), np.concatenate([ids[:0], *right])
        own = a != b
        if not own.any():
            return None
        return pa.RecordBatch.from_arrays([pa.array(a[own]), pa.array(b[own])], names=["x", "y"])

    def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)

    names = WORDS if wide is not None else WORDS[:1]
    held = np.zeros((0, 4 + len(names)), np.int64)
    for batch in batches:
        now = np.concatenate([held, np.stack([column(batch, c) for c in ("key", "a", "b", "id", *names)], 1)])
        if not len(now):
            continue
        differ = (now[:, :3] != now[-1, :3]).any(1)
        last = len(now) - int(np.argmax(differ[::-1])) if differ.any() else 0
        out = settle(now[:last, :3], now[:last, 3], np.ascontiguousarray(now[:last, 4:]).view(np.uint64)) if last else None
        if out:
            yield out
        held = now[last:]
    out = settle(held[:, :3], held[:, 3], np.ascontiguousarray(held[:, 4:]).view(np.uint64)) if len(held) else None
    if out:
        yield out


def links(classes: DataFrame, tau: int = 3, wide: int | None = None, keys: Column | None = None) -> DataFrame:
    """x, y: ids that connect all rows of classes (id, fp and, with wide, w1 to w3; distinct) within tau bits of each other.

    With keys, an array of longs, only rows that share one of these are compared.
    """
    spark = classes.sparkSession
    if keys is None:
        total = classes.count()
        sample = np.array([r[0] for r in classes.select("fp").orderBy(F.xxhash64("fp")).limit(PLAN_SAMPLE).collect()], np.int64).view(np.uint64)
        probes = [(k, mask) for k, masks in plan(sample, total, tau) for mask in masks] if len(sample) else [(0, 0)]
        keys = F.array(*[F.xxhash64(F.lit(k), F.lit(signed(mask)), F.col("fp").bitwiseAND(F.lit(signed(mask)))) for k, mask in probes])
    own = ["id", *(WORDS if wide is not None else WORDS[:1])]
    groups = classes.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > PART)
    probed = classes.select(*own, F.explode(keys).alias("key"))
    groups = common.written(groups, "hot")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    # only groups too large for one task are looked up: they are cut into parts, and each two parts are compared
    parts = probed.join(groups, "key", "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / PART), F.lit(1)).cast("int"))
    part = F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int")
    tiles = (
        parts.withColumn("part", part)
        .select(*own, "key", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select(*own, "key", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    together = tiles.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b")
    return together.mapInArrow(lambda batches: verified(batches, tau, wide), "x long, y long")


def near_duplicates(docs: DataFrame, shingle: int = 3, tau: int = LINK_TAU, wide: int | None = None) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach) for every row of docs.

    Fingerprints link within tau bits; with wide, 256-bit fingerprints of the same shingles must also be within so many bits,
    which tells likeness far better than 64 do. Rows of one fingerprint are one class before anything is compared, so copies cost
    nothing however many they are. Null texts are empty texts; texts without words share fingerprint 0 and so one class. A null
    doc_id takes part, and is nobody's component_id unless its whole component has no other. Repeated rows stay repeated; an empty
    table gives an empty result.
    """
    prints = common.written(fingerprints(docs, shingle, wide is not None).withColumn("id", F.xxhash64(*WORDS) if wide is not None else F.col("fp")), "prints")
    classes = common.written(prints.groupBy("id", *WORDS).agg(F.min("doc_id").alias("first")), "classes")
    roots = common.connected(links(classes, tau, wide), "x", "y")
    placed = classes.join(roots, classes.id == roots.node, "left").select("id", "first", F.coalesce("root", "id").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(placed.join(least, "root").select("id", "component_id"), "id").select("doc_id", "fp", "component_id")


#: Bands of least hashes, and least hashes in each: a pair of Jaccard similarity 0.8 shares no band with probability 3e-6.
BANDS, BAND_ROWS = 24, 4
#: Bits of 64 and of 256 within which a pair that bands propose falls but with probability 4e-7, or 5e-5 for texts of five shingles: the
#: fingerprints are of distinct shingles, their bits differ with probability 0.152, or 0.188 there.
ALIKE_TAU, ALIKE_WIDE = 26, 74
#: Shingles of a part of a group of candidates, about; larger groups are cut, and each two parts are compared.
TILE_SHINGLES = 1 << 20


def band_keys(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each text with hashes; found holds all hashes, counts their number by text."""
    n = counts[counts > 0]
    starts = np.cumsum(n) - n
    factors = np.random.default_rng(29).integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros((len(n), BANDS), np.uint64)
    if len(n):
        for band in range(BANDS):
            out[:, band] = band + 1
            for factor in factors[band * BAND_ROWS : (band + 1) * BAND_ROWS]:
                out[:, band] = remixed(out[:, band] ^ np.minimum.reduceat(found * factor, starts), FACTORS[0])
    return out


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, row_key, id (texts of the same shingles share it), n (distinct shingles), 256 bits, bands (none without words)."""
    common.small_batches(docs.sparkSession)
    names = ["doc_id", "text_key", "row_key", "id", "n", *WORDS, "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.unique(np.array(hashes(text, shingle), np.uint64)) for text in b.column("text").to_pylist()]
            counts = np.array([len(h) for h in got], np.int64)
            every = np.concatenate(got) if got else np.zeros(0, np.uint64)
            ids = pa.array(np.array([xxhash.xxh64_intdigest(h.tobytes(), 7) for h in got], np.uint64).view(np.int64))
            words = [majority(every, counts), *[majority(remixed(every, f), counts) for f in FACTORS]]
            ends = pa.array(np.r_[0, np.cumsum((counts > 0) * BANDS)], pa.int32())
            bands = pa.ListArray.from_arrays(ends, pa.array(band_keys(every, counts).reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), b.column("row_key"), ids, pa.array(counts), *[pa.array(w.view(np.int64)) for w in words], bands], names=names)

    table = common.text_table(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_key(), row_key(), F.col("text").cast("binary").alias("text"))
    return table.mapInArrow(run, "doc_id long, text_key long, row_key long, id long, n long, fp long, w1 long, w2 long, w3 long, bands array<long>")


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key")


def row_key() -> Column:
    """Rows of one doc_id, null or not, and one text share it."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").isNull(), F.col("doc_id")).alias("row_key")


def alike(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the smallest position that links reach: sets of Jaccard similarity 0.8 or more link. Members are distinct."""
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    every, at = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    off = np.r_[0, np.cumsum(size)]
    root, own = np.arange(len(sets)), np.zeros(len(every), bool)
    for i in range(len(sets)):
        # a set over 5/4 of another's size is not alike
        rest = np.arange(i + 1, np.searchsorted(size, size[i] * 5 // 4, "right"))
        rest = rest[root[rest] != root[i]]
        if not len(rest):
            continue
        own[at[off[i] : off[i + 1]]] = True
        begin = np.cumsum(size[rest]) - size[rest]
        members = at[np.arange(size[rest].sum()) + np.repeat(off[rest] - begin, size[rest])]
        shared = np.add.reduceat(own[members], begin, dtype=np.int64)
        own[at[off[i] : off[i + 1]]] = False
        hit = rest[9 * shared >= 4 * (size[i] + size[rest])]
        if len(hit):
            joined = np.isin(root, np.r_[root[i], root[hit]])
            root[joined] = root[joined].min()
    least = np.full(len(sets), len(sets))
    np.minimum.at(least, root, order)
    out = np.empty(len(sets), np.int64)
    out[order] = least[root]
    return out


def alike_links(texts: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """x, y: ids that connect all members (id, text_key, n, root) of one root whose shingles have Jaccard similarity 0.8 or more.

    texts has a text for each text_key. The shingles themselves are compared, those of a bounded tile at once.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.sum("n") / TILE_SHINGLES).cast("int").alias("parts"))
    members = members.join(sizes, "root").withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int"))
    rows = texts.join(members.drop("n"), "text_key").dropDuplicates(["text_key"])
    tiles = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "root", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "id", F.col("text").cast("binary").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []

        def settle() -> pa.RecordBatch:
            root = alike(sets)
            own = np.flatnonzero(root != np.arange(len(ids)))
            return pa.RecordBatch.from_arrays([pa.array([ids[k] for k in own], pa.int64()), pa.array([ids[root[k]] for k in own], pa.int64())], names=["x", "y"])

        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in ("root", "a", "b")])
            for key, i, text in zip(keys, batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if key != now and len(ids) > 1:
                    yield settle()
                if key != now:
                    now, ids, sets = key, [], []
                ids.append(i)
                sets.append(np.unique(np.array(hashes(text, shingle), np.uint64)))
        if len(ids) > 1:
            yield settle()

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiles.repartition(n, "root", "a", "b").sortWithinPartitions("root", "a", "b").mapInArrow(run, "x long, y long")


def alike_groups(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, text_key, row_key and root (the same in all of a group) for every row: texts of Jaccard similarity 0.8 or more link.

    The pigeonhole principle proposes what is within LINK_TAU bits of 64, as in near_duplicates. Texts of similarity 0.8 are
    further apart than partitions of bits can tell, so least hashes in bands propose these as well, and 256 bits of fingerprint
    drop what is far from alike. What is then connected is compared by its shingles. Texts without words, null ones too, are one
    group.
    """
    prints = common.written(sketches(docs, shingle), "prints")
    classes = prints.groupBy("id").agg(*[F.first(c).alias(c) for c in (*WORDS, "bands", "n")], F.min("text_key").alias("text_key"))
    classes = common.written(classes, "classes")
    worded = classes.where("n > 0")
    near = links(worded, LINK_TAU).unionByName(links(worded, ALIKE_TAU, ALIKE_WIDE, F.col("bands")))
    near = common.connected(near, "x", "y")
    near = near.union(near.select("root", "root")).distinct()
    members = common.written(classes.join(near, classes.id == near.node).select("id", "text_key", "n", "root"), "members")
    roots = common.connected(alike_links(docs.select(text_key(), F.coalesce("text", F.lit("")).alias("text")), members, shingle), "x", "y")
    return prints.join(roots, prints.id == roots.node, "left").select("doc_id", "text_key", "row_key", F.coalesce("root", "id").alias("root"))


def kept_documents(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of docs, with all its columns, for each group of near copies: that of the smallest doc_id, nulls last.

    Of a group's rows that share that doc_id, null ones too, one stays: by the text's hash, then by that of all columns. Groups do
    not touch one another, whatever doc_ids they share. Texts without words, null ones too, are one group.
    """
    columns = [F.col(c).alias(f"own_{k}") for k, c in enumerate(docs.columns)]
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "row_key")
    stays = common.written(alike_groups(docs, shingle).groupBy("root").agg(F.min(order)["row_key"].alias("row_key")).select("row_key"), "stays")
    rows = docs.select(row_key(), *columns).join(stays, "row_key", "left_semi")
    first = Window.partitionBy("row_key").orderBy(F.xxhash64(*[f"own_{k}" for k in range(len(columns))]))
    rows = rows.withColumn("place", F.row_number().over(first)).where("place = 1")
    return rows.select(*[F.col(f"own_{k}").alias(c) for k, c in enumerate(docs.columns)])
