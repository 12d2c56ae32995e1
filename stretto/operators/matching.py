"""Finding a query sequence in a template: coarse and rigid scans as joins, time warping as a kernel per pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.config import MatchSettings
from ..functions.music import dot, frame_cost
from .rangejoin import covering


def _aligned(templates: DataFrame, queries: DataFrame, stride: int = 1) -> DataFrame:
    """pair, start, m, n, tv, qv: each template frame with the query frame that falls on it when the query begins at start.

    Starts come first, so only frames that fall on each other meet, by pair and place.
    """
    m = queries.groupBy("pair").agg(F.count("*").alias("m"))
    n = templates.groupBy("pair").agg(F.count("*").alias("n"))
    starts = n.join(m, "pair").where("n >= m").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - F.col("m"), F.lit(stride).cast("long"))))
    asked = queries.select("pair", F.col("idx").alias("qi"), F.col("vec").alias("qv")).join(starts, "pair").withColumn("ti", F.col("start") + F.col("qi"))
    return asked.join(templates.select("pair", F.col("idx").alias("ti"), F.col("vec").alias("tv")), ["pair", "ti"])


def coarse_scores(templates: DataFrame, queries: DataFrame, stride: int = 8, top_k: int = 20) -> DataFrame:
    """pair, start, score, rank: the windows, at every stride, most like the query by the cosine of all their components."""
    sums = _aligned(templates, queries, stride).groupBy("pair", "start").agg(F.sum(dot(F.col("tv"), F.col("qv"))).alias("d"), F.sum(dot(F.col("tv"), F.col("tv"))).alias("t"), F.sum(dot(F.col("qv"), F.col("qv"))).alias("q"))
    scored = sums.withColumn("score", F.col("d") / ((F.sqrt("t") + 1e-8) * (F.sqrt("q") + 1e-8)))
    rank = F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("score"), "start"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top_k).select("pair", "start", "score", "rank")


def rigid(templates: DataFrame, queries: DataFrame, metric: str = "l2", tiebreak: str = "min_cost_latest") -> DataFrame:
    """pair, cost (per query frame), start, end without warping. A query as long as its template costs 0 unseen."""
    a = _aligned(templates, queries)
    per_frame = F.sum(frame_cost(F.col("tv"), F.col("qv"), "cosine")) if metric == "cosine" else F.sqrt(F.sum(F.pow(frame_cost(F.col("tv"), F.col("qv"), "l2"), F.lit(2.0))))
    costs = a.groupBy("pair", "start", "m", "n").agg(per_frame.alias("raw")).withColumn("raw", F.when(F.col("m") == F.col("n"), 0.0).otherwise(F.col("raw")))
    w = Window.partitionBy("pair")
    least = F.min("raw").over(w)
    tied = costs.withColumn("_least", least).withColumn("_tied", F.abs(F.col("raw") - F.col("_least")) <= F.greatest(F.lit(1e-6), F.col("_least") * 1e-9))
    order = {"earliest": [F.col("start")], "min_cost": [F.col("raw"), F.col("start")], "min_cost_latest": [F.desc("_tied"), F.desc("start")]}[tiebreak]
    best = tied.withColumn("_r", F.row_number().over(w.orderBy(*order))).where("_r = 1")
    return best.select("pair", (F.col("raw") / F.greatest(F.col("m"), F.lit(1))).alias("cost"), "start", (F.col("start") + F.col("m") - 1).alias("end"))


# Kernels on two matrices.


def frame_costs(template: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.sqrt(np.maximum(((template[:, None, :] - query[None, :, :]) ** 2).sum(2), 0.0))
    a, b = np.linalg.norm(template, axis=1), np.linalg.norm(query, axis=1)
    flat = (a[:, None] < 1e-8) | (b[None, :] < 1e-8)
    return np.where(flat, 1.0, 1.0 - template @ query.T / np.where(flat, 1.0, np.outer(a, b)))


def warp(template: np.ndarray, query: np.ndarray, metric: str = "l2", band: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(cost, start) of the best warped match that ends at each template frame.

    A match may begin anywhere. Steps go ahead in both, in the template or in the query; of equally dear ones the first named
    is taken. Cells of one sum of positions don't depend on each other, so each such diagonal is one step over arrays; where a
    match began travels along with its cost. band bounds how far positions may drift apart.
    """
    n, m = len(template), len(query)
    if not n or not m:
        raise ValueError("an empty sequence cannot be matched")
    if m > n:
        raise ValueError(f"the query ({m}) is longer than the template ({n})")
    cost = frame_costs(template, query, metric)
    slack = None if band is None else max(1, int(band * max(n, m)))
    dp = np.full((n + 1, m + 1), np.inf)
    begin = np.zeros((n + 1, m + 1), np.int64)
    dp[:, 0] = 0.0
    begin[:, 0] = np.arange(n + 1)
    for s in range(2, n + m + 1):
        i = np.arange(max(1, s - m), min(n, s - 1) + 1)
        j = s - i
        if slack is not None:
            ok = (i >= j - slack) & (i <= n - (m - j) + slack)
            i, j = i[ok], j[ok]
        both, ahead, stay = dp[i - 1, j - 1], dp[i - 1, j], dp[i, j - 1]
        use_both = (both <= ahead) & (both <= stay)
        use_ahead = ~use_both & (ahead <= stay)
        dp[i, j] = cost[i - 1, j - 1] + np.where(use_both, both, np.where(use_ahead, ahead, stay))
        begin[i, j] = np.where(j == 1, i - 1, np.where(use_both, begin[i - 1, j - 1], np.where(use_ahead, begin[i - 1, j], begin[i, j - 1])))
    return dp[1:, m], begin[1:, m]


Match = tuple[float, int, int]


def banded(template: np.ndarray, query: np.ndarray, band: float = 0.12) -> list[Match]:
    cost, start = warp(template, query, "l2", band if band > 0 else None)
    k = int(np.argmin(cost))
    return [(float(cost[k]) / len(query), int(start[k]), max(int(start[k]), k))] if np.isfinite(cost[k]) else []


def best_global(template: np.ndarray, query: np.ndarray, s: MatchSettings = MatchSettings()) -> list[Match]:
    """Of the ends within the margin of the least cost the one the tiebreak prefers."""
    cost, start = warp(template, query, s.metric)
    least = float(cost.min())
    ends = np.flatnonzero(cost <= least * (1 + max(0.0, s.margin)) + 1e-9)
    pairs = [(float(cost[k]), int(start[k]), max(int(start[k]), int(k))) for k in ends]
    if s.tiebreak == "earliest":
        best = min(pairs, key=lambda p: (p[1], p[0]))
    else:
        tied = [p for p in sorted(pairs, key=lambda p: p[0]) if abs(p[0] - least) <= max(1e-6, least * 1e-9)]
        best = max(tied, key=lambda p: p[1]) if s.tiebreak == "min_cost_latest" else tied[0]
    return [(best[0] / len(query), *best[1:])]


def diverse(template: np.ndarray, query: np.ndarray, top_k: int = 5, metric: str = "l2", separation: int | None = None) -> list[Match]:
    """The cheapest matches whose starts are apart, by (cost, end)."""
    cost, start = warp(template, query, metric)
    apart = max(1, len(query) // 2) if separation is None else separation
    out: list[Match] = []
    for k in np.lexsort((np.arange(len(cost)), cost)).tolist():
        if np.isfinite(cost[k]) and all(abs(int(start[k]) - p[1]) >= apart for p in out):
            out.append((float(cost[k]) / len(query), int(start[k]), max(int(start[k]), k)))
            if len(out) >= top_k:
                break
    return out


def z_scored(template: np.ndarray, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    std = template.std(0)
    std = np.where(std < 1e-6, 1.0, std)
    return (template - template.mean(0)) / std, (query - template.mean(0)) / std


def normalized(template: np.ndarray, query: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray]:
    if mode == "z_score":
        return z_scored(template, query)
    if mode == "minmax":
        low, high = min(template.min(), query.min()), max(template.max(), query.max())
        return ((template - low) / (high - low), (query - low) / (high - low)) if high - low > 1e-12 else (template * 0.0, query * 0.0)
    return template, query


def coarse_refined(template: np.ndarray, query: np.ndarray, top_k: int = 3, stride: int = 8, candidates: int = 24, band: float = 0.12) -> list[Match]:
    """Coarse scan, then banded warping around each candidate; matches that agree in both ends count once."""
    t, q = z_scored(template, query)
    n, m = len(t), len(q)
    if m > n:
        raise ValueError(f"the query ({m}) is longer than the template ({n})")
    starts = np.arange(0, n - m + 1, stride)
    windows = np.lib.stride_tricks.sliding_window_view(t, (m, t.shape[1]))[starts, 0].reshape(len(starts), -1)
    scores = windows @ q.ravel() / ((np.linalg.norm(windows, axis=1) + 1e-8) * (np.linalg.norm(q) + 1e-8))
    reach = max(2 * m, int(m * 1.4 + 32))
    found: dict[tuple[int, int], float] = {}
    for s in starts[np.argsort(-scores, kind="stable")[:candidates]].tolist():
        low, high = max(0, s - reach // 4), min(n, s + m + reach)
        if high - low >= m:
            for cost, a, b in banded(t[low:high], q, band):
                found[low + a, low + b] = min(cost, found.get((low + a, low + b), np.inf))
    return sorted(((c, a, b) for (a, b), c in found.items()))[:top_k]


def sequences(frames: DataFrame, key: str = "pair") -> DataFrame:
    """key, size, dims, data: each sequence as one row of doubles, by idx."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "vec")))
    return frames.groupBy(key).agg(rows.alias("s")).select(key, F.transform("s", lambda r: r["vec"]).alias("rows"))


def match_pairs(templates: DataFrame, queries: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], list[Match]]) -> DataFrame:
    """pair, rank, cost, start, end, score: kernel's matches of each pair's query in its template. Pairs are independent tasks' rows."""
    both = sequences(templates).withColumnRenamed("rows", "t").join(sequences(queries).withColumnRenamed("rows", "q"), "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for pair, t, q in zip(b.column("pair").to_pylist(), b.column("t").to_pylist(), b.column("q").to_pylist()):
                out += [(pair, k + 1, c, s, e, 1 / (1 + c)) for k, (c, s, e) in enumerate(kernel(np.array(t, float), np.array(q, float)))]
            columns = list(zip(*out)) or [[]] * 6
            types = (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["pair", "rank", "cost", "start", "end", "score"])

    return both.mapInArrow(run, "pair long, rank int, cost double, start long, end long, score double")


#: Seconds that a query and a template may last.
QUERY_SEC, TEMPLATE_SEC = (1.0, 5.0), (300.0, 1800.0)


def guarded(durations: DataFrame, bounds: tuple[float, float], what: str, column: str = "duration_sec") -> DataFrame:
    """durations, or an error that names what lasts too short or too long."""
    low, high = bounds
    told = F.concat(F.lit(f"{what} of "), F.round(column, 3).cast("string"), F.lit(f" s is not within {low:g} to {high:g} s"))
    return durations.withColumn(column, F.when(F.col(column).between(low, high), F.col(column)).otherwise(F.raise_error(told).cast("double")))


def low_score(score: Column, least: float = 0.35) -> Column:
    """A warning where the best score is low, else null."""
    return F.when(score < least, F.concat(F.lit("low confidence: score "), F.round(score, 3).cast("string")))


def match_templates(templates: DataFrame, queries: DataFrame, frame_sec: float, mode: str = "global", top_k: int = 3, least_score: float = 0.35, settings: MatchSettings = MatchSettings(), stride: int = 8, coarse: int = 24, band: float = 0.12, durations: DataFrame | None = None) -> DataFrame:
    """pair, rank, start, end (frames), start_sec, end_sec, score, method, warning: where each pair's query lies in its template.

    mode global warps over the whole template and gives the best match; coarse_local scans at a stride and warps around the top_k of
    coarse candidates. A query longer than its template, or outside a query's length in seconds (that of durations, if given, else of
    its frames), is an error.
    """
    if mode not in ("global", "coarse_local"):
        raise ValueError(f"unknown search mode {mode}")
    length = queries.groupBy("pair").agg((F.count("*") * F.lit(frame_sec)).alias("duration_sec"))
    checked = guarded(length if durations is None else durations, QUERY_SEC, "a query").where("duration_sec is not null").select("pair", "duration_sec")
    kernel = (lambda t, q: best_global(*normalized(t, q, settings.normalize), settings)) if mode == "global" else (lambda t, q: coarse_refined(t, q, top_k, stride, coarse, band))
    found = match_pairs(templates, queries, kernel).join(checked, "pair").where(F.col("rank") <= top_k)
    best = F.first("score").over(Window.partitionBy("pair").orderBy("rank"))
    seconds = lambda c: F.col(c) * F.lit(frame_sec)
    return found.select("pair", "rank", "start", "end", seconds("start").alias("start_sec"), seconds("end").alias("end_sec"), "score", F.col("duration_sec").alias("query_duration_sec"), F.lit(f"warping_{mode}").alias("method"), low_score(best, least_score).alias("warning"))


def context_windows(contexts: DataFrame, queries: DataFrame, frame_sec: float, expected_sec: float = 20.0) -> DataFrame:
    """contexts for locate (pair, low, high in frames) from where a pair was last found: (pair, last_sec, last_timestamp, timestamp).

    The centre lies where the template has got to since, never before where it was; half a window to either side is the larger of the
    query's length and expected_sec, halved. Without a place it was last found at there is no context.
    """
    length = queries.groupBy("pair").agg((F.count("*") * F.lit(frame_sec)).alias("query_sec"))
    since = F.coalesce(F.greatest(F.lit(0.0), F.col("timestamp") - F.col("last_timestamp")), F.lit(0.0))
    rows = contexts.where("last_sec is not null").join(length, "pair").withColumn("centre", F.col("last_sec") + since).withColumn("half", F.greatest(F.col("query_sec"), F.lit(expected_sec)) / 2)
    return rows.select("pair", F.ceil(F.greatest(F.lit(0.0), F.col("centre") - F.col("half")) / F.lit(frame_sec)).alias("low"), F.floor((F.col("centre") + F.col("half")) / F.lit(frame_sec)).alias("high"))


def candidates(found: DataFrame, events: DataFrame, frame_sec: float) -> DataFrame:
    """Matches (pair, rank, start, end, score) with the note that each begins at: its id, measure, beat and pitch."""
    points = found.select("pair", F.col("rank").cast("long").alias("point_id"), (F.col("start") * F.lit(frame_sec)).alias("t"))
    notes = covering(points, events.select("pair", "note_id", "start_sec", "end_sec"), "pair", closed=True).select("pair", F.col("point_id").cast("int").alias("rank"), "note_id")
    named = found.join(notes, ["pair", "rank"], "left").join(events.select("pair", "note_id", "measure", "beat", "pitch_midi"), ["pair", "note_id"], "left")
    return named.withColumn("start_sec", F.col("start") * F.lit(frame_sec)).withColumn("end_sec", F.col("end") * F.lit(frame_sec))


def locate(templates: DataFrame, queries: DataFrame, contexts: DataFrame, events: DataFrame, top_k: int = 5, separation: int = 3, least_score: float = 0.35, margin: float = 0.03, settings: MatchSettings = MatchSettings()) -> DataFrame:
    """pair, start, score, ambiguous, confidence, context_used, note_id, warning: where each query lies in its template.

    contexts (pair, low, high) bound a first search; its result counts if its best score is high enough, and the whole template is
    searched only for the other pairs. events (pair, note_id, start_sec, end_sec), in frames here, name the note found.
    """
    def kernel(t: np.ndarray, q: np.ndarray) -> list[Match]:
        return diverse(*normalized(t, q, settings.normalize), top_k, settings.metric, separation) if len(q) <= len(t) else []

    near = templates.join(contexts, "pair").where("idx >= low and idx <= high")
    first = near.groupBy("pair").agg(F.min("idx").alias("first"))
    local = match_pairs(near, queries, kernel).join(first, "pair").withColumn("start", F.col("start") + F.col("first")).withColumn("end", F.col("end") + F.col("first")).drop("first")
    good = local.where((F.col("rank") == 1) & (F.col("score") >= least_score)).select("pair")
    rest = templates.join(good, "pair", "left_anti")
    found = local.join(good, "pair", "left_semi").withColumn("context_used", F.lit(True)).unionByName(match_pairs(rest, queries, kernel).withColumn("context_used", F.lit(False)))
    second = F.lead("score").over(Window.partitionBy("pair").orderBy("rank"))
    best = found.withColumn("second", second).where("rank = 1")
    ambiguous = F.coalesce(F.col("score") - F.col("second") <= margin, F.lit(False))
    best = best.withColumn("ambiguous", ambiguous).withColumn("confidence", F.when(ambiguous, F.greatest(F.lit(0.0), F.col("score") - F.col("second"))).otherwise(F.col("score")))
    notes = covering(best.select("pair", F.col("pair").alias("point_id"), F.col("start").cast("double").alias("t")), events, "pair", closed=True)
    return best.join(notes.select("pair", "note_id"), "pair", "left").select("pair", "start", "end", "score", "ambiguous", "confidence", "context_used", "note_id", low_score(F.col("score"), least_score).alias("warning"))
