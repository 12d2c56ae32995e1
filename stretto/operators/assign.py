"""Detected onsets dealt to expected notes: greedy, nearest, each onset once."""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import DataFrame


def greedy(expected: list[float], detected: list[float]) -> list[float | None]:
    """For each expected time in turn the nearest detected one left, the earlier of equally near ones; none when they are used up.

    Taken ones point to the next one on either side, and paths shorten as they are walked, so time grows little faster than the notes.
    """
    times = sorted(detected)
    n = len(times)
    up, down = list(range(n + 1)), list(range(n + 1))  # down[k + 1] belongs to times[k]; 0 and n: none left on that side

    def walked(to: list[int], k: int) -> int:
        end = k
        while to[end] != end:
            end = to[end]
        while to[k] != end:
            to[k], k = end, to[k]
        return end

    out: list[float | None] = []
    for t in expected:
        k = bisect.bisect_left(times, t)
        right, left = walked(up, k), walked(down, k) - 1
        if left < 0 and right == n:
            out.append(None)
            continue
        best = left if left >= 0 and (right == n or abs(times[left] - t) <= abs(times[right] - t)) else right
        out.append(times[best])
        up[best], down[best + 1] = best + 1, best
    return out


def assign(expected: DataFrame, onsets: DataFrame) -> DataFrame:
    """expected (perf_id, ord, onset, ...; no rests) with det, the onset given to the note or null.

    One note's choice bears on all later ones of its performance, so performances are the unit: each is one group of a few
    thousand notes at most, and groups are independent.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in expected.schema.fields) + ", det double"

    def run(notes: pa.Table, found: pa.Table) -> pa.Table:
        notes = notes.sort_by("ord")
        times = [t for t in found.column("t").to_pylist() if t is not None]
        return notes.append_column("det", pa.array(greedy(notes.column("onset").to_pylist(), times), pa.float64()))

    return expected.groupBy("perf_id").cogroup(onsets.select("perf_id", "t").groupBy("perf_id")).applyInArrow(lambda a, b: run(a, b), schema)
