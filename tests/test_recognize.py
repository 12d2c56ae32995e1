"""Recognition in one meeting of a performance's notes and what was heard: against the single operators, and what its plan shuffles."""

import random
import re

import pytest

from stretto.functions.config import JudgeSettings
from stretto.operators.recognize import pitch_medians, recognize, recognize_heard
from stretto.operators.rhythm import judge
from stretto.plans import performance, views

HOP = 0.05
SF = "/root/testdata/sf0.001"


def tables(spark):
    """Performances with odd rows: frames out of order, with equal, absent or backward numbers, without times, pitches or verdicts of voice."""
    rng = random.Random(5)
    notes, onsets, frames = [], [], []
    for p in [1, 2, 3, 4, 5, None]:
        at = 0.0
        for k in range(25):
            d = rng.choice([0.0, 0.1, 0.3, 0.5, 1.0, 2.5])
            notes.append((p, k, at, d, float(rng.randrange(60, 64)), 1, k + 1, rng.choice([120.0, 90.0, 0.0, None])))
            at += d
        onsets += [(p, o + rng.uniform(-0.2, 0.2)) for q, _, o, *_ in notes if q == p and rng.random() < 0.7]
        for k in range(int(at / HOP)):
            number = rng.choice([k, k, -k, 3, None]) if p in (2, None) else k // 2 if p == 3 else k
            time = None if rng.random() < 0.03 else float("nan") if rng.random() < 0.03 else k * HOP
            frames.append((p, number, time, rng.choice([60.0, 60.4, 61.0, 62.0, 63.5, -1.0, None, float("nan")]), rng.choice([True, True, True, False, None])))
    onsets += [(9, 1.0), (5, None)]
    frames = [f for f in frames if f[0] != 4] + [(9, 0, 0.0, 60.0, True)]
    rng.shuffle(frames)
    return (
        spark.createDataFrame(notes, "perf_id long, ord long, onset double, dur double, midi double, measure int, idx int, tempo double"),
        spark.createDataFrame(onsets, "perf_id long, t double"),
        spark.createDataFrame(frames, "perf_id long, frame_idx long, t double, midi double, voiced boolean"),
    )


@pytest.mark.parametrize("mode", ["detected_onset", "score_grid", "anchored_grid"])
def test_equals_the_single_operators(spark, mode):
    expected, onsets, frames = tables(spark)
    s = JudgeSettings(mode=mode)
    segments = judge(expected, onsets, frames, s, HOP)
    segments = segments.selectExpr("*", "coalesce(det, onset) as p0", "coalesce(det, onset) + greatest(duration_detected, 0.001) as p1")
    want = pitch_medians(segments, frames).drop("p0", "p1", "t0", "t1")
    got = recognize(expected, onsets, frames, s, HOP)
    assert set(got.columns) == {*want.columns, "missed", "pitch_ok", "overall", "error_dims"}
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(key, got.select(want.columns).collect())) == sorted(map(key, want.collect()))


def test_what_is_heard_by_note_is_onsets_and_frames(spark):
    heard = views.heard(spark, SF)
    key = lambda rows: sorted(map(tuple, rows))
    assert key(heard.where("onset is not null").select("perf_id", "onset").collect()) == key(views.onsets(spark, SF).collect())
    assert key(heard.selectExpr("perf_id", "inline(frames)").collect()) == key(views.frames(spark, SF).collect())


@pytest.mark.parametrize("name", ["recognize", "recognize_summary"])
def test_frames_are_not_shuffled(spark, name):
    plan = performance.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#\w+,? ?(\w*)", plan)
    rows = [d for d in dealt if d[0] == "l_suppkey"]
    assert len(rows) == 2 and len(dealt) == len(rows) + (name == "recognize_summary")
    scans = set(re.findall(r"ReadSchema: (\S+)", performance.QUERIES[name](spark, SF)._jdf.queryExecution().toString()))
    assert len(scans) == 1  # both sides read the same columns, so the one shuffle of the notes serves both


def test_summary_shuffles_the_notes_once_and_no_more_of_them_than_it_needs(spark):
    rows = performance.recognize_summary(spark, SF)
    rows.collect()
    lines = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    dealt = [k for k, line in enumerate(lines) if "Exchange hashpartitioning(l_suppkey" in line]
    assert sum("ReusedExchange" not in lines[k] for k in dealt) == 1 and sum("ReusedExchange" in line for line in lines) == 1
    project = next(line for line in lines[dealt[0] :] if "Project [" in line)
    sent = re.findall(r"(\w+)#\d+L?(?:,|\]$)", re.sub(r"[^,]* AS ", "", project))
    assert set(sent) == {"l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "is_rest"}
    assert not any("row_number() windowspecdefinition(perf_id" in line for line in lines)  # a measure's numbers bear on no total


def test_empty_tables(spark):
    expected, onsets, frames = tables(spark)
    assert recognize(expected.limit(0), onsets, frames, hop=HOP).count() == 0
    bare = recognize(expected, onsets.limit(0), frames.limit(0), hop=HOP)
    assert bare.count() == expected.count() and bare.where("not missed or pitch_detected <> -1 or onset_ok").count() == 0
    assert recognize_heard(expected, spark.createDataFrame([], "perf_id long, onset double, frames array<struct<frame_idx:bigint,t:double,midi:double,voiced:boolean>>"), hop=HOP).count() == expected.count()
