"""Queries on vector sequences: features, scans, warping, locating."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.config import MatchSettings, PitchFeatureSettings
from ..operators import features, matching, start, template
from . import views as V


def _rounded(seq: DataFrame, places: int = 5) -> DataFrame:
    """Vectors as rows of components, which both engines compare exactly."""
    return seq.select("seq_id", "idx", F.posexplode("vec").alias("d", "x")).select("seq_id", "idx", F.col("d").cast("int").alias("d"), F.round("x", places).alias("x"))


def smooth(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(features.smooth(V.features(spark, sf)))


def l2_frames(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(features.l2_frames(V.features(spark, sf)))


def delta(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(features.delta(V.features(spark, sf)))


def context_mean(spark: SparkSession, sf: str) -> DataFrame:
    c = features.context_mean(V.features(spark, sf), 7)
    return c.select("seq_id", "center_frame", F.posexplode("vec").alias("d", "x")).select("seq_id", "center_frame", F.col("d").cast("int").alias("d"), F.round("x", 5).alias("x"))


def avg_pool(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(features.average_pool(V.features(spark, sf), 4))


def zscore_pair(spark: SparkSession, sf: str) -> DataFrame:
    seq = V.features(spark, sf)
    return _rounded(features.standardize(seq.withColumn("template", (F.col("seq_id") + 1) % 10), features.template_stats(seq), "template"), 4)


def shared_minmax(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(features.shared_minmax(V.features(spark, sf).withColumn("g", F.floor(F.col("seq_id") / 2)), "g"))


def slice_window(spark: SparkSession, sf: str) -> DataFrame:
    seq = V.features(spark, sf).withColumn("center_frame", F.col("idx") * 2)
    return features.slice_window(seq, F.col("seq_id") * F.lit(0.1), F.col("seq_id") * F.lit(0.1) + F.lit(1.0)).select("seq_id", "idx", "center_frame", "offset")


def _pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Each label as template; its query is eight frames of the label after it."""
    seq = V.features(spark, sf)
    queries = seq.where("idx between 3 and 10").select(((F.col("seq_id") + 9) % 10).alias("pair"), (F.col("idx") - 3).alias("idx"), "vec")
    return seq.withColumnRenamed("seq_id", "pair"), queries


def coarse_topk(spark: SparkSession, sf: str) -> DataFrame:
    return matching.coarse_scores(*_pair(spark, sf), 4, 5).select("pair", F.col("rank").cast("int").alias("rank"), "start", F.round("score", 6).alias("score"))


def _rigid(metric: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return matching.rigid(*_pair(spark, sf), metric).select("pair", F.round("cost", 6).alias("cost"), "start", "end")

    return query


def _kernel(kernel):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return matching.match_pairs(*_pair(spark, sf), kernel).withColumn("cost", F.round("cost", 6)).withColumn("score", F.round("score", 6))

    return query


def locate(spark: SparkSession, sf: str) -> DataFrame:
    templates, queries = _pair(spark, sf)
    contexts = templates.select("pair").distinct().select("pair", (F.col("pair") * 2).alias("low"), (F.col("pair") * 2 + 20).alias("high")).where("pair % 3 > 0")
    events = templates.where("idx % 4 = 0").select("pair", F.col("idx").alias("note_id"), F.col("idx").cast("double").alias("start_sec"), (F.col("idx") + 4).cast("double").alias("end_sec"))
    return matching.locate(templates, queries, contexts, events).withColumn("score", F.round("score", 6)).withColumn("confidence", F.round("confidence", 6))


def start_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of a tenth of a second; the query of a label is its own frames from its third note on, slightly off."""
    seq = V.features(spark, sf).withColumnRenamed("seq_id", "pair")
    events = seq.where("idx % 5 = 0").select("pair", F.col("idx").alias("note_id"), F.lit(1).alias("measure"), F.col("idx").cast("double").alias("beat"), (F.col("idx") * F.lit(0.1)).alias("start_sec"), ((F.col("idx") + 5) * F.lit(0.1)).alias("end_sec"), (F.lit(48) + F.col("idx") % 36).cast("double").alias("pitch_midi"))
    starts = seq.select("pair").distinct().select("pair", F.lit(1).alias("measure"), F.lit(3).alias("note_index"))
    queries = seq.where("idx between 12 + pair % 3 and 23 + pair % 3").withColumn("idx", F.col("idx") - 12 - F.col("pair") % 3).withColumn("vec", F.transform("vec", lambda x: x * 1.01 + 0.001))
    out = start.detect_starts(seq, queries, events, starts, 0.1)
    return out.select("pair", "started", F.round("template_sec", 6).alias("template_sec"), F.round("detected_sec", 6).alias("detected_sec"), "note_id", "pitch", F.round("onset", 6).alias("onset"))


def _template(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Templates of half a minute made of each label's vectors, with a note for every fifth."""
    seq = V.features(spark, sf)
    events = seq.where("idx % 5 = 0").select("seq_id", F.col("idx").alias("note_id"), F.col("idx").cast("double").alias("start_sec"), (F.col("idx") + 5.0).alias("end_sec"))
    durations = seq.select("seq_id").distinct().withColumn("duration_sec", F.lit(30.0))
    return template.build(seq, events, durations, PitchFeatureSettings(context_sec=0.0))


def template_build(spark: SparkSession, sf: str) -> DataFrame:
    coarse = _template(spark, sf)[0].where("kind = 'coarse'").select("template_id", "idx", F.posexplode("vec").alias("d", "x"))
    return coarse.select("template_id", "idx", F.col("d").cast("int").alias("d"), F.round("x", 4).alias("x"))


def template_events(spark: SparkSession, sf: str) -> DataFrame:
    return _template(spark, sf)[1].select(F.col("seq_id").alias("template_id"), "note_id", F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"))


GLOBAL = MatchSettings()
QUERIES = {
    "smooth": smooth, "l2_frames": l2_frames, "delta": delta, "context_mean": context_mean, "avg_pool": avg_pool, "zscore_pair": zscore_pair, "shared_minmax": shared_minmax, "slice_window": slice_window,
    "coarse_topk": coarse_topk, "rigid_match": _rigid("l2"), "rigid_match_cosine": _rigid("cosine"),
    "dtw_subsequence": _kernel(lambda t, q: matching.best_global(t, q, MatchSettings(metric="l2", margin=0.0, tiebreak="min_cost"))), "dtw_banded": _kernel(lambda t, q: matching.banded(t, q, 0.12)),
    "dtw_topk_diverse": _kernel(lambda t, q: matching.diverse(t, q, 5)), "coarse_refine": _kernel(lambda t, q: matching.coarse_refined(t, q)),
    "global_match": _kernel(lambda t, q: matching.best_global(*matching.normalized(t, q, "z_score"), GLOBAL)), "locate": locate, "start_detect": start_detect, "template_build": template_build, "template_events": template_events,
}

FEAT = f"with {V.V_FEAT}, c as (select seq_id, idx, unnest(generate_series(0, len(vec) - 1))::int as d, unnest(vec) as x from v_feat)"
PAIR = f"with recursive {V.V_FEAT}, t as (select seq_id as pair, idx, vec from v_feat), q as (select (seq_id + 9) % 10 as pair, idx - 3 as idx, vec from v_feat where idx between 3 and 10)"
ALIGNED = f"{PAIR}, n as (select pair, count(*) as n from t group by pair), a as (select t.pair, t.idx - q.idx as start, n.n, t.vec as tv, q.vec as qv from t join q using (pair) join n using (pair) where t.idx - q.idx between 0 and n.n - 8)"
BEST = "b as (select *, min(raw) over (partition by pair) as least from s) select pair, round(raw / 8, 6) as cost, start, start + 7 as \"end\" from b where abs(raw - least) <= greatest(1e-6, least * 1e-9) qualify row_number() over (partition by pair order by start desc) = 1"


def _walk(cost: str, banded: bool = False) -> str:
    """Warping as a recursion over template frames: a row holds the costs d and starts s of all eight query frames."""
    inside = lambda j: f"(c.i >= greatest(1, {j} - slack) and c.i <= least(n, n - (8 - {j}) + slack))" if banded else "true"
    old = lambda j: f"w.d{j}" if j else "0.0"
    new = lambda j: f"n{j}" if j else "0.0"
    steps = []
    for j in range(1, 9):
        steps.append(f"case when {inside(j)} then c.c[{j}] + least({old(j - 1)}, {old(j)}, {new(j - 1)}) else 'inf'::double end as n{j}")
        steps.append(f"c.i - 1 as m{j}" if j == 1 else f"case when {old(j - 1)} <= {old(j)} and {old(j - 1)} <= n{j - 1} then w.s{j - 1} when {old(j)} <= n{j - 1} then w.s{j} else m{j - 1} end as m{j}")
    names = ", ".join(f"n{j}, m{j}" for j in range(1, 9))
    return f"""cost as (select t.pair, t.idx + 1 as i, any_value(n.n) as n, greatest(1, floor(any_value(n.n) * 0.12))::bigint as slack, list({cost} order by q.idx) as c from t join q using (pair) join (select pair, count(*) as n from t group by pair) n using (pair) group by t.pair, t.idx),
  walk(pair, i, {", ".join(f"d{j}, s{j}" for j in range(1, 9))}) as (
    select pair, 0::bigint, {", ".join(["'inf'::double, 0::bigint"] * 8)} from (select distinct pair from t)
    union all
    select pair, i, {names} from (select c.pair, c.i, {", ".join(steps)} from walk w join cost c on c.pair = w.pair and c.i = w.i + 1)),
  ends as (select pair, i, d8 as cost, s8 as start, greatest(s8, i - 1) as "end", min(d8) over (partition by pair) as least from walk where i > 0)"""


_FOUND = 'select pair, 1::int as rank, round(cost / 8, 6) as cost, start, "end", round(1 / (1 + cost / 8), 6) as score from ends'
_ZPAIR = f"""with recursive {V.V_FEAT}, c as (select seq_id, idx, unnest(generate_series(1, len(vec))) as d, unnest(vec) as x from v_feat),
  st as (select seq_id, d, avg(x) as m, case when stddev_pop(x) < 1e-6 then 1.0 else stddev_pop(x) end as s from c group by all),
  z as (select st.seq_id as pair, c.seq_id, idx, list((x - m) / s order by c.d) as vec from c join st using (d) where c.seq_id = st.seq_id or (c.seq_id + 9) % 10 = st.seq_id group by all),
  t as (select pair, idx, vec from z where seq_id = pair), q as (select pair, idx - 3 as idx, vec from z where seq_id <> pair and idx between 3 and 10)"""

def _walk_by(key: str, cost: str, t: str, q: str, tag: str, band: bool = False) -> str:
    """_walk over templates t (key, idx from 0, vec) and queries q (key, idx, vec) of eight frames, as walk_<tag> and ends_<tag>."""
    body = _walk(cost, band).replace("from t join q using (pair)", f"from {t} t join {q} q using ({key})").replace("from t group by pair) n using (pair) group by t.pair", f"from {t} t group by {key}) n using ({key}) group by t.{key}")
    body = body.replace("cost as (", f"cost_{tag} as (", 1).replace("join cost c", f"join cost_{tag} c").replace("ends as (", f"ends_{tag} as (").replace("walk(", f"walk_{tag}(").replace("from walk w", f"from walk_{tag} w").replace("from walk where", f"from walk_{tag} where")
    body = body.replace("select distinct pair from t", f"select distinct {key} from {t}")
    return re.sub(r"\bpair\b", key, body)


def _diverse(ends: str, tag: str, top_k: int, apart: int) -> str:
    """The cheapest ends whose starts are apart, one after the other."""
    return f"""picked_{tag}(pair, k, starts, cost, start, "end") as (
    select pair, 0::bigint, []::bigint[], null::double, null::bigint, null::bigint from (select distinct pair from {ends})
    union all
    select p.pair, p.k + 1, list_append(p.starts, e.start), e.cost, e.start, e."end" from picked_{tag} p join {ends} e on e.pair = p.pair
    where p.k < {top_k} and isfinite(e.cost) and len(list_filter(p.starts, lambda x: abs(x - e.start) < {apart})) = 0 qualify row_number() over (partition by p.pair order by e.cost, e.i) = 1)"""


def _standard(t: str, q: str, tag: str) -> str:
    """t and q by the mean and deviation of t, as st_<tag> and sq_<tag>."""
    return f"""m_{tag} as (select pair, d, avg(x) as m, case when stddev_pop(x) < 1e-6 then 1.0 else stddev_pop(x) end as s from (select pair, unnest(generate_series(1, len(vec))) as d, unnest(vec) as x from {t}) group by all),
  st_{tag} as (select pair, idx, list((x - m) / s order by d) as vec from (select pair, idx, unnest(generate_series(1, len(vec))) as d, unnest(vec) as x from {t}) join m_{tag} using (pair, d) group by pair, idx),
  sq_{tag} as (select pair, idx, list((x - m) / s order by d) as vec from (select pair, idx, unnest(generate_series(1, len(vec))) as d, unnest(vec) as x from {q}) join m_{tag} using (pair, d) group by pair, idx)"""


_COSINE = "1 - list_cosine_similarity(t.vec, q.vec)"
_LOCATE = f"""{PAIR}, near as (select pair, idx - min(idx) over (partition by pair) as idx, min(idx) over (partition by pair) as first, vec from t where pair % 3 > 0 and idx between pair * 2 and pair * 2 + 20),
  {_standard("near", "q", "n")}, long_n as (select pair from st_n group by pair having count(*) >= 8), tn as (select * from st_n semi join long_n using (pair)), {_walk_by("pair", _COSINE, "tn", "sq_n", "n")}, {_diverse("ends_n", "n", 5, 3)},
  good as (select pair from picked_n where k = 1 and 1 / (1 + cost / 8) >= 0.35),
  far as (select * from t anti join good using (pair)), {_standard("far", "q", "f")}, {_walk_by("pair", _COSINE, "st_f", "sq_f", "f")}, {_diverse("ends_f", "f", 5, 3)},
  found as (select pair, k, 1 / (1 + cost / 8) as score, p.start + first as start, p."end" + first as "end", true as context_used from picked_n p join (select distinct pair, first from near) using (pair) semi join good using (pair) where k > 0
    union all select pair, k, 1 / (1 + cost / 8), start, "end", false from picked_f where k > 0),
  best as (select a.*, b.score as second from found a left join found b on b.pair = a.pair and b.k = 2 where a.k = 1),
  told as (select *, coalesce(score - second <= 0.03, false) as ambiguous from best),
  note as (select b.pair, arg_min(e.idx, (case when b.start between e.idx and e.idx + 4 then 0 else 1 end, case when b.start between e.idx and e.idx + 4 then 0 else abs(b.start - e.idx) end, e.idx)) as note_id from best b join t e on e.pair = b.pair and e.idx % 4 = 0 group by b.pair)
  select pair, start, "end", round(score, 6) as score, ambiguous, round(case when ambiguous then greatest(0.0, score - second) else score end, 6) as confidence, context_used, note_id,
    case when score < 0.35 then 'low confidence: score ' || round(score, 3) end as warning from told join note using (pair)"""

#: Windows at every eighth frame, the 24 most like the query; around each a stretch is warped under a band.
_REFINE = f"""{_ZPAIR}, n as (select pair, count(*) as n from t group by pair),
  w as (select t.pair, t.idx - q.idx as start, sum(list_dot_product(t.vec, q.vec)) / ((sqrt(sum(list_dot_product(t.vec, t.vec))) + 1e-8) * (sqrt(sum(list_dot_product(q.vec, q.vec))) + 1e-8)) as score
    from t join q using (pair) join n using (pair) where t.idx - q.idx between 0 and n.n - 8 and (t.idx - q.idx) % 8 = 0 group by all),
  cs as (select pair, start, pair * 1000000 + start as cand from w qualify row_number() over (partition by pair order by score desc, start) <= 24),
  tc as (select cand, t.idx - greatest(0, c.start - 10) as idx, vec from cs c join t on t.pair = c.pair and t.idx >= c.start - 10 and t.idx < c.start + 51), qc as (select cand, idx, vec from cs c join q using (pair)),
  {_walk_by("cand", "list_distance(t.vec, q.vec)", "tc", "qc", "c", True)},
  one as (select cand, cost, start as a, "end" as b from ends_c where isfinite(cost) qualify row_number() over (partition by cand order by cost, i) = 1),
  matched as (select c.pair, greatest(0, c.start - 10) + a as start, greatest(0, c.start - 10) + b as "end", min(cost) / 8 as cost from one join cs c using (cand) group by all)
  select pair, (row_number() over (partition by pair order by cost, start, "end"))::int as rank, round(cost, 6) as cost, start, "end", round(1 / (1 + cost), 6) as score from matched qualify rank <= 3"""

SQL = {
    "dtw_topk_diverse": f"{PAIR}, {_walk('list_distance(t.vec, q.vec)')}, {_diverse('ends', 'd', 5, 4)} select pair, k::int as rank, round(cost / 8, 6) as cost, start, \"end\", round(1 / (1 + cost / 8), 6) as score from picked_d where k > 0",
    "locate": _LOCATE, "coarse_refine": _REFINE,
    "dtw_subsequence": f"{PAIR}, {_walk('list_distance(t.vec, q.vec)')} {_FOUND} qualify row_number() over (partition by pair order by ends.cost, i) = 1",
    "dtw_banded": f"{PAIR}, {_walk('list_distance(t.vec, q.vec)', True)} {_FOUND} qualify row_number() over (partition by pair order by ends.cost, i) = 1",
    "global_match": f"{_ZPAIR}, {_walk('1 - list_cosine_similarity(t.vec, q.vec)')} {_FOUND} where ends.cost <= least * 1.05 + 1e-9 qualify row_number() over (partition by pair order by start, ends.cost) = 1",
    "start_detect": f"""with {V.V_FEAT}, p as (select distinct seq_id as pair, 12 + seq_id % 3 as first from v_feat)
      select pair, true as started, round(10 * 0.1::double, 6) as template_sec, round(first * 0.1::double, 6) as detected_sec, case when first * 0.1::double - 10 * 0.1::double <= 0.15 then 10 else first // 5 * 5 end as note_id,
        (['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'])[(48 + note_id % 36) % 12 + 1] || ((48 + note_id % 36) // 12 - 1) as pitch, round(first * 0.1::double - 10 * 0.1::double, 6) as onset from p""",
    "template_build": f"""{FEAT}, sm as (select seq_id, idx, d, sum(x) over (partition by seq_id, d order by idx rows between 5 preceding and 5 following) / 11.0 as x from c), nm as (select seq_id, idx, d, x / sqrt(sum(x * x) over (partition by seq_id, idx)) as x from sm),
      de as (select seq_id, idx, d, x from nm union all select seq_id, idx, d + 64, x - coalesce(lag(x) over (partition by seq_id, d order by idx), x) from nm)
      select seq_id as template_id, idx // 4 as idx, d::int as d, round(avg(x), 4) as x from de group by seq_id, idx // 4, d having count(*) = 4""",
    "template_events": f"with {V.V_FEAT}, e as (select seq_id, idx, 30.0::double / max(idx + 5.0) over (partition by seq_id) as scale from v_feat where idx % 5 = 0) select seq_id as template_id, idx as note_id, round(idx * scale, 6)::double as start_sec, round((idx + 5.0) * scale, 6)::double as end_sec from e",
    "smooth": f"{FEAT} select seq_id, idx, d, round(sum(x) over (partition by seq_id, d order by idx rows between 5 preceding and 5 following) / 11.0, 5) as x from c",
    "l2_frames": f"{FEAT} select seq_id, idx, d, round(x / sqrt(sum(x * x) over (partition by seq_id, idx)), 5) as x from c",
    "delta": f"{FEAT}, e as (select seq_id, idx, d, x from c union all select seq_id, idx, d + 64, x - coalesce(lag(x) over (partition by seq_id, d order by idx), x) from c) select seq_id, idx, d::int as d, round(x, 5) as x from e",
    "context_mean": f"{FEAT}, e as (select *, avg(x) over w as m, count(*) over w as k from c window w as (partition by seq_id, d order by idx rows between current row and 6 following)) select seq_id, idx + 3 as center_frame, d, round(m, 5) as x from e where k = 7",
    "avg_pool": f"{FEAT} select seq_id, idx // 4 as idx, d, round(avg(x), 5) as x from c group by seq_id, idx // 4, d having count(*) = 4",
    "zscore_pair": f"{FEAT}, s as (select seq_id, d, avg(x) as m, case when stddev_pop(x) < 1e-6 then 1.0 else stddev_pop(x) end as s from c group by all) select c.seq_id, idx, c.d, round((x - m) / s, 4) as x from c join s on s.seq_id = (c.seq_id + 1) % 10 and s.d = c.d",
    "shared_minmax": f"{FEAT}, m as (select *, min(x) over (partition by seq_id // 2) as a, max(x) over (partition by seq_id // 2) as b from c) select seq_id, idx, d, round((x - a) / (b - a), 5) as x from m",
    "slice_window": f"""with {V.V_FEAT}, s as (select seq_id, idx, idx * 2 as center from v_feat where idx * 2 >= round_even(seq_id * 0.1::double * 22050.0::double / 512.0::double, 0) and idx * 2 <= round_even((seq_id * 0.1::double + 1.0::double) * 22050.0::double / 512.0::double, 0))
      select seq_id, idx, center - min(center) over (partition by seq_id) as center_frame, min(center) over (partition by seq_id) as "offset" from s""",
    "coarse_topk": f"""{ALIGNED}, s as (select pair, start, sum(list_dot_product(tv, qv)) / ((sqrt(sum(list_dot_product(tv, tv))) + 1e-8) * (sqrt(sum(list_dot_product(qv, qv))) + 1e-8)) as score from a where start % 4 = 0 group by all)
      select pair, (row_number() over (partition by pair order by score desc, start))::int as rank, start, round(score, 6) as score from s qualify rank <= 5""",
    "rigid_match": f"{ALIGNED}, s as (select pair, start, sqrt(sum(pow(list_distance(tv, qv), 2))) as raw from a group by all), {BEST}",
    "rigid_match_cosine": f"{ALIGNED}, s as (select pair, start, sum(1 - list_cosine_similarity(tv, qv)) as raw from a group by all), {BEST}",
}
