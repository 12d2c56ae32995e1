import random
import re

from stretto.llm import mixing


def brute_targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    target, left, budget = {}, set(order), share * sum(sizes.values())
    while left:
        level = budget / sum(w[s] for s in left)
        over = [s for s in left if level * w[s] > most * sizes[s]]
        if not over:
            target |= {s: level * w[s] for s in left}
            break
        for s in over:
            target[s] = most * sizes[s]
            budget -= target[s]
            left.discard(s)
    return target


def rows(seed):
    rng = random.Random(seed)
    out = []
    for i in range(600):
        s = rng.choice(["a", "a", "a", "a", "b", "B", "é", None, "z", "tiny"])
        if s == "tiny" and rng.random() < 0.9:
            continue
        out.append((i, s, rng.choice([None, "", " \n", "x " * rng.randrange(200), "word\tother  word"])))
    return out + [out[3]] * 3 + [(None, "b", "one two")]


def test_targets_and_taken(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EDGE_ROWS", 50)
    given = rows(1)
    docs = spark.createDataFrame([(*r, 1) for r in given], "doc_id long, source string, text string, size int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(given)
    count = lambda t: len(re.findall(mixing.WORDS, t or ""))
    sizes = {}
    for _, s, t in given:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = brute_targets(sizes)
    most = {s: max(count(t) for _, x, t in given if x == s) for s in sizes}
    taken = {}
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6
    again = mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_slices_equal_one_sort(spark, monkeypatch):
    docs = spark.createDataFrame(rows(2), "doc_id long, source string, text string")
    one = sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "EDGE_ROWS", 3)
    monkeypatch.setattr(mixing, "SLICES", 4)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in mixing.mix(docs).collect()) == one


def test_mixed_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "x", "a b c", 9), (2, "y", "d", 8), (3, None, None, 7)], "doc_id long, source string, text string, target int")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert {r.text for r in out.collect()} <= {"a b c", "d"}
    assert mixing.mix(docs.limit(0)).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(docs.where("text is null")).collect())
