import random

import numpy as np
import xxhash

from stretto.llm import simhash


def brute(rows, shingle=3, tau=3):
    fps = {}
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        out.append((doc_id, sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))))
    values = sorted({f for _, f in out})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i:]:
            if (a ^ b).bit_count() <= tau:
                root[find(a)] = find(b)
    for doc_id, f in out:
        if doc_id is not None:
            fps[find(f)] = min(fps.get(find(f), doc_id), doc_id)
    return sorted(((d if d is not None else -1, f, fps.get(find(f))) for d, f in out))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 400]))]
        for _ in range(rng.choice([1, 1, 3])):
            own = list(base)
            if len(own) > 30:
                own[rng.randrange(len(own))] = "CHANGED"
            rows.append((len(rows) + 5, " \n".join(own)))
    rows += [(1, None), (2, ""), (3, " \t"), (4, "É x Ab"), (4, "É x Ab"), (None, "some text"), (900, "a b " * 5000)]
    docs = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fp % 2**64, r.component_id) for r in got) == brute(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_links_split_large_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 40)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    near = np.concatenate([base] + [base ^ (np.uint64(1) << np.uint64(rng.integers(0, 64))) ^ (np.uint64(1) << np.uint64(k)) for k in range(40)])
    fps = np.unique(np.concatenate([near, rng.integers(0, 2**63, 500, dtype=np.uint64)]))
    classes = spark.createDataFrame([(int(x), int(x)) for x in fps.view(np.int64)], "id long, fp long")
    roots = {r.node: r.root for r in simhash.common.connected(simhash.links(classes), "x", "y").collect()}
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    want = simhash.common.components(len(fps), a, b)
    ids = fps.view(np.int64)
    groups = {}
    for k, x in enumerate(ids.tolist()):
        groups.setdefault(want[k], set()).add(roots.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_plan_covers_the_threshold():
    rng = np.random.default_rng(4)
    sample = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for total in (100, 10**6, 10**10):
        for tau in (0, 3, 5):
            probes = simhash.plan(sample, total, tau)
            for _ in range(50):
                flip = sum(1 << int(i) for i in rng.choice(64, tau, replace=False))
                assert any(flip & mask == 0 for _, masks in probes for mask in masks)


def test_thresholds_take_the_cheapest():
    assert simhash.thresholds([[0, 5, 50], [0, 1, 2]], 1)[1] == [-1, 1]


def test_kept_documents(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    rows, group = [], []
    for g in range(40):
        base = [rng.choice(words) for _ in range(200)]
        for _ in range(rng.choice([1, 2, 4])):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = "changed"
            rows.append((len(rows), " ".join(own), "s", f"x{len(rows)}"))
            group.append(g)
    rows += [(1000, None, None, "n"), (1001, "", "s", None), rows[0], (None, rows[3][1], "s", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, id string")
    kept = simhash.kept_documents(docs)
    assert kept.columns == docs.columns
    want = [group.index(g) for g in range(40)]
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*want, 1000])
    assert simhash.kept_documents(docs.limit(0)).count() == 0


def shingled(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_groups(texts):
    sets = [shingled(t) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and len(a & b) / len(a | b) >= 0.8:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def around_the_threshold(seed, groups=150):
    """Texts with a partner of similarity from 0.7 to 0.9, single ones, chains, short ones and ones that repeat their words."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    texts = ["a b c d e f g h i", "a b c d e f g h", "word " * 300, "word " * 5000, None, "", "one", "one two"]
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([12, 40, 200]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 1, 2])):
            base = base[rng.randrange(3) :] + [rng.choice(words) for _ in range(int(len(base) * rng.uniform(0.05, 0.18)))]
            texts.append(" ".join(base))
    return texts


def test_kept_documents_equal_brute_force_at_the_threshold(spark, monkeypatch):
    texts = around_the_threshold(11)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    root = brute_groups(texts)
    want = sorted({root.index(r) for r in root})
    assert len(want) < len(texts) - 50
    assert sorted(r.doc_id for r in simhash.kept_documents(docs).collect()) == want
    monkeypatch.setattr(simhash, "TILE_SHINGLES", 150)  # groups cut into parts
    assert sorted(r.doc_id for r in simhash.kept_documents(docs).collect()) == want


def test_alike_is_exact():
    rng = np.random.default_rng(5)
    sets = [np.arange(10, dtype=np.uint64), np.arange(8, dtype=np.uint64), np.arange(7, dtype=np.uint64) + np.uint64(100)]
    sets += [np.unique(rng.integers(0, 14, 30).astype(np.uint64) + np.uint64(200)) for _ in range(60)]
    a, b = np.nonzero([[len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.8 for y in sets] for x in sets])
    assert simhash.alike(sets).tolist() == simhash.common.components(len(sets), a, b).tolist()


def test_kept_documents_one_row_a_group(spark):
    texts = [" ".join(f"{t}{k}" for k in range(30)) for t in "abcdef"]
    rows = [(None, texts[0], 1), (None, texts[1], 2), (None, texts[1], 3), (None, None, 4), (7, texts[2], 5), (7, texts[3], 6), (7, texts[3], 6), (2, texts[2], 7), (9, texts[4], 8), (None, texts[4], 9), (9, texts[5], 10), (9, texts[5] + " more", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    kept = [tuple(r) for r in simhash.kept_documents(docs).collect()]
    assert all(r in rows for r in kept) and sorted(r[2] for r in kept if r[2] not in (2, 3, 10, 11)) == [1, 4, 6, 7, 8]
    assert len([r for r in kept if r[2] in (2, 3)]) == 1 and len([r for r in kept if r[2] in (10, 11)]) == 1
    assert sorted(map(tuple, simhash.kept_documents(docs.repartition(3, "n")).collect()), key=str) == sorted(kept, key=str)
