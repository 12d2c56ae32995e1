import random

import numpy as np

from stretto.llm import suffixes


def brute(rows, length):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, (rows[k][1] or "").encode()))
    seen, out = set(), []
    for k in order:
        t = (rows[k][1] or "").encode()
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int))).reshape(-1, 2)
        out.append((rows[k][0], len(t), tuple(map(tuple, edge.tolist())), np.frombuffer(t, np.uint8)[~gone].tobytes()))
    return sorted(out, key=str)


def some_rows(seed, n):
    rng = random.Random(seed)
    words = ["thing", "on", "the", "é", "日本", "x", "re-er"]
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [make(rng.choice([12, 20, 30, 60])) for _ in range(12)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3 and rows:
            t = rows[rng.randrange(len(rows))][1] or ""
            at = rng.randrange(len(t) + 1)
            t = rng.choice([t, t[:at] + "!" + t[at:], t[at:], t + t])
        else:
            t = make(rng.randrange(40)) + " " + rng.choice(passages)[rng.randrange(20) :] + " " + make(rng.randrange(40))
        rows.append((i * 3 % 101, t[:6000]))
    return [*rows, (500, None), (501, ""), (502, "a" * 900), (503, "ab" * 700 + "c"), (504, "x" * 99), (None, passages[3] * 2), (505, passages[3]), rows[0], rows[0]]


def test_removed_bytes_equal_brute_force(spark, monkeypatch):
    for seed, block, piece, length, gram in ((1, 1 << 30, 1 << 20, 100, 32), (2, 600, 500, 100, 32), (3, 900, 300, 40, 9)):
        monkeypatch.setattr(suffixes, "BLOCK_BYTES", block)
        monkeypatch.setattr(suffixes, "PIECE", piece)
        rows = some_rows(seed, 120)
        docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, part string")
        got = sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in suffixes.remove_repeats(docs, length, gram).collect()), key=str)
        assert got == brute(rows, length)
    assert suffixes.remove_repeats(docs.limit(0)).count() == 0
    assert suffixes.remove_repeats(docs.where("text is null")).count() == 1


def test_multikey_order_and_common_lengths():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 99, (300, 21), dtype=np.uint8)
    text[100:] = text[rng.integers(0, 100, 200)]
    text[150:, 13:] = 97
    group = rng.integers(0, 3, 300)
    order, common = suffixes.multikey(group, text)
    keys = [(group[k], text[k].tobytes()) for k in order]
    assert keys == sorted(keys)
    for i in range(300):
        if i == 0 or keys[i][0] != keys[i - 1][0]:
            assert common[i] == -1
        else:
            assert common[i] == next((j for j in range(21) if keys[i][1][j] != keys[i - 1][1][j]), 21)
