import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stretto.llm import ppm


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


class Trie:
    """The model in plain Python: contexts with counts, walked byte by byte with an exclusion set."""

    def __init__(self, texts, order=ppm.ORDER):
        self.order, self.seen = order, defaultdict(Counter)
        for t in texts:
            s = bytes([ppm.START]) * order + t + bytes([ppm.END])
            for i in range(order, len(s)):
                for k in range(order + 1):
                    self.seen[s[i - k : i]][s[i]] += 1

    def score(self, text):
        s = bytes([ppm.START]) * self.order + text + bytes([ppm.END])
        return sum(self.log(s[i - self.order : i], s[i]) for i in range(self.order, len(s)))

    def log(self, context, byte):
        out, excluded = 0.0, set()
        for k in range(self.order, -1, -1):
            node = {b: c for b, c in self.seen.get(context[len(context) - k :], {}).items() if b not in excluded}
            if not node:
                continue
            total, distinct = sum(node.values()), len(node)
            if byte in node:
                return out + math.log10(node[byte] / (total + distinct))
            out += math.log10(distinct / (total + distinct))
            excluded |= set(node)
        return out - math.log10(256 - len(excluded))


def rows():
    rng = random.Random(4)
    parts = ["the ", "on", "er ", "Thing ", "é", "日本 ", "\n", "x"]
    out = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(60)))) for i in range(120)]
    return out + [(200, None), (201, ""), (202, " \t"), (0, out[0][1]), (None, "the null"), (203, "on er" * 3000)]


@pytest.mark.parametrize("share", [1 / 512, 1 / 40, 0.9])  # nearly all contexts are hot, some, none
def test_scores_equal_a_plain_trie(spark, monkeypatch, share):
    monkeypatch.setattr(ppm, "HOT_SHARE", share)
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(ppm, "PIECE", 700)
    given = rows()
    docs = spark.createDataFrame([(*r, 1.0) for r in given], "doc_id long, text string, score double")
    crc = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("None")).cast("binary")), F.lit(7)) == 2
    got = ppm.score(docs, crc).collect()
    assert len(got) == len(given)
    train = [(t or "").encode() for i, t in given if not held(i)]
    trie = Trie(train)
    tokens = Counter(w for t in train for w in [*t.lower().split(), None])
    n, v = sum(tokens.values()), len(tokens)
    want = {}
    for i, t in given:
        w = [*(t or "").encode().lower().split(), None]
        want[i, len((t or "").encode())] = (held(i), len(w), sum(tokens[x] > 0 for x in w), n, sum(math.log10((tokens[x] + 1) / (n + v + 1)) for x in w), trie.score((t or "").encode()))
    for r in got:
        held_out, size, known, total, base, score = want[r.doc_id, r.n_bytes]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out, size, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9), (r, base, score)


def test_without_training_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.score(docs, F.lit(True)).collect()}
    assert math.isclose(got[1].score, -3 * math.log10(256)) and got[2].n_tokens == 1 and got[1].n_known == 0 and got[1].train_tokens == 0
    assert ppm.score(docs.limit(0), F.lit(False)).count() == 0


def test_probabilities_sum_to_one(spark):
    trie = Trie([b"the cat", b"the hat"], 2)
    assert math.isclose(sum(10 ** trie.log(b"th", b) for b in range(256)), 1.0)


def test_a_hot_context_falls_into_many_parts(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcd") + rng.choice("uvwxy") + "e " for _ in range(400)) for _ in range(30)]
    found = ppm.common_contexts(spark.createDataFrame([(t.encode(),) for t in texts], "text binary"))
    hot = ppm.Hot(found)
    code = int.from_bytes(b"e ", "big")
    assert code in found[2].tolist() and int.from_bytes(b"ue ", "big") in found[3].tolist()
    gram, _ = ppm.grams([t.encode() for t in texts])
    own = (gram >> np.uint64(8)) & np.uint64(0xFFFF) == np.uint64(code)
    sizes = Counter(ppm.part_of(np.unique(gram[own]), 64, hot).tolist())
    assert len(sizes) > 15 and max(sizes.values()) < 0.2 * sum(sizes.values())
