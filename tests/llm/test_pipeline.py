"""The pipeline's stages against plain Python over the smallest table."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from stretto.llm import bpe, mixing, pii, simhash, toxicity

from .test_mixing import brute_targets
from .test_pii import plain_base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], SF).cache())
    return out


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_toxicity(spark, steps):
    chain = toxicity.train(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in steps[1].collect()}
    for r in steps[0].collect():
        found = [f for w in dict.fromkeys(r.text.encode().lower().translate(toxicity.PARTED).split()) for f in toxicity.features(w)]
        p = []
        for w in chain.weights:
            z = sum(float(np.float32(w[f])) for f in found) + sum(float(np.float32(w[(1 << toxicity.BITS) + k])) * x for k, x in enumerate(p)) + float(np.float32(w[-1]))
            p.append(1 / (1 + np.exp(-z)))
        assert (r.doc_id in kept) == (p[1] < chain.thresholds[1]) or abs(p[1] - chain.thresholds[1]) < 1e-5


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_near_duplicates(steps):
    given = {r.doc_id: shingles(r.text) for r in steps[1].collect()}
    kept = {r.doc_id for r in steps[2].collect()}
    like = lambda a, b: len(given[a] & given[b]) / len(given[a] | given[b])
    ids = sorted(given)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if like(a, b) >= 0.8:
                root[find(b)] = find(a)
    groups = Counter(find(i) for i in ids)
    assert len(kept) == len(groups) and {find(i) for i in kept} == set(groups)


def test_personal_data(steps):
    given = {r.doc_id: r for r in steps[2].collect()}
    got = {r.doc_id: r for r in steps[3].collect()}
    assert given.keys() == got.keys()
    model = pii.train(steps[2])
    for i, r in given.items():
        base = plain_base(r.text)
        assert got[i].text == pii.redacted(r.text, base + pii.added_spans([r.text], [base], model)[0])
        assert got[i].source == r.source and got[i].n_chars == r.n_chars


def test_mixing(steps):
    given = steps[3].collect()
    copies = Counter(r.doc_id for r in steps[4].collect())
    size = {r.doc_id: len(re.findall(mixing.WORDS, r.text)) for r in given}
    sizes = Counter()
    for r in given:
        sizes[r.source] += size[r.doc_id]
    want = brute_targets(sizes)
    for s in sizes:
        own = [r.doc_id for r in given if r.source == s]
        assert abs(sum(copies[i] * size[i] for i in own) - want[s]) <= max(size[i] for i in own) / 2 + 1e-6
    assert max(copies.values()) <= 2


def test_encoding(steps):
    ranks = bpe.PrefixEncoder.of_file(P.path("byte_bpe_multi_50k.tiktoken")).ranks
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in steps[4].collect():
        ids = t.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(map(tuple, steps[5].collect())) == sorted(want)


@pytest.mark.parametrize("stage", range(5))
def test_edge_rows(spark, steps, stage):
    name, f = corpus_pipeline.STAGES[stage]
    schema = steps[0].schema
    for field in schema.fields:
        field.nullable = True
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, None), (3, "word " * 100000, "en", "a", 5), (4, "x@y.zz 1.2.3.4", "en", "b", 3), (4, "x@y.zz 1.2.3.4", "en", "b", 3)]
    docs = spark.createDataFrame(rows, schema)
    out = f(spark, docs, SF)
    if stage < 4:
        assert out.columns == docs.columns
    assert 1 <= out.count() <= 2 * len(rows)
    assert f(spark, docs.limit(0), SF).count() == 0
