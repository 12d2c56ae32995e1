"""The pipeline's near copies go through the pigeonhole principle: it proposes what the bands pass over."""

import random

import numpy as np

from stretto.llm import simhash


def bits(text):
    h = np.unique(np.array(simhash.hashes(text.encode(), 5), np.uint64))
    return int(simhash.majority(h, np.array([len(h)]))[0])


def test_what_bands_pass_over_is_proposed_by_the_pigeonhole_principle(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for _ in range(30):
        base = [rng.choice(words) for _ in range(1500)]
        texts += [" ".join(base), " ".join([*base[:700], "changed", *base[701:]])]
    near = [g for g in range(30) if 0 < (bits(texts[2 * g]) ^ bits(texts[2 * g + 1])).bit_count() <= 3]
    assert len(near) > 5  # not equal fingerprints, so partitions have to tell
    asked, links = [], simhash.links

    def without_bands(classes, tau=3, wide=None, keys=None):
        asked.append((tau, keys is None))
        found = links(classes, tau, wide, keys)
        return found if keys is None else found.limit(0)

    monkeypatch.setattr(simhash, "links", without_bands)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.kept_documents(docs).collect()}
    assert (3, True) in asked and len(asked) == 2
    assert all(2 * g in kept and 2 * g + 1 not in kept for g in near)


def test_the_exact_comparison_follows(spark):
    """Texts within three bits that are not alike stay apart."""
    docs = [(i, " ".join(f"{t}{k % 5}" for k in range(6))) for i, t in enumerate("abcdefgh")]
    assert simhash.kept_documents(spark.createDataFrame(docs, "doc_id long, text string")).count() == 8
    same = [(i, "x y z u v " + w) for i, w in enumerate(["a", "b", "c"])]
    assert simhash.kept_documents(spark.createDataFrame(same, "doc_id long, text string")).count() == 3
