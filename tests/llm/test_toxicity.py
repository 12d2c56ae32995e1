import random

import numpy as np

from stretto.llm import toxicity


def rows(seed, n=600):
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(300)]
    bad = ["scum", "clown", *[f"lowei{rng.choice('abcdef')}{i}" for i in range(40)]]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(plain) for _ in range(rng.randrange(3, 80))]
        toxic, low = rng.random() < 0.15, rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                text[rng.randrange(len(text))] = rng.choice(bad)
        if low:
            text = [w.upper() + "!! junkmark" for w in text]
        docs.append((i, " ".join(text)))
        labels.append((i, int(not low), int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edge_rows(spark):
    docs, labels = rows(1)
    docs += [(None, None), (9001, None), (9002, ""), (9003, "scum clown " * 30000), docs[0]]
    d = spark.createDataFrame([(i, t, f"extra{i}") for i, t in docs], "doc_id long, text string, p_toxic string")
    y = spark.createDataFrame([*labels[:400], (9001, None, 1), (None, 1, 1), labels[0], (77777, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(d, y)
    got = toxicity.score(d, chain).collect()
    assert len(got) == len(docs)
    truth = dict((i, t) for i, _, t in labels)
    by_id = {r.doc_id: r for r in got}
    held_out = range(400, 600)
    right = sum(by_id[i].is_toxic == bool(truth[i]) for i in held_out)
    assert right >= 0.97 * len(held_out)
    assert not by_id[9001].is_toxic and by_id[9001].p_toxic == by_id[9002].p_toxic
    kept = toxicity.kept_documents(d, chain)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.is_toxic}
    assert sorted(r.p_toxic for r in toxicity.score(d.repartition(3), toxicity.train(d.repartition(5), y)).collect()) == sorted(r.p_toxic for r in got)


def test_without_labels_nothing_is_toxic(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    y = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.train(d, y)
    assert [r.is_toxic for r in toxicity.score(d, chain).collect()] == [False]
    assert toxicity.score(d.limit(0), chain).count() == 0


def test_later_models_are_fed_earlier_probabilities():
    rng = np.random.default_rng(2)
    n = 400
    first = rng.random(n) < 0.5
    x = toxicity.Rows(np.where(first, 5, 6), np.arange(n + 1))
    labels = np.stack([first, first ^ (rng.random(n) < 0.05)], 1).astype(int)
    chain = toxicity.Chain.learned(["a", "b"], x, labels, np.arange(n) % toxicity.FOLDS)
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1
    p = chain.probabilities([x.margin(w[: 1 << toxicity.BITS]) for w in chain.weights])
    assert ((p[:, 1] > 0.5) == first).all()
    assert chain.unseen.shape == (n, 2)


def test_sample_is_of_the_documents_given_and_ordered(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i} " + ("bad" if i % 2 else "good"), 0.5) for i in range(200)], "doc_id long, text string, p_toxic double")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(5000)], "doc_id long, quality int, toxic int")
    x, y, folds = toxicity.sampled_rows(docs, labels, toxicity.CATEGORIES, 100)
    assert len(y) == 100 and set(y[:, 1].tolist()) == {0, 1}
    again = toxicity.sampled_rows(docs.repartition(7), labels.repartition(3), toxicity.CATEGORIES, 100)
    assert x.at.tolist() == again[0].at.tolist() and y.tolist() == again[1].tolist()
    got = toxicity.score(docs, toxicity.train(docs, labels), keep=["p_toxic"])
    assert got.columns[1] == "own_p_toxic" and got.where("own_p_toxic <> 0.5").count() == 0
