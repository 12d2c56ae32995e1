"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other: each is a logistic model over hashed words and word beginnings, and over the
probabilities of the categories before it. While it learns, those are out-of-fold ones - each row's come from a model that has not
seen the row - so a later model meets what it will meet when it is used. Fitting takes a bounded sample of labelled rows; scoring
is a map over all documents, with a model of fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows to learn from, at most (those of smallest hashed ids); the one bound on what is looked at.
TRAIN_ROWS = 6000
BITS = 18
FOLDS = 3
#: Lengths of word beginnings that are features beside the word; strength of the penalty on weights.
BEGINNINGS = (4, 5, 6)
PENALTY = 1.0
#: Features of a model, chosen on the labelled rows: those whose documents deviate most from the category's share, of those in so
#: many documents at least. A parameter of the fit, not of what is scored.
CHOSEN, LEAST_DOCS = 4000, 3
ROUNDS = 40
CACHE_WORDS = 400_000
#: Everything ASCII that is no letter or digit parts words.
PARTED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Distinct words in the order of their first place, so that sums over them come out alike in every run."""
    return list(dict.fromkeys(text.lower().translate(PARTED).split()))


def features(word: bytes) -> list[int]:
    """The word's place among the hashed features, and those of its beginnings."""
    mask = (1 << BITS) - 1
    return [zlib.crc32(word) & mask, *[zlib.crc32(b"^" + word[:n]) & mask for n in BEGINNINGS if len(word) >= n]]


def by_row(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of each row's values; a row's does not depend on the other rows."""
    out = np.zeros((len(off) - 1, *values.shape[1:]))
    some = np.flatnonzero(off[1:] > off[:-1])
    if len(some):
        out[some] = np.add.reduceat(values, off[:-1][some])
    return out


@dataclass
class Rows:
    """Sparse rows: the features of row i are at[off[i]:off[i + 1]]; a feature counts once for each distinct word that has it."""

    at: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.off)[rows]
        off = np.concatenate([[0], np.cumsum(size)])
        return Rows(self.at[np.arange(off[-1]) + np.repeat(self.off[:-1][rows] - off[:-1], size)], off)

    def margin(self, w: np.ndarray) -> np.ndarray:
        return by_row(w[self.at], self.off)

    def gradient(self, r: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.at, np.repeat(r, np.diff(self.off)), n)

    def only(self, features: np.ndarray) -> Rows:
        """Rows over some features alone (sorted), by their place among them."""
        place = np.full(1 << BITS, -1, np.int32)
        place[features] = np.arange(len(features))
        at = place[self.at]
        ok = at >= 0
        return Rows(at[ok], np.concatenate([[0], np.cumsum(ok)])[self.off])


def telling(x: Rows, y: np.ndarray) -> np.ndarray:
    """The features by which documents of y differ most from the rest: by the deviation of y's share among those that have it."""
    pairs = np.sort(x.at.astype(np.int64) * max(1, len(x)) + np.repeat(np.arange(len(x)), np.diff(x.off)))
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
    feature, row = pairs // max(1, len(x)), pairs % max(1, len(x))
    first = np.flatnonzero(np.r_[True, feature[1:] != feature[:-1]]) if len(feature) else np.zeros(0, np.int64)
    own = feature[first]
    count = np.diff(np.r_[first, len(feature)])
    hits = np.add.reduceat(y[row], first) if len(first) else np.zeros(0)
    share = y.mean() if len(y) else 0.0
    z = np.abs(hits - count * share) / np.sqrt(np.maximum(count * share * (1 - share) * (1 - count / max(1, len(x))), 1e-9))
    z[count < LEAST_DOCS] = -1
    best = np.argsort(-z, kind="stable")[:CHOSEN]
    return np.sort(own[best[z[best] >= 0]])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: Rows, dense: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of a penalised logistic model: hashed features, then dense columns, then the constant. By L-BFGS."""
    chosen = telling(x, y)
    x = x.only(chosen)
    n, d, k = len(x), len(chosen), dense.shape[1]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.margin(w[:d]) + dense @ w[d : d + k] + w[-1]
        p = sigmoid(z)
        value = np.logaddexp(0, z).sum() - (y * z).sum() + PENALTY / 2 * (w[:-1] @ w[:-1])
        g = np.concatenate([x.gradient(p - y, d), dense.T @ (p - y), [(p - y).sum()]])
        g[:-1] += PENALTY * w[:-1]
        return value, g

    w = np.zeros(d + k + 1)
    share = np.clip(y.mean() if n else 0.0, 1e-3, 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    value, g = loss(w)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, kept = g.copy(), []
        for s, t in reversed(pairs):
            a = (s @ q) / (t @ s)
            q -= a * t
            kept.append(a)
        q *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(g).max())
        for (s, t), a in zip(pairs, reversed(kept)):
            q += s * (a - (t @ q) / (t @ s))
        step, slope = 1.0, g @ q
        for _ in range(12):
            new_value, new_g = loss(w - step * q)
            if new_value <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, t = -step * q, new_g - g
        if s @ t > 1e-10:
            pairs = [*pairs[-5:], (s, t)]
        done = value - new_value < 1e-5 * abs(value)
        w, value, g = w + s, new_value, new_g
        if done:
            break
    out = np.zeros((1 << BITS) + k + 1)
    out[chosen], out[1 << BITS :] = w[:d], w[d:]
    return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the most balanced hits (F1) of p on y, half way to the next lower probability; over 1 without any positive."""
    if not len(y) or not y.any():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1  # a cut can't part equal ones
    k = int(np.argmax(f1))
    return float((p[order[k]] + (p[order[k + 1]] if k + 1 < len(y) else 0)) / 2)


@dataclass
class Chain:
    """The fitted models, in the order of their categories."""

    categories: list[str]
    weights: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    @classmethod
    def learned(cls, categories: list[str], x: Rows, labels: np.ndarray, folds: np.ndarray) -> Chain:
        """labels: a row of 0/1 for each row of x and category; folds: each row's fold."""
        chain = cls(list(categories))
        earlier = np.zeros((len(x), 0))
        for k in range(len(categories)):
            y = labels[:, k].astype(float)
            unseen = np.zeros(len(x))
            for f in range(FOLDS):
                out = folds == f
                if out.any():
                    w = fit(x.take(np.flatnonzero(~out)), earlier[~out], y[~out])
                    unseen[out] = cls.probability(w, x.take(np.flatnonzero(out)).margin(w[: 1 << BITS]), earlier[out])
            chain.weights.append(fit(x, earlier, y))
            chain.thresholds.append(best_threshold(unseen, y))
            earlier = np.concatenate([earlier, unseen[:, None]], 1)
        chain.unseen = earlier
        return chain

    @staticmethod
    def probability(w: np.ndarray, margin: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        d = 1 << BITS
        return sigmoid(margin + earlier @ w[d:-1] + w[-1])

    def probabilities(self, margins: list[np.ndarray]) -> np.ndarray:
        """Of all categories, from each category's sums of hashed features."""
        earlier = np.zeros((len(margins[0]), 0))
        for w, m in zip(self.weights, margins):
            earlier = np.concatenate([earlier, self.probability(w, m, earlier)[:, None]], 1)
        return earlier


def sampled_rows(docs: DataFrame, labels: DataFrame, categories: dict[str, str], most: int = TRAIN_ROWS) -> tuple[Rows, np.ndarray, np.ndarray]:
    """Features, labels and folds of at most most labelled rows of docs. categories: name to SQL expression over the labels, 0/1."""
    wanted = labels.where("doc_id is not null").select("doc_id", *[F.expr(e).cast("int").alias(c) for c, e in categories.items()]).dropna()
    wanted = wanted.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories]).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    wanted = wanted.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(most)  # bounded, so it may be broadcast
    table = common.text_table(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    labelled = table.join(F.broadcast(wanted), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[f for w in words(t) for f in features(w)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[b.column(c) for c in categories], pa.array([np.array(f, "<i4").tobytes() for f in found], pa.binary())], names=["doc_id", *categories, "found"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, " + "".join(f"{c} int, " for c in categories) + "found binary"
    got = labelled.mapInArrow(run, schema).dropDuplicates(["doc_id", "found"]).orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id", "found").limit(most).collect()
    got.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), str(r.doc_id), bytes(r.found)))
    parts = [np.frombuffer(r.found, "<i4") for r in got]
    x = Rows(np.concatenate([np.zeros(0, np.int32), *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))
    y = np.array([[getattr(r, c) for c in categories] for r in got], np.int64).reshape(len(got), len(categories))
    return x, y, np.array([zlib.crc32(str(r.doc_id).encode()) % FOLDS for r in got], np.int64)


#: The categories that the labels tell, in the chain's order.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str] = CATEGORIES, most: int = TRAIN_ROWS) -> Chain:
    return Chain.learned(list(categories), *sampled_rows(docs, labels, categories, most))


def score(docs: DataFrame, chain: Chain, keep: list[str] = ()) -> DataFrame:
    """doc_id, p_<category> and is_<category> for each category, and the columns keep, for every row of docs.

    Null and empty texts have no features: their probabilities are the models' constants. Rows repeat as they are given; an
    empty table gives an empty result; columns that are not asked for are dropped, and one of keep that has a name of the result's
    comes back as own_ and its name. Without labels nothing is above a threshold.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    # the fixed-size tables of weights go along once per executor
    sent = spark.sparkContext.broadcast([w.astype(np.float32) for w in chain.weights])
    names, thresholds = chain.categories, list(chain.thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Chain(names, sent.value, thresholds)
        seen: dict[bytes, int] = {}
        table = np.zeros((1 << 12, len(names)))
        for b in batches:
            if len(seen) > CACHE_WORDS:
                seen.clear()
            every: list[bytes] = []
            ends = np.zeros(len(b) + 1, np.int64)
            for k, t in enumerate(b.column("text").to_pylist()):
                every += words(t)
                ends[k + 1] = len(every)
            new = [w for w in dict.fromkeys(every) if w not in seen]
            if new:
                at, size = [], []
                for w in new:
                    f = features(w)
                    at += f
                    size.append(len(f))
                rows = Rows(np.array(at, np.int64), np.concatenate([[0], np.cumsum(size)]))
                n = len(seen)
                while len(table) < n + len(new):
                    table = np.concatenate([table, np.zeros_like(table)])
                table[n : n + len(new)] = np.stack([rows.margin(w) for w in model.weights], 1)
                seen.update(zip(new, range(n, n + len(new))))
            numbers = np.fromiter(map(seen.__getitem__, every), np.int64, len(every))
            p = model.probabilities(list(by_row(table[numbers], ends).T))
            out = {"doc_id": b.column("doc_id")} | {c: b.column(f"kept_{k}") for k, c in enumerate(carried.values())}
            for k, c in enumerate(names):
                out |= {f"p_{c}": pa.array(p[:, k]), f"is_{c}": pa.array(p[:, k] >= thresholds[k])}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    carried = common.own_names(keep, ["doc_id", "text", *[f"{a}_{c}" for a in ("p", "is") for c in names]])
    types = dict(docs.dtypes)
    table = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), *[F.col(c).alias(f"kept_{k}") for k, c in enumerate(carried)])
    schema = ", ".join([f"doc_id {types['doc_id']}", *[f"{n} {types[c]}" for c, n in carried.items()], *[f"p_{c} double, is_{c} boolean" for c in names]])
    return table.mapInArrow(run, schema)


def kept_documents(docs: DataFrame, chain: Chain, category: str = "toxic") -> DataFrame:
    """The rows of docs, with all their columns, that the chain does not put into category. Null and empty texts have the models'
    constants, so they stay unless most labelled rows are of that category; repeated rows stay or go alike; an empty table stays."""
    names = [f"own_{k}" for k in range(len(docs.columns))]
    carried = docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in zip(docs.columns, names)])
    return score(carried, chain, names).where(~F.col(f"is_{category}")).select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)])


