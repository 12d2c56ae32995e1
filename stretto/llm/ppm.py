"""Language-model scoring by prediction by partial matching over bytes.

The model is the trie of all byte contexts of up to ORDER bytes in the training texts, with the counts of the bytes that follow.
A byte's probability is found from its longest context down: a context that has seen it gives its share, one that has not gives
its escape estimate (its distinct bytes against its total, method C), and bytes that longer contexts have seen are excluded from
the shorter ones' totals. A text's code length, as log10, is the sum over its bytes and an end mark.

The trie is never in one place. Since contexts nest, the byte and its whole context - one gram of ORDER + 1 bytes - decides the
probability. Blocks of texts send their distinct grams with training counts to the part of the trie that holds all longer
contexts of a two-byte context; parts add the counts up, work out each gram's probability, and send them back to the blocks in the
order asked. A context that more than a set share of all bytes follow is hot: its longer contexts are dealt one by one, again and
again as long as they are hot. All parts share the contexts of up to one byte, 65,536 counts at most, and the hot ones, 256 counts
for each; as they are a share of all, there are 2 / HOT_SHARE of each length at most, whatever the input.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 5
#: Two byte values that UTF-8 never uses: what stands before a text and what ends it.
START, END = 0xFE, 0xFF
#: Input bytes (as stored) of a block of documents.
BLOCK_BYTES = 12 << 20
#: Bytes of text whose grams are looked at together.
PIECE = 1 << 20
SHIFT = np.uint64(8)
#: Share of all bytes over which a context is hot, if it is (from half of it on some are), and the lengths that may be.
HOT_SHARE, HOT_LENGTHS = 1 / 512, (2, 3, 4)


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each position's gram (context and byte, the end mark last), and the offsets by text."""
    pad = bytes([START]) * order
    joined = np.frombuffer(b"".join([pad + t + bytes([END]) for t in texts]), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    g = np.zeros(max(0, len(joined) - order), np.uint64)
    for k in range(order + 1):
        g <<= SHIFT
        g |= joined[k : len(joined) - order + k]
    upto = np.concatenate([[0], np.cumsum(size)])
    # positions whose byte is padding belong to no text
    keep = np.ones(len(g), bool)
    begin = np.concatenate([[0], np.cumsum(size + order)])[1:-1]
    for k in range(order):
        keep[begin - order + k] = False
    return g[keep], upto


def pieces(texts: list[bytes], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most bytes."""
    begin = held = 0
    for k, t in enumerate(texts):
        held += len(t) + 1
        if held >= most:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def counted(sorted_values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, np.int64)
    if weights is None:
        return sorted_values[first], np.diff(np.r_[first, len(sorted_values)])
    return sorted_values[first], np.add.reduceat(weights, first) if len(first) else weights[:0]


def merged(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values)
    return counted(values[order], counts[order])


class Table:
    """Lookup of 64-bit keys by open hashing of one step; what collides is searched for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.bits = np.uint64(64 - max(4, int(2 * max(1, len(keys)) - 1).bit_length()))
        self.slots = np.zeros(1 << (64 - int(self.bits)), np.int32)
        self.slots[self.where(keys)] = np.arange(len(keys), dtype=np.int32)

    def where(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.bits

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self.where(keys)]
        lost = np.flatnonzero(self.keys[at] != keys)
        if len(lost):
            at[lost] = np.searchsorted(self.keys, keys[lost])
        return self.values[at]


class Hot:
    """Hot contexts by length, sorted, and how often each byte follows them in training."""

    def __init__(self, contexts: dict[int, np.ndarray]):
        self.contexts = {k: np.asarray(contexts.get(k, []), np.uint64) for k in HOT_LENGTHS}
        self.counts = {k: np.zeros((len(c), 256), np.int64) for k, c in self.contexts.items()}

    def place(self, k: int, gram: np.ndarray) -> np.ndarray:
        """The hot context of length k before each gram's byte, or -1."""
        own = self.contexts[k]
        context = (gram >> SHIFT) & np.uint64((1 << 8 * k) - 1)
        at = np.minimum(np.searchsorted(own, context), max(0, len(own) - 1))
        return np.where(own[at] == context, at, -1) if len(own) else np.full(len(gram), -1)

    def fill(self, rows: list[tuple[int, int, int]]) -> None:
        """rows: (length, context and byte, count)."""
        for k, code, n in rows:
            at = int(np.searchsorted(self.contexts[k], np.uint64(code >> 8)))
            self.counts[k][at, code & 255] = n


def common_contexts(table: DataFrame) -> dict[int, np.ndarray]:
    """The hot contexts of all texts (a column text of bytes): at least each that HOT_SHARE of all bytes follow.

    A context of that share has it in some task, so tasks tell of those alone that have it there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n, total, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, []
        longest = max(HOT_LENGTHS)
        for b in batches:
            raw, off = common.byte_lists(b.column("text"))
            for i in range(0, len(raw), PIECE):
                own = raw[i : i + PIECE + longest].astype(np.uint64)
                g = np.zeros(max(0, len(own) - longest), np.uint64)  # the few that lie over two texts do no harm
                for k in range(longest):
                    g = (g << SHIFT) | own[k : len(own) - longest + k]
                g.sort()
                held.append(counted(g))
                total += len(g)
                if len(held) >= 8:
                    code, n = merged(np.concatenate([code, *[h[0] for h in held]]), np.concatenate([n, *[h[1] for h in held]]))
                    held = []
        code, n = merged(np.concatenate([code, *[h[0] for h in held]]), np.concatenate([n, *[h[1] for h in held]]))
        rows = [(0, 0, total)]
        for k in HOT_LENGTHS:
            c, m = merged(code & np.uint64((1 << 8 * k) - 1), n)
            often = m >= total * HOT_SHARE / 2
            rows += [(k, x, y) for x, y in zip(c[often].tolist(), m[often].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))], names=["length", "context", "n"])

    found = table.select("text").mapInArrow(run, "length int, context long, n long").groupBy("length", "context").agg(F.sum("n").alias("n"))
    total = found.agg(F.sum(F.when(F.col("length") == 0, F.col("n")))).first()[0] or 0
    rows = found.where((F.col("length") > 0) & (F.col("n") >= F.lit(total * HOT_SHARE / 2))).collect()  # 2 / HOT_SHARE of a length at most
    return {k: np.array(sorted(r.context for r in rows if r.length == k), np.uint64) for k in HOT_LENGTHS}


def low_orders(pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts by (byte before, byte) and by byte, from the pairs' counts."""
    one = np.zeros((256, 256), np.int64)
    for key, n in pairs.items():
        one[key >> 8, key & 255] = n
    return one, one.sum(0)


def log_probabilities(gram: np.ndarray, count: np.ndarray, one: np.ndarray, zero: np.ndarray, hot: Hot, order: int = ORDER) -> np.ndarray:
    """log10 of each gram's probability. gram: sorted and distinct, with all grams of each context that is dealt as one; count: in
    training. What shorter contexts are followed by is told by hot, one and zero."""
    n = len(gram)
    out = np.zeros(n)
    done = np.zeros(n, bool)
    byte = (gram & np.uint64(255)).astype(np.int64)
    # of the context one longer: whether it exists, its distinct bytes, and their total in this context
    longer_q = np.zeros(n, np.int64)
    longer_total = np.zeros(n, np.int64)
    level = (gram, np.arange(n), count)  # distinct grams of this order, each gram's place among them, counts
    for k in range(order, -1, -1):
        if k >= 2:
            key, place, c = level
            c_here = c[place]
            context = key >> SHIFT
            node, node_first = np.unique(context, return_index=True)
            own = np.cumsum(np.isin(np.arange(len(key)), node_first)) - 1
            total = np.bincount(own, c, len(node)).astype(np.int64)[own][place]
            distinct = np.bincount(own, c > 0, len(node)).astype(np.int64)[own][place]
            at_hot = hot.place(k, gram) if k in HOT_LENGTHS else np.full(n, -1)
            known = at_hot >= 0
            follow = hot.counts[k][at_hot[known]] if known.any() else None
            if follow is not None:
                total[known], distinct[known] = follow.sum(1), (follow > 0).sum(1)
        elif k == 1:
            before = ((gram >> SHIFT) & np.uint64(255)).astype(np.int64)
            c_here = one[before, byte]
            total, distinct = one.sum(1)[before], (one > 0).sum(1)[before]
        else:
            c_here = zero[byte]
            total, distinct = np.full(n, zero.sum()), np.full(n, (zero > 0).sum())
        left, fresh = total - longer_total, distinct - longer_q
        open_ = ~done & (left > 0)
        seen = open_ & (c_here > 0)
        weight = np.maximum(left + fresh, 1)
        out[seen] += np.log10(c_here[seen] / weight[seen])
        done |= seen
        escape = open_ & ~seen
        out[escape] += np.log10(fresh[escape] / weight[escape])
        if k == 0:
            break
        # what this context's bytes sum up to in the next shorter one
        if k >= 3:
            mask = np.uint64((1 << 8 * k) - 1)
            short = key & mask
            by = np.argsort(short)
            short_key, short_count = counted(short[by], c[by])
            at = np.empty(len(key), np.int64)
            at[by] = np.cumsum(np.r_[False, short[by][1:] != short[by][:-1]])
            if k - 1 in HOT_LENGTHS:  # this part may not hold all that a hot context is followed by
                split = hot.place(k - 1, short_key)
                some = np.flatnonzero(split >= 0)
                short_count = short_count.copy()
                short_count[some] = hot.counts[k - 1][split[some], (short_key[some] & np.uint64(255)).astype(np.int64)]
            below = short_count[at]
            next_level = (short_key, at[place], short_count)
        elif k == 2:
            below = one[((key >> SHIFT) & np.uint64(255)).astype(np.int64), (key & np.uint64(255)).astype(np.int64)]
            next_level = None
        if k >= 2:
            longer_total = np.bincount(own, np.where(c > 0, below, 0), len(node)).astype(np.int64)[own][place]
            if follow is not None:
                # of a hot context's bytes: what they sum up to in the context one shorter, which is hot as well or has one byte
                if k == 2:
                    shorter = one[(hot.contexts[2] & np.uint64(255)).astype(np.int64)]
                else:
                    shorter = hot.counts[k - 1][hot.place(k - 1, hot.contexts[k] << SHIFT)]
                longer_total[known] = ((hot.counts[k] > 0) * shorter).sum(1)[at_hot[known]]
            level = next_level
        else:
            longer_total = ((one > 0) * zero[None, :]).sum(1)[before]
        longer_q = distinct
    out[~done] -= math.log10(max(1, 256 - int((zero > 0).sum())))
    return out


def part_of(gram: np.ndarray, parts: int, hot: Hot) -> np.ndarray:
    """The trie part that holds a gram: by the two bytes before its byte, or by as many more as it takes to be hot no longer."""
    context = (gram >> SHIFT) & np.uint64(0xFFFF)
    some = np.arange(len(gram))
    for k in HOT_LENGTHS:
        some = some[hot.place(k, gram[some]) >= 0]
        context[some] = (gram[some] >> SHIFT) & np.uint64((1 << 8 * (k + 1)) - 1)
    return ((context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts)


def deltas(values: np.ndarray) -> bytes:
    return zlib.compress(np.diff(values, prepend=np.uint64(0)).astype("<u8").reshape(-1).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def undeltas(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view("<u8"), dtype=np.uint64)


GATHERED = "block int, kind string, part int, keys binary, counts binary, n long, code long"


def gather(table: pa.Table, parts: int, hot: Hot) -> pa.Table:
    """One block's distinct grams and words with their training counts, dealt by part, and its counts of byte pairs and of what
    follows hot contexts."""
    block = table.column("block")[0].as_py()
    texts, held_out = common.unpacked(table, "text", "held_out")
    train = ~np.array(held_out)
    gram, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    words: dict[bytes, int] = {}
    tokens = 0
    for i, j in pieces(texts):
        for learn in (True, False):
            some = [t for t, x in zip(texts[i:j], train[i:j]) if x == learn]
            g, _ = grams(some)
            g.sort()
            g, c = counted(g)
            held.append((g, c if learn else np.zeros(len(g), np.int64)))
            if learn:
                tokens += len(some)
                for t in some:
                    w = t.lower().split()
                    tokens += len(w)
                    for x in w:
                        words[x] = words.get(x, 0) + 1
            else:
                for t in some:
                    for x in t.lower().split():
                        words.setdefault(x, 0)
        if len(held) >= 16 or j == len(texts):
            gram, count = merged(np.concatenate([gram, *[g for g, _ in held]]), np.concatenate([count, *[c for _, c in held]]))
            held = []
    rows: list[tuple] = []
    if len(gram):
        p = part_of(gram, parts, hot)
        order = np.argsort(p, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(p[order])) + 1):
            rows.append((block, "gram", int(p[own[0]]), deltas(gram[own]), zlib.compress(count[own].astype("<u4").tobytes(), 1), 0, None))
        pair = gram & np.uint64(0xFFFF)
        order = np.argsort(pair)
        keys, n = counted(pair[order], count[order])
        rows += [(block, "pair", int(k), None, None, int(c), None) for k, c in zip(keys.tolist(), n.tolist()) if c]
        for k in HOT_LENGTHS:
            some = np.flatnonzero((hot.place(k, gram) >= 0) & (count > 0))
            keys, n = merged(gram[some] & np.uint64((1 << 8 * (k + 1)) - 1), count[some])
            rows += [(block, "hot", k, None, None, c, code) for code, c in zip(keys.tolist(), n.tolist())]
    dealt: dict[int, list[bytes]] = {}
    for w in words:
        dealt.setdefault(zlib.crc32(w) % parts, []).append(w)
    for k, own in dealt.items():
        own.sort()
        counts_ = np.array([words[w] for w in own], "<u4")
        rows.append((block, "word", k, zlib.compress(b"\n".join(own), 1), zlib.compress(counts_.tobytes(), 1), 0, None))
    rows.append((block, "sum", 0, None, None, tokens, None))
    schema = pa.schema([("block", pa.int32()), ("kind", pa.string()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("n", pa.int64()), ("code", pa.int64())])
    return pa.table(dict(zip(schema.names, map(list, zip(*rows)))), schema)


def answer_grams(table: pa.Table, one: np.ndarray, zero: np.ndarray, hot: Hot) -> tuple[list[np.ndarray], list[np.ndarray]]:
    keys = [undeltas(k) for k in table.column("keys").to_pylist()]
    counts = [np.frombuffer(zlib.decompress(c), "<u4").astype(np.int64) for c in table.column("counts").to_pylist()]
    gram, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for i in range(0, len(keys), 16):
        gram, count = merged(np.concatenate([gram, *keys[i : i + 16]]), np.concatenate([count, *counts[i : i + 16]]))
    values = log_probabilities(gram, count, one, zero, hot)
    return keys, [values[np.searchsorted(gram, k)] for k in keys]


def answer_words(table: pa.Table) -> tuple[list[bytes], list[np.ndarray], int]:
    """What each block asked for, the training counts, and the number of distinct training words."""
    asked = [zlib.decompress(k) for k in table.column("keys").to_pylist()]
    total: dict[bytes, int] = {}
    for a, c in zip(asked, table.column("counts").to_pylist()):
        for w, n in zip(a.split(b"\n"), np.frombuffer(zlib.decompress(c), "<u4").tolist()):
            total[w] = total.get(w, 0) + n
    return asked, [np.array([total[w] for w in a.split(b"\n")], "<i8") for a in asked], sum(1 for n in total.values() if n)


ANSWERS = pa.schema([("block", pa.int32()), ("kind", pa.string()), ("keys", pa.binary()), ("counts", pa.binary()), ("n", pa.int64())])
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, known_sum double, n_bytes long, score double"


def answer(table: pa.Table, one: np.ndarray, zero: np.ndarray, hot: Hot) -> pa.Table:
    kind = table.column("kind")[0].as_py()
    blocks = table.column("block").to_pylist()
    if kind == "gram":
        _, values = answer_grams(table, one, zero, hot)
        rows = {"block": blocks, "kind": ["gram"] * len(blocks), "keys": table.column("keys"), "counts": [zlib.compress(v.astype("<f8").tobytes(), 1) for v in values], "n": [0] * len(blocks)}
    else:
        asked, values, distinct = answer_words(table)
        rows = {"block": [*blocks, -1], "kind": ["word"] * len(blocks) + ["distinct"], "keys": [*[zlib.compress(a, 1) for a in asked], None], "counts": [*[zlib.compress(v.tobytes(), 1) for v in values], None], "n": [0] * len(blocks) + [distinct]}
    return pa.table({k: pa.array(v, ANSWERS.field(k).type) if isinstance(v, list) else v.cast(ANSWERS.field(k).type) for k, v in rows.items()}, ANSWERS)


def score_block(docs: pa.Table, known: pa.Table) -> pa.Table:
    """Scores of a block's texts from the answers to what the block asked."""
    kinds = known.column("kind").to_pylist()
    keys, values = known.column("keys").to_pylist(), known.column("counts").to_pylist()
    mine = [k for k, kind in enumerate(kinds) if kind == "gram"]
    words: dict[bytes, int] = {}
    for k, kind in enumerate(kinds):
        if kind == "word":
            words.update(zip(zlib.decompress(keys[k]).split(b"\n"), np.frombuffer(zlib.decompress(values[k]), "<i8").tolist()))
    gram = np.concatenate([undeltas(keys[k]) for k in mine] or [np.zeros(0, np.uint64)])
    value = np.concatenate([np.frombuffer(zlib.decompress(values[k]), "<f8") for k in mine] or [np.zeros(0)])
    order = np.argsort(gram)
    table = Table(gram[order], value[order])
    texts, doc_id, held_out = common.unpacked(docs, "text", "doc_id", "held_out")
    score = np.zeros(len(texts))
    n_tokens, n_known = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    known_sum = np.zeros(len(texts))
    for i, j in pieces(texts):
        g, upto = grams(texts[i:j])
        score[i:j] = np.add.reduceat(table(g), upto[:-1])
        c = [np.fromiter(map(words.__getitem__, t.lower().split()), np.int64) for t in texts[i:j]]
        n = np.fromiter(map(len, c), np.int64, j - i)
        n_tokens[i:j] = n
        every = np.concatenate([*c, np.zeros(1, np.int64)])
        begin = np.concatenate([[0], np.cumsum(n)])
        n_known[i:j] = np.diff(np.concatenate([[0], np.cumsum(every > 0)])[begin])
        logs = np.log10(every + 1.0)
        known_sum[i:j] = [logs[a:b].sum() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return pa.table({"doc_id": pa.array(doc_id, pa.int64()), "held_out": held_out, "n_tokens": n_tokens, "n_known": n_known, "known_sum": known_sum, "n_bytes": size, "score": score})


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes for every row of docs.

    The model learns from the rows where held_out is false. score is log10 of the text's probability by the trie, the end mark
    included; base_score that of a unigram word model with add-one smoothing over words and one end per text. Null texts are empty:
    one token, the end. A held_out that is null counts as false. Without training rows every byte has probability 1/256. Rows that
    repeat are learned from as often and scored each. An empty table gives an empty result. Extra columns are dropped.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    n_blocks = common.blocks(docs, BLOCK_BYTES)
    parts = max(8, 2 * n_blocks)
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    table = table.withColumn("block", common.block_of(F.struct("doc_id", F.length("text")), n_blocks))
    hot = Hot(common_contexts(table))
    table = common.packed_blocks(table)
    asked = common.written(table.groupBy("block").applyInArrow(lambda t: gather(t, parts, hot), GATHERED), "grams")
    pairs = {r.part: r.n for r in asked.where("kind = 'pair'").groupBy("part").agg(F.sum("n").alias("n")).collect()}  # 65,536 at most
    one, zero = low_orders(pairs)
    followed = asked.where("kind = 'hot'").groupBy("part", "code").agg(F.sum("n").alias("n"))
    hot.fill([(r.part, r.code, r.n) for r in followed.collect()])  # 256 for each hot context at most
    tokens = int(asked.where("kind = 'sum'").agg(F.sum("n")).first()[0] or 0)
    train_docs = int(zero[END])
    answers = common.written(asked.where("kind in ('gram', 'word')").drop("n", "code").groupBy("kind", "part").applyInArrow(lambda t: answer(t, one, zero, hot), "block int, kind string, keys binary, counts binary, n long"), "answers")
    distinct = int(answers.where("kind = 'distinct'").agg(F.sum("n")).first()[0] or 0) + (train_docs > 0)
    back = answers.where("block >= 0").select("block", "kind", "keys", "counts")
    scored = table.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score_block, SCORES)
    level = math.log10(tokens + distinct + 1)
    end = math.log10(train_docs + 1)
    return scored.select(
        "doc_id", "held_out", (F.col("n_tokens") + 1).alias("n_tokens"), (F.col("n_known") + F.lit(int(train_docs > 0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("known_sum") + F.lit(end) - (F.col("n_tokens") + 1) * F.lit(level)).alias("base_score"), "score", "n_bytes",
    )
