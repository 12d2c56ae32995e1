"""Removal of long repeated byte strings by a sparse suffix array.

Not every suffix is sorted. In each window of LENGTH bytes the smallest hashed k-gram is an anchor (winnowing), so two equal
windows hold an anchor at the same place, and it is enough to sort the suffixes that begin at anchors. These are dealt to parts by
their leading eight bytes, between splitters taken from a sample. A part sorts the suffixes that share an anchor's k-gram, and the
reversed text before them, by multikey quicksort over eight-byte words, and keeps common lengths of neighbours. Two suffixes
share the window that reaches a bytes to the left of the anchor if their left neighbours share a bytes and their right ones the
other LENGTH - a; each window is a repeat unless its occurrence is the first of its group. Suffixes with one leading word lie in
one part, so no group crosses a boundary.

What travels is little: first the anchors' hashes, then for those that repeat a hash of their surroundings, which settles whole
repeats and hot passages without any text, and then the surroundings of the first of each kind only.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GRAM = 32
#: Input bytes (as stored) of a block of documents.
BLOCK_BYTES = 8 << 20
#: Bytes whose anchors are looked for together.
PIECE = 1 << 20
#: Documents of which splitters are taken, and words to choose among, at most; they bear on balance only.
SPLIT_DOCS, SPLIT_WORDS = 400, 50_000
BASE = 0x9E3779B97F4A7C15
CODES = np.random.default_rng(20240917).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ROW = "block int, part int, kind string, data binary"
ROW_SCHEMA = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("kind", pa.string()), ("data", pa.binary())])


def pack(*arrays: np.ndarray) -> bytes:
    # bytes of equal weight next to each other compress better
    flat = [(a.dtype.str, a.shape, np.ascontiguousarray(a).reshape(-1).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()) for a in arrays]
    return zstandard.ZstdCompressor(1).compress(pickle.dumps(flat, 5))


def unpack(data: bytes) -> list[np.ndarray]:
    out = []
    for kind, shape, raw in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        dtype = np.dtype(kind)
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, -1).T).reshape(-1).view(dtype).reshape(shape))
    return out


def powers(n: int, base: int) -> np.ndarray:
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.cumprod(x, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def rolling(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram-byte string, by differences of prefix sums modulo 2**64."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODES[data] * powers(len(data), BASE), out=sums[1:])
    return mixed((sums[gram:] - sums[:-gram]) * powers(len(data) - gram + 1, pow(BASE, -1, 1 << 64)))


def at_places(data: np.ndarray, places: np.ndarray, gram: int) -> np.ndarray:
    """rolling(data, gram) at some places only."""
    h = np.zeros(len(places), np.uint64)
    for i, p in enumerate(powers(gram, BASE)):
        h += CODES[data[places + i]] * p
    return mixed(h)


def sliding(x: np.ndarray, w: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) over each w neighbours, from running extremes of blocks of w."""
    y = np.concatenate([x, np.full(-len(x) % w, x[-1])]).reshape(-1, w)
    ahead = least.accumulate(y, axis=1).ravel()
    back = least.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return least(ahead[w - 1 : len(x)], back[: len(x) - w + 1])


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are smallest in some window of length bytes within one document."""
    w = length - gram + 1
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, len(data), PIECE):
        b = min(a + PIECE, len(data))
        lo, hi = max(0, a - w + 1), min(len(data), b + w - 1 + gram)
        if hi - lo < length:
            continue
        h = rolling(data[lo:hi], gram)
        smallest = sliding(h, w, np.minimum)
        first, last = np.searchsorted(off, lo, "right") - 1, np.searchsorted(off, lo + len(smallest) - 1, "right")
        cuts = np.clip(off[first : last + 1] - lo, 0, len(smallest))
        ends = np.repeat(off[first + 1 : last + 1] - lo, np.diff(cuts))
        smallest[np.arange(len(smallest)) + length > ends] = 0
        side = np.zeros(w - 1, np.uint64)
        chosen = np.flatnonzero((sliding(np.concatenate([side, smallest, side]), w, np.maximum) == h) & (h > 0))
        chosen = chosen[(chosen + lo >= a) & (chosen + lo < b)]
        out.append((chosen + lo, h[chosen]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([p for p, _ in out]), np.concatenate([h for _, h in out])


def leading(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first eight bytes of the suffixes, as numbers in the order of the bytes."""
    word = np.zeros(len(places), np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | data[places + i]
    return word


class Block:
    """A block's documents in order: by id (null last), then text; their bytes in a row."""

    def __init__(self, docs: pa.Table):
        texts, ids = common.unpacked(docs, "text", "doc_id")
        order = sorted(range(len(texts)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k]))
        self.ids = [ids[k] for k in order]
        texts = [texts[k] for k in order]
        self.off = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]).astype(np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.keys = np.array([np.iinfo(np.int64).max if i is None else i for i in self.ids], np.int64)

    def order(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_id, row and place within the row: what is earlier is smaller."""
        row = np.searchsorted(self.off, places, "right") - 1
        return self.keys[row], row.astype(np.int32), places - self.off[row]

    def around(self, places: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes that windows with these anchors can hold (zeros beyond the document), the first and the last window in it."""
        reach = length - gram
        row = np.searchsorted(self.off, places, "right") - 1
        before, after = places - self.off[row], self.off[row + 1] - places
        first, last = np.maximum(0, reach - before), np.minimum(reach, after + reach - length)
        at = places[:, None] + np.arange(-reach, length)
        inside = (at >= self.off[row][:, None]) & (at < self.off[row + 1][:, None])
        return np.where(inside, self.data[np.clip(at, 0, max(0, len(self.data) - 1))], 0).astype(np.uint8), first.astype(np.uint8), last.astype(np.uint8)


def rows_of(block: int, rows: list[tuple[int, str, bytes]]) -> pa.Table:
    return pa.table([[block] * len(rows), [p for p, _, _ in rows], [k for _, k, _ in rows], [d for _, _, d in rows]], schema=ROW_SCHEMA)


def runs(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for i, j in zip(edge, np.r_[edge[1:], len(part)] if len(part) else []):
        yield int(part[i]), int(i), int(j)


class Job:
    """The steps of the search for one length of strings; what blocks send to parts and parts answer to blocks."""

    def __init__(self, length: int, gram: int, splitters: np.ndarray):
        self.length, self.gram, self.splitters = length, gram, splitters
        self.reach = length - gram

    # 1: which anchors' k-grams occur again

    def send_hashes(self, docs: pa.Table) -> pa.Table:
        b = Block(docs)
        places, h = anchors(b.data, b.off, self.length, self.gram)
        part = np.searchsorted(self.splitters, leading(b.data, places), "right")
        order = np.lexsort((h, part))
        places, h, part = places[order], h[order], part[order]
        rows = [(-1, "places", pack(places.astype(np.int64), part.astype(np.int32)))]
        rows += [(p, "hash", pack(np.diff(h[i:j] >> np.uint64(24), prepend=np.uint64(0)))) for p, i, j in runs(part)]
        return rows_of(docs.column("block")[0].as_py(), rows)

    def again(self, table: pa.Table) -> pa.Table:
        sent = [np.cumsum(unpack(d)[0], dtype=np.uint64) for d in table.column("data").to_pylist()]
        every = np.sort(np.concatenate(sent))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        answers = []
        for s in sent:
            at = np.minimum(np.searchsorted(twice, s), max(0, len(twice) - 1))
            answers.append(pack(np.packbits(twice[at] == s if len(twice) else np.zeros(len(s), bool))))
        return pa.table([table.column("block"), table.column("part"), ["again"] * len(sent), answers], schema=ROW_SCHEMA)

    # 2: which of those have the same surroundings as an earlier one

    def send_surroundings(self, docs: pa.Table, known: pa.Table) -> pa.Table:
        b = Block(docs)
        got = {(k, p): unpack(d) for k, p, d in zip(known.column("kind").to_pylist(), known.column("part").to_pylist(), known.column("data").to_pylist())}
        places, part = got["places", -1]
        keep = np.zeros(len(places), bool)
        for p, i, j in runs(part):
            keep[i:j] = np.unpackbits(got["again", p][0], count=j - i).astype(bool)
        places, part = places[keep], part[keep]
        rows = [(-1, "places", pack(places, part))]
        for p, i, j in runs(part):
            h = at_places(b.data, places[i:j], self.gram)
            c = np.zeros(j - i, np.uint64)
            for m in range(i, j, 20_000):
                n = min(j, m + 20_000)
                text, first, last = b.around(places[m:n], self.length, self.gram)
                x = (first.astype(np.uint64) << np.uint64(8)) | last
                for col in range(text.shape[1]):
                    x = x * np.uint64(BASE) + CODES[text[:, col]]
                c[m - i : n - i] = mixed(x)
            rows.append((p, "around", pack(h, c, *b.order(places[i:j]))))
        return rows_of(docs.column("block")[0].as_py(), rows)

    def settle_surroundings(self, table: pa.Table) -> pa.Table:
        """0: the first or only one of its kind; 1: a repeat of an earlier one as a whole; 2: first of its kind, others differ."""
        sent = [unpack(d) for d in table.column("data").to_pylist()]
        h, c, doc, row, place = (np.concatenate([s[k] for s in sent]) for k in range(5))
        block = np.repeat(np.array(table.column("block").to_pylist()), [len(s[0]) for s in sent])
        order = np.lexsort((place, row, block, doc, c, h))
        hs, cs = h[order], c[order]
        new_h = np.r_[True, hs[1:] != hs[:-1]]
        first = new_h | np.r_[True, cs[1:] != cs[:-1]]
        group = np.cumsum(new_h) - 1
        kinds = np.bincount(group, first)
        state = np.empty(len(h), np.uint8)
        state[order] = np.where(~first, 1, np.where(kinds[group] > 1, 2, 0))
        answers = [pack(x) for x in np.split(state, np.cumsum([len(s[0]) for s in sent])[:-1])]
        return pa.table([table.column("block"), table.column("part"), ["state"] * len(sent), answers], schema=ROW_SCHEMA)

    # 3: which windows of the firsts of their kinds occur earlier

    def states(self, known: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]:
        places = part = None
        state: dict[int, np.ndarray] = {}
        windows: dict[int, np.ndarray] = {}
        for k, p, d in zip(known.column("kind").to_pylist(), known.column("part").to_pylist(), known.column("data").to_pylist()):
            if k == "places":
                places, part = unpack(d)
            else:
                (state if k == "state" else windows)[p] = unpack(d)[0]
        return places, part, np.concatenate([np.zeros(0, np.uint8), *[state[p] for p, _, _ in runs(part)]]), windows

    def send_texts(self, docs: pa.Table, known: pa.Table) -> pa.Table:
        b = Block(docs)
        places, part, state, _ = self.states(known)
        places, part = places[state == 2], part[state == 2]
        rows = []
        for p, i, j in runs(part):
            text, first, last = b.around(places[i:j], self.length, self.gram)
            rows.append((p, "text", pack(at_places(b.data, places[i:j], self.gram), *b.order(places[i:j]), first, last, text)))
        return rows_of(docs.column("block")[0].as_py(), rows)

    def compare(self, table: pa.Table) -> pa.Table:
        sent = [unpack(d) for d in table.column("data").to_pylist()]
        h, doc, row, place, first, last, text = (np.concatenate([s[k] for s in sent]) for k in range(7))
        block = np.repeat(np.array(table.column("block").to_pylist()), [len(s[0]) for s in sent])
        rank = np.empty(len(h), np.int64)
        rank[np.lexsort((place, row, block, doc))] = np.arange(len(h))
        right_order, right_common = multikey(h, text[:, self.reach :])
        left_order, left_common = multikey(h, text[:, : self.reach][:, ::-1])
        repeat = np.zeros((len(h), self.reach + 1), bool)
        for j in range(self.reach + 1):
            a = self.reach - j
            who = np.flatnonzero((first <= j) & (j <= last))
            key = classes(right_order, right_common, self.length - a)[who] * np.int64(len(h)) + classes(left_order, left_common, a)[who]
            order = np.argsort(key)
            edge = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(who) else []
            if len(who):
                least = np.minimum.reduceat(rank[who][order], edge)
                repeat[who[order], j] = rank[who][order] > np.repeat(least, np.diff(np.r_[edge, len(who)]))
        answers = [pack(np.packbits(x, axis=1)) for x in np.split(repeat, np.cumsum([len(s[0]) for s in sent])[:-1])]
        return pa.table([table.column("block"), table.column("part"), ["windows"] * len(sent), answers], schema=ROW_SCHEMA)

    # 4: what is left of the documents

    def cut(self, docs: pa.Table, known: pa.Table) -> pa.Table:
        b = Block(docs)
        change = np.zeros(len(b.data) + 1, np.int32)
        if known.num_rows:
            places, part, state, windows = self.states(known)
            whole = places[state == 1]
            row = np.searchsorted(b.off, whole, "right") - 1
            np.add.at(change, np.maximum(whole - self.reach, b.off[row]), 1)
            np.add.at(change, np.minimum(whole + self.length, b.off[row + 1]), -1)
            own, own_part = places[state == 2], part[state == 2]
            for p, i, j in runs(own_part):
                k, window = np.nonzero(np.unpackbits(windows[p], axis=1, count=self.reach + 1))
                start = own[i:j][k] - self.reach + window
                np.add.at(change, start, 1)
                np.add.at(change, start + self.length, -1)
        gone = np.cumsum(change[:-1]) > 0
        spans, kept = [], []
        for i, j in zip(b.off[:-1].tolist(), b.off[1:].tolist()):
            g = gone[i:j]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8))).reshape(-1, 2)
            spans.append([{"start": x, "end": y} for x, y in edge.tolist()])
            kept.append(b.data[i:j][~g].tobytes() if len(edge) else b.data[i:j].tobytes())
        return pa.table([pa.array(b.ids, pa.int64()), pa.array(np.diff(b.off)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def multikey(group: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of (group, text), and each row's common length with the one before it; -1 where a group begins.

    Multikey quicksort over eight-byte words: rows that are equal so far are sorted by the next word, the others stay.
    """
    n, width = text.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = text
    words = words.reshape(n, -1, 8)[:, :, ::-1].copy().view(np.uint64)[:, :, 0]
    order = np.argsort(group, kind="stable")
    g = group[order]
    common_ = np.where(np.r_[True, g[1:] != g[:-1]], -1, width) if n else np.zeros(0, np.int64)
    for k in range(words.shape[1]):
        start = common_ < width
        run = np.cumsum(start)
        tied = np.flatnonzero((run == np.r_[-1, run[:-1]]) | (run == np.r_[run[1:], -1])) if n else []
        if not len(tied):
            break
        w = words[order[tied], k]
        by = np.lexsort((w, run[tied]))
        order[tied] = order[tied][by]
        w = w[by]
        split = np.flatnonzero((w[1:] != w[:-1]) & (run[tied][1:] == run[tied][:-1])) + 1
        differ = w[split] ^ w[split - 1]
        equal = np.zeros(len(split), np.int64)
        for byte in range(1, 8):
            equal += differ >> np.uint64(64 - 8 * byte) == 0
        common_[tied[split]] = np.minimum(8 * k + equal, width - 1)
    return order, common_


def classes(order: np.ndarray, common_: np.ndarray, depth: int) -> np.ndarray:
    """Rows that share depth bytes have one number."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common_ < depth) - (depth == 0)
    return out


def splitters(docs: DataFrame, parts: int, length: int, gram: int) -> np.ndarray:
    """Leading words at even distances among the anchors of a few documents (those of smallest hashed ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text").to_pylist():
                data = np.frombuffer(t, np.uint8)
                words = np.unique(leading(data, anchors(data, np.array([0, len(data)]), length, gram)[0]))
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64))], names=["word"])

    some = docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SPLIT_DOCS).select(F.col("text").cast("binary").alias("text"))
    words = some.mapInArrow(run, "word long").distinct().orderBy(F.xxhash64("word")).limit(SPLIT_WORDS).collect()
    words = np.sort(np.array([r[0] for r in words], np.int64).view(np.uint64))
    return np.unique(words[np.linspace(0, len(words) - 1, parts + 1)[1:-1].astype(int)]) if len(words) > parts else words


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, end exclusive), kept (the bytes left) for every row of docs.

    A byte goes if a string of length bytes around it within its document starts earlier as well: in a row of a smaller doc_id or
    earlier in its own; judged on the input. Null texts are empty. Rows of one doc_id count in the order of their texts, equal rows
    one after the other; a null doc_id comes last. Texts shorter than length stay as they are, as does an empty table. Extra columns
    are dropped.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    n_blocks = common.blocks(docs, BLOCK_BYTES)
    table = common.text_table(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    job = Job(length, gram, splitters(table, max(1, n_blocks), length, gram))
    held = common.packed_blocks(table.select("doc_id", F.col("text").cast("binary").alias("text"), common.block_of(F.col("doc_id"), n_blocks).alias("block")))
    by_block = lambda df: df.groupBy("block")
    by_part = lambda df, kind: df.where(F.col("kind") == kind).groupBy("part")
    own = lambda df: df.where("part = -1")
    one = common.written(by_block(held).applyInArrow(lambda t: job.send_hashes(t), ROW), "anchors")
    again = by_part(one, "hash").applyInArrow(lambda t: job.again(t), ROW)
    two = common.written(by_block(held).cogroup(by_block(own(one).unionByName(again))).applyInArrow(lambda d, k: job.send_surroundings(d, k), ROW), "surroundings")
    state = common.written(own(two).unionByName(by_part(two, "around").applyInArrow(lambda t: job.settle_surroundings(t), ROW)), "states")
    three = by_block(held).cogroup(by_block(state)).applyInArrow(lambda d, k: job.send_texts(d, k), ROW)
    windows = common.written(three.groupBy("part").applyInArrow(lambda t: job.compare(t), ROW), "windows")
    return by_block(held).cogroup(by_block(state.unionByName(windows))).applyInArrow(lambda d, k: job.cut(d, k), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
