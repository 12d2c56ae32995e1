"""Token-id files compressed by Re-Pair grammars.

A shard holds consecutive documents. Its id sequence is rewritten round by round: the most frequent neighbouring pairs become
nonterminals, everywhere that they don't overlap, and the next round counts again. The rules and the number of ids that each
nonterminal stands for are stored with it, and where each document begins, so a document, or any range of its ids, is decoded
without the rest. Pairs do not cross documents.

Layout of a shard, little-endian: magic, six uint64 (rules, documents, those of them with a doc_id, which come first, symbols,
ids, first nonterminal); rules (2 x uint32 each); rules' lengths (uint32); documents' ids (int64), first symbols and first ids
(uint64 each, with an end); then the symbols as three planes of bytes (low, middle, high).
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress, product, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import bpe, common

MAGIC = b"SRPG0002"
SHARDS = "part int, number long, n_docs long, n_ids long, shard binary"
#: Ids of a shard, about, and pairs that one round replaces at most: the next round goes on.
SHARD_IDS, ROUND_RULES = 1_200_000, 8192
#: A rule takes 12 bytes and each use of it saves a symbol's three, so rarer pairs do not pay.
LEAST_COUNT = 4
#: Pieces that a worker's table holds before it is cut down; larger than elsewhere, as no table of words is held beside it.
PIECES = 500_000
#: Where texts without runs of white space are cut besides spaces: before a mark behind a letter, and on both sides of a line's end.
MARK, LETTER = (bytes(b in c for b in range(256)) for c in (b",.;:!?", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
BORDERS = [
    *product(("a", " a", "1a", "éa", "'s", "x's", "...a", "\na"), (",", ".", "...", ",'s", ". a", ".\na", ",a", ".1", "!é", ";", ":", "?")),
    *product(("a", "1", "!", "é", "漢", "a.", "'"), ("\n", "\na", "\n!", "\n1", "\né", "\n's")),
    *product(("\n", "a\n", "!\n"), ("a", "1", "!", "é", "漢", "'s", "...")),
]
#: The least byte that begins a character from U+0240 on. What is a letter before, the library's cutter and the pattern agree on; of
#: later characters their versions of Unicode tell some differently, so these are asked about as they are met.
LATER = 0xC9
#: Bytes of text, at most, that are encoded at once (a batch beyond is alone), so what batches have in common is looked up once.
TOGETHER = 24 << 20
#: Input bytes of a range of doc_ids, at most, about.
RANGE_BYTES = 16 << 20
#: Parts whose sums of ids are added up in one task.
PARTS = 4096
END = 0


def grammar(seq: np.ndarray, breaks: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, where each break is now, rules). breaks: positions at which a document begins; no pair reaches over one.

    Rounds follow one another until no pair occurs LEAST_COUNT times, or symbols would take more than three bytes. A round looks at
    the pairs that can be frequent only: no round makes a pair of older symbols more frequent, so what was rare once stays so.
    """
    seq = seq.astype(np.int32)
    starts = np.unique(breaks[breaks < len(seq)])
    rules: list[np.ndarray] = []
    made, factor, shift = base, np.uint64(0x9E3779B97F4A7C15), np.uint64(49)
    live = np.ones(max(len(seq) - 1, 0), bool)  # by the place of a pair's first symbol
    while len(seq) > 1:
        live[starts[starts > 0] - 1] = False  # what lies over a border is no pair
        where = np.flatnonzero(live)
        # looked up one by one, or where most are wanted read in a row
        if 4 * len(where) > len(seq):
            key = seq[:-1].astype(np.int64)
            key <<= 24
            key |= seq[1:]
            key = key.take(where)
        else:
            key = seq.take(where).astype(np.int64)
            key <<= 24
            key |= seq.take(where + 1)
        place = key.view(np.uint64) * factor
        # a bucket holds all of a pair's places, so those of a scant bucket hold rare pairs
        bits = min(20, max(15, len(key).bit_length()))
        bucket = (place >> np.uint64(64 - bits)).view(np.int64)
        full = (np.bincount(bucket, minlength=1 << bits) >= LEAST_COUNT).take(bucket)
        live[where] = full
        full = np.flatnonzero(full)
        where, key, place = where.take(full), key.take(full), place.take(full)
        k = np.sort(key)
        edge = np.flatnonzero(np.diff(k, prepend=-1))
        count = np.diff(edge, append=len(k))
        often = np.flatnonzero(count >= LEAST_COUNT)
        if len(often) > ROUND_RULES:
            often = often[np.argsort(-count[often], kind="stable")[:ROUND_RULES]]
        chosen = np.sort(k[edge[often]])[: (1 << 24) - made]
        if not len(chosen):
            break
        # one slot for each hash: of pairs that share one, one waits for the next round
        slots = np.full(1 << 15, -1, np.int32)
        slots[((chosen.view(np.uint64) * factor) >> shift).view(np.int64)] = np.arange(len(chosen), dtype=np.int32)
        chosen = chosen[np.sort(slots[slots >= 0])]
        slots[:] = 0
        slots[((chosen.view(np.uint64) * factor) >> shift).view(np.int64)] = np.arange(len(chosen), dtype=np.int32)
        place >>= shift
        at = slots.take(place.view(np.int64))
        found = np.flatnonzero(chosen.take(at) == key)
        hit, at = where.take(found), at.take(found)
        # of pairs that overlap in a row every second is taken
        over = np.flatnonzero(hit[1:] - hit[:-1] == 1) + 1
        if len(over):
            run = np.flatnonzero(np.diff(over, prepend=-2) != 1)
            stay = np.ones(len(hit), bool)
            stay[over[(np.arange(len(over)) - np.repeat(run, np.diff(run, append=len(over)))) & 1 == 0]] = False
            stay = np.flatnonzero(stay)
            hit, at = hit.take(stay), at.take(stay)
        seq[hit] = made + at
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        keep = np.flatnonzero(keep)
        seq, live = seq.take(keep), np.append(live, False).take(keep)
        starts -= np.searchsorted(hit, starts)  # each hit before a start took one symbol away
        fresh = hit - np.arange(len(hit))  # where the new symbols are now; pairs with them on either side are new
        live[fresh], live[np.maximum(fresh - 1, 0)] = True, True
        live = live[:-1]
        rules.append(np.stack([chosen >> 24, chosen & 0xFFFFFF], 1))
        made += len(chosen)
    return seq, starts, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """The number of ids behind each rule: known once both sides' are, which a few passes settle."""
    size = np.zeros(len(rules), np.int64)
    left = np.arange(len(rules))
    while len(left):
        sides = rules[left]
        known = np.where(sides < base, 1, size[np.maximum(sides - base, 0)])
        ready = (known > 0).all(1)
        size[left[ready]] = known[ready].sum(1)
        left = left[~ready]
    return size


def shard(doc_ids: list[int | None], ids: np.ndarray, off: np.ndarray, base: int) -> bytes:
    """The bytes of one shard. Every document has an id at least: its end. Documents without a doc_id come last."""
    symbols, starts, rules = grammar(ids, off[:-1], base)
    named = [i for i in doc_ids if i is not None]
    head = np.array([len(rules), len(doc_ids), len(named), len(symbols), len(ids), base], "<u8").tobytes()
    documents = np.array([*named, *[0] * (len(doc_ids) - len(named))], "<i8").tobytes()
    planes = symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()
    return b"".join([MAGIC, head, rules.astype("<u4").tobytes(), lengths(rules, base).astype("<u4").tobytes(), documents, np.r_[starts, len(symbols)].astype("<u8").tobytes(), off.astype("<u8").tobytes(), planes])


class Shard:
    """Reads a shard's bytes; documents are decoded as asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        rules, docs, self.named, symbols, self.n_ids, self.base = np.frombuffer(data, "<u8", 6, 8).astype(int).tolist()
        at = 56

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.rules, self.sizes = take("<u4", 2 * rules).reshape(-1, 2).astype(np.int64), take("<u4", rules).astype(np.int64)
        self.docs, self.starts, self.offsets = take("<i8", docs), take("<u8", docs + 1).astype(np.int64), take("<u8", docs + 1).astype(np.int64)
        planes = take("u1", 3 * symbols).reshape(3, -1)
        self.symbols = planes[0].astype(np.uint32) | (planes[1].astype(np.uint32) << np.uint32(8)) | (planes[2].astype(np.uint32) << np.uint32(16))
        self._pool: np.ndarray | None = None

    def _expansions(self) -> None:
        """All nonterminals' ids in a row: both sides of every rule, replaced by theirs until only ids are left."""
        s = self.rules.ravel()
        while len(inner := np.flatnonzero(s >= self.base)):
            n = np.ones(len(s), np.int64)
            n[inner] = 2
            at = (np.cumsum(n) - n)[inner]
            sides = self.rules[s[inner] - self.base]
            s = np.repeat(s, n)
            s[at], s[at + 1] = sides[:, 0], sides[:, 1]
        self._pool, self._begin = s.astype(np.uint32), np.concatenate([[0], np.cumsum(self.sizes)])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if self._pool is None:
            self._expansions()
        s = symbols.astype(np.int64)
        inner = np.flatnonzero(s >= self.base)
        size = np.ones(len(s), np.int64)
        size[inner] = self.sizes[s[inner] - self.base]
        upto = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(symbols.astype(np.uint32), size)
        which = s[inner] - self.base
        n = size[inner]
        total = int(n.sum())
        step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(upto[inner], n) + step] = self._pool[np.repeat(self._begin[which], n) + step]
        return out

    def document(self, k: int) -> np.ndarray:
        return self.expand(self.symbols[self.starts[k] : self.starts[k + 1]])

    def ids(self, k: int, i: int, j: int) -> np.ndarray:
        """Ids i to j of document k: only the symbols that reach into that range are expanded."""
        s = self.symbols[self.starts[k] : self.starts[k + 1]].astype(np.int64)
        size = np.where(s < self.base, 1, self.sizes[np.maximum(s - self.base, 0)] if len(self.sizes) else 1)
        upto = np.concatenate([[0], np.cumsum(size)])
        a, b = max(0, np.searchsorted(upto, i, "right") - 1), np.searchsorted(upto, min(j, upto[-1]))
        return self.expand(s[a:b])[i - upto[a] : i - upto[a] + max(0, min(j, upto[-1]) - i)]


def taken(ids: np.ndarray, off: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of rows place of a table of lists in a row, and where each begins: lists are copied as strings of bytes."""
    table = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(4 * off), pa.py_buffer(ids)])
    out = table.take(pa.array(place))
    upto = np.frombuffer(out.buffers()[1], np.int64, len(place) + 1, 8 * out.offset) // 4
    return np.frombuffer(out.buffers()[2] or b"", np.uint32, upto[-1]), upto


class Library:
    """Encodes batches of texts as the library does. Texts that hold one of its added tokens go through it whole.

    Texts are cut at single spaces, where pieces always end, those with runs of white space by the whole pattern. What several
    batches have in words is cut into pieces once, by the library's own cutter where the pattern would cut otherwise, and a piece is
    given to the library's model once, spelled in its alphabet of visible characters for bytes. Pieces stay in a table; when it has
    more than PIECES, only those of the last batches stay.
    """

    def __init__(self, path: str, pattern: str):
        self.whole = Tokenizer.from_file(path)
        self.tokenize = self.whole.model.tokenize
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values() if t.content]
        self.kinds = np.zeros(0x110000, np.uint8)  # by character: 0 not asked about yet, 2 odd
        self.cutter, self.split = self.whole.pre_tokenizer.pre_tokenize_str, bpe.splitter(pattern).findall
        if any(self.split(a + b) != self.split(a) + self.split(b) for a, b in BORDERS):
            raise ValueError("the pattern joins what line ends or marks behind letters part")
        shown = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
        others = iter(range(256, 512))
        spelled = {b: shown[b] if b in shown else chr(next(others)) for b in range(256)}
        self.alphabet = str.maketrans({chr(b): c for b, c in spelled.items()})
        self.but_nul = {k: v for k, v in self.alphabet.items() if k}
        self.known: dict[str, int] = {}
        self.ids, self.off, self.width = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def learn(self, fresh: list[str]) -> None:
        """Takes pieces into the table: their ids in a row, where each one's begin, and their bytes."""
        joined = "\0".join(fresh)
        if joined.count("\0") == len(fresh) - 1:  # none in a piece
            names = joined.encode().decode("latin-1").translate(self.but_nul).split("\0")
        else:
            names = [p.encode().decode("latin-1").translate(self.alphabet) for p in fresh]
        ids, sizes = array("I"), array("I")
        for k in range(0, len(names), 32):  # few tokens at a time: they are objects
            found = list(map(self.tokenize, names[k : k + 32]))
            sizes.extend(map(len, found))
            ids.extend([t.id for tokens in found for t in tokens])
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh))))
        self.ids = np.concatenate([self.ids, np.frombuffer(ids, np.uint32)])
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(np.frombuffer(sizes, np.uint32), dtype=np.int64)])
        self.width = np.concatenate([self.width, np.fromiter(map(len, names), np.int64, len(names))])

    def forget_all_but(self, place: np.ndarray) -> None:
        stay = np.zeros(len(self.known), bool)
        stay[place] = True
        self.known = dict(zip(compress(self.known, stay.tolist()), range(len(stay))))
        self.ids, self.off = taken(self.ids, self.off, np.flatnonzero(stay))
        self.width = self.width[stay]

    def odd_in(self, text: str) -> list[int]:
        """The characters that are of another kind to the library's cutter than to the pattern."""
        found = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        for c in np.unique(found[self.kinds[found] == 0]).tolist():
            probe = f"a{chr(c)}1{chr(c)}!"
            self.kinds[c] = 1 + (self.library_pieces(probe) != self.split(probe))
        return np.unique(found[self.kinds[found] == 2]).tolist()

    def library_pieces(self, text: str) -> list[str]:
        return [text[i:j] for _, (i, j) in self.cutter(text)]

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, and how many come before each text. A space stays with the word behind it; a mark behind a letter
        and a line's end are words as well."""
        raw, off = common.byte_lists(texts)
        begins = raw == 32
        data = raw.tobytes()
        marks = np.flatnonzero(np.frombuffer(data.translate(MARK), bool)[1:]) + 1
        begins[marks[np.frombuffer(LETTER, bool)[raw[marks - 1]]]] = True
        lines = np.flatnonzero(raw == 10)
        begins[lines] = True
        begins[lines[lines + 1 < len(raw)] + 1] = True
        begins[off[:-1][off[:-1] < off[1:]]] = True
        for k in np.flatnonzero(pc.match_substring_regex(texts, bpe.RUN).to_numpy(zero_copy_only=False).astype(bool)).tolist():
            text = texts[k].as_py()
            pieces = self.split(text) if text.isascii() or not self.odd_in(text) else self.library_pieces(text)
            ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            chars = np.flatnonzero(raw[off[k] : off[k + 1]] & 0xC0 != 0x80)  # where each begins
            if ends[-1] != len(chars):
                raise ValueError("the pattern leaves something out")
            begins[off[k] + 1 : off[k + 1]] = False
            begins[off[k] + chars[ends[:-1]]] = True
        at = np.flatnonzero(begins)
        words = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(raw)).astype(np.int32)), pa.py_buffer(data))
        return words, np.searchsorted(at, off)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words, and where each one's begin."""
        raw, ends = common.byte_lists(words)
        plain = pc.match_substring_regex(words, bpe.PLAIN).to_numpy(zero_copy_only=False).astype(bool)
        later, strange = np.zeros(len(words), bool), np.zeros(len(words), bool)
        later[np.searchsorted(ends, np.flatnonzero(raw >= LATER), "right") - 1] = True
        if odd := self.odd_in(common.byte_lists(words.filter(pa.array(later)))[0].tobytes().decode()):
            strange = pc.match_substring_regex(words, f"[{''.join(f'\\x{{{c:x}}}' for c in odd)}]").to_numpy(zero_copy_only=False).astype(bool)
            plain &= ~strange
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        # plain words, in a row, fall into the same pieces as apart
        pieces = self.split(common.byte_lists(words.filter(pa.array(plain)))[0].tobytes().decode())
        for w, is_strange in zip(words.filter(pa.array(~plain)).to_pylist(), strange[~plain].tolist()):
            pieces += self.library_pieces(w) if is_strange else self.split(w)
        place = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(new := np.flatnonzero(place < 0)):
            missing = [pieces[k] for k in new.tolist()]
            self.learn(list(dict.fromkeys(missing)))
            place[new] = np.fromiter(map(self.known.__getitem__, missing), np.int64, len(missing))
        ids, upto = taken(self.ids, self.off, place)
        # whose pieces are whose is told by where words and pieces end
        last = np.searchsorted(np.cumsum(self.width[place]), np.cumsum(np.diff(ends)[order]), "right")
        off = upto[np.concatenate([[0], last])]
        if len(self.known) > PIECES:
            self.forget_all_but(place)
        if plain.all():
            return ids, off
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return taken(ids, off, back)

    def batches(self, given: list[pa.Array]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each batch of texts all ids, and where each text's begin."""
        special = []
        for texts in given:
            special.append(np.zeros(len(texts), bool))
            for token in self.added:
                special[-1] |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False).astype(bool)
        cuts = [self.cut(pc.if_else(pa.array(s), "", texts) if s.any() else texts) for s, texts in zip(special, given)]
        coded = pa.chunked_array([w for w, _ in cuts], pa.string()).combine_chunks().dictionary_encode()
        words, off = self.encode(coded.dictionary)
        numbers, begin = coded.indices, 0
        for s, texts, (own, upto) in zip(special, given, cuts):
            ids, ends = taken(words, off, numbers[begin : begin + len(own)])
            begin += len(own)
            yield self.with_whole(ids, ends[upto], texts, s) if s.any() else (ids, ends[upto])

    def with_whole(self, ids: np.ndarray, off: np.ndarray, texts: pa.Array, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(off)
        found = [self.whole.encode(t, add_special_tokens=False).ids for t in texts.filter(pa.array(special)).to_pylist()]
        n[special] = list(map(len, found))
        out = np.empty(int(n.sum()), np.uint32)
        own = np.repeat(special, n)
        out[own], out[~own] = np.array([i for f in found for i in f], np.uint32), ids
        return out, np.concatenate([[0], np.cumsum(n)])

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin."""
        return next(self.batches([texts]))


@functools.lru_cache(maxsize=1)
def library(path: str, pattern: str) -> Library:
    """A worker's next task goes on with the tables, which are bounded by bytes: to fill them anew costs a fifth of the time."""
    return Library(path, pattern)


def write_shards(docs: DataFrame, path: str, pattern: str, target: str) -> None:
    """Encodes every whole text, ends each document with id 0, and writes shards of ascending doc_id as Parquet rows to target.

    Ranges of doc_id are sorted apart from each other, so documents of one id stay together, by text; a null doc_id comes last.
    Null texts are empty: the end alone. Repeated rows are documents of their own; an empty table writes no shard. part and number
    (a shard's place) and n_ids are columns of their own, so where a shard begins in the whole is found without its bytes.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    base = Tokenizer.from_file(path).get_vocab_size()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library(path, pattern)

        def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray]]]:
            some: list[pa.RecordBatch] = []
            for b in batches:
                if sum(x.column("text").nbytes for x in [*some, b]) > TOGETHER:
                    yield from zip(some, encoder.batches([x.column("text") for x in some]))
                    some = []
                some.append(b)
            yield from zip(some, encoder.batches([x.column("text") for x in some]))

        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal number, held
            doc_ids = [i for d, _, _ in held for i in d]
            ids = np.concatenate([x for _, x, _ in held])
            off = np.concatenate([[0], np.cumsum(np.concatenate([n for _, _, n in held]))])
            data = shard(doc_ids, ids, off, base)
            number, held = number + 1, []
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], names=["part", "number", "n_docs", "n_ids", "shard"])

        for b, (ids, off) in encoded(batches):
            doc_ids = b.column("doc_id").to_pylist()
            begin = 0
            while begin < len(doc_ids):
                room = SHARD_IDS - sum(len(x) for _, x, _ in held)
                end = max(begin + 1, int(np.searchsorted(off, off[begin] + room, "right")) - 1)
                n = np.diff(off[begin : end + 1]) + 1
                whole = np.full(int(n.sum()), END, np.uint32)
                keep = np.ones(len(whole), bool)
                keep[np.cumsum(n) - 1] = False
                whole[keep] = ids[off[begin] : off[end]]
                held.append((doc_ids[begin:end], whole, n))
                begin = end
                if begin < len(doc_ids) or sum(len(x) for _, x, _ in held) >= SHARD_IDS:
                    yield close()
        if held:
            yield close()

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), common.blocks(docs, RANGE_BYTES))
    table = common.text_table(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = F.col("doc_id").asc_nulls_last()
    ranged = table.repartitionByRange(n, order).sortWithinPartitions(order, "text")
    ranged.mapInArrow(run, SHARDS).write.parquet(target)


def read_shards(shards: DataFrame, with_ids: bool = True) -> DataFrame:
    """part, number (the shard), doc_id, inner (ids before it in the shard), n_tokens, ids_crc32 and (or null) the ids of each
    document, decoded from what write_shards wrote. No shards give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, number, data in zip(b.column("part").to_pylist(), b.column("number").to_pylist(), b.column("shard").to_pylist()):
                s = Shard(data)
                ids = s.expand(s.symbols).astype("<u4")
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist())]
                k = len(crc)
                docs = pa.array(s.docs, pa.int64(), mask=np.arange(k) >= s.named)
                lists = pa.ListArray.from_arrays(pa.array(s.offsets, pa.int32()), pa.array(ids.view(np.int32))) if with_ids else pa.nulls(k, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * k, pa.int32()), pa.array([number] * k, pa.int64()), docs, pa.array(s.offsets[:-1]), pa.array(np.diff(s.offsets)), pa.array(crc, pa.int64()), lists],
                    names=["part", "number", "doc_id", "inner", "n_tokens", "ids_crc32", "ids"],
                )

    common.small_batches(shards.sparkSession)
    return shards.select("part", "number", "shard").mapInArrow(run, "part int, number long, doc_id long, inner long, n_tokens long, ids_crc32 long, ids array<int>")


def positions(shards: DataFrame, decoded: DataFrame) -> DataFrame:
    """decoded with start: the number of ids in all documents before.

    Sums go from shards to groups of PARTS parts, and from there, a row each, over all groups.
    """
    rows = shards.select("part", "number", "n_ids").withColumn("groups", F.floor(F.col("part") / PARTS).cast("int"))
    within = F.sum("n_ids").over(Window.partitionBy("groups").orderBy("part", "number"))
    groups = rows.groupBy("groups").agg(F.sum("n_ids").alias("n"))
    groups = groups.select("groups", (F.sum("n").over(Window.orderBy("groups")) - F.col("n")).alias("before"))
    begins = rows.withColumn("begin", within - F.col("n_ids")).join(groups, "groups")
    begins = begins.select("part", "number", (F.col("begin") + F.col("before")).alias("begin"))
    return decoded.join(begins, ["part", "number"]).withColumn("start", F.col("begin") + F.col("inner")).drop("begin", "part", "number", "inner")
