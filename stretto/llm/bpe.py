"""Byte-level BPE by prefix dynamic programming.

A byte string has one valid encoding. Its prefixes' encodings have last tokens, one for each prefix, and a prefix's encoding
is the encoding of what precedes its last token, and that token. So it is enough to store each prefix's last token: the next
byte's is the one token t that ends there and is compatible with the last token before t. Appending is exact, and after an
edit encoding begins again at the edit.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Callable, Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes, about, of a worker's table of words seen, and entries of a generation of its tables of pieces and of neighbours; memory,
#: not results, depends on them.
WORD_BYTES, PIECES, NEIGHBOURS = 64 << 20, 150_000, 200_000
#: What a word costs in the table besides its own bytes and ids: its entry, its object, its number.
ENTRY_BYTES = 160


class Recent:
    """A table in two generations: a full young one becomes the old one, whose entries come back as they are asked for."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.young[key] = found
        return found

    def absent(self, keys: list) -> list:
        """Those of keys that have no entry, each once; the entries of the others are then in the young table."""
        young, old = self.young, self.old
        missing = set(keys).difference(young)
        back = old.keys() & missing if old else ()  # goes through the shorter of the two
        young.update(zip(back, map(old.__getitem__, back)))
        return list(missing.difference(back))

    def age(self) -> None:
        """Between batches, so that what a batch has looked up is still there at its end."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


class PrefixEncoder:
    """Encodes and decodes by the ranks of a tiktoken file (rank is id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for t, i in ranks.items():
            parts = self._merged(t, i)
            if len(parts) == 2:
                self.halves[i] = (parts[0], parts[1])
                self.joined[parts[0], parts[1]] = i
            elif len(t) > 1:
                self.halves[i] = (i, i)
        # tokens that no merges give: only a whole piece can be one
        self.odd = {i for i, (a, b) in self.halves.items() if a == b == i and len(self.token[i]) > 1}
        self.size = {i: len(t) for t, i in ranks.items()}
        # finds all tokens that end at a byte, the longest first
        self.ending = ahocorasick.Automaton()
        for t, i in ranks.items():
            if i not in self.odd:
                self.ending.add_word(t.decode("latin-1"), i)
        self.ending.make_automaton()
        self._fits = Recent(NEIGHBOURS)

    @classmethod
    @functools.lru_cache(maxsize=4)  # noqa: B019
    def of_file(cls, path: str) -> PrefixEncoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _merged(self, piece: bytes, below: int) -> list[int]:
        """Ids of piece by merges of a rank under below."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, k = min((self.ranks.get(parts[k] + parts[k + 1], below), k) for k in range(len(parts) - 1))
            if rank >= below:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether the encoding of a's and b's bytes is a, b: no merge across their border comes before those that make them."""
        known = self._fits.get(a << 24 | b)
        if known is None:
            known = self._fits.young[a << 24 | b] = self._stands(a, b)
        return known

    def age(self) -> None:
        self._fits.age()

    def forget(self) -> None:
        self._fits = Recent(NEIGHBOURS)

    def _stands(self, a: int, b: int) -> bool:
        """Undo the later of the two tokens' merges again and again, on the side of the border; a pair that then touches the
        border and merges by an earlier rank than the one undone last would have been merged."""
        left, right, limit = [a], [b], len(self.ranks) + 1
        while True:
            x, y = left[-1], right[-1]
            if self.joined.get((x, y), limit) < limit:
                return False
            # the later of the merges that made x and y; a merge at equal rank goes left first
            hx = self.halves.get(x)
            hy = self.halves.get(y)
            if hx is None and hy is None:
                return True
            if hy is None or (hx is not None and x > y):
                limit = x
                left.append(hx[1])
            else:
                # the right token was made at rank y: an equal pair further left would have been merged before it
                limit = y + 1
                right.append(hy[0])

    def last_tokens(self, piece: bytes, before: list[int] | None = None) -> list[int]:
        """The last token of each prefix; before: those of a prefix already known, whose bytes have not changed."""
        done = len(before or ())
        last = [*(before or ()), *[-1] * (len(piece) - done)]
        known, size = self._fits.young.get, self.size
        longest = max(0, done - self.longest)
        for end, t in self.ending.iter(piece[longest:].decode("latin-1")) if longest else self.ending.iter(piece.decode("latin-1")):
            end += longest
            if end < done:
                continue
            cut = end - size[t]
            if cut < 0:
                ok = True
            else:
                ok = known(last[cut] << 24 | t)
                if ok is None:
                    ok = self.fits(last[cut], t)
            if ok:
                last[end] = t
                done = end + 1
        if -1 in last:
            raise ValueError("no valid last token")
        return last

    def from_last(self, last: list[int]) -> list[int]:
        ids, end = [], len(last)
        while end:
            ids.append(last[end - 1])
            end -= len(self.token[last[end - 1]])
        return ids[::-1]

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one piece; a whole piece that is a token is that token."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.from_last(self.last_tokens(piece))

    def edited(self, old: bytes, last: list[int], new: bytes) -> list[int]:
        """The last tokens of new's prefixes, from those of old: begins again at the first byte that differs."""
        same = next((i for i, (x, y) in enumerate(zip(old, new)) if x != y), min(len(old), len(new)))
        return self.last_tokens(new, last[:same])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


#: A run of white space that is not one plain character between two words keeps its text from being cut at spaces. Written out
#: for an engine whose \\s is ASCII; a NUL, which marks the cuts, counts as well.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
PLAIN = f"\\A [^\\x00{SPACE[1:]}(?:[^\\x00]*[^\\x00{SPACE[1:]})?\\z"  # one space, then white space at neither end
#: What may stand on both sides of a cut; a pattern is taken if it parts all of these.
BEFORE_SPACE, AFTER_SPACE = ("a", "1", "!", "é", "漢", "a's", "½"), (" a", " 1", " !", " é", " 漢", " 's", " ½")
RUN = f"{SPACE}{SPACE}|\\A{SPACE}|{SPACE}\\z|\\x00"


def splitter(pattern: str) -> regex.Pattern:
    """The pattern, which has to part at single spaces."""
    found = regex.compile(pattern)
    if any(found.findall(a + b) != found.findall(a) + found.findall(b) for a in BEFORE_SPACE for b in AFTER_SPACE):
        raise ValueError("the pattern joins what single spaces part")
    return found


def packed(ids: list[int]) -> bytes:
    """Ids as bytes: small, and nothing for the garbage collector to walk through."""
    return array("I", ids).tobytes()


def by_word(words: list[str], pieces: list[str], ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All pieces' ids in a row and their number by word, told by where words and pieces end."""
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)])
    within = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, words), np.int64, len(words))), "right")
    return np.frombuffer(b"".join(ids), np.uint32), np.diff(upto[within], prepend=0)


class Words:
    """Encodes texts by their words: a text is cut at single spaces, where pieces always end, and each word encoded once.

    Words seen stay in a table of size bytes, about. When it is full, those met in the most batches stay, up to half of it. Texts
    with runs of white space are cut by the whole pattern. encode: gives (all ids, their number for each word) of a list of words
    not seen yet, and is told if all of them are plain: one space, then no white space at their beginning and end.
    """

    def __init__(self, encode: Callable[[list[str], bool], tuple[np.ndarray, np.ndarray]], pattern: str, size: int = WORD_BYTES):
        self.encode, self.size = encode, size
        self.pattern = splitter(pattern)
        self.forget()

    def forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.pool, self.begin, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0
        self.met, self.bytes = np.zeros(1 << 14, np.int32), 0

    def make_room(self) -> None:
        names, met = list(self.seen), self.met[: len(self.seen)]
        n = np.diff(self.begin[: len(names) + 1])
        cost = np.fromiter(map(len, names), np.int64, len(names)) + 4 * n + ENTRY_BYTES
        often = np.argsort(-met, kind="stable")
        often = often[(met[often] > 1) & (np.cumsum(cost[often]) <= self.size // 2)]
        old_pool, old_begin = self.pool, self.begin
        self.forget()
        own = n[often]
        where = np.arange(own.sum()) + np.repeat(old_begin[often] - (np.cumsum(own) - own), own)
        self.put([names[k] for k in often.tolist()], old_pool[where], own)
        self.met[: len(often)] = met[often] // 2

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """The words of each text; all but the first keep the space before them."""
        run = pc.match_substring_regex(texts, RUN)
        plain = pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(run)), " ", "\0 "), "\0")
        if len(plain) == len(texts):
            return plain
        whole = pa.array([self.pattern.findall(t) for t in texts.filter(run).to_pylist()], pa.list_(pa.string()))
        run = run.to_numpy(zero_copy_only=False)
        place = np.empty(len(texts), np.int64)
        place[np.concatenate([np.flatnonzero(~run), np.flatnonzero(run)])] = np.arange(len(texts))
        return pa.concat_arrays([plain, whole]).take(pa.array(place))

    def put(self, new: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.seen)
        while len(self.begin) < n + len(new) + 1:
            self.begin = np.concatenate([self.begin, np.zeros(len(self.begin), np.int64)])
            self.met = np.concatenate([self.met, np.zeros(len(self.met), np.int32)])
        while len(self.pool) < self.used + len(ids):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.begin[n + 1 : n + len(new) + 1] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.bytes += sum(map(len, new)) + 4 * len(ids) + ENTRY_BYTES * len(new)
        self.seen.update(zip(new, range(n, n + len(new))))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin."""
        if self.bytes > self.size:
            self.make_room()
        lists = self.cut(texts)
        ends = lists.offsets.to_numpy().astype(np.int64) - lists.offset
        coded = lists.flatten().dictionary_encode()
        distinct, seen = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), self.seen
        place = np.fromiter(map(seen.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(place < 0)
        plain = pc.match_substring_regex(coded.dictionary.take(pa.array(new)), PLAIN).to_numpy(zero_copy_only=False).astype(bool)
        for own, are_plain in ((new[plain], True), (new[~plain], False)):
            if len(own):
                place[own] = np.arange(len(seen), len(seen) + len(own))
                words = [distinct[k] for k in own.tolist()]
                self.put(words, *self.encode(words, are_plain))
        self.met[place] += 1
        numbers = place[coded.indices.to_numpy()] if len(distinct) else place
        n = self.begin[numbers + 1] - self.begin[numbers]
        upto = np.concatenate([[0], np.cumsum(n)])
        where = np.arange(upto[-1]) + np.repeat(self.begin[numbers] - upto[:-1], n)
        return self.pool[where], upto[ends - ends[0]]


def encoder_words(path: str, pattern: str) -> Words:
    """Words encoded by PrefixEncoder."""
    encoder = PrefixEncoder.of_file(path)
    split = regex.compile(pattern).findall
    known = Recent(PIECES)

    def encode(words: list[str], plain: bool) -> tuple[np.ndarray, np.ndarray]:
        known.age()
        encoder.age()
        pieces = split("".join(words)) if plain else [p for w in words for p in split(w)]
        for p in known.absent(pieces):
            known.young[p] = packed(encoder.piece(p.encode()))
        return by_word(words, pieces, list(map(known.young.__getitem__, pieces)))

    return Words(encode, pattern)


TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])


def encode_documents(docs: DataFrame, path: str, pattern: str, keep_decoded: bool = True) -> DataFrame:
    """doc_id, ids, decoded (the bytes that the ids stand for) of every whole text.

    Null and empty texts have no ids. A null doc_id stays null; repeated rows stay repeated; other columns are dropped. A map
    over the input without any shuffle, in batches of a bounded number of rows; a task that is lost is run again alone.
    """
    spark = docs.sparkSession
    common.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder_words(path, pattern)
        token = PrefixEncoder.of_file(path).token
        for b in batches:
            ids, off = words.batch(b.column("text"))
            decoded = []
            if keep_decoded:
                values = ids.tolist()
                decoded = [b"".join(map(token.__getitem__, values[i:j])) for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(decoded if keep_decoded else [None] * len(b), pa.binary())],
                schema=TOKENS,
            )
        del words
        PrefixEncoder.of_file(path).forget()
        common.give_back()

    table = common.text_table(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return table.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode_documents' rows, by SQL functions. No ids are an empty string; rows that
    repeat are rows, an empty table gives an empty result."""
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

