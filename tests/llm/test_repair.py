import random
import uuid
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from stretto.llm import common, repair

PATH = P.path("byte_bpe_50k.json")


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for n_docs, high in ((1, 3), (40, 4), (40, 300), (3, 1)):
        docs = [rng.integers(0, high, rng.integers(1, 400)) for _ in range(n_docs)]
        off = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        s = repair.Shard(repair.shard([*range(n_docs - 1), None], np.concatenate(docs), off, 500))
        assert np.array_equal(s.expand(s.symbols), np.concatenate(docs))
        for k, d in enumerate(docs):
            assert np.array_equal(s.document(k), d)
            for _ in range(5):
                i, j = sorted(rng.integers(0, len(d) + 1, 2).tolist())
                assert np.array_equal(s.ids(k, i, j), d[i:j])
        if high == 4:
            assert len(s.symbols) < off[-1] / 2


def counted(seq, breaks):
    """How often each pair occurs without overlapping itself, within documents."""
    out, last = {}, {}
    for i in range(len(seq) - 1):
        pair = (seq[i], seq[i + 1])
        if i + 1 not in breaks and last.get(pair, -2) < i - 1:
            out[pair], last[pair] = out.get(pair, 0) + 1, i
    return out


def test_no_pair_that_pays_is_left():
    rng = np.random.default_rng(4)
    for high, n in ((5, 3000), (400, 20000)):
        seq = np.concatenate([rng.integers(0, high, n), np.tile(rng.integers(0, high, 700), 20), np.zeros(2000, int)])
        breaks = np.array([0, 50, 51, n, n + 700 * 11])
        symbols, starts, rules = repair.grammar(seq.astype(np.uint32), breaks, 500)
        assert max(counted(symbols.tolist(), set(starts.tolist())).values()) < repair.LEAST_COUNT
        # a passage that stands there twenty times becomes one symbol or few
        assert repair.lengths(rules, 500).max() >= 350
        off = np.concatenate([breaks, [len(seq)]])
        s = repair.Shard(repair.shard(list(range(len(breaks))), seq.astype(np.uint32), off, 500))
        assert np.array_equal(s.expand(s.symbols), seq)


def test_shards_hold_what_the_library_encodes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(repair, "SHARD_IDS", 300)
    rng = random.Random(2)
    rows = [(i * 7 % 97, "".join(rng.choice(["the ", "Thing, ", "on\n", "é ", "don't  ", "日本🙂 "]) for _ in range(rng.randrange(60)))) for i in range(90)]
    rows += [(200, None), (201, ""), (None, "last"), (5, "again the same id"), (300, "long " * 4000), (301, "\0 \x1c x　y  z"), (302, "<|endoftext|>"), (2**63 - 1, "a <|endoftext|> b<|endoftext|>"), (303, "<|endoftext|"), (-5, "below")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, first int")
    target = f"{common.shared_dir(spark)}/shards-test-{uuid.uuid4().hex}"
    repair.write_shards(docs, PATH, P.PATTERN, target)
    shards = spark.read.parquet(target)
    got = repair.positions(shards, repair.read_shards(shards)).orderBy("start").collect()
    t = Tokenizer.from_file(PATH)
    at = 0
    assert [(r.doc_id is None, r.doc_id or 0) for r in got] == sorted((i is None, i or 0) for i, _ in rows)
    want = {}
    for i, text in rows:
        want.setdefault(i, []).append(t.encode(text or "", add_special_tokens=False).ids + [0])
    for r in got:
        assert r.start == at and list(r.ids) in want[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    assert shards.count() > 10
    repair.write_shards(docs.limit(0), PATH, P.PATTERN, target + "-empty")
    empty = spark.read.schema(shards.schema).parquet(target + "-empty")
    assert repair.positions(empty, repair.read_shards(empty)).count() == 0


def test_rounds_sort_only_pairs_that_can_be_frequent(monkeypatch):
    rng = np.random.default_rng(3)
    phrase = rng.integers(1, 500, 64)  # doubles its nonterminals' lengths round by round, amid ids that hardly repeat
    seq = np.concatenate([np.r_[phrase, rng.integers(500, 60_000, 1000)] for _ in range(60)]).astype(np.uint32)
    breaks = np.arange(0, len(seq), 5320)
    sorted_keys, sort = [], np.sort
    monkeypatch.setattr(repair.np, "sort", lambda x, *a, **k: sorted_keys.append(len(x)) or sort(x, *a, **k))
    symbols, starts, rules = repair.grammar(seq, breaks, 60_000)
    monkeypatch.undo()
    assert len(sorted_keys) > 9 and sum(sorted_keys) < len(seq)  # every round used to sort all that was left
    off = np.r_[breaks, len(seq)]
    assert np.array_equal(repair.Shard(repair.shard(list(range(len(breaks))), seq, off, 60_000)).expand(symbols.astype(np.uint32)), seq)
    inside = np.ones(len(symbols) - 1, bool)
    inside[starts[1:] - 1] = False
    assert np.unique((symbols[:-1].astype(np.int64) << 24 | symbols[1:])[inside], return_counts=True)[1].max() < repair.LEAST_COUNT


def test_batches_share_what_they_look_up():
    rng = random.Random(6)
    stems = ["".join(rng.choices("abcdefghij", k=8)) for _ in range(300)]
    given = [pa.array([" ".join(rng.choice(stems) + rng.choice(["", "", ",", ".", "!", ".\nAnd"]) for _ in range(150)) for _ in range(20)]) for _ in range(12)]
    words, cut, asked = repair.Library(PATH, P.PATTERN), [], []
    split, tokenize = words.split, words.tokenize
    words.split = lambda t: cut.extend(found := split(t)) or found
    words.tokenize = lambda p: asked.append(p) or tokenize(p)
    got = list(words.batches(given))
    # a stem was cut for each batch that it was new to, and again with each mark behind it
    assert len(cut) < 1000 and len(asked) == len(set(asked)) < 700
    t = Tokenizer.from_file(PATH)
    for texts, (ids, off) in zip(given, got, strict=True):
        assert [ids[i:j].tolist() for i, j in zip(off[:-1], off[1:])] == [e.ids for e in t.encode_batch(texts.to_pylist(), add_special_tokens=False)]


def test_batches_agree_with_the_library_whatever_the_table_holds(monkeypatch):
    monkeypatch.setattr(repair, "PIECES", 40)
    rng = random.Random(7)
    parts = ["a", "b", "Ab", "é", "ñ", "日", "ß", " ", " ", "  ", "\n", "\t", "\r\n", ".", ",", "!", "?", ";", ":", "'", "'s", "'ll", "1", "½", "\0", "\x1c", "\x85", "\xa0", "\u3000", "-", "🙂", "e\u0301", "the", " the", "<|endoftext|>", "<|end"]
    words, t = repair.Library(PATH, P.PATTERN), Tokenizer.from_file(PATH)
    for most in (3, 8, 40):
        for _ in range(25):
            given = [["".join(rng.choices(parts, k=rng.randrange(most))) for _ in range(rng.randrange(12))] for _ in range(rng.randrange(1, 5))]
            for texts, (ids, off) in zip(given, words.batches([pa.array(["before", *texts], pa.string())[1:] for texts in given]), strict=True):
                want = [t.encode(x, add_special_tokens=False).ids for x in texts]
                assert [ids[i:j].tolist() for i, j in zip(off[:-1], off[1:])] == want, texts
            assert len(words.known) == len(words.width) == len(words.off) - 1 < 400
    assert [len(ids) for ids, _ in words.batches([pa.array([], pa.string()), pa.array([""])])] == [0, 0]


def test_characters_of_every_kind_are_cut_as_the_library_does():
    t = Tokenizer.from_file(PATH)
    # letters of later versions of Unicode, whose bytes merge with those behind them unless both are cut apart
    texts = [f"{chr(c)}蹋 a{chr(c)}b {chr(c)}蹋  {chr(c)}" for c in [*range(1, 0xD800, 5), *range(0x10008, 0x20000, 0x40)]]
    ids, off = repair.Library(PATH, P.PATTERN).batch(pa.array(texts))
    got = [ids[i:j].tolist() for i, j in zip(off[:-1], off[1:])]
    assert not [x for x, own, e in zip(texts, got, t.encode_batch(texts, add_special_tokens=False), strict=True) if own != e.ids]
