import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from stretto.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return bpe.PrefixEncoder.of_file(PATH)


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    yield from ["", "a", "  ", "a  b", "a   b ", "\n\n x", "don't  stop", "x\t\ty", "日本語テスト 漢字", "🙂🙂 a🙂", "a" * 400, "a b 　 c", "½ ²³ x²", "\x1c\x1d a\x1eb", " \n", "a\0b c", "<|endoftext|>"]
    for _ in range(300):
        yield "".join(rng.choice("ab  \n\té'sS1½²!?., 日🙂theing") for _ in range(rng.randint(1, 60)))
    for _ in range(300):
        yield "".join(chr(rng.choice([rng.randint(32, 0x24F), rng.randint(0x400, 0x9FF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(rng.randint(1, 40)))


def test_words_agree_with_the_library(reference):
    given = list(texts())
    words = bpe.encoder_words(PATH, P.PATTERN)
    for _ in range(2):  # the second time from the table
        ids, off = words.batch(pa.array(given))
        for k, t in enumerate(given):
            assert ids[off[k] : off[k + 1]].tolist() == reference.encode_ordinary(t), repr(t)
    words.size = 2000  # room is made again and again, and what stays is still right
    for k in range(0, len(given), 10):
        ids, off = words.batch(pa.array(given[k : k + 10] + ["again and again", "once more"]))
        assert ids.tolist() == [i for t in [*given[k : k + 10], "again and again", "once more"] for i in reference.encode_ordinary(t)]
        assert words.bytes < 20000
    assert " and" in words.seen


def test_a_pattern_that_joins_over_spaces_is_refused():
    with pytest.raises(ValueError):
        bpe.Words(lambda words, plain: None, r"\w+ \w+|.")


def test_pieces_and_edits_agree_with_plain_merges(encoder):
    rng = random.Random(5)
    for _ in range(400):
        piece = bytes(rng.choice(b" theingaoures") for _ in range(rng.randint(1, 40)))
        assert encoder.from_last(encoder.last_tokens(piece)) == encoder._merged(piece, len(encoder.ranks) + 1)
        at = rng.randrange(len(piece) + 1)
        new = piece[:at] + b"xq" + piece[at + rng.randrange(2) :]
        assert encoder.edited(piece, encoder.last_tokens(piece), new) == encoder.last_tokens(new)
        assert encoder.last_tokens(new, encoder.last_tokens(new[:at])) == encoder.last_tokens(new)
        assert encoder.decode(encoder.piece(new)) == new


def test_library_words_agree_with_the_library():
    from tokenizers import Tokenizer

    from stretto.llm import repair

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    given = list(texts()) + [" ".join("abcdefg"[i % 7] * (1 + i % 5) + ",.'s\nxé"[i % 7] + "q" for i in range(k)) for k in range(60)]
    words = repair.Library(path, P.PATTERN)
    for _ in range(2):
        ids, off = words.batch(pa.array(given))
        for k, e in enumerate(t.encode_batch(given, add_special_tokens=False)):
            assert ids[off[k] : off[k + 1]].tolist() == e.ids, repr(given[k])
