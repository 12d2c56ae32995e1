"""Personal data: fixed base patterns, and candidates that boosted trees accept.

Base spans (email, ip, card, phone) are found by patterns and checks of their own and always stay. Generators with high recall
propose further spans, overlapping ones too: looser separators, spelled-out addresses, missing plus signs. Gradient-boosted trees
score each candidate by its format and its context; they learn from candidates of a bounded sample of documents. The examples to
find are base spans, as they stand and rewritten in place to the looser forms; the rest are candidates that touch no base span and
fail a check of their kind, and rewritten spans spoiled so that they fail it. Candidates that pass the check teach nothing, as
nobody has said what they are. Secrets (keys, tokens, passwords) are a kind without base spans: the trees learn them from made-up
ones, and from look-alikes such as checksums, set into the sampled documents. A threshold per kind, read off held-out documents by
isotonic calibration, decides which candidates are added.
"""

from __future__ import annotations

import ipaddress
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: What only the method finds; its spans may lie over others.
SECRET = "secret"
# The base patterns.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: What proposes candidates; every piece is bounded, so a scan is linear.
PROPOSED = [
    ("email", re.compile(r"[\w.%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[\w-]{1,64}(?:(?: ?(?:\.|\(dot\)|\[dot\]) ?| dot )[\w-]{2,32}){1,4}")),
    ("email", re.compile(r"[\w.%+-]{1,64} at [\w-]{1,64}(?: dot [\w-]{2,32}){1,4}")),
    ("email", re.compile(r"[\w.%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[\w-]{1,64}(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?| dot )[\w-]{2,32}){1,4}")),
    ("email", re.compile(r"[^\s@,;:<>()]{1,64}@[^\s@,;:<>()]{0,127}\w")),
    ("ip", re.compile(r"(?<![0-9])[0-9]{1,3}(?:[.,:] ?[0-9]{1,3}){3}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ .\-_/]?[0-9]){11,19}(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ .\-_/]{1,2}[0-9]{4}){2,3}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])(?:\+|00)?[0-9(][0-9() ./-]{6,22}[0-9](?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")),
]
KEY = r"(?:token|secret|passw(?:or)?d|passphrase|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|auth[a-z]{0,10}|credentials?|bearer)"
#: Proposed secrets: what a key word is given, what begins like an issued key, and any long mixed word.
GIVEN = re.compile(rf"(?i)(?<![a-z]){KEY}(?![a-z])['\"]?\s{{0,3}}(?:=>|:=|[=:])?\s{{0,3}}['\"]?(?P<own>[^\s'\"<>,;]{{8,512}})")
ISSUED = re.compile(r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{20,255}|[sr]k_(?:live|test)_[0-9A-Za-z]{10,255}|sk-[0-9A-Za-z_-]{20,255}|xox[abprs]-[0-9A-Za-z-]{10,255}|eyJ[\w-]{8,1024}\.[\w-]{8,1024}\.[\w-]{8,1024}|AIza[\w-]{30,60})")
MIXED = re.compile(r"(?<![0-9A-Za-z+/_=-])[0-9A-Za-z+/_-]{20,256}={0,2}(?![0-9A-Za-z+/_=-])")
ASSIGNED = re.compile(rf"(?i)(?<![a-z]){KEY}['\"]?\s{{0,3}}(?:=>|:=|[=:])\s{{0,3}}['\"]?$")
DIGIT = re.compile("[0-9]")
CUES = re.compile(r"(?i)mail|e-mail|contact|tel|phone|fon|call|fax|card|visa|account|ip\b|host|server|address|token|password|key|version|isbn|license")
CALLS = re.compile(r"(?i)\b(?:tel|phone|telephone|telefon|fon|call|fax|mobile|mobil|cell)\b")
#: Last labels that a spelled-out address ("at", "dot") may end in.
ENDINGS = set("com org net edu gov mil int info biz io ai app dev co me tv eu de fr uk us ca au at ch nl be es it pt pl se no fi dk cz ru jp cn in br mx kr ie nz za".split())
DATE = re.compile(r"(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}(?![0-9]).*|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)[0-9]{2}(?![0-9]).*")
CALLED = re.compile(r"(?:1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-]?)[0-9]{3}[ .-][0-9]{4}|00[1-9][0-9() ./-]+|\(?0[1-9][0-9]{1,4}\)?[ ./-][0-9 -]+|[1-9][0-9]{0,2}[ .-]?\([0-9]{2,5}\)[ .-]?[0-9 .-]+")
#: Documents whose candidates are learned from, at most (those of smallest hashed ids), and distinct candidates of theirs.
TRAIN_DOCS, TRAIN_ROWS = 20_000, 40_000
#: One in so many of them gets made-up secrets set into it.
SET_IN = 4
TREES, DEPTH, RATE, BINS = 40, 3, 0.2, 16
#: Share of true ones that candidates at the threshold must have in calibration.
PRECISION = 0.9


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def holds(kind: str, text: str) -> bool:
    """Whether a match of a base pattern counts."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    if kind == "card":
        digits = text.replace(" ", "").replace("-", "")
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(DIGIT.findall(text)) <= 15
    return True


def plausible(kind: str, text: str, before: str = "") -> bool:
    """Whether a candidate of a looser form may be of its kind; stricter than what proposes it. before: the text before it."""
    if kind == SECRET:
        if ISSUED.fullmatch(text):
            return True
        mixed = len(set(text)) >= 8 and any(c.isdigit() for c in text) and any(c.isalpha() for c in text)
        return mixed and entropy(text) >= 2.8 and ASSIGNED.search(before) is not None
    if kind == "email":
        bare = re.sub(r" ?(?:@|[(\[]at[)\]]) ?| at ", "@", text)
        local, _, domain = re.sub(r" ?[(\[]dot[)\]] ?| dot ", ".", bare).partition("@")
        labels = domain.split(".")
        ends = labels[-1].lower()
        spelled = " at " in text or " dot " in text
        return len(labels) > 1 and all(labels) and any(c.isalnum() for c in local) and (ends in ENDINGS if spelled else ends.isalpha() and 2 <= len(ends) <= 24)
    if kind == "ip":
        try:
            ipaddress.ip_address(text)
        except ValueError:
            return False
        return True
    digits = "".join(DIGIT.findall(text))
    groups = [len(g) for g in re.findall("[0-9]+", text)]
    if kind == "card":
        even = groups in ([4, 6, 5], [len(digits)]) or all(g == 4 for g in groups[:-1]) and groups[-1] <= 4
        return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits) and even and len(set(re.findall("[^0-9]+", text))) <= 1
    if not 9 <= len(digits) <= 15 or DATE.fullmatch(text) or text.count("(") != text.count(")") or re.fullmatch(r"[0-9]+\.[0-9]+|97[89].*", text):
        return False
    return CALLED.fullmatch(text) is not None or CALLS.search(before) is not None


def entropy(text: str) -> float:
    """Bits a character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def made_up(rng: random.Random) -> list[tuple[str, str, str, int]]:
    """(text before, own, text after, whether it is one) of secrets and of what looks like them."""
    hexed = lambda n: f"{rng.getrandbits(4 * n):0{n}x}"
    word = lambda n, of="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(rng.choice(of) for _ in range(n))
    name = rng.choice(["token", "secret", "password", "api_key", "API_KEY", "access_key", "auth_token", "apikey", "client_secret", "Password"])
    mark, quote = rng.choice([" = ", "=", ": ", ":"]), rng.choice(['"', "'", ""])
    plain = rng.choice(["changeable", "required_field", "documentation", "authentication", "https://example.org/login", "www.example.com/reset"])
    return [
        (name + mark + quote, rng.choice([hexed(32), hexed(40), hexed(64), word(rng.randrange(16, 60)), word(20) + "-" + word(9)]), quote, 1),
        (rng.choice(["", "key ", "use "]), rng.choice(["AKIA" + word(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), "ghp_" + word(36), "sk_live_" + word(24), "xoxb-" + word(12, "0123456789") + "-" + word(24)]), "", 1),
        (name + mark + quote, plain, quote, 0),
        (rng.choice(["sha1 ", "commit ", "checksum: ", "md5sum ", "id ", ""]), rng.choice([hexed(32), hexed(40), hexed(64)]), "", 0),
        (rng.choice(["", "see ", "/"]), rng.choice(["-".join(word(6, "abcdefghij") for _ in range(4)), "_" * 30, "-" * 40, "usr/lib/python3/site-packages/" + word(5, "abcde"), word(30, "0123456789")]), "", 0),
    ]


def rewritten(kind: str, text: str) -> list[tuple[str, int]]:
    """Looser forms of a base span (1), and some spoiled so that they are none (0)."""
    if kind == "email":
        local, _, domain = text.partition("@")
        labels = domain.split(".")
        forms = [(" at ", " dot "), (" (at) ", "."), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" @ ", "."), ("@", " dot ")]
        out = [local + a + d.join(labels) for a, d in forms] + [local + a + d.join([*labels[:-1], "matrix7"]) for a, d in forms]
    elif kind == "ip":
        h = [f"{int(p) % 256:x}" for p in text.split(".")]
        whole = ["2001", "db8", *(f"{a}{b.zfill(2)}" for a in h[:2] for b in h[2:]), h[0], h[3]]
        out = [":".join(whole), "fe80::" + ":".join(whole[2:6]), "2001:db8::" + h[3], ":".join(whole[:7]), ":".join(h[:3]), ", ".join(map(str, text.split("."))), ":".join([*whole[:5], "", "", h[0]]).replace("::", ":")]
    elif kind == "card":
        digits = "".join(DIGIT.findall(text))
        wrong = digits[:-1] + str((int(digits[-1]) + 3) % 10)
        out = [s.join(d[k : k + 4] for k in range(0, len(d), 4)) for d in (digits, wrong) for s in "./_"]
    else:
        d = "".join(DIGIT.findall(text))
        out = [text[1:], "00" + text[1:], "00" + d]
        if len(d) >= 10:
            a, b, c = d[-10:-7], d[-7:-4], d[-4:]
            out += [f"({a}) {b}-{c}", *(s.join([a, b, c]) for s in "-. "), f"{a}{b}{c}", f"20{a[:2]}-0{b[0]}-1{b[1]} {c}", f"{a[0]}.{d[-9:]}", f"{a} {b} {c[:3]} {a}", " ".join([a[:2], b[:2], c[:2], a[1:], b[1:]])]
    return [(t, int(plausible(kind, t))) for t in out]


LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(BASE["email"].pattern.partition("@")[2])


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What BASE["email"] finds, in time that grows with the text alone: each @ has one longest local part before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        part = text[done:at]
        start = done + len(part.rstrip(LOCAL))
        end = DOMAIN.match(text, at + 1) if start < at else None
        if end:
            done = end.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")


def quartets(text: str) -> Iterator[tuple[int, int]]:
    """What BASE["ip"] finds, in time that grows with the text alone: each four parts of a row of numbers parted by dots."""
    for m in DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            parts = m.group().split(".")
            at = m.start()
            for k in range(0, len(parts) - 3, 4):
                end = at + sum(map(len, parts[k : k + 4])) + 3
                yield at, end
                at = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start, in code points."""
    out = []
    digits = DIGIT.search(text) is not None
    out += [("email", i, j) for i, j in emails(text)]
    for kind in KINDS[1:] if digits else ():
        if kind == "ip":
            out += [(kind, i, j) for i, j in quartets(text) if holds(kind, text[i:j])] if "." in text else []
        elif kind != "phone" or "+" in text:
            out += [(kind, m.start(), m.end()) for m in BASE[kind].finditer(text) if holds(kind, m.group())]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Distinct proposed spans, overlapping ones included."""
    lower_at = (" at " in text and " dot " in text) or "(at)" in text or "[at]" in text
    has_at, digits = "@" in text, DIGIT.search(text) is not None
    found = {}
    for kind, pattern in PROPOSED:
        if (has_at or lower_at) if kind == "email" else digits:
            for m in pattern.finditer(text):
                found[kind, m.start(), m.end()] = None
    for m in GIVEN.finditer(text):
        found[SECRET, m.start("own"), m.end("own")] = None
    for pattern in (ISSUED, MIXED) if digits else ():
        for m in pattern.finditer(text):
            if DIGIT.search(m.group()):
                found[SECRET, m.start(), m.end()] = None
    return list(found)


FEATURES = 30


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    own, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
    digits = DIGIT.findall(own)
    groups = re.findall("[0-9]+", own)
    letters = sum(c.isalpha() for c in own)
    seps = [c for c in own if not c.isalnum()]
    cue = CUES.findall(before)
    return [
        (*KINDS, SECRET).index(kind), len(own), len(digits), letters, len(seps), len(set(seps)), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        max((int(g) for g in groups if len(g) < 10), default=0), own.count("."), own.count("-"), own.count(" "), own.count("@"), own.count(":"), own.count("("), own.startswith("+"),
        len(own.rsplit(".", 1)[-1]) if "." in own else 0, int(digits[0]) if digits else -1, len(set(digits)), luhn("".join(digits)) if 12 <= len(digits) <= 20 else 0,
        ord(before[-1]) if before else 0, ord(after[0]) if after else 0, len(cue), sum(c.isdigit() for c in before[-15:] + after[:15]), before[-1:].isalnum() or after[:1].isalnum(),
        plausible(kind, own, before), entropy(own), ASSIGNED.search(before) is not None, sum(c.isupper() for c in own),
    ]


@dataclass
class Trees:
    """Boosted trees for the logistic loss over binned features."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, value by node
    start: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    @classmethod
    def fitted(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        model = cls([np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])])
        b = model.binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        model.start = float(np.log(share / (1 - share)))
        z = np.full(len(y), model.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            feature, cut, value = (np.zeros(2 ** (DEPTH + 1), t) for t in (np.int64, np.int64, float))
            node = np.ones(len(y), np.int64)
            for level in range(DEPTH):
                n = 2**level
                gains = np.zeros((x.shape[1], n, BINS))
                for k in range(x.shape[1]):
                    at = (node - n) * BINS + b[:, k]
                    gs, hs = (np.cumsum(np.bincount(at, v, n * BINS).reshape(n, BINS), 1) for v in (g, h))
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gains[k] = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                best = gains.transpose(1, 0, 2).reshape(n, -1).argmax(1)
                feature[n : 2 * n], cut[n : 2 * n] = best // BINS, best % BINS
                node = 2 * node + (b[np.arange(len(y)), feature[node]] > cut[node])
            top = 2**DEPTH
            value[top:] = np.bincount(node - top, g, top) / (np.bincount(node - top, h, top) + 1) * RATE
            model.trees.append((feature, cut, value))
            z += value[node]
        return model

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, z = self.binned(x), np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            node = np.ones(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + (b[np.arange(len(x)), feature[node]] > cut[node])
            z += value[node]
        return z


def isotonic(y: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to y (pooling of neighbours that fall)."""
    pools: list[list[float]] = []
    for v in y.tolist():
        pools.append([v, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            v_, n_ = pools.pop()
            pools[-1][0] += v_
            pools[-1][1] += n_
    return np.repeat([s / n for s, n in pools], [n for _, n in pools]) if pools else np.zeros(0)


@dataclass
class Model:
    trees: Trees | None = None
    thresholds: dict[str, float] = field(default_factory=dict)  # a kind without one gets nothing added

    @classmethod
    def learned(cls, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Model:
        """held: rows kept for calibration."""
        if not (y[~held] == 1).any() or not (y[~held] == 0).any():
            return cls()
        model = cls(Trees.fitted(x[~held], y[~held]))
        z = model.trees.margin(x)
        for k, kind in enumerate((*KINDS, SECRET)):
            own = np.flatnonzero(held & (x[:, 0] == k))
            own = own[np.argsort(z[own], kind="stable")]
            good = np.flatnonzero(isotonic(y[own].astype(float)) >= PRECISION)
            if len(good) and y[own].any():
                # half way to the next lower one
                model.thresholds[kind] = float((z[own[good[0]]] + z[own[max(0, good[0] - 1)]]) / 2)
        return model


def learnable(text: str) -> Iterator[tuple[list[float], int]]:
    """Features and labels of a text's candidates: base spans, also as rewritten, are 1; what is not plausible, also as rewritten
    and spoiled, is 0. Plausible candidates that touch no base span say nothing, but for addresses of the newer sort, which are 1."""
    base = base_spans(text)
    exact = set(base)
    for kind, i, j in candidates(text):
        if (kind, i, j) in exact:
            yield describe(text, kind, i, j), 1
        elif kind == SECRET:
            if not plausible(kind, text[i:j], text[max(0, i - 40) : i]):
                yield describe(text, kind, i, j), 0
        elif not any(i < e and s < j for _, s, e in base):
            good = plausible(kind, text[i:j], text[max(0, i - 40) : i])
            if not good or kind == "ip":
                yield describe(text, kind, i, j), int(good)
    for kind, i, j in base:
        before, after = text[max(0, i - 80) : i], text[j : j + 80]
        for form, y in rewritten(kind, text[i:j]):
            own = before + form + after
            if (kind, len(before), len(before) + len(form)) in candidates(own):
                yield describe(own, kind, len(before), len(before) + len(form)), y or int(plausible(kind, form, before[-40:]))
    seed = zlib.crc32(text.encode())
    if text and seed % SET_IN == 0:
        rng = random.Random(seed)
        at = rng.randrange(len(text))
        for before, own, after, y in made_up(rng):
            before, after = f"{text[max(0, at - 80) : at]} {before}", f"{after} {text[at : at + 80]}"
            whole = before + own + after
            if (SECRET, len(before), len(before) + len(own)) in candidates(whole):
                yield describe(whole, SECRET, len(before), len(before) + len(own)), y


def train(docs: DataFrame, most: int = TRAIN_DOCS, most_rows: int = TRAIN_ROWS) -> Model:
    """Learns from at most most_rows distinct candidates (by their text's hash) of at most most documents; a lone constant without
    examples of both sorts."""
    spark = docs.sparkSession
    common.small_batches(spark)
    table = common.text_table(docs)
    wanted = table.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(23)), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(zlib.crc32(t.encode()), np.array(f, "<f4").tobytes(), y) for t in b.column("text").to_pylist() for f, y in learnable(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int32())], names=["text", "x", "y"])

    # bounded: one row for each distinct candidate of a bounded number of documents
    got = sorted(map(tuple, table.join(F.broadcast(wanted), "doc_id").select("text").mapInArrow(run, "text long, x binary, y int").distinct().orderBy("text", "x", "y").limit(most_rows).collect()))
    x = np.array([np.frombuffer(r[1], "<f4") for r in got], np.float64).reshape(len(got), FEATURES)
    y = np.array([r[2] for r in got], np.int64)
    return Model.learned(x, y, np.array([r[0] % 10 < 3 for r in got], bool))


def added_spans(texts: list[str], bases: list[list[tuple[str, int, int]]], model: Model) -> list[list[tuple[str, int, int]]]:
    """The candidates that the model accepts and that touch no base span nor a likelier accepted one; secrets only each other."""
    found: list[tuple[int, str, int, int]] = []
    x: list[list[float]] = []
    if model.trees is not None:
        for k, (t, base) in enumerate(zip(texts, bases)):
            for kind, i, j in candidates(t):
                if kind in model.thresholds and (kind == SECRET or not any(i < e and s < j for _, s, e in base)):
                    found.append((k, kind, i, j))
                    x.append(describe(t, kind, i, j))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if found:
        z = model.trees.margin(np.array(x, np.float32).astype(np.float64))
        for c in np.lexsort((np.arange(len(z)), -z)).tolist():
            k, kind, i, j = found[c]
            if z[c] >= model.thresholds[kind] and not any(i < e and s < j for o, s, e in out[k] if (o == SECRET) == (kind == SECRET)):
                out[k].append((kind, i, j))
    return out


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with its spans replaced by their kind; spans that overlap by the first one's."""
    out, at = [], 0
    for kind, i, j in sorted(spans, key=lambda s: (s[1], -s[2])):
        if i >= at:
            out += [text[at:i], f"[{kind.upper()}]"]
        at = max(at, j)
    return "".join([*out, text[at:]])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPANS_SQL = "array<struct<kind:string,start:long,end:long>>"


def find(docs: DataFrame, model: Model, keep: list[str] = (), redact: bool = False) -> DataFrame:
    """doc_id, base and spans (by kind, then start; code points), secrets (by start), the columns keep and, if asked for, redacted,
    for every row.

    A column of keep that has the name of another of these comes back as own_ and its name. Null texts are empty and have no spans (their redacted text stays null). Rows repeat as given; an empty table gives an empty
    result. A map over the input with a model of fixed size.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    carried = common.own_names(keep, ("doc_id", "text", "base", "spans", "secrets", "redacted"))
    types = dict(docs.dtypes)
    order = {k: n for n, k in enumerate(KINDS)}

    def structs(rows: list[list[tuple[str, int, int]]]) -> pa.Array:
        off = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        flat = [s for r in rows for s in r]
        inner = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.int64()), pa.array([s[2] for s in flat], pa.int64())], ["kind", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column("text").to_pylist()
            texts = [t or "" for t in given]
            base = [base_spans(t) for t in texts]
            added = added_spans(texts, base, model)
            every = [sorted([*s, *(x for x in a if x[0] != SECRET)], key=lambda x: (order[x[0]], x[1])) for s, a in zip(base, added)]
            secrets = [sorted(x for x in a if x[0] == SECRET) for a in added]
            out = {"doc_id": b.column("doc_id"), "base": structs(base), "spans": structs(every), "secrets": structs(secrets)} | {c: b.column(c) for c in carried.values()}
            if redact:
                out["redacted"] = pa.array([redacted(t, [*s, *x]) if s or x else t for t, s, x in zip(given, every, secrets)], pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    schema = ", ".join([f"doc_id {types['doc_id']}", f"base {SPANS_SQL}", f"spans {SPANS_SQL}", f"secrets {SPANS_SQL}", *[f"{n} {types[c]}" for c, n in carried.items()], *["redacted string"] * redact])
    return docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in carried.items()]).mapInArrow(run, schema)


def redacted_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with all their columns, personal data in text replaced."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = {c: f"own_{k}" for k, c in enumerate(others)}
    carried = docs.select("doc_id", "text", *[F.col(c).alias(n) for c, n in names.items()])
    found = find(carried, model, list(names.values()), redact=True)
    return found.select(*[F.col("redacted").alias("text") if c == "text" else F.col(names.get(c, c)).alias(c) for c in docs.columns])
