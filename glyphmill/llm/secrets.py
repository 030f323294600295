"""Secret scans: patterns, and a linear-chain conditional random field that tags tokens as begin, inside or outside of a secret.

Tokens are what stands between ASCII white space. A token's score is the sum of what its own shape, the shapes of the words before and
after it, and the file say. The field is fitted on windows around the pattern matches of a bounded sample, on windows of texts without
one, and on copies of both in which matches give way to made-up secrets of other kinds, with other openers or none, and numbers,
addresses and names that are no secrets are strewn in; so it learns the shape of a secret rather than the patterns. Tokens recur, so a
worker keeps the scores of each distinct shape and scores whole texts by table lookups. Decoding is exact Viterbi: a token that no
choice of neighbours could pull out of "outside" is fixed there first, and the runs between such tokens are decoded together.
"""

from __future__ import annotations

import json
import math
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.crf import Batch, Chain, fit, viterbi
from glyphmill.llm.rows import buffers_of, chunks_of, map_batches, pick, positional, slices, texts_of, trim

#: The field is fitted on at most so many texts that may hold a pattern match and so many others, those with the smallest hash; on at
#: most so many windows of each, which a hash chooses from the whole text. Scans read every token of every text.
MAX_MATCHED, MAX_CLEAN, MAX_WINDOWS = 400, 1200, 2
AROUND, CLEAN_TOKENS = 12, 30
#: A token is shown to the field, in windows and in scans, by so many of its first characters; longer ones look alike to it anyway.
SHOWN = 256
REMEMBERED = 200_000

KINDS = ["assign", "access", "hex", "crf"]
#: The patterns of the three base kinds, and the words that may open an assignment.
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_OPENERS = re.compile(r"(?ai:password|passwd|secret|token|api_?key)")
_HINT = re.compile(r"(?ai:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{32}")
_TOKEN = re.compile(r"[^\t-\r ]+")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each pattern; those too short drop out afterwards."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text) if m.end() - m.start() >= 32]
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


_LENGTHS = [1, 2, 4, 8, 12, 16, 20, 24, 32, 40, 64]
_SIDES = "\"'`()[]{}<>.,;:!?#*%&$|"
_CLASS = str.maketrans({**{chr(c): "a" for c in range(97, 123)}, **{chr(c): "A" for c in range(65, 91)}})
_FOREIGN = re.compile(r"[^\x00-\x7f]|\x01")
_DIGIT = re.compile("[0-9]")
_RUNS = re.compile("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")


def shape(token: str) -> str:
    """What the field sees of a token: its beginning, with one letter for all from beyond ASCII; without a digit or a hint of a pattern
    also one for all small letters and one for all capitals. Tokens of equal shape have equal features."""
    seen = _FOREIGN.sub("é", token[:SHOWN])
    return seen if _DIGIT.search(seen) or _HINT.search(seen) else seen.translate(_CLASS)


_BLUR = np.arange(256, dtype=np.uint8)
_BLUR[97:123], _BLUR[65:91], _BLUR[192:] = 97, 65, 1
_ROUGH = np.where(_BLUR == 1, 1, np.arange(256)).astype(np.uint8)


def blurred(d: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens' bytes with as few distinct tokens as their shapes allow: 1 for each character from beyond ASCII; tokens that surely
    have neither digit nor hint with one letter for all small ones and one for all capitals."""
    sharp = np.zeros(len(starts) - 1, bool)
    if len(d) > 4:
        low, n = d | 0x20, len(d) - 3
        at = [np.nonzero((d >= 48) & (d <= 57))[0]]
        for part in (b"pass", b"secr", b"toke", b"api", b"akia"):
            met = low[:n] == part[0]
            for k in range(1, len(part)):
                met &= low[k : k + n] == part[k]
            at.append(np.nonzero(met)[0])
        other = np.nonzero(((d < 97) | (d > 102)) & ((d < 48) | (d > 57)))[0]
        edges = np.concatenate([[-1], other, [len(d)]])
        at.append(edges[:-1][np.diff(edges) > 32] + 1)  # a run of 32 hexadecimal digits may begin in one token and end in the next
        at.append(edges[1:][np.diff(edges) > 32] - 1)
        sharp[np.searchsorted(starts, np.concatenate(at), side="right") - 1] = True
    else:
        sharp[:] = True
    d = np.where(np.repeat(sharp, np.diff(starts)), _ROUGH[d], _BLUR[d])
    whole = (d & 0xC0) != 0x80
    return d[whole], np.concatenate([[0], np.cumsum(whole, dtype=np.int64)])[starts]


def shape_features(token: str) -> list[float]:
    """Of a token's shape: length, kinds of characters and how they change, punctuation, and the words that open an assignment."""
    token = shape(token)
    n = len(token)
    core = token.strip(_SIDES)
    runs = _RUNS.findall(core)
    digits = sum(len(r) for r in runs if "0" <= r[0] <= "9")
    upper = sum(len(r) for r in runs if "A" <= r[0] <= "Z")
    lower = sum(len(r) for r in runs if "a" <= r[0] <= "z")
    alnum = digits + upper + lower
    m = max(1, len(core))
    mixed = digits > 0 and upper + lower > 0
    hexed = digits > 0 and not upper and alnum == len(core) and all(c in "0123456789abcdef" for c in core)
    opener = bool(_OPENERS.search(token))
    joins = sum(c in "=:" for c in core)
    value = max(re.split("[=:]+", core), key=len).strip(_SIDES) if joins else core
    word = max([len(r) for r in runs if "a" <= r[0] <= "z"], default=0)
    return [
        float(digits > 0 and lower > 0),
        float(opener),
        *[float(n >= x) for x in _LENGTHS],
        *[float(mixed and len(value) >= x) for x in (8, 12, 16, 20, 24, 32)],
        *[float(mixed and len(runs) >= x) for x in (4, 6, 9, 12)],
        float(digits > 0 and upper > 0),
        float(digits > 0 and upper > 0 and lower > 0),
        float(digits == len(core) and digits > 0),
        float(hexed),
        float(hexed and len(core) >= 12),
        float(alnum > 0 and lower + upper == len(core)),
        float(upper == len(core) and upper > 1),
        digits / m,
        upper / m,
        (m - alnum) / m,
        len(runs) / m if mixed else 0.0,
        min(len(runs), 16) / 16 if mixed else 0.0,
        float(word >= 6),
        float(mixed and word >= 6),
        float(len(set(value)) >= 12 and digits > 0),
        float(joins > 0),
        float(joins > 0 and mixed and len(value) >= 16),
        float("=" in token),
        float(token in ("=", ":", ":=", "=>")),
        float(token[-1:] in "=:" and n > 1),
        float(token[:1] in "\"'`"),
        float(token[-1:] in "\"'`"),
        float("_" in core or "-" in core),
        float("/" in core),
        float("+" in core or core[-1:] == "="),
        float("@" in core),
        float("://" in token or core.startswith(("/", "www"))),
        float("." in core),
        float(core.count(".") >= 3),
        float(opener and joins > 0),
        float(opener and digits > 0),
        float(core.startswith("AKIA")),
        float("é" in core),
        1.0,
    ]


N_SHAPE = len(shape_features(""))
MIXED, OPENER = 0, 1
N_FILE = 3


def file_features(mixed: int, openers: int, tokens: int) -> list[float]:
    """Of a whole text: the share of tokens that mix digits with letters, whether a word that opens an assignment occurs, shortness."""
    return [min(1.0, 10 * mixed / max(1, tokens)), float(openers > 0), float(tokens < 50)]


@dataclass
class Tagger:
    """States: 0 outside, 1 begin, 2 inside."""

    chain: Chain  # features: own, before, after, file

    def live(self, e: np.ndarray) -> np.ndarray:
        """Tokens that can be other than outside: some run about them may score more than the same run outside would.

        A run of length n gains what its tokens gain at most, n - 1 moves within, one into it and one out of it.
        """
        m, first = self.chain.moves, self.chain.first
        within = float(m[1:, 1:].max() - m[0, 0])
        into = float(max((m[0, 1:] - m[0, 0]).max(), (first[1:] - first[0]).max()))
        out = float(max((m[1:, 0] - m[0, 0]).max(), 0.0))
        upto = np.concatenate([[0.0], np.cumsum(np.maximum(e[:, 1], e[:, 2]) - e[:, 0] + within)])
        low = np.minimum.accumulate(upto[:-1])
        high = np.maximum.accumulate(upto[:0:-1])[::-1]
        return high - low + (into + out - within) >= -1e-9 * (1 + np.abs(low))

    def decode(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Exact Viterbi: tokens that must be outside cut the texts into short runs whose neighbours are known."""
        state = np.zeros(len(e), np.int64)
        live = self.live(e) if len(e) else np.zeros(0, bool)
        if not live.any():
            return state
        heads = np.zeros(len(e), bool)
        ends = np.zeros(len(e), bool)
        some = lengths[lengths > 0]
        heads[np.cumsum(some) - some] = True
        ends[np.cumsum(some) - 1] = True
        prior = np.concatenate([[False], live[:-1]]) & ~heads
        after = np.concatenate([live[1:], [False]]) & ~ends
        opens, closes = live & ~prior, live & ~after
        at = np.nonzero(live)[0]
        run = np.diff(np.append(np.nonzero(opens[at])[0], len(at)))
        own = e[at].copy()
        start, stop = opens[at], closes[at]
        own[start] += np.where(heads[at[start]][:, None], self.chain.first[None], self.chain.moves[0][None])
        own[stop] += np.where(ends[at[stop]][:, None], 0.0, self.chain.moves[:, 0][None])
        state[at] = viterbi(own, Chain(self.chain.weights, self.chain.moves, np.zeros(3)), Batch(run))
        return state


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


@dataclass
class Window:
    tokens: list[str]
    states: list[int]
    whole: list[int]  # of the whole text: tokens that mix digits with letters, that open an assignment, and all


def _unsure(token: str) -> bool:
    """Looks like a secret of no known pattern: neither a good nor a bad example."""
    core = token.strip(_SIDES)
    return len(core) >= 16 and not any(x in core for x in ("@", "://")) and len(_DIGIT.findall(core)) >= 3 and sum(c.isascii() and c.isalpha() for c in core) >= 3


def windows_of(text: str, seed: int, most: int = MAX_WINDOWS) -> list[Window]:
    """Windows around matches of the patterns, or, of a text without, one anywhere and one around a token with a digit.

    A hash of seed and place chooses among all places of the whole text.
    """
    places = [m.span() for m in _TOKEN.finditer(text)]
    tokens = [text[s:e] for s, e in places]
    states, k = [0] * len(places), 0
    taken = merged([(s, e) for _, s, e in base_spans(text)])
    starts = []
    for i, (a, b) in enumerate(places):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < b:
            fresh = not (i and places[i - 1][1] > taken[k][0])
            states[i] = 1 if fresh or not states[i - 1] else 2
            if states[i] == 1:
                starts.append(i)
    seen = {t: (bool(f[MIXED]), bool(f[OPENER])) for t in set(tokens) for f in [shape_features(t)]}
    whole = [sum(seen[t][0] for t in tokens), sum(seen[t][1] for t in tokens), len(tokens)]

    def chosen(at: list[int], n: int) -> list[int]:
        return sorted(at, key=lambda i: (zlib.crc32(f"{seed}:{i}".encode()), i))[:n]

    if starts:
        cuts = [(max(0, i - AROUND), i + AROUND + 1) for i in chosen(starts, most)]
    else:
        digits = chosen([i for i, t in enumerate(tokens) if _DIGIT.search(t)], most - 1)
        anywhere = [seed % len(tokens)] if tokens else []
        cuts = [(max(0, i - CLEAN_TOKENS // 2), i + CLEAN_TOKENS // 2) for i in (digits + anywhere)[:most]]
    out = [Window([t[:SHOWN] for t in tokens[a:b]], states[a:b], whole) for a, b in cuts]
    return [w for w in out if not any(s == 0 and _unsure(t) for t, s in zip(w.tokens, w.states, strict=True))]


_LOW, _UP, _NUM = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


class Maker:
    """Made-up secrets and made-up tokens that are none, from a seeded generator: the same seed gives the same ones.

    Kinds of values: 0 letters and digits, 1 base 64, 2 its form for addresses, 3 hexadecimal, 4 capitals and digits, 5 groups of these,
    6 after a prefix, 7 three parts with dots.
    """

    def __init__(self, seed: int, kinds: tuple[int, ...] = (0, 0, 1, 2, 3, 4, 5, 6, 7)):
        self.rng, self.kinds = random.Random(seed), kinds

    def some(self, chars: str, low: int, high: int) -> str:
        return "".join(self.rng.choices(chars, k=self.rng.randint(low, high)))

    def value(self) -> str:
        pick = self.rng.choice
        while True:
            kind = pick(self.kinds)
            if kind == 0:
                v = self.some(_LOW + _UP + _NUM, 20, 48)
            elif kind == 1:
                v = self.some(_LOW + _UP + _NUM + "+/", 24, 64) + pick(["", "=", "=="])
            elif kind == 2:
                v = self.some(_LOW + _UP + _NUM + "-_", 22, 48)
            elif kind == 3:
                v = self.some("0123456789" + pick(["ABCDEF", "abcdef"]), 24, 64)
            elif kind == 4:
                v = self.some(_UP + _NUM, 16, 32)
            elif kind == 5:
                size = self.rng.randint(4, 6)
                v = "-".join(self.some(_UP + _NUM, size, size) for _ in range(self.rng.randint(4, 6)))
            elif kind == 6:
                v = self.some(_LOW, 2, 5) + pick("_-") + self.some(_LOW + _UP + _NUM, 20, 40)
            else:
                v = ".".join(self.some(_LOW + _UP + _NUM + "-_", 20, 40) for _ in range(3))
            if sum(c in _NUM for c in v) >= 2 and any(c not in _NUM for c in v):
                return v

    def secret(self) -> tuple[list[str], list[int]]:
        """Tokens and their states: a value alone, joined to a name, or some tokens after one."""
        pick = self.rng.choice
        quote = pick(["", "", "\"", "'", "`"])
        value = quote + self.value() + quote + pick(["", "", "", ".", ",", ";"])
        name = pick(["", "", "my_", "X-", "app."]) + pick([self.some(_LOW, 3, 9), self.some(_UP, 3, 8)]) + pick(["", "", "_key", "_id", "Key"])
        style = self.rng.random()
        if style < 0.4:
            return [value], [1]
        if self.rng.random() < 0.3:  # shorter ones after a name only
            value = quote + self.some(_UP, 2, 4) + self.some(_LOW + _UP + _NUM + "!@#%^", 6, 10) + self.some(_NUM, 1, 2) + self.some(_LOW, 1, 3) + quote
        if style < 0.65:
            return [name + pick(["=", ":", "=>", ":="]) + value], [1]
        if style < 0.8:
            return [name, pick(["=", ":", "=>"]), value], [0, 0, 1]
        if style < 0.9:
            return [name + ":", value], [0, 1]
        return [pick(["token", "Password", "secret:", "api_key", "SECRET"]), pick(["is", "=", ":", "was", "->"]), value], [1, 2, 2]

    def other(self) -> list[str]:
        """A date, number, address, name, path or the like; or a word that opens an assignment, before a common word."""
        pick, num = self.rng.choice, lambda low, high: self.some(_NUM, low, high)
        word = lambda low=3, high=9: self.some(_LOW, low, high)
        kind = self.rng.randrange(18)
        one = [
            lambda: f"{num(4, 4)}-{num(2, 2)}-{num(2, 2)}" + pick(["", f"T{num(2, 2)}:{num(2, 2)}:{num(2, 2)}Z"]),
            lambda: f"{num(1, 2)}{pick('/.')}{num(1, 2)}{pick('/.')}{num(4, 4)}",
            lambda: f"{num(3, 3)}-{num(4, 4)}",
            lambda: num(1, 19),
            lambda: ".".join(num(1, 3) for _ in range(4)),
            lambda: f"{word()}.{num(1, 4)}@{word()}{pick(['', num(1, 2)])}.{pick(['com', 'org', 'net'])}",
            lambda: f"{pick(['http', 'https'])}://{pick(['www.', ''])}{word()}.{word(2, 3)}/{word()}/{word()}{num(0, 6)}" + pick(["", ".html", f"?id={num(3, 9)}", f"?{word()}={word()}&p={num(1, 2)}"]),
            lambda: f"v{num(1, 2)}.{num(1, 2)}.{num(1, 2)}",
            lambda: f"${num(1, 3)},{num(3, 3)}.{num(2, 2)}",
            lambda: "".join(word(3, 8).capitalize() for _ in range(self.rng.randint(2, 4))) + pick(["", num(1, 2)]),
            lambda: "_".join(word(2, 8) for _ in range(self.rng.randint(2, 5))) + pick(["", "_" + num(1, 3)]),
            lambda: f"{pick(['IMG', 'DSC', word()])}_{num(4, 8)}.{pick(['jpg', 'png', 'txt', 'py'])}",
            lambda: "/" + "/".join(word() for _ in range(self.rng.randint(2, 4))) + pick(["", f"/{word()}{num(1, 3)}.{word(2, 3)}"]),
            lambda: f"{self.some(_UP, 1, 4)}-{num(1, 5)}",
            lambda: f"{word(1, 8)}={pick([num(1, 6), word(1, 10)])}",
            lambda: f"{word()}{num(1, 4)}",
            lambda: self.some(_UP, 2, 14),
            lambda: word(14, 30),
        ][kind]()
        if self.rng.random() < 0.12:
            return [pick(["token", "password:", "secret", "Secret", "api_key", "passwd"]), pick([word(), "is", "of", "for", "="]), pick([word(), one])]
        return [one + pick(["", "", ".", ",", ")", ";"])]

    def widened(self, w: Window) -> Window:
        """A copy in which every marked run gives way to a made-up secret; without one, a secret or none is put in, and others."""
        tokens, states, i = [], [], 0
        put = set(self.rng.sample(range(len(w.tokens) + 1), min(len(w.tokens) + 1, self.rng.randint(0, 3))))
        secret = self.rng.randrange(len(w.tokens) + 1) if not any(w.states) and self.rng.random() < 0.5 else -1
        while i <= len(w.tokens):
            if i == secret:
                made = self.secret()
                tokens, states = tokens + made[0], states + made[1]
            elif i in put and not (i < len(w.tokens) and w.states[i] == 2):
                made = self.other()
                tokens, states = tokens + made, states + [0] * len(made)
            if i == len(w.tokens):
                break
            if w.states[i]:
                i += 1
                while i < len(w.tokens) and w.states[i] == 2:
                    i += 1
                made = self.secret()
                tokens, states = tokens + made[0], states + made[1]
            else:
                tokens, states, i = [*tokens, w.tokens[i]], [*states, 0], i + 1
        whole = list(w.whole)
        for t in tokens if tokens != w.tokens else []:
            f = shape_features(t)
            whole = [whole[0] + int(f[MIXED]), whole[1] + int(f[OPENER]), whole[2]]
        return Window(tokens, states, whole)


def train(windows: list[Window], maker: Maker | None = None) -> Tagger:
    """From windows of which some have marked tokens; if none has, the tagger tags nothing."""
    if not any(any(w.states) for w in windows):
        first = np.array([0.0, -20.0, -20.0])
        return Tagger(Chain(np.zeros((3 * N_SHAPE + N_FILE, 3)), np.tile(first, (3, 1)), first))
    maker = maker or Maker(1)
    every = [w for w in [*windows, *[maker.widened(w) for w in windows for _ in range(1 + any(w.states))]] if w.tokens]
    lengths = np.array([len(w.tokens) for w in every])
    seen: dict[str, int] = {}
    at = np.array([seen.setdefault(shape(t), len(seen)) for w in every for t in w.tokens])
    rows = np.array([shape_features(t) for t in seen], np.float32)
    total, ends = int(lengths.sum()), np.cumsum(lengths)
    x = np.zeros((total, 3 * N_SHAPE + N_FILE), np.float32)
    x[:, :N_SHAPE] = rows[at]
    inner = np.ones(total, bool)
    inner[ends - lengths] = False
    inner = np.nonzero(inner)[0]
    x[inner, N_SHAPE : 2 * N_SHAPE] = rows[at[inner - 1]]
    x[inner - 1, 2 * N_SHAPE : 3 * N_SHAPE] = rows[at[inner]]
    x[:, 3 * N_SHAPE :] = np.repeat(np.array([file_features(*w.whole) for w in every], np.float32), lengths, 0)
    return Tagger(fit(x, np.array([s for w in every for s in w.states]), lengths, 3, l2=0.3))


def learn_from(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_matched: int = MAX_MATCHED, max_clean: int = MAX_CLEAN, max_windows: int = MAX_WINDOWS) -> Tagger:
    """Fits on the texts themselves: pattern matches are the labels. Texts of any length take part, by windows from all over them."""
    t = pick(docs, doc_id, text).select(F.xxhash64(doc_id, text).alias("h"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    low = F.lower("t")
    near: Column = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api_key") | low.contains("apikey") | F.col("t").contains("AKIA")
    counts = t.agg(F.count_if(near).alias("near"), F.count_if(~near).alias("far")).first()
    # half as many again as wanted come to the driver, whatever the corpus holds, by shares of the hash's range
    place = F.pmod("h", F.lit(1 << 31))
    share = {True: (counts.near, max_matched), False: (counts.far, max_clean)}
    wide = {side: min(1 << 31, math.ceil(1.5 * (most + 20) / max(1, n) * (1 << 31))) for side, (n, most) in share.items()}
    some = t.where((near & (place < wide[True])) | (~near & (place < wide[False]))).select("h", near.alias("near"), "t").dropDuplicates(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, h in enumerate(b.column(0).to_pylist()):
                found = windows_of(b.column(2)[k].as_py(), h % (1 << 31), max_windows)
                told = json.dumps([[w.tokens, w.states, w.whole] for w in found])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), b.column(1).slice(k, 1), pa.array([told], pa.string())], ["h", "near", "windows"])

    rows = sorted((r.h % (1 << 31), r.h, r.windows, r.near) for r in map_batches(some, run, "h bigint, near boolean, windows string").collect())
    chosen = [w for *_, w, side in rows if side][:max_matched] + [w for *_, w, side in rows if not side][:max_clean]
    tagger = train([Window(*w) for told in chosen for w in json.loads(told)])
    trim()
    return tagger


class Scanner:
    """Scans texts; keeps the scores of shapes met, as far as remembered."""

    def __init__(self, tagger: Tagger):
        self.tagger = tagger
        self._forget()

    def _forget(self) -> None:
        self.shapes: dict[str, int] = {}
        self.scores, self.flags = np.zeros((0, 9)), np.zeros((0, 3), bool)

    def _numbers(self, distinct: list[str]) -> np.ndarray:
        """The number of each token's shape; scores (own, before, after) and flags (mixed, opener, hint) of new shapes are added."""
        if len(self.shapes) > REMEMBERED:
            self._forget()
        seen, known = [*map(shape, distinct)], self.shapes
        new = [s for s in dict.fromkeys(seen) if s not in known]
        if new:
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            x = np.array([shape_features(s) for s in new])
            w = self.tagger.chain.weights
            self.scores = np.concatenate([self.scores, np.concatenate([x @ w[k * N_SHAPE : (k + 1) * N_SHAPE] for k in range(3)], 1)])
            self.flags = np.concatenate([self.flags, np.stack([x[:, MIXED] > 0, x[:, OPENER] > 0, [bool(_HINT.search(s)) for s in new]], 1)])
        return np.fromiter(map(known.__getitem__, seen), np.int64, len(seen))

    def scan(self, texts: pa.Array) -> list[list[Span]]:
        distinct, which, lengths = chunks_of(texts, blurred)
        if not len(which):
            return [[] for _ in range(len(texts))]
        of = self._numbers(distinct)[which]
        ends = np.cumsum(lengths)
        doc = np.repeat(np.arange(len(texts)), lengths)
        flags = self.flags[of]
        mixed, openers = (np.bincount(doc, flags[:, k], len(texts)) for k in (MIXED, OPENER))
        # a pattern may begin anywhere in a token, also past what the field is shown
        long = np.array([bool(len(t) > SHOWN and _HINT.search(t)) for t in distinct])
        hinted = np.bincount(doc, flags[:, 2] | long[which], len(texts)) > 0
        whole = np.array([file_features(a, b, n) for a, b, n in zip(mixed, openers, lengths, strict=True)]) @ self.tagger.chain.weights[3 * N_SHAPE :]
        scores = self.scores[of]
        e = scores[:, :3] + whole[doc]
        inner = np.ones(len(of), bool)
        inner[(ends - lengths)[lengths > 0]] = False
        at = np.nonzero(inner)[0]
        e[at] += scores[at - 1, 3:6]
        e[at - 1] += scores[at, 6:]
        state = self.tagger.decode(e, lengths)
        tagged = np.bincount(doc, state > 0, len(texts)) > 0
        out: list[list[Span]] = [[] for _ in range(len(texts))]
        for k in np.nonzero(hinted | tagged)[0].tolist():
            text = texts[k].as_py()
            out[k] = base_spans(text) if hinted[k] else []
            if tagged[k]:
                out[k] = out[k] + _added(text, state[ends[k] - lengths[k] : ends[k]], out[k])
        return out


def _added(text: str, state: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of the tagged runs, without punctuation at their sides; what the base spans leave of them, where that has a letter or digit."""
    places = [m.span() for m in _TOKEN.finditer(text)]
    runs: list[list[int]] = []
    for i in np.nonzero(state)[0].tolist():
        if state[i] == 2 and runs and runs[-1][2] == i - 1:
            runs[-1][1:] = places[i][1], i
        else:
            runs.append([*places[i], i])
    taken, k = merged([(s, e) for _, s, e in base]), 0
    out: list[Span] = []
    for s, e, _ in runs:
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        at, j = s, k
        while j < len(taken) and taken[j][0] < e:
            out.append(("crf", at, taken[j][0]))
            at, j = taken[j][1], j + 1
        out.append(("crf", at, e))
    bare = []
    for kind, s, e in out:
        part = text[s:e] if s < e else ""
        s, e = s + len(part) - len(part.lstrip(_SIDES + " \t\n\r\x0b\x0c")), e - len(part) + len(part.rstrip(_SIDES + " \t\n\r\x0b\x0c"))
        if s < e and any(c.isalnum() for c in text[s:e]):
            bare.append((kind, s, e))
    return bare


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_matched: int = MAX_MATCHED, max_clean: int = MAX_CLEAN, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf), a row for each input row.

    Spans are of whole matches in code points, end exclusive. The field adds spans of kind crf, which overlap no pattern match, and
    takes none away. Null, empty and blank texts have no spans. Without a pattern match in the sample the field adds nothing.
    Repeated rows have equal results; null ids stay null. The same rows give the same spans in any partitioning.
    """
    held = docs.sparkSession.sparkContext.broadcast(learn_from(docs, doc_id, text, max_matched, max_clean, max_windows))
    df = pick(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(held.value)
        for b in batches:
            offsets, _ = buffers_of(b.column(1))
            for i, j in slices(offsets):
                spans = scanner.scan(b.column(1).slice(i, j - i))
                counts = [pa.array([sum(x[0] == kind for x in s) for s in spans], pa.int64()) for kind in KINDS]
                base = pa.array([joined([x for x in s if x[0] != "crf"]) for s in spans], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *counts, base, pa.array([joined(s) for s in spans], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    found = map_batches(df, run, f"doc_id {df.schema[doc_id].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, n_crf bigint, base string, spans string")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_crf")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[secret]", max_matched: int = MAX_MATCHED, max_clean: int = MAX_CLEAN, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """The documents with every span, overlapping ones merged, replaced by the mark. Nulls stay null; no row goes, and all columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(learn_from(docs, doc_id, text, max_matched, max_clean, max_windows))
    plain, (place,) = positional(docs, text)
    names = plain.columns
    at = names.index(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(held.value)
        for b in batches:
            offsets, _ = buffers_of(b.column(at))
            for i, j in slices(offsets):
                part = b.slice(i, j - i)
                found = scanner.scan(part.column(at))
                if any(found):
                    new = [None if (s is None) else _masked(t, f, mark) for s, t, f in zip(part.column(at).to_pylist(), texts_of(part.column(at)), found, strict=True)]
                    part = part.set_column(at, names[at], pa.array(new, part.column(at).type))
                yield part

    return map_batches(plain, run, plain.schema).toDF(*docs.columns)


def _masked(text: str, spans: list[Span], mark: str) -> str:
    out, at = [], 0
    for _, s, e in sorted(spans, key=lambda x: (x[1], x[2])):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])
