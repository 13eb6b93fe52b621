"""Operator 3: secret scan by patterns and a linear-chain conditional random field.

One narrow pass over the whole texts, without a shuffle.  Three fixed patterns
give the base spans.  A conditional random field over the tags O, B (secret
begins) and I (inside) reads every token of every line: words, runs of key
characters, and each punctuation mark for itself.  No token is ruled out beforehand.

Features, all discrete: the token's shape (kinds of characters, length, changes of
kind, how unusual its letter pairs are), the marks next to it, the hashes of the two words
before and the one after, the token before, and of the whole file the density of
digits and of programming marks.  They are computed for a batch at once.

Decoding is Viterbi, exactly: a token whose lead of O over B and I exceeds all that
its neighbours' transitions can win back is O on every best path, so the chain falls
into segments there, and only those are searched.

Training is by maximum likelihood on a bounded sample of the texts
(``sample_docs``; those with base spans are sixteen times as likely).  Its
lines are used as they are, the values of base spans being secrets; key-like runs outside them
are left out, as they may be secrets that no pattern knows; then each with a
generated key planted, after a word for secrets or with that word masked, so
that the field learns shapes and surroundings apart; and with generated harmless codes
(dates, versions, paths, identifiers, numbers), so that it leaves those alone.

Defined cases: null text counts as empty and has no span; an empty table gives
no row; repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.llm._common import SPACE, mix, powers, slices, spread, text_buffers, trim

# The base patterns and the order of kinds.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")

#: Texts of the training sample, lines of each, and tokens of a training chain.
SAMPLE_DOCS, SAMPLE_LINES, CHAIN = 500, 3, 32
_KEYWORDS = ("password", "passwd", "secret", "token", "api")
_LIKELY = r"[0-9a-f]{32}|AKIA[A-Z0-9]{12}|(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
O, B, I = 0, 1, 2  # noqa: E741


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` of the base patterns, sorted."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def secret_values(text: str) -> list[tuple[int, int]]:
    """The secrets within the base spans: of an assignment only its value."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    return out + [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 16] + [m.span() for m in HEX.finditer(text)]


# -- tokens and features -----------------------------------------------------------------
_CORE = np.zeros(256, bool)
_CORE[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_SOLID = _CORE.copy()
_SOLID[[43, 47]] = True  # + and / belong to keys and paths
_LINK = np.zeros(256, bool)
_LINK[[45, 46]] = True  # - and . only between solid characters
#: Kind of a byte: 0 lower, 1 upper, 2 digit, 3 beyond ASCII, 4 underscore, 5 link, 6 other
_KIND = np.full(256, 6, np.uint8)
for _kind, _bytes in enumerate((range(97, 123), range(65, 91), range(48, 58), range(128, 256), (95,), (43, 45, 46, 47))):
    _KIND[list(_bytes)] = _kind
_HEXLIKE = np.zeros(256, bool)
_HEXLIKE[[*range(48, 58), *range(97, 103), *range(65, 71)]] = True
_CODE_MARK = np.zeros(256, bool)
_CODE_MARK[[ord(c) for c in "{}();=<>[]"]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LENGTHS = np.array([1, 2, 3, 4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 40, 64])
_WORDS = 4096
#: Entries per feature: shape, length and kind, changes, pairs, hex, mark before, mark after, words before and after, token before, file.
SIZES = (192, 64, 64, 128, 32, 400, 400, _WORDS, _WORDS, _WORDS, 128, 64)


class Tokens:
    """The tokens of a slice of texts: byte ranges, lines and discrete features."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, surprise: np.ndarray, file_code: np.ndarray | None = None) -> None:
        n = len(buf)
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        solid = _SOLID[buf]
        left, right = np.append(False, solid[:-1]), np.append(solid[1:], False)
        inside = solid | (_LINK[buf] & left & right & ~edge[:n] & ~edge[1:])
        start = ~SPACE[buf]
        start[1:] &= ~(inside[1:] & inside[:-1] & ~edge[1:n])
        self.start = np.flatnonzero(start)
        m = len(self.start)
        end = ~SPACE[buf]
        end[:-1] &= ~(inside[1:] & inside[:-1] & ~edge[1:n])
        self.end = np.flatnonzero(end) + 1
        self.doc = np.searchsorted(off, self.start, side="right") - 1
        breaks = np.cumsum((buf == 10) | edge[:n]) if n else np.empty(0, np.int64)
        self.line = breaks[self.start] if m else np.empty(0, np.int64)
        self.x = np.zeros((m, len(SIZES)), np.int32)
        if m:
            self._features(buf, off, surprise, file_code)

    def _features(self, buf: np.ndarray, off: np.ndarray, surprise: np.ndarray, file_code: np.ndarray | None) -> None:
        s, e, x, n = self.start, self.end, self.x, len(buf)
        size = e - s
        length = np.searchsorted(_LENGTHS, size, side="right")
        coarse = np.minimum(length // 4, 3)
        kind = _KIND[buf]
        count = []
        for k in range(7):
            total = np.zeros(n + 1, np.int32)
            np.cumsum(kind == k, out=total[1:])
            count.append(total[e] - total[s])
        mark = (size == 1) & (count[6] == 1)
        bits = sum((c > 0).astype(np.int32) << k for k, c in enumerate(count[:6]))
        x[:, 0] = np.where(mark, 64 + np.minimum(buf[s], 127), bits)
        letters, digits = count[0] + count[1] + count[3], count[2]
        what = np.where(mark, 0, np.where(digits == 0, 1, np.where(letters == 0, 2, 3)))
        x[:, 1] = length * 4 + what
        change = np.zeros(n + 1, np.int32)
        np.cumsum(np.append(False, kind[1:] != kind[:-1]), out=change[1:])
        turns = change[e] - change[s + 1]
        x[:, 2] = (np.minimum(turns * 8 // size, 7) * 4 + coarse) * 2 + (digits > 0)
        pair = np.zeros(n + 1, np.float64)
        np.cumsum(np.append(0.0, surprise[buf[:-1].astype(np.int64) << 8 | buf[1:]]), out=pair[1:])
        odd = (pair[e] - pair[s + 1]) / np.maximum(size - 1, 1)
        x[:, 3] = np.clip((odd * 2).astype(np.int32), 0, 31) * 4 + coarse
        hexes = np.zeros(n + 1, np.int32)
        np.cumsum(_HEXLIKE[buf], out=hexes[1:])
        x[:, 4] = np.where(hexes[e] - hexes[s] == size, 16 + length, length)
        new_line = np.append(True, self.line[1:] != self.line[:-1])
        last = np.append(new_line[1:], True)
        m = len(s)
        before = np.maximum(np.arange(m) - 1, 0)
        after = np.minimum(np.arange(m) + 1, m - 1)
        code = np.where(mark, np.minimum(buf[s], 127).astype(np.int32), 128 + what)
        x[:, 5] = np.where(new_line, 399, code[before] + np.where(e[before] == s, 0, 132))
        x[:, 6] = np.where(last, 399, code[after] + np.where(s[after] == e, 0, 132))
        # a word's name is the hash of what follows its last underscore, in lower case
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_LOWER[buf] * up[:n], out=total[1:])
        under = np.maximum.accumulate(np.where(kind == 4, np.arange(1, n + 1), 0))
        tail = np.maximum(s, under[np.maximum(e - 2, s)])
        name = (mix((total[e] - total[tail]) * down[tail]) % np.uint64(_WORDS - 1)).astype(np.int32) + 1
        word = np.flatnonzero(~mark)
        latest = np.searchsorted(word, np.arange(m)) - 1  # the last word before each token
        for k, col in ((0, 7), (1, 8)):
            w = word[np.maximum(latest - k, 0)] if len(word) else np.zeros(m, np.int64)
            x[:, col] = np.where((latest - k >= 0) & (self.line[w] == self.line), name[w], 0)
        nxt = np.searchsorted(word, np.arange(m), side="right")
        w = word[np.minimum(nxt, len(word) - 1)] if len(word) else np.zeros(m, np.int64)
        x[:, 9] = np.where((nxt < len(word)) & (self.line[w] == self.line), name[w], 0)
        x[:, 10] = np.where(new_line, 127, what[before] * 16 + length[before])
        if file_code is None:
            file_code = file_codes(buf, off)
        x[:, 11] = file_code[self.doc] * 4 + what


def _keylike(start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Runs of ten characters or more that mix letters and digits, or change case often, without a link."""
    n, size = len(kind), end - start
    total = np.zeros((4, n + 1), np.int32)
    for row, flag in zip(total, (kind <= 1, kind == 2, kind == 5, np.append(False, kind[1:] != kind[:-1])[:n])):
        np.cumsum(flag, out=row[1:])
    letters, digits, links = (r[end] - r[start] for r in total[:3])
    turns = total[3][end] - total[3][np.minimum(start + 1, n)]
    return (size >= 10) & (links == 0) & (letters > 0) & ((digits > 0) | (turns >= 4))


def file_codes(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Per text: how dense digits and programming marks are, four steps each."""
    out, size = [], np.maximum(np.diff(off), 1)
    for mark in (_KIND[buf] == 2, _CODE_MARK[buf]):
        total = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(mark, out=total[1:])
        out.append(np.searchsorted([2, 10, 50], 1000 * np.diff(total[off]) // size, side="right"))
    return (out[0] * 4 + out[1]).astype(np.int32)


def pair_surprise(buf: np.ndarray) -> np.ndarray:
    """Surprise in nats of each pair of bytes, from the pairs of ``buf``."""
    count = np.bincount(buf[:-1].astype(np.int64) << 8 | buf[1:], minlength=1 << 16).reshape(256, 256) + 0.05
    return -np.log(count / count.sum(axis=1, keepdims=True)).ravel()


# -- the field ------------------------------------------------------------------------------
class Crf:
    """Weights ``emit[feature][entry, tag]`` and ``move[from, to]``; lines begin and end in O; O to I is barred."""

    def __init__(self, emit: list[np.ndarray], move: np.ndarray, surprise: np.ndarray) -> None:
        self.emit, self.move, self.surprise = emit, move, surprise
        free = move[move > -1e8]
        self.reach = float(free.max() - free.min())

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sum((w[x[:, k]] for k, w in enumerate(self.emit)), np.zeros((len(x), 3)))

    def decode(self, e: np.ndarray, line: np.ndarray) -> np.ndarray:
        """The best tag of each token (Viterbi per line), from emission scores."""
        n = len(e)
        tags = np.zeros(n, np.int8)
        if not n:
            return tags
        follow = np.append(np.where(line[1:] == line[:-1], np.maximum(0.0, e[1:, I] - e[1:, B]), 0.0), 0.0)
        sure = e[:, O] - np.maximum(e[:, B], e[:, I]) > 3 * self.reach + follow
        rest = np.flatnonzero(~sure)
        if not len(rest):
            return tags
        first = np.flatnonzero(np.append(True, (np.diff(rest) > 1) | (line[rest[1:]] != line[rest[:-1]])))
        size = np.diff(np.append(first, len(rest)))
        for length in np.unique(size).tolist():
            start = rest[first[size == length]]
            back = np.zeros((length, len(start), 3), np.int8)
            score = self.move[O] + e[start]
            for t in range(1, length):
                step = score[:, :, None] + self.move
                back[t] = step.argmax(axis=1)
                score = step.max(axis=1) + e[start + t]
            now = (score + self.move[:, O]).argmax(axis=1)
            for t in range(length - 1, -1, -1):
                tags[start + t] = now
                if t:
                    now = back[t, np.arange(len(start)), now]
        return tags


def fit_crf(chains: list[tuple[np.ndarray, np.ndarray]], surprise: np.ndarray, rounds: int = 50, rate: float = 0.3, penalty: float = 1e-6) -> Crf:
    """Maximum likelihood by full-batch gradients; chains are padded with certain O tokens to few lengths."""
    first = np.cumsum([0, *SIZES])
    weight, move = np.zeros((first[-1], 3)), np.zeros((3, 3))
    allowed = np.ones((3, 3))
    allowed[O, I] = 0.0
    order = sorted(range(len(chains)), key=lambda k: len(chains[k][1]))
    chains = [chains[k] for k in order]
    x = np.concatenate([np.zeros((0, len(SIZES)), np.int64), *(c[0] + first[:-1] for c in chains)])
    gold = np.eye(3)[np.concatenate([np.zeros(0, np.int64), *(c[1] for c in chains)]).astype(np.int64)]
    size = np.array([len(c[1]) for c in chains], np.int64)
    start = np.cumsum(np.append(0, size))
    blocks, a = [], 0  # of chains of nearly one length: the places of their tokens, -1 where padded
    while a < len(chains):
        z = int(np.searchsorted(size, size[a] + size[a] // 4, side="right"))
        place = start[a:z, None] + np.arange(size[z - 1])
        blocks.append(np.where(place < start[a + 1 : z + 1, None], place, -1))
        a = z
    n, state = max(1, len(x)), [(np.zeros_like(p), np.zeros_like(p)) for p in (weight, move)]
    for step in range(1, rounds + 1):
        e = weight[x].sum(axis=1)
        e = np.exp(e - e.max(axis=1, keepdims=True, initial=-np.inf)) if len(e) else e
        e = np.concatenate([e, [[1.0, 0.0, 0.0]]])  # the last row pads
        m = np.exp(move) * allowed
        p, g_move = np.zeros((len(x) + 1, 3)), np.zeros((3, 3))
        for place in blocks:
            f, length = e[place], place.shape[1]
            y = np.concatenate([gold, [[1.0, 0.0, 0.0]]])[place]
            alpha, beta, scale = np.empty_like(f), np.empty_like(f), np.empty(f.shape[:2])
            now = np.broadcast_to(m[O], f[:, 0].shape)
            for t in range(length):
                now = (now if t == 0 else now @ m) * f[:, t]
                scale[:, t] = now.sum(axis=1)
                alpha[:, t] = now = now / scale[:, t, None]
            now = np.broadcast_to(m[:, O], f[:, 0].shape)
            for t in range(length - 1, -1, -1):
                beta[:, t] = now
                now = (f[:, t] * now) @ m.T / scale[:, t, None]
            both = alpha * beta
            z = both.sum(axis=2, keepdims=True)
            both /= z
            p[place] = both
            if length > 1:
                pair = np.einsum("sti,stj->ij", alpha[:, :-1] / (scale[:, 1:, None] * z[:, 1:]), f[:, 1:] * beta[:, 1:]) * m
                g_move += np.einsum("sti,stj->ij", y[:, :-1], y[:, 1:]) - pair
            g_move[O] += (y[:, 0] - both[:, 0]).sum(axis=0)
            g_move[:, O] += (y[:, -1] - both[:, -1]).sum(axis=0)
        gap = gold - p[:-1]
        flat = x.ravel()
        g = np.stack([np.bincount(flat, weights=np.repeat(gap[:, tag], x.shape[1]), minlength=len(weight)) for tag in range(3)], axis=1)
        for v, d, (u, w) in zip((weight, move), (g / n - penalty * weight, g_move / n - penalty * move), state):
            u += 0.1 * (d - u)
            w += 0.01 * (d * d - w)
            v += rate * (u / (1 - 0.9**step)) / (np.sqrt(w / (1 - 0.99**step)) + 1e-8)
    move[O, I] = -1e9
    return Crf(np.split(weight, first[1:-1]), move, surprise)


# -- training text ------------------------------------------------------------------------------
# Words that announce a secret, words that announce a harmless code.
ANNOUNCE = "password passwd pwd pass secret token key apikey api_key client_key access_key private_key secret_key auth_token credential credentials auth bearer authorization passphrase login pin license signature".split()
HARMLESS = "version date file page order number phone price id item year see from the model chapter about at of in".split()
_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
_SYMBOLS = "!@#$%&*?^"
_MIXED = re.compile(r"(?=[^\W\d]*\d)(?=\d*[^\W\d])\w{10}")


def _key(r: random.Random, short: bool) -> str:
    """A generated secret: a random key of some alphabet and length, perhaps with a prefix, padding or symbols."""
    if short and r.random() < 0.3:
        core = [r.choice(_ALPHABETS[4]) for _ in range(r.randint(6, 14))]
        for _ in range(r.randint(1, 3)):
            core.insert(r.randint(1, len(core)), r.choice(_SYMBOLS))
        return "".join(core)
    alphabet = r.choice(_ALPHABETS)
    value = "".join(r.choice(alphabet) for _ in range(r.randint(10, 24) if short else r.choice((20, 24, 28, 32, 36, 40, 48, 64))))
    if r.random() < 0.15:
        value = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 4))) + r.choice(("_", "-", "_live_", ".")) + value
    return value + r.choice(("=", "==")) if "+" in alphabet and r.random() < 0.5 else value


def _planted(r: random.Random) -> tuple[str, str, str]:
    """``(before, secret, after)``: a generated key, after a word for secrets or (one in four) with that word masked."""
    if r.random() < 0.25:
        quote = r.choice(("", "", '"', "'"))
        return r.choice(("", "", "= ", ": ", "(", "<")) + quote, _key(r, False), quote
    word = r.choice(ANNOUNCE)
    word = r.choice((word, word, word.upper(), word.capitalize()))
    if r.random() < 0.2:
        word = r.choice(("my", "client", "app", "db", "user", "service")) + r.choice(("_", "-", " ")) + word
    quote = r.choice(("", "", '"', "'"))
    joint = r.choice((" = ", "=", ": ", ":", " is ", " was ", " ", " -> ", " := ", '": "', " => "))
    return word + joint + quote, _key(r, r.random() < 0.6), quote


def _decoy(r: random.Random, words: list[str]) -> str:
    """Harmless text that looks like a code."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: r.choice(words)
    h = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    return r.choice(
        (
            lambda: d(r.randint(1, 19)),
            lambda: f"{d(4)}-{d(2)}-{d(2)}",
            lambda: f"{d(4)}-{d(2)}-{d(2)}T{d(2)}:{d(2)}:{d(2)}Z",
            lambda: f"{d(2)}/{d(2)}/{d(4)} {d(2)}:{d(2)}",
            lambda: f"v{d(1)}.{d(2)}.{d(1)}" + r.choice(("", "-beta", "-rc1", f"+{d(3)}")),
            lambda: f"{d(3)}.{d(2)}.{d(1)}.{d(3)}",
            lambda: f"+{d(2)} {d(3)} {d(7)}",
            lambda: f"({d(3)}) {d(3)}-{d(4)}",
            lambda: f"{w()}.{w()}{d(2)}@{w()}.{r.choice(('com', 'org', 'net'))}",
            lambda: f"https://www.{w()}.com/{w()}/{w()}-{d(5)}.html",
            lambda: f"/{w()}/{w()}/{w()}.{r.choice(('txt', 'py', 'pdf', 'tar.gz'))}",
            lambda: "_".join(w() for _ in range(r.randint(2, 4))) + r.choice(("", d(2))),
            lambda: "-".join(w() for _ in range(r.randint(2, 5))),
            lambda: w().lower() + "".join(w().capitalize() for _ in range(r.randint(1, 4))) + r.choice(("", "()", d(1))),
            lambda: f"{h(8)}-{h(4)}-{h(4)}-{h(4)}-{h(12)}",
            lambda: "#" + h(6),
            lambda: h(r.randint(5, 8)),
            lambda: f"{w()[:2].upper()}-{d(r.randint(2, 6))}",
            lambda: f"ISBN {d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
            lambda: w().upper() + " " + w().upper(),
            lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}",
            lambda: f"{d(2)},{d(3)}.{d(2)} %",
            lambda: w() + r.choice(("=", ": ", '="')) + w(),
            lambda: f"{w()}.{d(2)}@{w()}{d(1)}.{w()}.{r.choice(('com', 'org', 'net'))}",
            lambda: w() + r.choice("#$%&*!?-=.") * r.randint(1, 5),
            lambda: r.choice("#$%&*!?-=_.") * r.randint(2, 40),
            lambda: f"{w()}/{w()}/{w()}/{w()}/{w().capitalize()}.{r.choice(('java', 'md', 'html', 'json'))}",
        )
    )()


def training_chains(lines: list[tuple[str, int]], seed: int = 7) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Chains ``(features, tags)`` of sample lines ``(text, file code)`` and of the same with keys and decoys planted; and the pair table."""
    r = random.Random(seed)
    words = sorted({w for text, _ in lines for w in re.findall(r"[^\W\d_]{2,12}", text)}) or ["word"]
    texts: list[tuple[str, list[tuple[int, int]], int]] = []
    for text, code in lines:
        texts.append((text, secret_values(text), code))
        plain = [w for w in text.split() if not _MIXED.search(w)]
        at = r.randrange(len(plain) + 1)
        head, tail = " ".join(plain[max(0, at - 5) : at]), " ".join(plain[at : at + 5])
        joint = lambda a, b: a + " " + b if a and b else a + b
        before, secret, after = _planted(r)
        whole = joint(head, before)
        texts.append((joint(whole + secret + after, tail), [*secret_values(head), (len(whole), len(whole) + len(secret)), *((a + len(whole + secret + after) + 1, b + len(whole + secret + after) + 1) for a, b in secret_values(tail))], r.choice((code, r.randrange(16)))))
        for _ in range(2):
            lead = r.choice((*HARMLESS, *words[:50], r.choice(ANNOUNCE), "", ""))
            whole = joint(joint(head, lead + r.choice(("", "", ":", " is", " =")) if lead and lead not in ANNOUNCE else lead), joint(_decoy(r, words), tail))
            texts.append((whole, secret_values(whole), r.choice((code, r.randrange(16)))))
    raw = [t.encode() for t, _, _ in texts]
    surprise = pair_surprise(np.frombuffer(b"\n".join(x.encode() for x, _ in lines), np.uint8)) if lines else np.zeros(1 << 16)
    chains = []
    off = np.cumsum([0, *map(len, raw)])
    tokens = Tokens(np.frombuffer(b"".join(raw), np.uint8), off, surprise, np.array([c for _, _, c in texts], np.int32))
    edge = np.searchsorted(tokens.doc, np.arange(len(texts) + 1))
    unsure = _keylike(tokens.start, tokens.end, _KIND[np.frombuffer(b"".join(raw), np.uint8)]) & np.repeat(np.arange(len(texts)) % 4 == 0, np.diff(edge))
    for k, (text, spans, _) in enumerate(texts):
        a, b = edge[k], edge[k + 1]
        place = {s: (len(text[:s].encode()), len(text[:e].encode())) for s, e in spans}
        tags = np.zeros(b - a, np.int64)
        for s, e in place.values():
            hit = np.flatnonzero((tokens.start[a:b] - off[k] < e) & (tokens.end[a:b] - off[k] > s))
            tags[hit] = I
            tags[hit[:1]] = B
        unsure[a:b] &= tags == O
        i = 0
        while i < len(tags):
            if unsure[a + i]:
                i += 1
                continue
            j = min(i + CHAIN, len(tags))
            j = i + int(np.append(np.flatnonzero(unsure[a + i : a + j]), j - i)[0])
            while j < len(tags) and j > i + 1 and tags[j] == I:
                j -= 1
            if tags[i] != I:  # never begins inside a secret
                chains.append((tokens.x[a + i : a + j], tags[i:j]))
            i = j
    return chains, surprise


def sample_pieces(text: str, n: int) -> list[str]:
    """Up to ``n`` stretches of lines of a text: around base spans first, then around digits, then any."""
    r, out = random.Random(len(text)), []
    lines = [x for x in text.split("\n") if x.strip()]
    r.shuffle(lines)
    for rank, places in enumerate((secret_values, lambda x: [m.span() for m in re.finditer(r"\d", x)], lambda x: [(0, 0)])):
        for line in lines if len(out) < n else ():
            if found := places(line):
                at = r.choice(found)[0] if rank < 2 else r.randrange(len(line))
                out.append(line[max(0, at - 80) : at + 120])
                if len(out) >= n - (rank == 1):
                    break
    return out[:n]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Crf:
    """Fit the field on ``sample_lines`` stretches of lines (those with base spans first, then those with digits) of each of ``sample_docs`` texts."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, codes = [], []
            buf, off = text_buffers(batch.column(0))
            for cell, code in zip(batch.column(0), file_codes(buf, off).tolist()):
                text = cell.as_py()
                for piece in sample_pieces(text, sample_lines):
                    out.append(piece)
                    codes.append(code)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(codes, pa.int32())], names=["line", "code"])

    h = F.shiftrightunsigned(F.xxhash64(F.col("doc_id")), 1)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null and text <> ''")
    # a bound on the hash lets 4 to 64 times the sample through, so little is ordered at any size
    bound = min(1.0, 4 * sample_docs / max(1, rows.count())) * float(1 << 63)
    rows = rows.withColumn("h", F.when(F.col("text").rlike(_LIKELY), F.shiftrightunsigned(h, 4)).otherwise(h))
    chosen = rows.where(F.col("h") <= bound).orderBy("h", F.xxhash64("text")).limit(sample_docs).select("text")
    got = sorted((r.line, r.code) for r in chosen.mapInArrow(extract, "line string, code int").collect())
    return fit_crf(*training_chains(got))


# -- scanning ---------------------------------------------------------------------------------------
def field_spans(column: pa.Array, crf: Crf) -> list[list[tuple[int, int]]]:
    """Spans that the field tags in each text, in code points."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(column))]
    buf, off = text_buffers(column)
    for i, j in slices(off, 1 << 18):
        part, edges = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        t = Tokens(part, edges, crf.surprise)
        tags = crf.decode(crf.scores(t.x), t.line)
        begin = np.flatnonzero(tags == B)
        if not len(begin):
            continue
        stop = np.flatnonzero((tags != O) & (np.append(tags[1:], O) != I))
        letter = np.append(0, np.cumsum((part & 0xC0) != 0x80))
        for a, b in zip(begin.tolist(), stop[np.searchsorted(stop, begin)].tolist()):
            d = int(t.doc[a])
            first = letter[edges[d]]
            out[i + d].append((int(letter[t.start[a]] - first), int(letter[t.end[b]] - first)))
    return out


def merged(base: list[tuple[int, int, int]], field: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and those of the field that overlap none of them, by start and kind."""
    starts, reach = [s for s, _, _ in base], []
    for _, e, _ in base:
        reach.append(max(e, reach[-1] if reach else e))
    free = [(s, e, 3) for s, e in field if (k := bisect_left(starts, e)) == 0 or reach[k - 1] <= s]
    return sorted(base + free, key=lambda s: (s[0], s[2]))


def scan(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """Spans of every text: ``(doc_id, spans array<struct<kind, start, end>>)``; offsets in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(crf or train(docs))
    shape = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            field = field_spans(batch.column(1), model)
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in merged(base_spans(cell.as_py() or ""), more)] for cell, more in zip(batch.column(1), field)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(shape))], names=["doc_id", "spans"])
        trim()

    rows = spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the hash of the base spans and all spans as text, from the rows of :func:`scan`."""
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *map(count, KINDS[:3]),
        F.sha2(text(F.filter("spans", lambda x: x["kind"] != "crf")), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        count("crf"),
    )
