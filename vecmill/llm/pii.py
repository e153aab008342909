"""Personal data in text: patterns, and a character-level bidirectional LSTM with a CRF on top.

The patterns give the base spans. The network, written in numpy and trained here from labelled spans, finds data in
spellings that the patterns don't know: it labels each character as none or one of the four kinds. Text is read in
overlapping windows on a fixed grid; emissions of the windows over a character are averaged, nearer centres weighing more,
and one CRF decoding runs over each stretch of joined windows, so that no span depends on a window's edge. What the network
labels has to hold what makes up its kind (so many digits, a checksum, four bytes, an at and a dot), in any spelling. Each
of these holds a digit or an at, so windows without either can't have a span and aren't read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, runs_of_docs

KINDS = ("email", "ip", "card", "phone")
#: Window, distance between windows, and hidden units of a direction.
WINDOW, STEP, HIDDEN = 64, 32, 24
#: Documents that training windows come from, about, and the most windows (documented bounds).
SAMPLE_DOCS, SAMPLE_WINDOWS = 10_000, 3_000
BATCH, STEPS, RATE = 64, 1200, 0.02
#: Windows of either sort that training draws from.
LESSONS = 6_000
#: Least mean probability of a span's label under the CRF.
SURE = 0.6
#: An at: the sign, the word in brackets, or the word before a word and "dot".
_AT = r"@|[\[({<]\s?at\s?[\])}>]|(?<=[A-Za-z0-9] )at(?= [A-Za-z0-9-]{1,40}(?: dot |\s?[\[({<]\s?dot))"
#: A span holds one of these.
TRIGGER = re.compile(rf"[0-9]|{_AT}", re.I)

# ---------------------------------------------------------------- patterns
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMERIC = np.zeros(128, bool)
_NUMERIC[[ord(c) for c in "0123456789 ().+-"]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def numeric_runs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of digits, spaces and the signs of numbers that hold a digit; every number lies inside one."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(code) + 2, np.int8)
    inside[1:-1] = _NUMERIC[np.minimum(code, 127)]
    edge = np.diff(inside)
    a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    digits = np.concatenate([[0], np.cumsum((code >= 48) & (code <= 57))])
    has = digits[z] > digits[a]
    return list(zip(a[has].tolist(), z[has].tolist(), strict=True))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind: leftmost non-overlapping matches of each kind that pass its test."""
    out = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            a = m.start()
            while a > last and text[a - 1] in _LOCAL_CHARS:
                a -= 1
            if a < m.start():
                out.append(("email", a, m.end()))
                last = m.end()
    if re.search("[0-9]", text):
        for a, z in numeric_runs(text):
            run = text[a:z]
            if "." in run:
                out += [("ip", a + m.start(), a + m.end()) for m in _IP.finditer(run) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
            if z - a >= 14:
                out += [("card", a + m.start(), a + m.end()) for m in _CARD.finditer(run) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
            if "+" in run:
                out += [("phone", a + m.start(), a + m.end()) for m in _PHONE.finditer(run) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ---------------------------------------------------------------- the network
LABELS = 1 + len(KINDS)
#: ASCII as it is (controls as space), other letters, anything else.
SYMBOLS = 98


def symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(code < 32, 0, np.where(code < 127, code - 32, np.where((code >= 0xC0) & (code < 0x2000), 96, 97)))
    return out.astype(np.int64)


PAD = 0


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    h = HIDDEN
    out = {}
    for d in "fb":
        out["x" + d] = rng.normal(0, 0.3, (SYMBOLS, 4 * h))
        out["h" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
        out["b" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
    out |= {"o": rng.normal(0, 0.3, (2 * h, LABELS)), "c": np.zeros(LABELS), "t": np.zeros((LABELS, LABELS)), "s": np.zeros(LABELS), "e": np.zeros(LABELS)}
    return {k: v.astype(np.float32) for k, v in out.items()}


def _lstm(p: dict, codes: np.ndarray, keep: bool):
    """Hidden states (time, row, unit), forward units first, of windows (row, time); with ``keep``, what going back needs.

    Both directions run together; the second reads each window from its end.
    """
    n, t = codes.shape
    half = np.concatenate([np.full(3 * HIDDEN, 0.5), np.ones(HIDDEN)]).astype(np.float32)  # a gate is a tanh of half its input
    table = np.stack([p["x" + d] + p["b" + d] for d in "fb"]) * half
    weight = np.stack([p["h" + d] for d in "fb"]) * half
    read = np.stack([codes.T, codes.T[::-1]])
    h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    out = np.empty((t, n, 2 * HIDDEN), np.float32)
    kept = []
    for i in range(t):
        z = h @ weight
        z[0] += table[0, read[0, i]]
        z[1] += table[1, read[1, i]]
        np.tanh(z, out=z)
        z[..., : 3 * HIDDEN] *= 0.5
        z[..., : 3 * HIDDEN] += 0.5
        a, f, o, g = (z[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        before, c = c, f * c + a * g
        tc = np.tanh(c)
        if keep:
            kept.append((z, before, tc, h))
        h = o * tc
        out[i, :, :HIDDEN], out[t - 1 - i, :, HIDDEN:] = h[0], h[1]
    return out, kept


def _lstm_back(p: dict, codes: np.ndarray, kept: list, dout: np.ndarray, grad: dict) -> None:
    n, t = codes.shape
    weight = np.stack([p["h" + d].T for d in "fb"])
    dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    dz = np.empty((t, 2, n, 4 * HIDDEN), np.float32)
    for i in range(t - 1, -1, -1):
        z, before, tc, _ = kept[i]
        a, f, o, g = (z[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        dh[0] += dout[i, :, :HIDDEN]
        dh[1] += dout[t - 1 - i, :, HIDDEN:]
        dc = dc + dh * o * (1 - tc * tc)
        dz[i] = np.concatenate([dc * g * a * (1 - a), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * a * (1 - g * g)], axis=2)
        dc = dc * f
        dh = dz[i] @ weight
    states = np.stack([k[3] for k in kept])
    for d, (name, read) in enumerate((("f", codes.T), ("b", codes.T[::-1]))):
        flat = dz[:, d].reshape(-1, 4 * HIDDEN)
        one = np.zeros((len(flat), SYMBOLS), np.float32)
        one[np.arange(len(flat)), read.ravel()] = 1
        grad["x" + name] = one.T @ flat
        grad["h" + name] = states[:, d].reshape(-1, HIDDEN).T @ flat
        grad["b" + name] = flat.sum(0)


def emissions(p: dict, codes: np.ndarray) -> np.ndarray:
    """Label scores (time, row, label) of windows (row, time)."""
    return _lstm(p, codes, False)[0] @ p["o"] + p["c"]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis)


def marginals(p: dict, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Label probabilities (time, row, label) under the CRF, forward and backward scores, and the log partition of each row."""
    t = len(e)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    alpha[0], beta[-1] = e[0] + p["s"], p["e"]
    for i in range(1, t):
        alpha[i] = e[i] + _lse(alpha[i - 1][:, :, None] + p["t"], 1)
    for i in range(t - 2, -1, -1):
        beta[i] = _lse((beta[i + 1] + e[i + 1])[:, None, :] + p["t"], 2)
    z = _lse(alpha[-1] + p["e"], 1)
    return np.exp(alpha + beta - z[None, :, None]), alpha, beta, z


def gradient(p: dict, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
    """Mean negative log likelihood of the labels (row, time) and its gradient."""
    n, t = codes.shape
    hidden, kept = _lstm(p, codes, True)
    e = hidden @ p["o"] + p["c"]
    prob, alpha, beta, z = marginals(p, e)
    y = labels.T
    rows = np.arange(n)
    gold = p["s"][y[0]] + p["e"][y[-1]] + e[np.arange(t)[:, None], rows, y].sum(0) + p["t"][y[:-1], y[1:]].sum(0)
    one = np.eye(LABELS, dtype=np.float32)
    de = (prob - one[y]) / n
    grad = {"s": de[0].sum(0), "e": (prob[-1] - one[y[-1]]).sum(0) / n}
    pair = np.exp(alpha[:-1, :, :, None] + p["t"] + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None]).sum((0, 1))
    np.subtract.at(pair, (y[:-1].ravel(), y[1:].ravel()), 1)
    grad |= {"t": (pair / n).astype(np.float32), "o": np.einsum("tnh,tnl->hl", hidden, de), "c": de.sum((0, 1))}
    dh = de @ p["o"].T
    _lstm_back(p, codes, kept, dh, grad)
    return float((z - gold).mean()), grad


def viterbi(p: dict, e: np.ndarray) -> np.ndarray:
    """Best labels of one sequence of scores (time, label)."""
    score, back = e[0] + p["s"], []
    for x in e[1:]:
        total = score[:, None] + p["t"]
        back.append(total.argmax(0))
        score = total.max(0) + x
    out = [int((score + p["e"]).argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return np.array(out[::-1])


# ---------------------------------------------------------------- what makes up a kind
_DOT = re.compile(r"\.|dot", re.I)
_ADDRESS = re.compile(rf"[A-Za-z0-9][^\s@]*\s?(?:{_AT})\s?[A-Za-z0-9][^\s@]*(?:\s(?:[\[({{<]?dot[\])}}>]?|\.)\s[A-Za-z0-9]+|(?:\.|\W?dot\W?)[A-Za-z0-9-]+)(?:\s(?:[\[({{<]?dot[\])}}>]?)\s[A-Za-z0-9]+)*", re.I)


def plausible(kind: str, s: str) -> bool:
    """Whether a string holds what the kind is made of; how it is spelled is for the network to judge."""
    if kind == "email":
        return bool(_ADDRESS.fullmatch(s))
    groups, gaps = re.findall("[0-9]+", s), re.split("[0-9]+", s)
    inner, d = gaps[1:-1], "".join(groups)
    if kind == "ip":
        dots = bool(inner) and len(set(inner)) == 1 and bool(_DOT.search(inner[0])) and len(inner[0]) <= 5
        return len(groups) == 4 and dots and all(len(g) <= 3 and int(g) <= 255 for g in groups) and not any(gaps[:1] + gaps[-1:])
    if any(len(g) > 3 or any(map(str.isalnum, g)) or "\n" in g for g in inner):
        return False
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    four = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and len(set(inner)) == 1
    return 10 <= len(d) <= 15 and not four and (len(groups) > 1 or s[:1] in "+(" or d[:2] == "00")


# ---------------------------------------------------------------- labelled spans
Window = tuple[str, list[tuple[str, int, int]]]


class Inventor:
    """Data in many spellings, numbers that are none, and filler."""

    def __init__(self, rng: np.random.Generator):
        self.rng = rng

    def pick(self, xs):
        return xs[int(self.rng.integers(len(xs)))]

    def digits(self, k: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, k)))

    def word(self) -> str:
        return "".join(self.rng.choice(list("etaoinshrdlucmfwypvbgkáéñöü"), int(self.rng.integers(2, 10))))

    def name(self) -> str:
        return re.sub("[^a-z]", "x", self.word())

    def card(self) -> str:
        body = self.pick("3456") + self.digits(int(self.rng.integers(12, 17)))
        number = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        sep = self.pick(["", " ", "-", ".", "/", "_", ":", " - ", "  ", "\u2013", "\u00b7", "|", ","])
        cuts = self.pick([(4, 8, 12, 16), (4, 10), (6, 12), (5, 10, 15)])
        return sep.join(number[a:b] for a, b in zip((0, *cuts), (*cuts, len(number)), strict=True) if a < len(number))

    def phone(self) -> str:
        start = self.pick(["+{2}", "+{1}", "+{3}", "00{2}", "({3})", "({4})", "{3}", "{4}", "0{3}", "+{2} (0)", "+{2}(0){2}", "+{1} ({3})"])
        start = re.sub(r"\{(\d)\}", lambda m: self.digits(int(m[1])), start)
        sep = self.pick([" ", "-", ".", "/", " - ", "\u2013", " / ", "  ", "_", "\u00b7"])
        room = 10 + int(self.rng.integers(0, 4)) - len(_digits(start))
        parts = []
        while room > 0:
            n = min(room, int(self.rng.integers(2, 5)) if self.rng.random() < 0.8 else room)
            n = room if room - n == 1 else n
            parts.append(self.digits(n))
            room -= n
        return self.pick([sep, " ", ""] if start[-1] == ")" else [sep]).join([start, sep.join(parts)])

    def ip(self) -> str:
        return self.pick([".", "[.]", "(.)", " . ", ". ", "{.}", "[dot]", " dot ", "(dot)", "<.>", "\\."]).join(str(int(x)) for x in self.rng.integers(0, 256, 4))

    def email(self) -> str:
        n = self.name
        user = self.pick([f"{n()}.{n()}", n(), f"{n()}{self.digits(2)}", f"{n()}_{n()}", f"{n()[0]}.{n()}", f"{n()}-{n()}"])
        at = self.pick(["@", " @ ", "@ ", " @", "[at]", "(at)", "{at}", "<at>", " [at] ", " (at) ", " at ", " (@) ", "[@]", " { at } "])
        dot = self.pick([".", "."] if at.strip() not in ("at",) else [" dot "]) if self.rng.random() < 0.6 else self.pick([" dot ", "[dot]", "(dot)", " [dot] ", " (dot) ", "{dot}", " . "] if at != " at " else [" dot ", " [dot] "])
        host = dot.join([n(), self.pick(["com", "org", "net", "de", "io", "fr", "edu"])] if self.rng.random() < 0.8 else [n(), "co", "uk"])
        out = f"{user}{at}{host}"
        return out.upper() if self.rng.random() < 0.15 else out

    def none(self) -> str:
        hexes = lambda k: "".join(self.rng.choice(list("0123456789abcdef"), k))
        d, w, n = self.digits, self.word, int(self.rng.integers(1, 9))
        wrong = next(x for x in iter(lambda: d(16), None) if not luhn(x))
        choices = [d(n), f"{d(4)}-{d(2)}-{d(2)}", f"{d(4)}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}", hexes(40), hexes(32), f"version {d(1)}.{d(1)}.{d(1)}", f"@{w()}", f"{d(2)}:{d(2)}", f"{wrong}$$$", wrong, f"{d(3)}.{d(2)}", f'token = "{hexes(32)}"', f"({d(4)})", d(int(self.rng.integers(20, 30))), f"{d(1)},{d(3)},{d(3)}", f"#{d(6)}", f"{w()} at {w()} {w()}", f"{w()} dot {w()}", f"{d(3)}-{d(4)}", f"{d(1)}.{d(2)}.{d(4)}", f"{w()} @ {d(3)}", f"{d(4)} {d(2)} {d(2)}", f"page {d(3)}, {d(3)}", f"{d(5)}%"]
        return self.pick(choices)

    def data(self) -> tuple[str, str]:
        """A kind and a string that holds what makes it up."""
        while True:
            kind = self.pick(KINDS)
            item = getattr(self, kind)()
            if plausible(kind, item):
                return kind, item


def invented(rng: np.random.Generator, n: int) -> list[Window]:
    """Windows of filler with labelled data in many spellings, and with numbers that are none."""
    make, out = Inventor(rng), []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW + 20:
            filler = " ".join(make.word() for _ in range(int(rng.integers(0, 6))))
            text += make.pick(["", "", " ", "\n", ", ", ": "]) + (filler.upper() if rng.random() < 0.1 else filler) + make.pick([" ", " ", "\n", ": ", " ("])
            if rng.random() < 0.35:
                text += make.none()
            else:
                kind, item = make.data()
                spans.append((kind, len(text), len(text) + len(item)))
                text += item
        cut = int(rng.integers(0, len(text) - WINDOW + 1))
        out.append(cropped(text, spans, cut))
    return out


def cropped(text: str, spans: list[tuple[str, int, int]], cut: int) -> Window:
    return text[cut : cut + WINDOW], [(k, max(0, a - cut), min(WINDOW, z - cut)) for k, a, z in spans if z > cut and a < cut + WINDOW]


def undecided(text: str, spans: list[tuple[str, int, int]]) -> bool:
    """Whether something outside the spans could be data that the patterns don't know: such a text teaches nothing."""
    for _, a, z in spans:
        text = text[:a] + "\n" * (z - a) + text[z:]
    if re.search(rf"[A-Za-z0-9]\s?(?:{_AT})\s?[A-Za-z0-9]", text, re.I):
        return True
    for run in re.findall(r"[+(]?[0-9](?:[^A-Za-z\n]{0,3}[0-9]|dot[0-9])*", text):
        places = [m.span() for m in re.finditer("[0-9]+", run)]
        if any(plausible(k, run[a[0] : z[1]]) for i, a in enumerate(places) for z in places[i : i + 8] for k in KINDS[1:]) or plausible("phone", run):
            return True
    return False


def windows_of(text: str, plain: bool = False) -> list[Window]:
    """Windows around the signs of data in a whole text, with the base spans as labels; windows that are undecided are left out.

    ``plain`` adds one at any place, so that training sees text without signs too.
    """
    out, after = [], 0
    spans = base_spans(text)
    anywhere = [zlib.crc32(text.encode("utf-8", "replace")) % max(1, len(text) - WINDOW)] if plain else []
    for at in sorted([*anywhere, *(m.start() for m in TRIGGER.finditer(text))]):
        if at < after:
            continue
        a = max(0, at - WINDOW // 3)
        after = a + WINDOW
        wide = max(0, a - WINDOW)
        if not undecided(text[wide : after + WINDOW], [(k, max(s, wide) - wide, e - wide) for k, s, e in spans if e > wide and s < after + WINDOW]):
            out.append(cropped(text, spans, a))
    return out


def planted(make: Inventor, window: Window) -> Window:
    """A window with data in some spelling written into it at a space outside its spans, if there is one."""
    text, spans = window
    spaces = [m.end() for m in re.finditer(r"\s", text) if not any(a - 1 <= m.start() <= z for _, a, z in spans)]
    if not spaces:
        return window
    at = make.pick(spaces)
    kind, item = make.data()
    item_and_end = item + make.pick([" ", " ", ". ", ", ", "\n"])
    moved = [(k, a + len(item_and_end) * (a >= at), z + len(item_and_end) * (a >= at)) for k, a, z in spans]
    whole = text[:at] + item_and_end + text[at:]
    inside = int(make.rng.integers(0, max(1, len(whole) - WINDOW + 1)))
    return cropped(whole, sorted([*moved, (kind, at, at + len(item))], key=lambda s: s[1]), inside)


def as_arrays(windows: list[tuple[str, list[tuple[str, int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    codes, labels = np.full((len(windows), WINDOW), PAD), np.zeros((len(windows), WINDOW), np.int64)
    for i, (text, spans) in enumerate(windows):
        codes[i, : len(text)] = symbols(text)
        for kind, a, z in reversed(spans):
            labels[i, a:z] = 1 + KINDS.index(kind)
    return codes, labels


def fit(windows: list[Window], steps: int = STEPS, seed: int = 23) -> dict[str, np.ndarray]:
    """Train by Adam on invented windows and, where there are any, as many corpus windows, three in four of which have data planted."""
    rng = np.random.default_rng(seed)
    make = Inventor(rng)
    made = invented(rng, LESSONS)
    real = [planted(make, windows[i % len(windows)]) if i % 4 else windows[i % len(windows)] for i in range(LESSONS)] if windows else []
    own, more = as_arrays(real), as_arrays(made)
    p = initial(rng)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        half = BATCH // 2 if len(real) else 0
        a, b = rng.integers(0, max(1, len(real)), half), rng.integers(0, len(made), BATCH - half)
        _, grad = gradient(p, np.concatenate([own[0][a], more[0][b]]), np.concatenate([own[1][a], more[1][b]]))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = RATE * min(1, 5 / (norm + 1e-9)) * 0.5 * (1 + np.cos(np.pi * step / steps))
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    """Fit on windows of a bounded sample of the documents, chosen by a hash of the text, labelled by the patterns."""
    rows = max(1, docs.count())
    share = int(min(1.0, SAMPLE_DOCS / rows) * (1 << 40))
    sample = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) < share)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [w for t in batch.column("text").to_pylist() for w in windows_of(t, plain=True)]
            spans = pa.array([[{"k": k, "a": a, "z": z} for k, a, z in s] for _, s in found], pa.list_(pa.struct([("k", pa.string()), ("a", pa.int32()), ("z", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), spans], ["text", "spans"])

    found = sample.mapInArrow(cut, "text string, spans array<struct<k:string,a:int,z:int>>").orderBy(F.xxhash64("text"), "text").limit(SAMPLE_WINDOWS).collect()
    return _fitted(tuple((r["text"], tuple(tuple(s) for s in r["spans"])) for r in found))


@lru_cache(2)
def _fitted(windows: tuple) -> dict[str, np.ndarray]:
    """One training for one sample: a session that asks again gets the same network."""
    return fit([(t, list(s)) for t, s in windows])


# ---------------------------------------------------------------- decoding
_WEIGHT = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def _trim(text: str, a: int, z: int) -> tuple[int, int]:
    while a < z and not (text[a].isalnum() or text[a] in "+(" and a + 1 < z and text[a + 1].isdigit()):
        a += 1
    while z > a and not text[z - 1].isalnum():
        z -= 1
    return a, z


def learned_spans(texts: list[str], p: dict, bases: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """Spans that the network adds to each text; none overlaps a base span."""
    jobs, codes = [], []  # (text, window starts)
    for i, text in enumerate(texts):
        grid = {g for m in TRIGGER.finditer(text) for g in range(max(0, (m.start() - WINDOW + STEP) // STEP), m.start() // STEP + 1)}
        if grid:
            sym = symbols(text)
            starts = sorted(g * STEP for g in grid if g * STEP < len(text))
            jobs.append((i, len(text), starts))
            for s in starts:
                row = np.full(WINDOW, PAD)
                row[: len(sym) - s] = sym[s : s + WINDOW]
                codes.append(row)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not jobs:
        return out
    codes = np.array(codes)
    scores = np.concatenate([emissions(p, codes[k : k + 4096]).transpose(1, 0, 2) for k in range(0, len(codes), 4096)])
    at = 0
    for i, size, starts in jobs:
        begin = 0
        while begin < len(starts):  # a stretch of joined windows
            end = begin + 1
            while end < len(starts) and starts[end] <= starts[end - 1] + WINDOW - 1:
                end += 1
            lo, hi = starts[begin], min(size, starts[end - 1] + WINDOW)
            e, w = np.zeros((hi - lo, LABELS), np.float32), np.zeros(hi - lo, np.float32)
            for k in range(begin, end):
                a = starts[k] - lo
                n = min(WINDOW, hi - lo - a)
                e[a : a + n] += scores[at + k, :n] * _WEIGHT[:n, None]
                w[a : a + n] += _WEIGHT[:n]
            e /= w[:, None]
            if (e[:, 1:].max(1) > e[:, 0]).any():
                labels = viterbi(p, e)
                if labels.any():
                    out[i] += _spans(texts[i], lo, labels, marginals(p, e[:, None, :])[0][:, 0], bases[i])
            begin = end
        at += len(starts)
    return out


def _spans(text: str, lo: int, labels: np.ndarray, prob: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    out = []
    cut = np.flatnonzero(np.diff(np.concatenate([[-1], labels, [-1]])))
    for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if not labels[a] or prob[a:z, labels[a]].mean() < SURE:
            continue
        kind = KINDS[labels[a] - 1]
        s, e = _trim(text, lo + a, lo + z)
        # a span that goes on in the text is no span of its own
        if s == e or (s and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum()):
            continue
        if plausible(kind, text[s:e]) and not any(b < e and s < c for _, b, c in base):
            out.append((kind, s, e))
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def find(docs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every whole text.

    The counts and base_sha256 are of the base spans; ``spans`` holds these and the learned ones (n_added), by start and
    kind, as kind:start:end in code points. A null or empty text has none. Repeated rows and repeated or null doc_ids
    give a row each; an empty table gives no rows; other columns don't matter.
    """
    model = model or train(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base, added = found(texts, sent.value)
            counts = [[sum(s[0] == k for s in b) for b in base] for k in KINDS]
            sha = [hashlib.sha256(written(b).encode()).hexdigest() for b in base]
            spans = [written(sorted(b + x, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))) for b, x in zip(base, added, strict=True)]
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array([len(x) for x in added], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    return id_and_text(docs).mapInArrow(run, ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in names))


def found(texts: list[str], model: dict) -> tuple[list[list[tuple[str, int, int]]], list[list[tuple[str, int, int]]]]:
    """Base and added spans of each text."""
    base = [base_spans(t) for t in texts]
    added: list[list[tuple[str, int, int]]] = []
    for a, b in runs_of_docs(np.array([len(t) for t in texts], np.int64), 2_000_000):
        added += learned_spans(texts[a:b], model, base[a:b])
    return base, added


def masked(docs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``docs``, all columns, with each span's text replaced by its kind in angle brackets; of overlapping spans the union is replaced.

    Null and empty texts stay as they are; repeated rows and repeated or null doc_ids give a row each; an empty table gives
    no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    k = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(k).to_pylist()
            base, added = found([t or "" for t in texts], sent.value)
            out = []
            for text, b, x in zip(texts, base, added, strict=True):
                parts, last = [], 0
                for kind, a, z in sorted(b + x, key=lambda s: (s[1], KINDS.index(s[0]), s[2])):
                    if z <= last:
                        continue
                    if a >= last:
                        parts += [text[last:a], f"<{kind}>"]
                    last = z
                out.append("".join([*parts, text[last:]]) if parts else text)
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.column(k).type) if i == k else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
