"""Splitting text into the pre-tokens of byte-level BPE, with array operations over many documents.

The result is that of ``public_tokenizers.PATTERN``: contractions, then runs of letters, of numbers or of other
characters, each with one space before it at most, then white space, whose last character goes on its own before a
following word unless it is the space that the word takes.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import regex

OTHER, LETTER, NUMBER, SPACE = range(4)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and random 64-bit value of each code point."""
    kinds = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = (x + 0x800 * (x >= 0xD800) for x in m.span())
            kinds[a:b] = kind
            if a < 0xD800 < b:
                kinds[0xD800:0xE000] = OTHER
    return kinds, np.random.default_rng(17).integers(1, 2**63, 0x110000, dtype=np.uint64) | np.uint64(1)


@cache
def powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, 0xD6E8FEB86659FD93, np.uint64))


def split(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """All texts joined; their code points; the start of each pre-token; for each text, its first pre-token (one more at the end)."""
    joined = "".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    begin = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    if not n:
        return joined, code, np.zeros(0, np.int64), np.zeros(len(begin), np.int64)
    kind = tables()[0][code]
    edge = np.zeros(n + 1, bool)  # a text starts here
    edge[begin] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    # a word after white space: the last white-space character is a token, or the word's own first character
    words = np.flatnonzero(start[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~edge[1:n]) + 1
    start |= edge[:n]
    start[words - 1] = True
    start[words[code[words - 1] == 32]] = False
    # contractions
    at = np.flatnonzero((code == 39) & start)
    if len(at):
        room = np.searchsorted(begin, at, "right")
        left = begin[np.minimum(room, len(begin) - 1)] - at
        c1 = code[np.minimum(at + 1, n - 1)]
        c2 = code[np.minimum(at + 2, n - 1)]
        two = (left > 1) & np.isin(c1, [ord(c) for c in "stmd"])
        three = (left > 2) & (((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l")))
        for mask, length in ((two, 2), (three, 3)):
            a = at[mask]
            start[a + 1] = False
            after = a + length
            start[after[after < n]] = True
    first = np.flatnonzero(start)
    return joined, code, first, np.searchsorted(first, begin)


def distinct(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pre-tokens, the number of the distinct one at each place, and each text's first place (one more at the end).

    Equality is decided by a 64-bit hash and then checked on the characters.
    """
    joined, code, first, of_text = split(texts)
    if not len(first):
        return [], np.zeros(0, np.int64), of_text
    length = np.diff(np.append(first, len(code)))
    place = np.arange(len(code)) - np.repeat(first, length)
    key = np.add.reduceat(tables()[1][code] * powers(1 << int(length.max()).bit_length())[place], first)
    key ^= key >> np.uint64(31)
    _, where, number = np.unique(key, return_index=True, return_inverse=True)
    rep = first[where]
    same = (length[where][number] == length).all() and (code == code[np.minimum(np.repeat(rep[number], length) + place, len(code) - 1)]).all()
    if not same:  # two pre-tokens with one hash: number them by their text
        names: dict[str, int] = {}
        ends = (first + length).tolist()
        number = np.array([names.setdefault(joined[a:b], len(names)) for a, b in zip(first.tolist(), ends, strict=True)])
        return list(names), number, of_text
    return [joined[a:b] for a, b in zip(rep.tolist(), (rep + length[where]).tolist(), strict=True)], number, of_text
