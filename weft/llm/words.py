"""Words of many texts at once, as arrays: the shared kernel of the text operators.

A word is a run of a-z and 0-9 in the lower-case text. Each word becomes a 64-bit hash by prefix sums
over the bytes of a block of texts, so the cost per byte is a few vector operations and no Python
object is made per word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: What a transcriber put between the words of a speech: anything in square or round brackets.
BRACKETED = re.compile(r"\[[^\]]*\]|\([^)]*\)")
#: A word broken by a hyphen at a line end.
BROKEN = re.compile(r"(?<=[a-z0-9])[-‐¬­][^\S\n]*\r?\n\s*(?=[a-z0-9])")

_IS_WORD = np.zeros(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    _IS_WORD[_c] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are hashed at once.
BLOCK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def spoken(text: str) -> str:
    """text in lower case without bracketed parts, broken words joined."""
    low = text.lower()
    if "[" in low or "(" in low:
        low = BRACKETED.sub(" ", low)
    return BROKEN.sub("", low) if "\n" in low else low


WORD = re.compile("[a-z0-9]+")


def pieces(text: str, overlap: int, size: int = 1 << 22) -> list[str]:
    """A very long text in parts cut between words; the last `overlap` words of a part begin the next."""
    out, at, reach = [], 0, size
    while len(text) - at > reach:
        stop = at + reach
        while stop < len(text) and text[stop].isalnum():
            stop += 1
        words = [m.start() for m in WORD.finditer(text, max(at, stop - 64 * (overlap + 1)), stop)]
        if len(words) <= overlap + 1:
            words = [m.start() for m in WORD.finditer(text, at, stop)]
        if len(words) <= overlap + 1:  # too few words to overlap by: a longer part
            reach += size
            continue
        out.append(text[at:stop])
        at, reach = words[-overlap] if overlap else stop, size
    out.append(text[at:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_of(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


@dataclass
class Words:
    """Words of a block: hash, number of the text, and place in the bytes of the block."""

    hash: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    raw: bytes

    def joined(self, at: int, n: int) -> str:
        """n words from number `at` on, with one blank between them."""
        return " ".join(self.raw[s:e].decode("ascii") for s, e in zip(self.start[at : at + n].tolist(), self.end[at : at + n].tolist(), strict=True))


def _hashed(raw: bytes, ends: np.ndarray) -> Words:
    buf = np.frombuffer(raw, np.uint8)
    is_word = _IS_WORD[buf]
    edge = np.diff(is_word.astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    value = buf.astype(np.uint64)
    value[~is_word] = 0
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(value * _powers_of(_BASE, len(buf)), out=total[1:])
    h = mixed((total[end] - total[start]) * _powers_of(_INVERSE, len(buf) + 1)[start] + (end - start).astype(np.uint64))
    return Words(h, np.searchsorted(ends, start, "right"), start, end, raw)


def blocks(texts: list[str], size: int = BLOCK) -> Iterator[tuple[int, int, Words]]:
    """(first, last + 1, words) of consecutive texts; Words.text counts from first. No text is split."""
    first, held, filled = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "replace") + b"\n"
        held.append(raw)
        filled += len(raw)
        if filled >= size:
            yield first, i + 1, _hashed(b"".join(held), np.cumsum([len(x) for x in held]))
            first, held, filled = i + 1, [], 0
    if held:
        yield first, len(texts), _hashed(b"".join(held), np.cumsum([len(x) for x in held]))


def word_hashes(words: list[str]) -> np.ndarray:
    """The hash that blocks() gives each of these words."""
    out = np.zeros(len(words), np.uint64)
    for i, w in enumerate(words):
        total = sum(b * pow(_BASE, j, 1 << 64) for j, b in enumerate(w.encode())) & ((1 << 64) - 1)
        out[i] = (total + len(w)) & ((1 << 64) - 1)
    return mixed(out)


def shingles(w: Words, n: int) -> np.ndarray:
    """A hash of each n consecutive words; the largest value where they are not of one text."""
    count = len(w.hash) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x100000001B3) + w.hash[j : j + count]
    out = mixed(out)
    out[w.text[:count] != w.text[n - 1 :]] = np.iinfo(np.uint64).max
    return out


def sliding_minimum(x: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each n consecutive values."""
    width, out = 1, x
    while width < n:
        step = min(width, n - width)
        out = np.minimum(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        width += step
    return out
