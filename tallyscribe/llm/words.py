"""Words and shingles of many texts at once, as 64-bit numbers, in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes of text to take apart at a time: the arrays below need about 50 bytes for each.
SLICE = 1 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Strings are polynomials in ``BASE`` modulo this prime. Modulo a power of two, whole families of strings would meet.
PRIME = (1 << 61) - 1
BASE = 0x0851F42D4C957F2D
#: So many products of a byte and half a power add up without a carry out of 64 bits.
ADDENDS = 1 << 22

_PRIME = np.uint64(PRIME)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (one to one)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo the prime."""
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, from halves of 31 bits."""
    half, low = np.uint64(31), np.uint64((1 << 31) - 1)
    x1, x0, y1, y0 = x >> half, x & low, y >> half, y & low
    middle = x1 * y0 + x0 * y1
    middle = (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << half)
    return reduced(np.uint64(2) * x1 * y1 + middle + x0 * y0)


def joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """``high * 2^32 + low`` modulo the prime, for ``high`` below 2^61."""
    return reduced((high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32)) + reduced(low))


def powers(n: int, base: int = BASE) -> np.ndarray:
    """At least ``n`` powers of ``base`` modulo the prime."""
    if len(_POWERS.get(base, ())) < n:
        out = np.ones(1, np.uint64)
        while len(out) < max(n, 1024):
            out = np.concatenate([out, times(out, np.full(len(out), pow(base, len(out), PRIME), np.uint64))])
        _POWERS[base] = out
    return _POWERS[base]


def halves(letters: np.ndarray, power: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of bytes (plus one) with the upper and the lower 32 bits of powers."""
    letters = letters.astype(np.uint64) + np.uint64(1)
    return letters * (power >> np.uint64(32)), letters * (power & np.uint64((1 << 32) - 1))


def _long(letters: np.ndarray) -> np.uint64:
    """The polynomial of one word of any length, ``ADDENDS`` letters at a time."""
    total, power = 0, powers(len(letters))[: len(letters)]
    for a in range(0, len(letters), ADDENDS):
        high, low = halves(letters[a : a + ADDENDS], power[a : a + ADDENDS])
        total += int(joined(high.sum().reshape(1), low.sum().reshape(1))[0])
    return np.uint64(total % PRIME)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a run of texts (A-Z lower-cased unless ``fold`` is off).

    ``code``: 64-bit number of each word; ``doc``: the index of its text; ``start``, ``size``: its bytes in ``raw``.
    """

    def __init__(self, raw: np.ndarray, starts: np.ndarray, fold: bool = True):
        inside = _IS_WORD[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = starts[:-1][starts[:-1] < len(raw)]
        first[cuts] = inside[cuts]
        self.raw, self.n_docs = raw, len(starts) - 1
        self.start = np.flatnonzero(first)
        letters = raw[inside]
        if fold:
            letters = _FOLD[letters]
        before = np.cumsum(inside, dtype=np.int64) - inside
        at = before[self.start]
        self.size = np.diff(np.append(at, len(letters)))
        if len(at):
            place = np.arange(len(letters)) - np.repeat(at, self.size)
            high, low = halves(letters, powers(int(self.size.max()))[place])
            value = joined(*(np.add.reduceat(x, at) for x in (high, low)))
            for word in np.flatnonzero(self.size > ADDENDS):
                value[word] = _long(letters[at[word] : at[word] + self.size[word]])
            self.code = mix(value + self.size.astype(np.uint64) * _STEP)
        else:
            self.code = np.zeros(0, np.uint64)
        self.doc = np.searchsorted(starts, self.start, side="right") - 1
        #: Where the words of each text begin, with the end.
        self.bounds = np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def tail(self, n: int = 2) -> np.ndarray:
        """The last ``n`` bytes of each word as a number."""
        out = np.zeros(len(self.start), np.uint64)
        end = self.start + self.size
        for k in range(1, n + 1):
            out = out * np.uint64(257) + np.where(self.size >= k, _FOLD[self.raw[end - np.minimum(k, self.size)]].astype(np.uint64) + np.uint64(1), np.uint64(0))
        return out


def shingle_sets(words: Words, length: int) -> list[np.ndarray]:
    """Per text the sorted distinct numbers of its runs of ``length`` words; with fewer words, of all it has as one."""
    code = words.code
    runs = len(code) - length + 1
    grams = np.zeros(max(runs, 0), np.uint64)
    for k in range(length):
        if runs > 0:
            grams = mix(grams * np.uint64(31) + code[k : k + runs] + np.uint64(k + 1))
    out = []
    for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        n = b - a
        if n >= length:
            out.append(np.unique(grams[a : b - length + 1]))
        elif n:
            whole = np.zeros(1, np.uint64)
            for k in range(n):
                whole = mix(whole * np.uint64(37) + code[a + k : a + k + 1] + np.uint64(k + 1))
            out.append(mix(whole + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
