"""Word, shingle and content hashes of whole texts: 64 bits each, the same in every process."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Moduli and bases of the hashes of spans. Neither modulus is a power of two: modulo 2^64, any odd base maps long words
#: of few letters to one number.
_MODULI = (np.uint64(2**31 - 1), np.uint64(2**31 - 19))
_BASES = (1_403_580_817, 774_236_119)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word ``[^\\x20\\x09-\\x0D]+`` of the bytes."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    """The first n powers of the base, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    size, step = 1, base
    while size < n:
        part = out[size : 2 * size]
        part[:] = out[: len(part)] * np.uint64(step) % np.uint64(modulus)
        size, step = 2 * size, step * step % modulus
    return out


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_KEPT = 1 << 18


def _power_tables(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse; only short tables are kept."""
    if k not in _tables or len(_tables[k][0]) < n:
        size, modulus = max(n, _KEPT), int(_MODULI[k])
        made = tuple(_powers(b, modulus, size) for b in (_BASES[k], pow(_BASES[k], -1, modulus)))
        if n > _KEPT:
            return made
        _tables[k] = made
    return _tables[k]


def content_hashes(values: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Function (starts, ends) -> hash of the values between: two polynomials modulo two primes, 62 bits together."""
    parts = []
    for k, modulus in enumerate(_MODULI):
        up, down = _power_tables(k, len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        if values.dtype == np.uint8 and len(values) < 1 << 24:  # no sum can reach 2^64
            np.cumsum((values + np.uint64(1)) * up[: len(values)], out=sums[1:])
        else:
            np.cumsum((values % modulus + np.uint64(1)) * up[: len(values)] % modulus, out=sums[1:])
        parts.append((sums, down, modulus))

    def between(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        first, second = ((sums[ends] - sums[starts]) % modulus * down[starts] % modulus for sums, down, modulus in parts)
        return mixed(((first << np.uint64(31)) | second) + (ends - starts).astype(np.uint64) * _ODD)

    return between


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every span of the bytes."""
    return content_hashes(raw)(starts, ends)


def gram_hashes(text: bytes, n: int) -> np.ndarray:
    """A hash of every n bytes in a row, at least 8: made of 8 bytes at a time, the last ones overlapping."""
    if len(text) < n:
        return np.zeros(0, np.uint64)
    eight = np.empty(len(text) - 7, np.uint64)
    for k in range(min(8, len(eight))):
        eight[k::8] = np.frombuffer(text, "<u8", (len(text) - k) // 8, k)
    out = np.zeros(len(text) - n + 1, np.uint64)
    for at in [*range(0, n - 8, 8), n - 8]:
        out = (out ^ eight[at : at + len(out)]) * _ODD
        out ^= out >> np.uint64(29)
    return mixed(out)


def word_hashes(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    return span_hashes(raw, *word_bounds(raw))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n words in a row; with fewer words, none."""
    if len(words) < n:
        return words[:0]
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = out * _ODD + words[i : len(words) - n + 1 + i]
        out ^= out >> np.uint64(29)
    return mixed(out)


def shingle_set(text: bytes, n: int = 5) -> np.ndarray:
    """The distinct shingles of n words, A-Z in lower case, sorted; of a shorter text its whole sequence."""
    words = word_hashes(text.lower())
    return np.unique(window_hashes(words, min(n, len(words)))) if len(words) else words
