"""64-bit hashes over numpy arrays: mixing, rolling polynomials, words and word shingles."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
#: Longest text piece that one table of powers serves.
PIECE = 1 << 20
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # any odd numbers
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x = x * U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def powers(n: int, base: int = BASES[0]) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    size = 1 << max(12, (n - 1).bit_length())
    if (size, base) not in _POWERS:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, U)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _POWERS[size, base] = tuple(both)
    up, down = _POWERS[size, base]
    return up[:n], down[:n]


def prefix(raw: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """P with P[j] - P[i] = base**i * polynomial of raw[i:j]."""
    out = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * powers(len(raw), base)[0], out=out[1:])
    return out


def spans(p: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Hashes of raw[start:end], equal for equal content at any place."""
    return mix((p[end] - p[start]) * powers(len(p), base)[1][start] + (end - start).astype(U))


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash for each maximal run of bytes that are not white space."""
    if len(raw) > PIECE:
        parts, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + PIECE)
            while end < len(raw) and end > at and raw[end] not in b" \t\n\v\f\r":
                end -= 1
            if end == at:  # one word over a piece long
                found = min((i for c in b" \t\n\v\f\r" if (i := raw.find(bytes([c]), at)) >= 0), default=len(raw))
                parts.append(np.frombuffer(hashlib.blake2b(raw[at:found], digest_size=8).digest(), U))
                end = found
            else:
                parts.append(word_hashes(raw[at:end]))
            at = end + (end < len(raw))
        return np.concatenate(parts)
    codes = np.frombuffer(raw, np.uint8)
    inside = np.concatenate(([False], ~_SPACE[codes], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return spans(prefix(codes), edges[::2], edges[1::2])


def shingles(raw: bytes, width: int = 5) -> np.ndarray:
    """A hash for each window of `width` words; one for the whole of a shorter text; none without words."""
    words = word_hashes(raw)
    width = min(width, len(words))
    if not width:
        return words
    out = np.zeros(len(words) - width + 1, U)
    for i in range(width):
        out = mix(out + words[i : i + len(out)] * U(2 * i + 1))
    return out
