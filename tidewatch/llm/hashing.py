"""64-bit hashes of words, many at once."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
#: Bytes hashed at once (cut at white space), and the longest word that is hashed with others.
CHUNK, LONGEST = 1 << 16, 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.RandomState(1).randint(0, 2**63, size=256, dtype=np.int64).astype(np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base % 2**64, dtype=np.uint64))])


_UP, _DOWN = _powers(_BASE, 1 << 12), _powers(pow(_BASE, -1, 2**64), 1 << 12)


def _grow(n: int) -> None:
    global _UP, _DOWN
    if n > len(_UP):
        n = 1 << (n - 1).bit_length()
        _UP, _DOWN = _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)


def _hash_chunk(b: np.ndarray) -> np.ndarray:
    gap = _SPACE[b]
    turn = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        turn = np.concatenate([np.zeros(1, turn.dtype), turn])
    if not gap[-1]:
        turn = np.append(turn, len(b))
    return spans(b, turn[::2], turn[1::2])


def spans(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes: a polynomial in its bytes, whatever its place."""
    _grow(len(b))
    upto = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_TABLE[b] * _UP[:len(b)], out=upto[1:])
    return mix((upto[end] - upto[start]) * _DOWN[start] + (end - start).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word of a text, in order."""
    raw = (text or "").encode("utf-8")
    if not raw:
        return np.zeros(0, dtype=np.uint64)
    b = np.frombuffer(raw, dtype=np.uint8)
    if len(b) <= CHUNK:
        return _hash_chunk(b)
    out, at = [], 0
    while at < len(b):
        to = min(len(b), at + CHUNK)
        while to < len(b) and not _SPACE[b[to]]:  # to the end of a word
            ahead = np.flatnonzero(_SPACE[b[to:to + CHUNK]])
            to = to + int(ahead[0]) if len(ahead) else min(len(b), to + CHUNK)
        gap = _SPACE[b[at:to]]
        last = at + int(np.flatnonzero(gap)[-1]) + 1 if to - at > LONGEST and gap.any() else at
        if to - last > LONGEST:  # the word that ends the chunk; those before it are hashed as anywhere else
            if last > at:
                out.append(_hash_chunk(b[at:last]))
            out.append(np.array([xxhash.xxh64_intdigest(raw[last:to])], dtype=np.uint64))
        else:
            out.append(_hash_chunk(b[at:to]))
        at = to
    return np.concatenate(out)
