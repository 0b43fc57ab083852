"""Words and word shingles of many texts at once, as 64-bit hashes.

A text is lower-cased in A-Z and cut at the six ASCII space characters
(space, tab, line feed, vertical tab, form feed, carriage return), so UTF-8
bytes can be scanned directly.  A word under eight bytes is its own 64-bit
hash (its bytes and its length, spread by a bijection), so two of them never
coincide; a longer word's hash is BLAKE2b of its bytes, cut to 64 bits.  Runs
of words are hashed by doubling: the hash of 2k words mixes those of their two
halves, so no arrangement of words cancels out as it can in a polynomial.
Different runs of words share a hash with a chance of 2**-64.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)  # masks of a word's first k bytes
_LEFT, _SALT = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
#: Words that a process remembers, and the longest of them in bytes; beyond the number it starts anew.
REMEMBERED, LONGEST = 200_000, 48


class _Hashes(dict):
    """Word to hash; a word that is not there is hashed, and kept if it is short."""

    def __missing__(self, word: bytes) -> int:
        out = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = out
        return out


_hashes = _Hashes()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (public-domain murmur finaliser)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def lowered(texts: list[bytes | None]) -> bytes:
    """The texts in lower case, each followed by a space."""
    return b" ".join([*(t or b"" for t in texts), b""]).translate(_LOWER)


def words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word, offsets in bytes of its own text, and
    ``first``: words first[i]:first[i+1] belong to texts[i]; None has none."""
    sizes = np.fromiter((len(t or b"") for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    if not texts or not begins[-1]:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(texts) + 1, np.int64)
    body = lowered(texts)
    padded = body + bytes(8)
    data = np.frombuffer(body, np.uint8)
    edge = np.diff(np.concatenate([[True], _IS_SPACE[data], [True]]).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = end - start
    short = size < 8
    value = np.empty(len(start), np.uint64)
    eight = np.ndarray(len(body), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    few = size[short]
    value[short] = mix(eight[start[short]] & _FIRST[few] | few.astype(np.uint64) << _U(56))
    spans = zip(start[~short].tolist(), end[~short].tolist(), strict=True)
    value[~short] = np.fromiter((_hashes[body[a:b]] for a, b in spans), np.uint64, len(start) - len(few))
    first = np.searchsorted(start, begins)
    of = np.repeat(begins[:-1], np.diff(first))
    return value, start - of, end - of, first


def shingles(value: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hash of the ``size`` words that begin at each word (of the whole array;
    the last size-1 have none); other salts give independent hashes."""
    n = len(value) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, width, whole, held = mix(value + _SALT * _U(2 * salt + 1)), 1, None, 0
    while True:
        if size & width:
            if whole is None:
                whole = level
            else:
                part = level[held:]
                whole = mix(whole[: len(part)] * _LEFT + part + _U(held))
            held += width
        if held == size:
            return mix(whole[:n] + _U(size))
        level = mix(level[:-width] * _LEFT + level[width:])
        width *= 2


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes in ascending order.  A text of fewer
    words has its whole sequence as one shingle; a text without words has none."""
    value, _, _, first = words(texts)
    full, out = shingles(value, size), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        else:
            out.append(shingles(value[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def code_points(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(points, begins): byte b of texts[i] is at code point points[begins[i] + b] - points[begins[i]]."""
    begins = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]), begins
