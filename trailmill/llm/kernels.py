"""Words and shingles of many texts at once, as arrays of 64-bit hashes.

Everything works on UTF-8 bytes: the word classes used here hold all bytes over
127, so they are the same on bytes as on characters. A word's hash is a
polynomial over a random table of its bytes; a shingle's hash is mixed from the
hashes of its words. Two different shingles of two documents of n and m words
are taken for equal with a chance of about n * m / 2^64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes worked on at a time; a longer text is one piece.
PIECE = 1_000_000
U = np.uint64


def _word_bytes(separators: Iterable[int]) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words without ASCII white space.
SPACED = _word_bytes([0x20, *range(0x09, 0x0E)])
#: Words of ASCII letters and digits and everything over 127.
PLAIN = _word_bytes(
    [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
)

_random = np.random.Generator(np.random.PCG64(20240229))
BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
BYTE[65:91] = BYTE[97:123]  # A-Z count as a-z
PLACE = _random.integers(1, 1 << 63, 16, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for at least ``size`` places."""
    size = 1 << (size - 1).bit_length()
    if size not in _powers:
        _powers.clear()
        ones = np.full((2, size), [[BASE], [BASE_INVERSE]], np.uint64)
        ones[:, 0] = 1
        _powers[size] = tuple(np.cumprod(ones, axis=1, dtype=np.uint64))
    return _powers[size]


@dataclass
class Words:
    """Word hashes of some texts, text after text."""

    first: int  # index of the first text
    counts: np.ndarray  # words of each text
    hashes: np.ndarray
    prefixes: dict[int, np.ndarray]  # by bytes: hashes of how long words begin, word by word

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.counts)


def pieces(texts: list[str | None], size: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """Encoded texts in runs of about ``size`` bytes, with the index of each first."""
    first, run, held = 0, [], 0
    for k, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass") if text else b""
        if run and held + len(data) > size:
            yield first, run
            first, run, held = k, [], 0
        run.append(data)
        held += len(data) + 1
    if run:
        yield first, run


def words(
    texts: list[str | None], table: np.ndarray = SPACED, prefixes: tuple[int, ...] = ()
) -> Iterator[Words]:
    """Hashes of all words; of their first bytes too, 0 for words that are shorter."""
    for first, run in pieces(texts):
        data = np.frombuffer(b"\n" + b"\n".join(run) + b"\n", np.uint8)
        inside = table[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        starts, ends = edges[0::2], edges[1::2]
        power, inverse = _power(len(data))
        total = np.cumsum(BYTE[data] * power[: len(data)], dtype=np.uint64)
        value = (total[ends - 1] - total[starts - 1]) * inverse[starts]
        after = np.cumsum([len(x) + 1 for x in run]) + 1  # where the next text starts
        upto = np.searchsorted(starts, after)
        begun = {}
        for size in prefixes:
            last = np.minimum(starts + size, ends) - 1
            part = mix((total[last] - total[starts - 1]) * inverse[starts] + U(size << 32))
            begun[size] = np.where(ends - starts >= size, part, U(0))
        hashes = mix(value + (ends - starts).astype(np.uint64))
        yield Words(first, np.diff(upto, prepend=0), hashes, begun)


def shingles(found: Words, k: int = 5, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and the text (from 0) of each.

    With ``whole``, a text of 1 to k - 1 words is one shingle. Hashes stand in
    the order of the texts.
    """
    h, counts = found.hashes, found.counts
    text = np.repeat(np.arange(len(counts)), counts)
    if len(h) < k:
        full = np.zeros(0, np.uint64)
        owner = np.zeros(0, np.int64)
    else:
        n = len(h) - k + 1
        value = np.zeros(n, np.uint64)
        for j in range(k):
            value += h[j : j + n] * PLACE[j]
        inside = text[:n] == text[k - 1 :]
        full, owner = mix(value[inside]), text[:n][inside]
    if whole and (short := np.flatnonzero((counts > 0) & (counts < k))).size:
        begin = (found.ends - counts)[short]
        value = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            used = counts[short] > j
            value[used] += h[begin[used] + j] * PLACE[j]
        # The number of words keeps whole short texts apart from other shingles.
        value = mix(value + counts[short].astype(np.uint64) * PLACE[8])
        full, owner = np.concatenate([full, value]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        full, owner = full[order], owner[order]
    return full, owner


def sets(texts: list[str | None], k: int = 5, table: np.ndarray = SPACED) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    for found in words(texts, table):
        full, owner = shingles(found, k)
        at = np.searchsorted(owner, np.arange(len(found.counts) + 1))
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield np.unique(full[a:b])
