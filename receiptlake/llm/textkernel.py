"""Whole columns of text as numpy arrays: words found, lower-cased and hashed without a Python loop over words.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Those bytes are never
part of a longer UTF-8 sequence, so all work is done on bytes. A word's hash is
a polynomial over keyed bytes modulo 2**64 with a mixing step; equal words have
equal hashes, and different ones collide with a chance near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SEGMENT = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finishing step of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_KEYED = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_KEYED[65:91] = _KEYED[97:123]  # A-Z count as a-z
_POWERS: dict[int, np.ndarray] = {}


def _powers(of: int, n: int) -> np.ndarray:
    have = _POWERS.get(of)
    if have is None or len(have) < n:
        have = np.full(max(n, SEGMENT), of, U)
        have[0] = 1
        have = _POWERS[of] = np.multiply.accumulate(have)
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts. Offsets start at 0."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    if column.null_count:
        lengths = np.where(np.asarray(column.is_null()), 0, np.diff(offs))
        if lengths.sum() != offs[-1]:
            return buffers(column.fill_null(""))
    return data, offs


def pieces(column: pa.Array, most_bytes: int = 2 * SEGMENT) -> Iterator[tuple[int, int]]:
    """Row ranges whose text is about most_bytes together; one longer text is a range of its own."""
    _, offs = buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + most_bytes, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


#: Separators for letters only: every ASCII character but A-Z and a-z.
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[128:] = False
NOT_LETTERS[65:91] = NOT_LETTERS[97:123] = False


def words(data: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(hash, text number, first byte, byte after) of every word, in order; then for each
    length in prefixes the hash of the word's first bytes, 0 where the word is shorter."""
    n, at, found = len(data), 0, []
    first_bytes = np.unique(offs[:-1])
    while at < n:
        to = min(n, at + SEGMENT)
        if to < n and not (space[data[to - 1]] or space[data[to]]):
            gaps = np.flatnonzero(space[data[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:  # one word longer than a segment: go on to its end
                while to < n and not space[data[to]]:
                    more = np.flatnonzero(space[data[to : to + SEGMENT]])
                    to = to + int(more[0]) if len(more) else min(n, to + SEGMENT)
        part = data[at:to]
        gap = space[part]
        edge = np.zeros(len(part) + 1, bool)
        inside = first_bytes[np.searchsorted(first_bytes, at) : np.searchsorted(first_bytes, to)] - at
        edge[inside] = True
        edge[0] = edge[-1] = True
        before = np.empty(len(part), bool)
        before[0] = True
        before[1:] = gap[:-1]
        starts = np.flatnonzero(~gap & (before | edge[:-1]))
        after = np.empty(len(part), bool)
        after[-1] = True
        after[:-1] = gap[1:]
        ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(_KEYED[part] * _powers(_BASE, len(part)), out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(part))[starts])
        begun = []
        for k in prefixes:
            long = ends - starts >= k
            to_k = np.where(long, starts + k, starts)
            begun.append(np.where(long, mix((sums[to_k] - sums[starts]) * _powers(_INVERSE, len(part))[starts]), U(0)))
        found.append((h, starts + at, ends + at, *begun))
        at = to
    if not found:
        z = np.zeros(0, np.int64)
        return (z.astype(U), z, z, z, *[z.astype(U) for _ in prefixes])
    h, starts, ends, *begun = (np.concatenate(x) for x in zip(*found, strict=True))
    return (h, np.searchsorted(offs, starts, "right") - 1, starts, ends, *begun)


def narrow(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)).tobytes()


def wide(blobs: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Counts of all blobs of ``narrow``, of so many each; those without any may be absent."""
    full = sizes[sizes > 0].tolist()
    return np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(b, f"<u{len(b) // n}") for b, n in zip(filter(None, blobs), full, strict=True)]]).astype(np.int64)


def word_hash(word: str) -> int:
    """The hash that words() gives this word."""
    b = np.frombuffer(word.encode(), np.uint8)
    return int(words(b, np.array([0, len(b)]))[0][0])
