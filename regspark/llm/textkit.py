"""Vectorised text kernels: words, hashes and windows of many documents at a time.

A chunk holds whole documents back to back: `buf` has their UTF-8 bytes and
`offs` the n + 1 bounds. A chunk is half a megabyte, or one longer document; arrays
over it have eight bytes for each byte of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=U) * U(_P))
_pow = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_pow[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, _INV)):
            p = np.full(size, base, U)
            p[0] = 1
            _pow[k] = np.multiply.accumulate(p)
    return _pow[0][:n], _pow[1][:n]


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any slice follows."""
    out = np.zeros(len(symbols) + 1, U)
    np.cumsum(symbols * powers(len(symbols))[0], out=out[1:])
    return out


def slices(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of symbols[start:end] by powers modulo 2^64; equal slices have equal sums.

    Unequal slices can be built that have the same sum, so these serve only to
    spread features and names; what is called equal is told by `word_hashes`,
    `in_a_row` and `run_hashes`.
    """
    return mix((pre[end] - pre[start]) * powers(len(pre))[1][start])


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, buf, offs) for runs of rows of about `limit` bytes."""
    col = col.cast(pa.large_binary()).fill_null(b"")
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `inside`, cut at document bounds, and each document's bounds among them."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | first[1:])) + 1
    return start, end, np.searchsorted(start, offs)


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-document bounds of the words `[^\\x20\\x09-\\x0D]+`."""
    return runs(~SEPARATOR[buf], offs)


#: Masks that leave the first so many bytes of eight, and the length beyond which a slice is hashed by the library.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], U)
LONG = 1024


def lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros after the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each slice of bytes: eight bytes a step, and all bits are mixed in each step."""
    size = end - start
    h = mix(size.astype(U) + U((1 + seed) * _P % (1 << 64)))
    if not len(h):
        return h
    eight = lanes(buf)
    live = np.flatnonzero(size <= LONG) if int(size.max()) > LONG else None
    at, left = (start, size) if live is None else (start[live], size[live])
    while len(at):
        x = eight[at] & _FIRST[np.minimum(left, 8)]
        if live is None:
            h = mix(h ^ x)
        else:
            h[live] = mix(h[live] ^ x)
        more = np.flatnonzero(left > 8)
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    if len(long := np.flatnonzero(size > LONG)):
        raw = buf.tobytes()
        h[long] = [int.from_bytes(hashlib.blake2b(raw[a:z], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little") for a, z in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return h


def in_a_row(x: np.ndarray, k: int, size: int = 1, also: int = 0):
    """A hash of every k symbols in a row, from hashes x of every `size` in a row; and of every `also` (a step on the way).

    Spans are doubled; the last two overlap. High bits are folded into low ones
    after each sum, so no sum of symbols can cancel.
    """
    other = x if size == also else None
    while 2 * size <= k:
        y = x[:-size] * U(_P)
        y += x[size:]
        y ^= y >> U(32)
        x, size = y, 2 * size
        other = x if size == also else other
    if size < k:
        y = x[: len(x) - (k - size)] * U(_P)
        y ^= U(k)
        y += x[k - size :]
        x = y
    return mix(x), other


def run_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each short run of symbols, one symbol a step."""
    n = end - start
    out = mix(n.astype(U) * U(_P))
    for j in range(int(n.max(initial=0))):
        live = np.flatnonzero(n > j)
        out[live] = mix(out[live] * U(_P) + h[start[live] + j])
    return out


def owner(bounds: np.ndarray) -> np.ndarray:
    """The document of each item, from the bounds of the documents."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def window_starts(bounds: np.ndarray, k: int) -> np.ndarray:
    """Indexes at which k items in a row are of one document."""
    d = np.zeros(int(bounds[-1]) + 1, np.int32)
    np.add.at(d, np.maximum(bounds[1:] - (k - 1), bounds[:-1]), 1)  # the last k - 1 items of each document start no window
    np.add.at(d, bounds[1:], -1)
    return np.flatnonzero(np.cumsum(d[:-1]) == 0)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all w items in a row, by doubling."""
    size = 1
    while 2 * size <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the (start, end) spans."""
    d = np.zeros(n + 1, np.int64)
    if len(spans):
        np.add.at(d, spans[:, 0], 1)
        np.add.at(d, spans[:, 1], -1)
    return np.cumsum(d[:n]) > 0


def grouped_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]; 0 for none."""
    c = np.concatenate([[0], np.cumsum(values)])
    return c[bounds[1:]] - c[bounds[:-1]]
