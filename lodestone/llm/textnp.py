"""Words and hashes of whole Arrow text columns with numpy: no loop over rows or words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

PRIME = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME**i and PRIME**-i modulo 2**64 for i < n at least."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", PRIME), ("down", INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of the batch of about `most` text bytes; a row is never split, so one row may be larger."""
    offsets = utf8(batch.column(column))[1] if batch.num_rows else np.zeros(1, np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def table(word: str) -> np.ndarray:
    """Byte classes. 'alnum': 0-9, a-z, A-Z and bytes of non-ASCII characters; 'nonspace': all but blank and 09-0D."""
    t = np.zeros(256, bool)
    if word == "alnum":
        t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    else:
        t[:] = True
        t[[0x20, *range(0x09, 0x0E)]] = False
    return t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and their row. Words end at row ends."""
    inside = is_word[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Longer byte ranges are hashed one at a time by xxh3.
LONG = 64


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one little-endian number; the bytes behind the end count as 0."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, equal wherever its bytes are equal. Eight bytes at a time go through a bijection, so ranges of
    the same length of up to eight bytes never share a hash; no prefix sums, whose differences structured strings can cancel."""
    size = (ends - starts).astype(np.int64)
    load = eights(data)
    out = mix((size.astype(np.uint64) + np.uint64(1)) * PRIME)
    live = np.flatnonzero((size > 0) & (size <= LONG))
    for at in range(0, LONG, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        piece = load[starts[live] + at] & MASKS[np.minimum(size[live] - at, 8)]
        out[live] = mix((out[live] ^ piece) * PRIME + np.uint64(at))
    big = np.flatnonzero(size > LONG)
    if len(big):
        raw = memoryview(np.ascontiguousarray(data))
        for i, a, b in zip(big.tolist(), starts[big].tolist(), ends[big].tolist(), strict=True):
            out[i] = xxhash.xxh3_64_intdigest(raw[a:b])
    return out


def same_bytes(one: np.ndarray, a: np.ndarray, two: np.ndarray, b: np.ndarray, size: np.ndarray, most: int = LONG) -> np.ndarray:
    """Whether the ranges one[a:a+size] and two[b:b+size] hold the same bytes, told on the bytes; those of more than
    `most` bytes one at a time."""
    out = np.ones(len(a), bool)
    x, y = eights(one), eights(two)
    live = np.flatnonzero((size > 0) & (size <= most))
    for at in range(0, most, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        mask = MASKS[np.minimum(size[live] - at, 8)]
        out[live] &= (x[a[live] + at] ^ y[b[live] + at]) & mask == 0
        live = live[out[live]]
    for i in np.flatnonzero(size > most).tolist():
        out[i] = np.array_equal(one[a[i] : a[i] + size[i]], two[b[i] : b[i] + size[i]])
    return out


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n consecutive words, by first word (the last n - 1 words have none)."""
    m = max(0, len(hashes) - n + 1)
    out = np.full(m, np.uint64(n), np.uint64)
    for i in range(n):
        out = mix(out ^ hashes[i : i + m]) * PRIME
    return out
