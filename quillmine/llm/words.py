"""Words of many texts at once, in numpy: places, 64-bit digests, windows. No Python object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Odd, so it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
#: Bytes that part words: \x20 and \x09 to \x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A word goes by a random 64-bit number per byte, so that neighbouring bytes have unlike digests.
BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: Bytes of text worked on at once, about; temporaries take some 60 times as much.
CHUNK = 2 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**(n-1), at least, modulo 2**64; kept."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.ones(size, dtype=np.uint64)
        have[1:] = base
        _powers[int(base)] = have = np.multiply.accumulate(have)
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_digest(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """A digest of values[start:end] for each pair, equal for equal content wherever it stands.

    For windows of some words: as a polynomial modulo 2**64 it has patterns that collide in spans of a thousand values and more.
    """
    inverse = np.uint64(pow(int(base), -1, 2**64))
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values))[: len(values)], out=total[1:])
    length = (ends - starts).astype(np.uint64)
    return mixed((total[ends] - total[starts]) * powers(inverse, len(values) + 1)[starts] + length * np.uint64(0xD6E8FEB86659FD93))


_keys: dict[int, np.ndarray] = {}


def keys(base: np.uint64, n: int) -> np.ndarray:
    """n fixed random numbers, at least, others for each base; kept."""
    have = _keys.get(int(base))
    if have is None or len(have) < n:
        _keys[int(base)] = have = mixed(mixed(np.arange(1, max(n + n // 2, 1 << 16) + 1, dtype=np.uint64) * base) + base)
    return have


def runs_digest(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """A digest of values[start:end] for each pair; the spans must ascend without overlap, and may be of any length.

    Multilinear: each value times the random number of its place in the span, summed. Unlike a polynomial, no pattern in the
    values makes unequal spans of equal length collide but by the chance of the numbers, 2**-60 or less.
    """
    length = ends - starts
    out = np.zeros(len(starts), dtype=np.uint64)
    some = np.flatnonzero(length > 0)
    if len(some):
        # Places count from each span's start on; what stands between spans belongs to none.
        bounds = np.stack((starts[some], ends[some]), axis=1).ravel()
        gapless = len(some) == 1 or (bounds[1:-1:2] == bounds[2::2]).all()
        lo, hi = int(bounds[0]), int(bounds[-1])
        place = np.arange(lo, hi) - np.repeat(starts[some], np.diff(np.append(starts[some], hi)))
        terms = values[lo:hi] * keys(base, int(place.max()) + 1)[place]
        if gapless:
            out[some] = np.add.reduceat(terms, starts[some] - lo)
        else:
            total = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum(terms, out=total[1:])
            out[some] = total[ends[some] - lo] - total[starts[some] - lo]
    return mixed(out + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(lens)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


def bytes_digest(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """A digest of the bytes data[start:end] for each pair: up to 16 bytes as two numbers, longer spans as runs_digest has them."""
    size = ends - starts
    held = np.concatenate((data, np.zeros(16, dtype=np.uint8)))
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=held, strides=(1,))
    upto = lambda at, n: eight[at] & (np.uint64(2**64 - 1) >> (np.uint64(64) - (n << 3).astype(np.uint64)))
    out = np.zeros(len(starts), dtype=np.uint64)
    some = np.flatnonzero(size > 0)
    out[some] = mixed(upto(starts[some], np.minimum(size[some], 8)) ^ base)
    more = np.flatnonzero((size > 8) & (size <= 16))
    out[more] = mixed(out[more] + upto(starts[more] + 8, size[more] - 8) * base)
    long = np.flatnonzero(size > 16)
    if len(long):
        stop = np.cumsum(size[long])
        out[long] = runs_digest(BYTE[data[ranges(starts[long], size[long])]], stop - size[long], stop, base)
    return mixed(out + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words of a run of texts: data holds their bytes, text i's are data[at[i]:at[i+1]], its words first[i]:first[i+1]."""

    data: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    doc: np.ndarray

    def digests(self, base: np.uint64 = BASE) -> np.ndarray:
        return bytes_digest(self.data, self.start, self.end, base)


def chunks(texts: pa.Array, size: int = CHUNK):
    """(offset, number) of runs of rows of about size bytes, one row at least."""
    at = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type) else np.int64)
    at = at[texts.offset : texts.offset + len(texts) + 1]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, min(j, len(texts)) - i
        i = min(j, len(texts))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and where each begins; a null text is empty."""
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    at = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_string(texts.type) or pa.types.is_binary(texts.type) else np.int64)
    at = at[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def words(texts: pa.Array) -> Words:
    data, at = raw(texts)
    space = SPACE[data]
    edge = np.ones(len(data) + 1, dtype=bool)  # a text's end parts words too
    edge[:-1] = space
    text_start = np.zeros(len(data) + 1, dtype=bool)
    text_start[at] = True
    inside = ~space
    before = np.concatenate(([True], space[:-1])) | text_start[:-1] if len(data) else np.zeros(0, bool)
    after = np.concatenate((space[1:], [True])) | text_start[1:] if len(data) else np.zeros(0, bool)
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(data, at, start, end, first, doc)


def sliding(values: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of each width consecutive values; len(values) - width + 1 of them."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    have, size = values, 1
    while size * 2 <= width:
        have = of(have[:-size], have[size:])
        size *= 2
    return of(have[:n], have[width - size : width - size + n])


def counts_in(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]
