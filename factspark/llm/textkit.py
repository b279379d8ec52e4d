"""Vectorised words and shingle hashes of whole Arrow batches of texts.

A word is a maximal run of bytes of one class in the UTF-8 text after A-Z are lower-cased; both classes in use are
closed over code points, so working on bytes changes nothing. Words are named by 64-bit hashes: every eight bytes go
through a mixing of their own, so words of up to eight bytes and one length never agree; xxh3 names long words. Among
10**9 different words some two agree with a chance below 0.1. Nothing is kept between batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_POWER = np.uint64(0x9E3779B97F4A7C15)
_STEP = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words of more bytes are hashed one by one.
LONG = 64
#: The low bytes of eight, by their number.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: [^\x20\x09-\x0D]
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased text
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def joined(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, each followed by a line end, the last by eight; and where each begins (with the end as a last entry)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    one = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(texts)], pa.int64()), texts), pa.scalar("\n", pa.large_string()))
    raw = np.frombuffer(one[0].as_buffer(), np.uint8) if len(texts) else np.zeros(0, np.uint8)
    return np.append(_LOWER[raw], np.full(8, 10, np.uint8)), np.concatenate(([0], ends))


def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each word; data goes on for eight bytes after the last one."""
    size = end - begin
    eights = np.ndarray(max(len(data) - 7, 0), "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64) * _POWER + _STEP[0])
        rest = np.arange(len(size))
        for j in range(0, LONG, 8):
            rest = rest[size[rest] > j] if j else rest
            if not len(rest):
                return out
            out[rest] = mix(out[rest] ^ (eights[begin[rest] + j] & _LOW[np.minimum(size[rest] - j, 8)]))
    for i in rest[size[rest] > LONG].tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[begin[i] : end[i]])
    return out


class Words:
    """Words of a batch. hashes: of each word in order; first[i]: index of the first word of text i (len(texts)+1 entries);
    begin, end: byte places in data."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, kind: np.ndarray = SPACED):
        self.data, self.offsets = joined(texts)
        inside = kind[self.data].view(np.int8)
        edge = np.flatnonzero(np.diff(inside, prepend=np.int8(0), append=np.int8(0)))
        self.begin, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.begin, self.offsets)
        self.hashes = _hashes(self.data, self.begin, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words, of all words where a text has fewer (but any), and where each text's hashes begin."""
    h, n = words.hashes, words.counts()
    have = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.concatenate(([0], np.cumsum(have)))
    total = int(first[-1])
    at = np.arange(total) - np.repeat(first[:-1] - words.first[:-1], have)
    last = np.repeat(words.first[1:], have)
    out = np.zeros(total, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            place = at + j
            there = place < last
            if there.all():
                out += mix(h[place] + _STEP[j]) * _STEP[j + 32]
            else:
                out[there] += mix(h[place[there]] + _STEP[j]) * _STEP[j + 32]
        return mix(out), first


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
