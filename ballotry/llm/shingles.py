"""Vectorised word n-gram hashing of Arrow text columns.

A batch of texts is handled as one byte buffer: words, word hashes and n-gram hashes come from
numpy operations over the whole batch, never from a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed odd constants (public 64-bit mixers).
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_POLY = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    have, step = 1, np.uint64(base)
    with np.errstate(over="ignore"):
        while have < n:
            take = min(have, n - have)
            out[have : have + take] = out[:take] * step
            have, step = have + take, step * step
    return out


_CACHE: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each; kept between batches."""
    if "p" not in _CACHE or len(_CACHE["p"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _CACHE["p"] = _powers(_POLY, size)
        _CACHE["i"] = _powers(pow(_POLY, -1, 1 << 64), size)
    return _CACHE["p"], _CACHE["i"]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its n+1 offsets; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have ``most`` bytes or so, one row at least, so that the arrays
    made of them stay small."""
    size = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, size[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


#: Bytes that separate words: 0x20 and 0x09 to 0x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z lower-cased) in order, and the words' n+1 offsets by document."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    starts[first] = inside[first]  # a document's first byte begins a word of its own
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | starts[1:]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _power_table(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        raw = (total[end] - total[begin]) * inverse[begin]
        hashes = mix(raw + _GOLD * (end - begin).astype(np.uint64))
    return hashes, np.searchsorted(begin, offsets)


def ngram_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of every document, end to end, and their n+1 offsets.

    A document with fewer than ``width`` words has its whole sequence as its one n-gram; one
    without words has none.
    """
    words, at = word_hashes(data, offsets)
    n_docs, n_words = len(offsets) - 1, np.diff(at)
    doc = np.repeat(np.arange(n_docs, dtype=np.int64), n_words)
    left = np.repeat(at[1:], n_words) - np.arange(len(words))  # words from here to the end
    begins = (left >= width) | (n_words[doc] < width) & (np.arange(len(words)) == at[:-1][doc])
    with np.errstate(over="ignore"):
        gram = np.zeros(len(words), dtype=np.uint64)
        for k in range(width):
            part = np.zeros(len(words), dtype=np.uint64)
            part[: len(words) - k] = words[k:]
            part[left <= k] = 0  # past the document's end
            gram = mix(gram * np.uint64(_POLY) + part + _GOLD)
    gram, doc = gram[begins], doc[begins]
    bounds = np.searchsorted(doc, np.arange(n_docs + 1))
    out, sizes = [], np.zeros(n_docs, dtype=np.int64)
    for i in range(n_docs):
        own = np.sort(gram[bounds[i] : bounds[i + 1]])
        if len(own) > 1:
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        out.append(own)
        sizes[i] = len(own)
    flat = np.concatenate(out) if out else np.zeros(0, np.uint64)
    return flat, np.concatenate(([0], np.cumsum(sizes)))
