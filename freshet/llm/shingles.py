"""Vectorised word and shingle hashing over Arrow string batches.

Words are maximal runs of bytes outside ``\\x20`` and ``\\x09-\\x0D`` after A-Z
is lower-cased; a shingle is five consecutive words.  Everything runs on the
UTF-8 buffer of a batch with numpy, a bounded slice of it at a time, so a batch
of long documents costs no more memory than a batch of short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
_SLICE = 1 << 18
_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ONE = np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: a bijection whose output order is unrelated to its input's."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 77)[_LOWER]
_POWERS = np.cumprod(np.full(_SLICE + 1, _MULT, dtype=np.uint64)) * _INV
_INVERSES = np.cumprod(np.full(_SLICE + 1, _INV, dtype=np.uint64)) * _MULT


def _slice_words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of the words of one slice that begins and ends between words; words also end at ``edges``, where a text begins."""
    word = ~_SPACE[data]
    edges = edges[edges < len(data)]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]  # of edge 0 the last byte, which ends a word if it is in one
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    n = len(data)
    if n < len(_POWERS):
        powers, inverses = _POWERS[:n], _INVERSES
    else:
        powers = np.cumprod(np.full(n, _MULT, dtype=np.uint64)) * _INV
        inverses = np.cumprod(np.full(n + 1, _INV, dtype=np.uint64)) * _MULT
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers, out=sums[1:])
    values = (sums[ends] - sums[starts]) * inverses[starts]
    return starts, mix(values + (ends - starts).astype(np.uint64))


def portions(texts: pa.Array, size: int = 2 << 20) -> Iterator[pa.Array]:
    """The texts in turn, about ``size`` bytes at a time (a longer text alone), nulls as empty texts."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield texts.slice(a, min(b, len(texts)) - a)
        a = min(b, len(texts))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and each text's bounds in them (nulls: no words)."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, dtype=np.uint8)
    hashes, bounds = [], np.zeros(len(texts) + 1, dtype=np.int64)
    n = i = 0
    with np.errstate(over="ignore"):
        while i < len(texts):
            a = int(offsets[i])
            k = max(i + 1, int(np.searchsorted(offsets, a + _SLICE, side="right")) - 1)  # texts that fit a slice, or one longer text
            end = int(offsets[k])
            if end - a <= _SLICE:
                starts, h = _slice_words(data[a:end], offsets[i:k] - a)
                hashes.append(h)
                bounds[i + 1 : k + 1] = n + np.searchsorted(starts, offsets[i + 1 : k + 1] - a)
                n += len(h)
            else:
                while a < end:
                    b = min(end, a + _SLICE)
                    while b < end and not _SPACE[data[b]]:  # a slice ends between words
                        b += 1
                    _, h = _slice_words(data[a:b], np.zeros(0, dtype=np.int64))
                    hashes.append(h)
                    n += len(h)
                    a = b
                bounds[k] = n
            i = k
    return (np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)), bounds


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted.

    Fewer than five words make one shingle of the whole sequence; no words make
    an empty set.
    """
    for tokens, bounds in set_portions(texts):
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield tokens[a:b]


def set_portions(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of shingle_sets, those of a portion of the texts in one array, and each text's bounds in it."""
    for part in portions(texts):
        yield _portion_sets(part)


def sort_parts(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sorts what stands between neighbouring bounds, each part on its own and in place."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        values[a:b].sort()
    return values


def _portion_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, bounds = word_hashes(texts)
    n_words = np.diff(bounds)
    with np.errstate(over="ignore"):
        n = max(len(words) - WIDTH + 1, 0)
        rolled = np.zeros(n, dtype=np.uint64)
        for k in range(WIDTH):
            rolled = rolled * _MULT + words[k : k + n]
        rolled = mix(rolled, 5)
        short = np.flatnonzero((n_words > 0) & (n_words < WIDTH))
        whole = []
        for i in short:
            h = np.uint64(n_words[i])
            for w in words[bounds[i] : bounds[i + 1]]:
                h = h * _MULT + w
            whole.append(h)
        if len(short):  # room for their one shingle, which shares no word with a neighbour's
            rolled = np.concatenate([rolled, np.zeros(len(words) - n, dtype=np.uint64)])
            rolled[bounds[short]] = mix(np.array(whole, dtype=np.uint64), 6)
    sizes = np.where(n_words >= WIDTH, n_words - WIDTH + 1, np.minimum(n_words, 1))
    inside = np.repeat(np.arange(len(sizes)), sizes)
    at = np.append(0, np.cumsum(sizes))
    tokens = sort_parts(rolled[np.arange(at[-1]) - at[inside] + bounds[inside]], at)
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (inside[1:] != inside[:-1])
    return tokens[new], np.append(0, np.cumsum(np.bincount(inside[new], minlength=len(sizes))))
