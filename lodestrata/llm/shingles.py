"""Word and shingle hashes of whole texts, in numpy.

The words of a batch are hashed together. A word's hash is a polynomial over its bytes modulo 2^64, with
random values for the bytes, read off running sums, then scrambled. A-Z have the values of a-z, so nothing
is lowered. Equal words have equal hashes in every process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WINDOW = 1 << 20  # bytes that are hashed at once; a longer word makes its window longer
BASE = 0x9E3779B97F4A7C15 | 1
_values = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)
_values[65:91] = _values[97:123]
_blank = np.zeros(256, bool)
_blank[[0x20, *range(0x09, 0x0E)]] = True


class _Powers:
    """Powers of the base and of its inverse, as many as the longest window so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, WINDOW + 1)
            chain = lambda x: np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)])
            cls.up, cls.down = chain(BASE), chain(pow(BASE, -1, 1 << 64))
        return cls.up, cls.down


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _window_words(data: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of a window; ``heads``: places at which a text begins."""
    letter = ~_blank[data]
    new = np.empty(len(data), bool)
    new[:1] = letter[:1]
    new[1:] = letter[1:] & ~letter[:-1]
    new[heads] = letter[heads]
    first = np.flatnonzero(new)
    last = np.empty(len(data), bool)
    last[-1:] = letter[-1:]
    last[:-1] = letter[:-1] & ~letter[1:]
    inner = heads[heads > 0]
    last[inner - 1] |= letter[inner - 1]
    end = np.flatnonzero(last) + 1
    up, down = _Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_values[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64)), first


def batch_words(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a column of texts, in order, and how many each text has; null has none.

    Words lie between the blanks U+0020 and U+0009 to U+000D.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    heads = np.unique(at[:-1][at[1:] > at[:-1]])
    hashes, places, lo = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while lo < len(data):
        hi = min(lo + WINDOW, len(data))
        while hi < len(data):  # a window ends at a blank
            blank = np.flatnonzero(_blank[data[max(lo, hi - WINDOW // 16) : hi]])
            if len(blank):
                hi = max(lo, hi - WINDOW // 16) + int(blank[-1]) + 1
                break
            hi = min(hi + WINDOW // 16, len(data))
        k = np.searchsorted(heads, [lo, hi])
        found, first = _window_words(data[lo:hi], heads[k[0] : k[1]] - lo)
        hashes.append(found)
        places.append(first + lo)
        lo = hi
    places = np.concatenate(places)
    return np.concatenate(hashes), np.diff(np.searchsorted(places, at))


def ordered_hash(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of aligned sequences of hashes; order and number of parts count."""
    out = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + p)
    return out


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of the runs of ``width`` words; of fewer words, but some, the whole sequence."""
    words, sizes = batch_words(texts)
    many = len(words) - width + 1
    runs = ordered_hash([words[k : k + many] for k in range(width)]) if many > 0 else np.zeros(0, np.uint64)
    out, at = [], 0
    for n in sizes.tolist():
        if n >= width:
            out.append(np.unique(runs[at : at + n - width + 1]))
        elif n:
            out.append(ordered_hash([words[k : k + 1] for k in range(at, at + n)]))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
