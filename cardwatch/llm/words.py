"""Hashes of words and shingles of many texts at once, for use inside Arrow functions.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered, on its UTF-8 bytes. All hashes have 64 bits.
"""

from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; a longer text is taken in windows that end at white space.
WINDOW = 1 << 21

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(bits: int) -> np.ndarray:
    return np.cumprod(np.full(1 << bits, _BASE, dtype=np.uint64))


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of UTF-8 bytes."""
    hashes, starts, at = [], [], 0
    while at < len(text):
        end = min(len(text), at + WINDOW)
        while end < len(text):  # to the next white space, so that no word is cut
            gap = np.flatnonzero(_SPACE[text[end : end + WINDOW]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(text), end + WINDOW)
        part = text[at:end]
        inside = ~_SPACE[part]
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        first, size = edge[::2], edge[1::2] - edge[::2]
        if len(first):
            letters = _FOLD[part[inside]].astype(np.uint64) + np.uint64(1)
            offset = np.cumsum(size) - size
            place = np.arange(len(letters)) - np.repeat(offset, size)
            letters *= _powers(max(4, int(size.max()).bit_length()))[place]
            hashes.append(mix(np.add.reduceat(letters, offset) ^ size.astype(np.uint64)))
            starts.append(first + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def text_bytes(column: pa.Array) -> list[np.ndarray]:
    """The UTF-8 bytes of each text of a string column, without copies; null is empty."""
    if pa.types.is_large_string(column.type):
        offsets = np.frombuffer(column.buffers()[1], np.int64)
    else:
        offsets = np.frombuffer(column.buffers()[1], np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    return [data[a:b] if ok else data[:0] for a, b, ok in zip(offsets[:-1], offsets[1:], valid)]


def batch_words(column: pa.Array):
    """(rows, hashes, ends) for runs of rows of about ``WINDOW`` bytes: rows from first to last, the hashes of all
    their words, and for each row where its words end. A text never shares a hash call with a very long one."""
    texts, at = text_bytes(column), 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= WINDOW:
            size += len(texts[end])
            end += 1
        space = np.array([32], np.uint8)
        joined = np.concatenate([x for t in texts[at:end] for x in (t, space)])
        hashes, starts = word_hashes(joined)
        borders = np.cumsum([len(t) + 1 for t in texts[at:end]])
        yield range(at, end), hashes, np.searchsorted(starts, borders)
        at = end


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words in their order; of fewer words, of the whole sequence; of none, nothing."""
    if len(words) == 0:
        return words
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, np.uint64(n), dtype=np.uint64)
    for i in range(n):
        out = out * _BASE + words[i : len(words) - n + 1 + i]
        out ^= out >> np.uint64(29)
    return mix(out)


def shingle_sets(column: pa.Array, size: int):
    """(row, sorted distinct shingles) of every row of a string column."""
    for rows, words, ends in batch_words(column):
        runs = shingles(words, size) if len(words) >= size else words[:0]
        start = 0
        for row, end in zip(rows, ends):
            if end - start >= size:
                yield row, np.unique(runs[start : end - size + 1])
            else:
                yield row, shingles(words[start:end], size)
            start = end
