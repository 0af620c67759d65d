"""Word and shingle hashes of whole Arrow batches, computed in numpy without a Python step for each word.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased text; everything
else separates words. A shingle is ``width`` words in a row; a text with fewer words (but at least one) has one
shingle, of all its words. Hashes have 64 bits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (bijective)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    key = "i" if inverse else "p"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        grown = np.full(size, _INVERSE if inverse else _BASE, np.uint64)
        grown[0] = 1
        _powers[key] = have = np.cumprod(grown, dtype=np.uint64)
    return have[:n]


def slices(texts: pa.Array, most: int = 1 << 20):
    """(first row, rows) such that a slice has up to ``most`` bytes, or one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i - begin
            begin, total = i, 0
        total += int(n)
    if len(sizes) > begin:
        yield begin, len(sizes) - begin


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows (null: empty) and the rows' offsets in them."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def word_hashes(texts: pa.Array, break_at: int | None = None):
    """(hashes of all words, row of each word, start byte, end byte, lower-cased bytes, offsets).

    ``break_at``: a byte value that ends an item inside a row; then a fourth array numbers the items of each row.
    """
    raw, offsets = buffers(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _IS_WORD[raw]
    first = np.zeros(len(raw) + 2, bool)
    first[offsets + 1] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | first[1:]))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first[1:]))
    prefix = np.zeros(len(raw) + 1, np.uint64)
    sums = prefix[1:]  # filled in place: a pass over eight times the text costs most here
    np.add(raw, np.uint64(1), out=sums)
    sums *= powers(len(raw))
    np.add.accumulate(sums, out=sums)
    hashes = mix((prefix[ends] - prefix[starts]) * powers(len(raw) + 1, inverse=True)[starts])
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return hashes, rows, starts, ends, raw, offsets


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]:
    """(first word of each row and the end, start byte, end byte, bytes, offsets) of the words in the texts as they are."""
    raw, offsets = buffers(texts)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _IS_WORD[raw]
    first = np.zeros(len(raw) + 2, bool)
    first[offsets + 1] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | first[1:]))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first[1:]))
    return np.searchsorted(starts, offsets), starts, ends, raw.tobytes(), offsets


def weights(width: int) -> np.ndarray:
    return mix(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def shingles(words: np.ndarray, items: np.ndarray, n_items: int, width: int):
    """Shingle hashes and the item of each, in order; ``items`` (ascending) has the item of each word."""
    w = weights(width)
    counts = np.bincount(items, minlength=n_items)
    first = np.concatenate([[0], np.cumsum(counts)])
    if len(words) >= width:
        total = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            total += words[k : len(words) - width + 1 + k] * w[k]
        whole = items[: len(total)] == items[width - 1 :]
        long_hashes, long_items = mix(total[whole]), items[: len(total)][whole]
    else:
        long_hashes, long_items = np.empty(0, np.uint64), np.empty(0, items.dtype)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if not len(short):
        return long_hashes, long_items
    extra = np.array([int((words[first[i] : first[i] + counts[i]] * w[: counts[i]]).sum(dtype=np.uint64)) + int(counts[i]) for i in short.tolist()], dtype=object)
    extra = mix(np.array([x & 0xFFFFFFFFFFFFFFFF for x in extra], np.uint64))
    all_items, all_hashes = np.concatenate([long_items, short]), np.concatenate([long_hashes, extra])
    order = np.argsort(all_items, kind="stable")
    return all_hashes[order], all_items[order]


def sequence_keys(words: np.ndarray, items: np.ndarray, n_items: int) -> np.ndarray:
    """A 64-bit key of each item's word sequence; 0 where it has no word."""
    counts = np.bincount(items, minlength=n_items)
    first = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(len(words)) - first[items]
    total = np.zeros(len(words) + 1, np.uint64)
    longest = int(counts.max()) if n_items and len(counts) else 0
    np.cumsum(words * powers(longest + 1)[place] if len(words) else words, out=total[1:])
    keys = mix(total[first[1:]] - total[first[:-1]] + counts.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return np.where(counts > 0, keys, np.uint64(0))


def hash_family(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    base = mix(np.arange(2 * n, dtype=np.uint64) + np.uint64(seed * 1_000_003))
    return base[:n] | np.uint64(1), base[n:]


def minhashes(hashes: np.ndarray, items: np.ndarray, n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(items that have a shingle, their ``n`` MinHash values as rows)."""
    if not len(hashes):
        return np.empty(0, np.int64), np.empty((0, n), np.uint64)
    begin = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]]))
    a, b = hash_family(n, seed)
    out = np.empty((len(begin), n), np.uint64)
    for k in range(n):
        out[:, k] = np.minimum.reduceat(hashes * a[k] + b[k], begin)
    return items[begin], out


def plain_words(text: str | None) -> list[bytes]:
    """The words of one text, for tests and small jobs."""
    return WORD.findall((text or "").lower().encode())
