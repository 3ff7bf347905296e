"""Vectorised word hashing on Arrow string buffers.

A word is a maximal run of characters that are neither white space nor (with
``punctuation=False``) punctuation, of ASCII, Latin-1, the general punctuation, or Chinese, Japanese and full-width
forms. Scripts that are written without blanks have a word for every character: Chinese characters, kana, Thai, Lao,
Khmer and Burmese. ASCII and Latin-1 capitals are folded. Each word gets a 64-bit hash that depends on its bytes and its length only, so
equal words agree on every executor and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes hashed at a time; a longer text is hashed alone.
CHUNK_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BREAK = _SPACE.copy()
_BREAK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

#: Code points from U+0800 to U+FFFF: white space, punctuation, and characters that are words of their own.
_WIDE_SPACE, _WIDE_BREAK, _ALONE = (np.zeros(1 << 16, dtype=bool) for _ in range(3))
for _lo, _hi in ((0x1680, 0x1680), (0x2000, 0x200B), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
    _WIDE_SPACE[_lo : _hi + 1] = True
_WIDE_BREAK |= _WIDE_SPACE
for _lo, _hi in ((0x2010, 0x2027), (0x2030, 0x205E), (0x3001, 0x3004), (0x3008, 0x3030), (0x303D, 0x303F), (0x30FB, 0x30FB), (0x0E4F, 0x0E4F), (0x0E5A, 0x0E5B), (0x104A, 0x104F), (0x17D4, 0x17DA), (0xFE10, 0xFE19), (0xFE30, 0xFE6B), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)):
    _WIDE_BREAK[_lo : _hi + 1] = True
for _lo, _hi in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FA), (0x30FC, 0x312F), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F)):
    _ALONE[_lo : _hi + 1] = True
_ALONE &= ~_WIDE_BREAK
#: Second bytes of U+00A0 to U+00BF that are punctuation.
_LATIN_BREAK = np.zeros(256, dtype=bool)
_LATIN_BREAK[[0xA0, 0xA1, 0xA7, 0xAB, 0xB6, 0xB7, 0xBB, 0xBF]] = True

_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, CHUNK_BYTES + 4096)
        inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)], dtype=np.uint64)
        _inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, inv)], dtype=np.uint64)
    return _powers, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the splitmix64 finaliser)."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order-dependent hash of two hashes."""
    with np.errstate(over="ignore"):
        return mix(np.asarray(a, np.uint64) * np.uint64(0xD6E8FEB86659FD93) + mix(b))


def _other_breaks(raw: np.ndarray, sep: np.ndarray, punctuation: bool) -> tuple[np.ndarray, np.ndarray]:
    """Mark breaks beyond ASCII in ``sep``; the first and the past-the-end byte of every character that is a word of its own."""
    n = len(raw)
    two = np.flatnonzero(raw[:-1] == 0xC2)
    if len(two):
        two = two[raw[two + 1] == 0xA0 if punctuation else _LATIN_BREAK[raw[two + 1]]]
        sep[two] = sep[two + 1] = True
    three = np.flatnonzero(raw[: max(n - 2, 0)] >= 0xE0)
    if not len(three):
        return three, three
    four, three = three[raw[three] >= 0xF0], three[raw[three] < 0xF0]
    code = (raw[three].astype(np.int64) & 15) << 12 | (raw[three + 1].astype(np.int64) & 63) << 6 | raw[three + 2] & 63
    gone = three[(_WIDE_SPACE if punctuation else _WIDE_BREAK)[code]]
    for k in range(3):
        sep[gone + k] = True
    alone = three[_ALONE[code]]
    four = four[(four + 3 < n) & (raw[four] == 0xF0) & (raw[four + 1] >= 0xA0)]  # U+20000 to U+3FFFF
    begin = np.r_[alone, four]
    return begin, np.r_[alone + 3, four + 4]


def hash_bytes(raw: np.ndarray, bounds: np.ndarray, punctuation: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts ``raw[bounds[i]:bounds[i + 1]]``: hashes, first word of each text (length texts + 1), first and past-the-end byte of each word."""
    n = len(raw)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(bounds), dtype=np.int64), z, z
    sep = (_SPACE if punctuation else _BREAK)[raw]
    alone, after = _other_breaks(raw, sep, punctuation)
    low = _LOWER[raw]
    high = np.flatnonzero(raw[:-1] == 0xC3)
    if len(high):
        nxt = low[high + 1]
        low[high + 1] = np.where((nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97), nxt + 32, nxt)
    word = ~sep
    begin = word.copy()
    begin[1:] &= sep[:-1]
    cut = bounds[1:-1]
    cut = cut[cut < n]
    begin[cut] = word[cut]
    if len(alone):
        begin[alone] = True
        after = after[after < n]
        begin[after] = word[after]
    end = np.empty(n, dtype=bool)
    end[:-1] = word[:-1] & (sep[1:] | begin[1:])
    end[-1] = word[-1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = _tables(n + 1)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        h = (total[e] - total[s]) * down[s]
        h = mix(h + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return h, np.searchsorted(s, bounds), s, e


def texts_of(col: pa.Array | pa.ChunkedArray, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past-the-end row, bytes, bounds) of runs of rows of about ``chunk`` bytes; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if not len(col):
        return
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("")
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + chunk, side="right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_hashes(col: pa.Array | pa.ChunkedArray, punctuation: bool = True, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past-the-end row, hashes, first word of each row) over all rows."""
    for i, j, raw, bounds in texts_of(col, chunk):
        h, first, _, _ = hash_bytes(raw, bounds, punctuation)
        yield i, j, h, first
