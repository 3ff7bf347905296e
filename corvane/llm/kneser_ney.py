"""Perplexity by an interpolated modified Kneser-Ney trigram model (operator 4).

Chen and Goodman (1999); counts and continuation counts of all n-grams of the whole
corpus, none pruned. A first scan counts words: the frequent ones get short codes, and the hot ones a number of
slices. The second scan sums up trigrams in blocks that are sorted and coded. A trigram goes to the bucket of its middle
word, a hot one's to the slice of its first word: so a bucket holds whole contexts of two words and, but for hot ones, all
that precedes and follows a word, and one shuffle gives the counts, the contexts' totals and the
bigrams' continuation counts. Only the bigrams of hot words and sums over words are shuffled again. Every bucket is written as sorted hash arrays, one file for each
order, into the folder that all machines share. Scoring maps these files into memory:
the machines' page caches hold what is used, nothing is broadcast.

Keys are 32 bits within a bucket of about ``BUCKET`` n-grams: an n-gram that was never seen passes for a
seen one with a chance of BUCKET / 2**32, 0.03 %. The number of buckets grows with the corpus.
"""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import local_path, new_path, small_batches, written
from corvane.llm.words import combine, mix, word_hashes

BUCKET = 1 << 20
#: At most so many words have codes and slices.
_HEAD = 65_000
_BEGIN, _END = np.uint32(1), np.uint32(2)
_LOW = np.uint64(0xFFFFFFFF)
_FLUSH = 4_000_000
_ORDERS = (3, 2, 1)
#: Files of a bucket and the order that each belongs to; "h": bigrams of hot words.
_FILES = {"3": 3, "2": 2, "h": 2, "1": 1}


def _padded(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of texts, each with two begin marks and an end mark; and the text of each word that is predicted. Texts without words are left out."""
    n = np.diff(first)
    rows = np.flatnonzero(n)
    n = n[rows]
    start = np.cumsum(n + 3) - n - 3
    out = np.full(int(n.sum()) + 3 * len(n), _BEGIN, np.uint32)
    out[start + n + 2] = _END
    at = np.arange(len(h)) + 3 * np.repeat(np.arange(len(n)), n) + 2
    out[at] = np.maximum((h >> np.uint64(32)).astype(np.uint32), np.uint32(3))
    return out, np.repeat(rows, n + 1)


def _predicted(ids: np.ndarray) -> np.ndarray:
    """Places of the words that are predicted: all but the begin marks."""
    return np.flatnonzero(ids != _BEGIN)


def _context(*words: np.ndarray) -> np.ndarray:
    """Hash of a context of one or two words; the top bits are its bucket."""
    packed = words[0].astype(np.uint64)
    if len(words) == 2:
        packed = packed << np.uint64(32) | words[1].astype(np.uint64)
    return mix(packed + np.uint64(0x51ED2701 * len(words)))


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An index of each distinct key, in the order of keys, and its summed count."""
    o = np.argsort(key)
    k = key[o]
    head = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return o[head], np.add.reduceat(count[o].astype(np.int64), head)


@dataclass
class _Words:
    """Frequent words, in falling order of ``count`` (of their places as a middle word); the first ``hot`` are spread over ``slices`` buckets."""

    word: np.ndarray
    slices: np.ndarray
    hot: int
    bits: int

    def __post_init__(self):
        by = np.argsort(self.word)
        self._sorted, self._code = self.word[by], (by + 1).astype(np.uint16)
        self._hot = np.sort(self.word[: self.hot])
        self._slices = self.slices[: self.hot][np.argsort(self.word[: self.hot])].astype(np.uint64)

    def codes(self, words: np.ndarray) -> np.ndarray:
        """The place of each word from 1, 0 for others."""
        if not len(self._sorted):
            return np.zeros(len(words), np.uint16)
        at = np.minimum(np.searchsorted(self._sorted, words), len(self._sorted) - 1)
        return np.where(self._sorted[at] == words, self._code[at], np.uint16(0))

    def is_hot(self, words: np.ndarray) -> np.ndarray:
        if not self.hot:
            return np.zeros(len(words), bool)
        return self._hot[np.minimum(np.searchsorted(self._hot, words), self.hot - 1)] == words

    def home(self, words: np.ndarray, bits: int | None = None) -> np.ndarray:
        """Bucket of what a word is the context of."""
        return (mix(words.astype(np.uint64) + np.uint64(0x2545F491)) >> np.uint64(64 - (bits or self.bits))).astype(np.int64)

    def bucket(self, v: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Bucket of the contexts (u, v)."""
        out = self.home(v)
        if self.hot:
            at = np.minimum(np.searchsorted(self._hot, v), self.hot - 1)
            k = np.flatnonzero(self._hot[at] == v)
            out[k] = (out[k] + ((context[k] >> np.uint64(32)) % self._slices[at[k]]).astype(np.int64)) & (1 << self.bits) - 1
        return out

    def pack(self, count: np.ndarray, *words: np.ndarray) -> bytes:
        """Coded words, byte by byte, the others whole; counts in a byte where they fit."""
        parts = [np.array([len(count), len(words)], np.int64).tobytes()]
        for w in words:
            code = self.codes(w)
            parts += [(code >> 8).astype(np.uint8).tobytes(), code.astype(np.uint8).tobytes(), w[code == 0].astype(np.uint32).tobytes()]
        parts += [np.minimum(count, 255).astype(np.uint8).tobytes(), count[count >= 255].astype(np.int64).tobytes()]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))

    def unpack(self, blob: bytes) -> list[np.ndarray]:
        """Words and, last, counts."""
        raw = zstandard.ZstdDecompressor().decompress(blob)
        (n, k), at, out = np.frombuffer(raw, np.int64, 2).tolist(), 16, []
        for _ in range(k):
            code = np.frombuffer(raw, np.uint8, n, at).astype(np.int64) << 8 | np.frombuffer(raw, np.uint8, n, at + n)
            at += 2 * n
            rare = np.flatnonzero(code == 0)
            w = self.word[code - 1] if len(self.word) else np.zeros(n, np.uint32)
            w[rare] = np.frombuffer(raw, np.uint32, len(rare), at)
            at += 4 * len(rare)
            out.append(w)
        count = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
        big = np.flatnonzero(count == 255)
        count[big] = np.frombuffer(raw, np.int64, len(big), at + n)
        return [*out, count]

    def blocks(self, kind: int, bucket: np.ndarray, count: np.ndarray, *words: np.ndarray) -> pa.RecordBatch:
        """One row (kind, bucket, data) for each bucket; its n-grams sorted by their first words."""
        order = words[0].astype(np.uint64)
        if len(words) > 1:
            order = order << np.uint64(32) | words[1]
        o = np.lexsort((order, bucket))
        b = bucket[o]
        head = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
        count, words = count[o], [w[o] for w in words]
        blobs = [self.pack(count[s:e], *(w[s:e] for w in words)) for s, e in zip(head, np.r_[head[1:], len(b)])]
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(head), pa.int32()), pa.array(b[head].astype(np.int64)), pa.array(blobs, pa.binary())], names=["kind", "bucket", "data"])


_BLOCKS = "kind int, bucket long, data binary"


def _key(words: list[np.ndarray]) -> np.ndarray:
    if len(words) == 3:
        return combine(_context(words[0], words[1]), words[2].astype(np.uint64))
    return words[0].astype(np.uint64) if len(words) == 1 else words[0].astype(np.uint64) << np.uint64(32) | words[1]


def _by_bucket(batches: Iterator[pa.RecordBatch], words: _Words, at_once: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(bucket, words and counts) of each bucket of rows that come bucket by bucket, each n-gram once. Summed up whenever
    ``at_once`` more have come: what is held are the different ones."""
    now, held, n, last = None, [], 0, 0

    def merged():
        cols = [np.concatenate(x) for x in zip(*held)]
        one, c = _summed(_key(cols[:-1]), cols[-1])
        return [*(x[one] for x in cols[:-1]), c]

    for b in batches:
        for k, data in zip(b["bucket"].to_pylist(), b["data"].to_pylist()):
            if k != now:
                if held:
                    yield now, merged()
                now, held, n, last = k, [], 0, 0
            held.append(words.unpack(data))
            n += len(held[-1][-1])
            if n > 2 * last + at_once:
                held = [merged()]
                n = last = len(held[0][-1])
    if held:
        yield now, merged()


def _narrow(codes: np.ndarray, n: int) -> np.ndarray:
    return codes.astype(np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32)


def _distinct_rows(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a table of four small or large numbers, and the one of each row."""
    if not len(table):
        return table, np.zeros(0, np.int64)
    if table.max() < 1 << 16:
        packed = table[:, 0] << 48 | table[:, 1] << 32 | table[:, 2] << 16 | table[:, 3]
        _, first, code = np.unique(packed.view(np.uint64), return_index=True, return_inverse=True)
        return table[first], code
    rows, code = np.unique(table, axis=0, return_inverse=True)
    return rows, code.reshape(-1)


def _write(path: str, name: str, bucket: int, key: np.ndarray, count: np.ndarray, context: np.ndarray | None) -> None:
    """The sorted hash arrays of one bucket: n-gram keys and counts, context keys with (total, n1, n2, n3+). A repeated task writes the same file again."""
    o = np.argsort(key)
    counts, code = np.unique(count[o], return_inverse=True)
    if context is None:
        ckey, stats, ccode = np.zeros(0, np.uint32), np.zeros((0, 4), np.int64), np.zeros(0, np.int64)
    else:
        co = np.argsort(context)
        c, n = context[co], count[co]
        head = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, np.int64)
        table = np.stack([np.add.reduceat(x.astype(np.int64), head) for x in (n, n == 1, n == 2, n >= 3)], axis=1) if len(c) else np.zeros((0, 4), np.int64)
        stats, ccode = _distinct_rows(table)
        ck = (c[head] & _LOW).astype(np.uint32)
        by = np.argsort(ck, kind="stable")
        ckey, ccode = ck[by], ccode[by]
    code, ccode = _narrow(code, len(counts)), _narrow(ccode, len(stats))
    coc = np.array([(count == k).sum() for k in (1, 2, 3, 4)] + [count.sum(), (count >= 3).sum()], np.int64)
    head = np.array([len(key), len(ckey), len(counts), len(stats), code.itemsize, ccode.itemsize], np.int64)
    tmp = f"{path}/.{name}-{bucket}-{uuid.uuid4().hex}"
    with open(tmp, "wb") as f:
        for a in (head, coc, counts.astype(np.int64), stats.astype(np.int64), key[o].astype(np.uint32), ckey, ccode, code):
            f.write(np.ascontiguousarray(a).tobytes())
            f.write(bytes(-f.tell() % 8))
    os.replace(tmp, f"{path}/{name}-{bucket}")


@dataclass
class _Bucket:
    """A memory-mapped file that :func:`_write` made."""

    coc: np.ndarray
    counts: np.ndarray
    stats: np.ndarray
    key: np.ndarray
    ckey: np.ndarray
    ccode: np.ndarray
    code: np.ndarray

    @classmethod
    def open(cls, path: str) -> _Bucket | None:
        if not os.path.exists(path):
            return None
        raw = np.asarray(np.memmap(path, np.uint8, "r"))
        n, m, nc, ns, wide, cwide = raw[:48].view(np.int64).tolist()
        kind, out, at = {1: np.uint8, 2: np.uint16, 4: np.uint32}, [], 48
        for of, size in ((np.int64, 6), (np.int64, nc), (np.int64, 4 * ns), (np.uint32, n), (np.uint32, m), (kind[cwide], m), (kind[wide], n)):
            end = at + np.dtype(of).itemsize * size
            out.append(raw[at:end].view(of))
            at = end + -end % 8
        out[2] = out[2].reshape(-1, 4)
        return cls(*out)


def _found(sorted_keys: np.ndarray, codes: np.ndarray, wanted: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Rows of ``table`` of the wanted keys, zeros where there is none. Wanted keys are sorted first: neighbours are then near in memory."""
    out = np.zeros((len(wanted), *table.shape[1:]), table.dtype)
    if len(sorted_keys):
        o = np.argsort(wanted)
        w = wanted[o]
        at = np.minimum(np.searchsorted(sorted_keys, w), len(sorted_keys) - 1)
        hit = np.flatnonzero(sorted_keys[at] == w)
        out[o[hit]] = table[codes[at[hit]]]
    return out


@dataclass
class LanguageModel:
    """``path``: folder of the bucket files; ``words``: frequent and hot words; ``bits1``: of the words' own buckets; ``discounts``: D1, D2, D3+ by order; ``total``: distinct
    bigrams; ``vocabulary``: words and the end mark; ``uni``: how many words have a continuation count of 1, 2, more."""

    path: str
    words: _Words
    bits1: int
    discounts: dict[int, tuple[float, float, float]]
    total: int
    vocabulary: int
    uni: tuple[int, int, int]

    def probabilities(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability of each word ``ids[at]`` after the two before it."""
        u, v, w = ids[at - 2], ids[at - 1], ids[at]
        one, to = np.unique(w, return_inverse=True)
        p = self._unigram(one)[to]
        one, to = np.unique(v, return_inverse=True)
        home = (self.words.home(one) << 1 | self.words.is_hot(one))[to]
        p = self._interpolated(2, _context(v), home, ("2", "h"), w, p)
        ctx = _context(u, v)
        return self._interpolated(3, ctx, self.words.bucket(v, ctx) << 1, ("3",), w, p)

    def _discounted(self, order: int, c: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.discounts[order]])
        return np.maximum(c - d[np.minimum(c, 3)], 0.0)

    def _unigram(self, w: np.ndarray) -> np.ndarray:
        key = _context(w).astype(np.uint32)
        c = np.zeros(len(w), np.int64)
        for rows, f in self._files(self.words.home(w, self.bits1) << 1, ("1",)):
            if f is not None:
                c[rows] = _found(f.key, f.code, key[rows], f.counts)
        back = sum(d * n for d, n in zip(self.discounts[1], self.uni)) / max(self.total, 1)
        return self._discounted(1, c) / max(self.total, 1) + back / (self.vocabulary + 1)

    def _interpolated(self, order: int, ctx: np.ndarray, bucket: np.ndarray, names: tuple[str, ...], w: np.ndarray, lower: np.ndarray) -> np.ndarray:
        key = combine(ctx, w.astype(np.uint64)).astype(np.uint32)
        d = np.array([0.0, *self.discounts[order]])
        out = lower.copy()
        for rows, f in self._files(bucket, names):
            if f is None:
                continue
            # of the few different rows of a file's tables the sums are worked out once
            c = _found(f.key, f.code, key[rows], np.maximum(f.counts - d[np.minimum(f.counts, 3)], 0.0))
            back = np.column_stack([f.stats[:, 1:] @ d[1:], f.stats[:, 0]])
            s = _found(f.ckey, f.ccode, ctx[rows].astype(np.uint32), back)
            seen = s[:, 1] > 0
            p = (c + s[:, 0] * lower[rows]) / np.maximum(s[:, 1], 1)
            out[rows] = np.where(seen, p, lower[rows])
        return out

    def _files(self, bucket: np.ndarray, names: tuple[str, ...]) -> Iterator[tuple[np.ndarray, _Bucket | None]]:
        """Rows of each file; ``bucket``: its number doubled, and which of the names in the last bit."""
        o = np.argsort(bucket.astype(np.uint16) if self.words.bits < 15 else bucket, kind="stable")  # by radix where they are short
        b = bucket[o]
        head = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
        for s, e in zip(head.tolist(), np.r_[head[1:], len(b)].tolist()):
            yield o[s:e], _opened(f"{self.path}/{names[b[s] & 1]}-{b[s] >> 1}")


_open: dict[str, _Bucket | None] = {}


def _opened(path: str) -> _Bucket | None:
    if path not in _open:
        if len(_open) >= 2_000:  # each is an open file
            _open.clear()
        _open[path] = _Bucket.open(path)
    return _open[path]


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's estimates; 0.5, 1 and 1.5 where a count of counts that they need is zero."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * b / a, 0.0), float(k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _frequent(texts: DataFrame, bucket: int) -> tuple[_Words, int]:
    """Words of more than 1 in 2**16 places of some task's share, the most frequent _HEAD of them, and the number of all n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def merged():
            one, c = _summed(*(np.concatenate(x) for x in zip(*held)))
            return np.concatenate([k for k, _ in held])[one], c

        for b in batches:
            for _, _, h, first in word_hashes(b["text"], punctuation=False):
                ids, _ = _padded(h, first)
                at = _predicted(ids)
                held.append(np.unique(ids[at - 1], return_counts=True))
                total += len(at)
                if sum(len(k) for k, _ in held) > 4_000_000:
                    held = [merged()]
        if held:
            k, c = merged()
            often = c > max(2, total >> 16)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[k[often].astype(np.int64), -1]), pa.array(np.r_[c[often], total])], names=["word", "n"])

    counts = written(texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.filter("word = -1").agg(F.sum("n")).first()[0] or 0
    top = counts.filter("word >= 0").orderBy(F.desc("n"), "word").limit(_HEAD).toArrow()  # _HEAD rows at most
    word, n = top["word"].to_numpy().astype(np.uint32), top["n"].to_numpy()
    bits = max(2, math.ceil(math.log2(max(total, 1) / bucket))) if total else 2
    slices = np.minimum(-(-n // bucket), 1 << bits)
    return _Words(word, slices, int((slices > 1).sum()), bits), int(total)


def fit_language_model(docs: DataFrame, text_col: str = "text", bucket: int = BUCKET, merge_at: int = 1 << 28) -> LanguageModel:
    """The model of all texts of ``docs``, its files in the shared folder. Null texts and texts without words have no n-grams; repeated rows count each.

    ``bucket``: n-grams that a bucket is meant to have. ``merge_at``: where a word has more places than this, its blocks are first
    summed up in as many groups of map tasks, so that no task reads all of them. Both change nothing in the result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(text_col).alias("text")).filter("text is not null")
    words, total = _frequent(texts, bucket)
    bits1 = max(1, words.bits - 4)
    path = local_path(new_path(spark, "language-model"))
    os.makedirs(path)
    salts = -(-int(words.slices.max(initial=1)) * bucket // merge_at)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        salt = TaskContext.get().partitionId() % salts

        def flush():
            u, v, w = (np.concatenate(x) for x in zip(*held))
            ctx = _context(u, v)
            one, c = _summed(combine(ctx, w.astype(np.uint64)), np.ones(len(w), np.int64))
            u, v, w = u[one], v[one], w[one]
            at = words.bucket(v, ctx[one])
            hot = words.is_hot(v) if salts > 1 else np.zeros(len(v), bool)
            for kind, k in ((0, ~hot), (1 + salt, hot)):
                if k.any():
                    yield words.blocks(kind, at[k], c[k], v[k], u[k], w[k])

        for b in batches:
            for _, _, h, first in word_hashes(b["text"], punctuation=False):
                ids, _ = _padded(h, first)
                at = _predicted(ids)
                held.append((ids[at - 2], ids[at - 1], ids[at]))
                n += len(at)
                if n >= _FLUSH:
                    yield from flush()
                    held.clear()
                    n = 0
        if n:
            yield from flush()

    def by_bucket(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.repartition(*keys).sortWithinPartitions(*keys)

    def trigrams(batches):
        for k, (v, u, w, c) in _by_bucket(batches, words, _FLUSH):
            ctx = _context(u, v)
            _write(path, "3", k, (combine(ctx, w.astype(np.uint64)) & _LOW).astype(np.uint32), c, ctx)
            del ctx, u, c
            two, n = _summed(v.astype(np.uint64) << np.uint64(32) | w, np.ones(len(w), np.int64))
            v, w = v[two], w[two]
            hot = words.is_hot(v)
            if hot.any():
                yield words.blocks(2, words.home(v[hot]), n[hot], v[hot], w[hot])
            if not hot.all():
                yield bigrams("2", k, v[~hot], w[~hot], n[~hot])

    def bigrams(name, k, v, w, n):
        ctx = _context(v)
        _write(path, name, k, (combine(ctx, w.astype(np.uint64)) & _LOW).astype(np.uint32), n, ctx)
        last, n = _summed(w.astype(np.uint64), np.ones(len(w), np.int64))
        return words.blocks(1, words.home(w[last], bits1), n, w[last])

    def hot_bigrams(batches):
        for k, (v, w, n) in _by_bucket(batches, words, _FLUSH):
            yield bigrams("h", k, v, w, n)

    def unigrams(batches):
        for k, (w, n) in _by_bucket(batches, words, _FLUSH):
            _write(path, "1", k, (_context(w) & _LOW).astype(np.uint32), n, None)
            yield pa.RecordBatch.from_arrays([pa.array([len(n)], pa.int64())], names=["words"])

    counted = texts.mapInArrow(count, _BLOCKS)
    if salts > 1:

        def premerged(batches):
            for k, (v, u, w, c) in _by_bucket(batches, words, _FLUSH):
                yield words.blocks(0, np.full(len(v), k), c, v, u, w)

        counted = written(counted, "trigrams")
        counted = counted.filter("kind = 0").unionByName(by_bucket(counted.filter("kind > 0"), "kind", "bucket").mapInArrow(premerged, _BLOCKS))
    rest = written(by_bucket(counted, "bucket").mapInArrow(trigrams, _BLOCKS), "bigrams")
    hot = written(by_bucket(rest.filter("kind = 2"), "bucket").mapInArrow(hot_bigrams, _BLOCKS), "hot-bigrams")
    last = by_bucket(rest.filter("kind = 1").unionByName(hot), "bucket").mapInArrow(unigrams, "words long")
    vocabulary = last.agg(F.sum("words")).first()[0] or 0

    def stats(batches):
        for b in batches:
            for k in b["id"].to_pylist():
                for name, order in _FILES.items():
                    if (f := _Bucket.open(f"{path}/{name}-{k}")) is not None:
                        yield pa.RecordBatch.from_pydict({"o": pa.array([order], pa.int32()), "n": pa.array([f.coc.tolist()], pa.list_(pa.int64()))})

    sums = spark.range(1 << words.bits).mapInArrow(stats, "o int, n array<long>").groupBy("o").agg(*(F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(6))).collect()  # a row an order
    by = {r["o"]: list(r)[1:] for r in sums}
    uni = by.get(1, [0] * 6)
    return LanguageModel(path, words, bits1, {o: _discounts(*by.get(o, [0] * 6)[:4]) for o in _ORDERS}, uni[4], vocabulary, (uni[0], uni[1], uni[5]))


def perplexities(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ``n_words``, ``log10_prob``, ``perplexity``) of every row of ``docs``.

    ``n_words`` counts the end mark. Null texts and texts without words: 0 words and nulls. Null ids and repeated rows are kept. No rows: no
    rows. Other columns aren't looked at.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def scored(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        n, total = np.zeros(len(b), np.int64), np.zeros(len(b))
        for i, _, h, first in word_hashes(b["text"], punctuation=False, chunk=8 << 20):
            ids, row = _padded(h, first)
            if not len(ids):
                continue
            p = np.log10(model.probabilities(ids, _predicted(ids)))
            n += np.bincount(row + i, minlength=len(b))
            total += np.bincount(row + i, p, minlength=len(b))
        none = n == 0
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            ppl = 10 ** (-total / n)
        return pa.RecordBatch.from_arrays([b["id"], pa.array(n), pa.array(total, mask=none), pa.array(ppl, mask=none)], names=[id_col, "n_words", "log10_prob", "perplexity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # many words at a time: a bucket's file is then looked at for many of them
        for b in batches:
            if len(b):
                held.append(b)
                size += b.nbytes
            if size >= 4 << 20:
                yield scored(held)
                held, size = [], 0
        if held:
            yield scored(held)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_words long, log10_prob double, perplexity double")


def op4_perplexity(spark, sf_dir: str) -> DataFrame:
    """Perplexity of every document under the model of all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = perplexities(docs, fit_language_model(docs))
    return out.withColumns({"log10_prob": F.round("log10_prob", 4), "perplexity": F.round("perplexity", 4)})
